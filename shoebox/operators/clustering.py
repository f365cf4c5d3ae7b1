"""Clusterers over (id, v) rows; labels are (id, cluster_id), -1 is noise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from shoebox.operators import evaluation as E
from shoebox.operators import starts as S
from shoebox.operators.balls import BallBlocks, in_reach, nearest_of
from shoebox.operators.components import connected_components
from shoebox.operators.knn import similarity_edges
from shoebox.operators.mixture import components, fit_mixture
from shoebox.operators.numbering import numbered
from shoebox.operators.radius import RadiusBlocks, counts, least_marks, links
from shoebox.session import materialize

#: Edges of a leader's wave, which one task walks.
WAVE_ROWS = 2_000_000
#: Centres that there are at least for each cell of rows; sums of so many tasks are added by the driver, those of more tasks by tasks.
CELL_CENTRES, FEW_TASKS = 8, 16


def features(rows: DataFrame) -> DataFrame:
    return rows.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))


def _starts(blocks: BallBlocks, k: int, seeds: list[int], steps: int = 2) -> list[np.ndarray]:
    """The first centres that Spark ML's k-means|| has for these seeds, see ``starts``; all seeds in the same passes over the blocks."""
    seeds, width, jumps = [S.seed_of(s) for s in seeds], blocks.width, S._jumps(max(blocks.sizes))
    runs, parts = range(len(seeds)), len(blocks.sizes)
    wanted = {r: S.first_row(blocks.sizes, s) for r, s in enumerate(seeds)}

    def rows_of(found):
        for run, part, place, x in found:
            yield pa.RecordBatch.from_pydict({"run": pa.array([run] * len(x), pa.int32()), "part": pa.array([part] * len(x), pa.int32()), "place": pa.array(place, pa.int64()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    def taken(function) -> list[np.ndarray]:
        t = blocks.each(function, "run int, part int, place long, x binary").toArrow()
        run, x = t["run"].to_numpy(), np.frombuffer(b"".join(t["x"].to_pylist())).reshape(-1, width)
        order = np.lexsort((t["place"].to_numpy(), t["part"].to_numpy()))
        return [x[order[run[order] == r]] for r in runs]

    def first(rows):
        for part, place, _, _, x in rows:
            for r, (p, at) in wanted.items():
                if p == part and len(i := np.flatnonzero(place == at)):
                    yield from rows_of([(r, part, place[i], x[i])])

    def nearest(candidates):
        """(run, candidate, squared distance) of each row of a block."""
        squares = [(c * c).sum(1) for c in candidates]

        def run(middle, radius, x):
            norms = (x * x).sum(1)
            for r, c in enumerate(candidates):
                some = in_reach(middle, radius, c, squares[r])
                product = x @ c[some].T - squares[r][some] / 2
                own = product.argmax(1)
                yield r, some[own], np.maximum(norms - 2 * product[np.arange(len(x)), own], 0)

        return run

    candidates = taken(first)
    for step in range(steps):
        near, drawn = nearest(candidates), [S.states(s, step, parts) for s in seeds]

        def cost(rows, near=near):
            total = np.zeros(len(runs))
            for _, _, middle, radius, x in rows:
                for r, _, d in near(middle, radius, x):
                    total[r] += d.sum()
            yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.int32()), "cost": total})

        costs = {r["run"]: r["cost"] for r in blocks.each(cost, "run int, cost double").groupBy("run").agg(F.sum("cost").alias("cost")).collect()}

        def choose(rows, near=near, drawn=drawn, costs=costs):
            for part, place, middle, radius, x in rows:
                for r, _, d in near(middle, radius, x):
                    some = np.flatnonzero(S.doubles(drawn[r][part], place, jumps) < 2.0 * d * k / costs[r]) if costs[r] > 0 else []
                    if len(some):
                        yield from rows_of([(r, part, place[some], x[some])])

        candidates = [np.vstack([c, new]) for c, new in zip(candidates, taken(choose))]
    candidates = [c[np.sort(np.unique(c, axis=0, return_index=True)[1])] for c in candidates]
    near = nearest(candidates)

    def count(rows):
        total = [np.zeros(len(c), np.int64) for c in candidates]
        for _, _, middle, radius, x in rows:
            for r, own, _ in near(middle, radius, x):
                total[r] += np.bincount(own, minlength=len(total[r]))
        for r, n in enumerate(total):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"run": pa.array([r] * len(some), pa.int32()), "candidate": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    counts = blocks.each(count, "run int, candidate int, n long").groupBy("run", "candidate").agg(F.sum("n").alias("n")).toArrow()
    run, at, n = (counts[c].to_numpy() for c in ("run", "candidate", "n"))
    weights = [np.bincount(at[run == r], n[run == r], len(c)) for r, c in enumerate(candidates)]
    return [c if len(c) <= k else S.weighted_plus_plus(c, w, k) for c, w in zip(candidates, weights)]


def _lloyd(data: DataFrame | BallBlocks, starts: list[np.ndarray], max_iter: int, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) of each start, all moved in one pass over the rows an iteration, as matrix products. A start is done when
    no centre moves by more than ``tol``; an empty cluster keeps its centre. A block of rows is compared with the centres that its ball
    leaves possible: with all of them where rows are in no groups, with the same result."""
    schema = "run int, cluster binary, n binary, inertia binary, s binary"
    names, kinds = ("cluster", "n", "inertia", "s"), (np.int64, np.int64, np.float64, np.float64)
    width, centres = starts[0].shape[1], [c.copy() for c in starts]
    blocks = data if isinstance(data, BallBlocks) else BallBlocks(data, len(starts[0]) // CELL_CENTRES)

    def row_of(run, n, cost, s):
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int32())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(names, (some, n[some], cost[some], s[some]))})

    def added(table: pa.Table, k: dict[int, int]) -> dict[int, tuple]:
        total = {}
        for run, *cells in zip(*(table[c].to_pylist() for c in ("run", *names))):
            at, *found = (np.frombuffer(b, t) for b, t in zip(cells, kinds))
            sums = total.setdefault(run, (np.zeros(k[run], np.int64), np.zeros(k[run]), np.zeros((k[run], width))))
            for own, x in zip(sums, found):
                own[at] += x.reshape(len(at), *own.shape[1:])
        return total

    def sums(of: dict[int, np.ndarray], costs: bool = False) -> dict[int, tuple]:
        k = {run: len(c) for run, c in of.items()}

        def part(rows):
            total = {run: (np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(c.shape)) for run, c in of.items()}
            squares = {run: (c * c).sum(1) for run, c in of.items()}
            for _, _, middle, radius, x in rows:
                for run, c in of.items():
                    some = in_reach(middle, radius, c, squares[run])
                    product = x @ c[some].T
                    product -= squares[run][some] / 2
                    own = product.argmax(1)
                    n, cost, s = total[run]
                    order = np.argsort(own.astype(np.int16 if len(some) < 32_768 else np.int64), kind="stable")
                    first = np.flatnonzero(np.diff(own[order], prepend=-1))
                    at = some[own[order[first]]]
                    n[at] += np.diff(first, append=len(x))
                    s[at] += np.add.reduceat(x[order], first)
                    if costs:
                        cost += np.bincount(some[own], np.maximum((x * x).sum(1) - 2 * product[np.arange(len(x)), own], 0), len(c))
            yield from (row_of(run, *total[run]) for run in of)

        def add(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([row_of(run, *t) for run, t in added(table, k).items()])

        found = blocks.each(part, schema)
        return added((found if blocks.tasks <= FEW_TASKS else found.groupBy("run").applyInArrow(add, schema)).toArrow(), k)

    going = set(range(len(starts)))
    for _ in range(max_iter):
        for r, (n, _, s) in sums({r: centres[r] for r in sorted(going)}).items():
            new, some = centres[r].copy(), n > 0
            new[some] = s[some] / n[some][:, None]
            if (((new - centres[r]) ** 2).sum(1) <= tol * tol).all():
                going.discard(r)
            centres[r] = new
        if not going:
            break
    last = sums(dict(enumerate(centres)), costs=True)
    return [(c, float(last[r][1].sum())) for r, c in enumerate(centres)]


def kmeans(rows: DataFrame, k: int, seed: int = 42, max_iter: int = 300, restarts: int = 10, init: str = "k-means||") -> DataFrame:
    """The restart of least inertia. Each restart's first centres are those of Spark ML; all restarts are then moved together."""
    rows = rows.filter("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    blocks = BallBlocks(rows, k // CELL_CENTRES)
    if init == "k-means||" and k > 1 and blocks.n and blocks.plain:
        starts = _starts(blocks, k, [seed + i for i in range(restarts)])
    else:  # Spark ML chooses, or says what is wrong
        data = features(rows).persist()
        try:
            starts = [np.array(KMeans(k=k, seed=seed + i, maxIter=0, initMode=init).fit(data).clusterCenters()) for i in range(restarts)]
        finally:
            data.unpersist()
    best = min(_lloyd(blocks, starts, max_iter), key=lambda m: m[1])[0]
    width, kind = best.shape[1], rows.schema["id"].dataType.simpleString()

    def label(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest_of(x, best)[0], pa.int32())], ["id", "cluster_id"])

    return rows.mapInArrow(label, f"id {kind}, cluster_id int")


def gmm(rows: DataFrame, k: int, seed: int = 42, max_iter: int = 100, covariance: str = "full") -> DataFrame:
    """Most probable component of a mixture that starts from k-means; covariances are full, tied or diag."""
    start = materialize(kmeans(rows, k, seed, 20, 1), "mixture-start")
    return components(rows, fit_mixture(rows, start, k, covariance, max_iter))


def choose_k(inertias: dict[int, float], silhouettes: dict[int, float], gate: float = 0.3) -> int:
    """The best silhouette, if over the gate; else the elbow: the largest second difference of the inertias."""
    ks = sorted(silhouettes)
    best = max(ks, key=lambda k: (silhouettes[k], -k))
    if silhouettes[best] > gate or len(ks) < 3:
        return best
    i = [inertias[k] for k in ks]
    second = [i[j] - 2 * i[j + 1] + i[j + 2] for j in range(len(i) - 2)]
    return min(max(second.index(max(second)) + 2, ks[0]), ks[-1])


def auto_k(rows: DataFrame, max_k: int = 20, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, chosen) for every k that was tried."""
    n = rows.count()
    inertias, silhouettes = {}, {}
    data = features(rows).persist()
    for k in range(2, min(max_k, n // 2) + 1):
        model = KMeans(k=k, seed=seed, maxIter=50, predictionCol="cluster_id").fit(data)
        inertias[k] = model.summary.trainingCost
        silhouettes[k] = E.silhouette(rows, model.transform(data).select("id", "cluster_id"), 5000).first()["silhouette"]
    data.unpersist()
    chosen = choose_k(inertias, silhouettes) if silhouettes else 1
    out = [(k, float(inertias[k]), float(silhouettes[k]), k == chosen) for k in sorted(inertias)]
    return rows.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, chosen boolean")


def dbscan(rows: DataFrame, eps: float, min_samples: int, metric: str = "cosine") -> DataFrame:
    """Density clusters of unit vectors under cosine distance, or of any vectors under Euclidean distance (``l2``).

    The neighbours of a row are counted, linked and asked for their cluster where blocks of rows meet, three times; what leaves a
    pair of blocks is at most a row for each of its rows, never the pairs within the radius, of which a dense cluster has the
    square of its rows. A row counts in its own neighbourhood. A border row goes to the reachable cluster with the smallest id; clusters are
    numbered by their smallest row."""
    blocks = RadiusBlocks(rows, 1 - eps) if metric == "cosine" else RadiusBlocks(rows, eps * eps, "l2")
    if blocks.filed is None:
        return rows.select("id", F.lit(-1).alias("cluster_id"))
    near = blocks.meet(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core = materialize(near.filter(F.col("n") >= min_samples).select("id"), "core")
    marked = blocks.filed.join(core.withColumn("core", F.lit(1)), "id", "left").select("id", "v", "cell", F.coalesce("core", F.lit(0)).alias("core"), F.lit(0).cast("long").alias("mark"))
    edges = materialize(blocks.meet(links, "u long, v long", materialize(marked, "core-rows")), "edges")
    parts = materialize(connected_components(edges).select(F.col("node").alias("id"), "component"), "dense")
    told = blocks.filed.join(parts, "id", "left").select("id", "v", "cell", F.col("component").isNotNull().cast("int").alias("core"), F.coalesce("component", F.lit(0)).alias("mark"))
    border = blocks.meet(least_marks, "id long, component long", told).groupBy("id").agg(F.min("component").alias("component"))
    return numbered_clusters(rows, parts.unionByName(border))


def numbered_clusters(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Clusters (component) renumbered from 0 in order of component; rows without one are noise."""
    heads = numbered(parts.select("component").distinct(), [], ["component"], "cluster_id").withColumn("cluster_id", (F.col("cluster_id") - 1).cast("int"))
    return rows.select("id").join(parts.join(heads, "component").select("id", "cluster_id"), "id", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def _walk(min_cluster_size: int, simple: bool) -> Callable[[pa.Table], pa.Table]:
    """Group function over (seed, id): the leader rule for these seeds in order of id, (id, component); noise that nobody took has none as component."""

    def walk(table: pa.Table) -> pa.Table:
        seed, other = table["seed"].to_numpy(), table["id"].to_numpy()
        order = np.argsort(seed, kind="stable")
        seed, other = seed[order], other[order]
        starts = np.flatnonzero(np.diff(seed, prepend=seed[0] - 1))
        names, at = np.unique(np.concatenate([seed, other]), return_inverse=True)
        seed, other = at[: len(seed)], at[len(seed) :]
        head = np.full(len(names), -2)  # -2: nobody's, -1: noise
        for a, b in zip(starts, np.append(starts[1:], len(seed))):
            own, near = seed[a], other[a:b]
            if head[own] >= 0 or (head[own] == -1 and not simple):
                continue
            free = near[(head[near] == -2) | (simple & (head[near] == -1))]
            members = np.unique(np.append(free, own))
            head[members if len(members) >= min_cluster_size else own] = own if len(members) >= min_cluster_size else -1
        told = head != -2
        return pa.table({"id": pa.array(names[told], pa.int64()), "component": pa.array(names[head[told]], pa.int64(), mask=head[told] < 0)})

    return walk


def _leader_waves(edges: DataFrame, min_cluster_size: int, simple: bool, wave_rows: int) -> DataFrame:
    """(id, component) of the leader rule in waves: a task walks the next undecided seeds in order of id, as many as have about
    ``wave_rows`` edges. All seeds before them are decided, so a wave never has to wait, whatever the order of ids."""
    seeds = edges.select("seed").distinct()
    free = materialize(edges.select("seed", "id").unionByName(seeds.select("seed", F.col("seed").alias("id"))).distinct(), "leader-free")
    found = []
    while True:
        n = free.agg(F.count("*").alias("n"), F.count_distinct("seed").alias("seeds")).first()
        if not n["n"]:
            break
        least = max(1, wave_rows * n["seeds"] // n["n"])
        last = None if least >= n["seeds"] else free.select("seed").distinct().orderBy("seed").limit(least).agg(F.max("seed")).first()[0]
        wave = free if last is None else free.filter(F.col("seed") <= last)
        got = wave.groupBy(F.lit(0).alias("wave")).applyInArrow(_walk(min_cluster_size, simple), "id long, component long")
        found.append(materialize(got, "leader-taken"))
        if last is None:
            break
        taken = found[-1].filter("component is not null").select("id")
        gone = taken if simple else found[-1].select("id")
        rest = free.filter(F.col("seed") > last).join(gone, "id", "left_anti").join(taken.select(F.col("id").alias("seed")), "seed", "left_anti")
        free = materialize(rest.select("seed", "id"), "leader-free")
    if not found:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    paths = [f for t in found for f in t.inputFiles()]
    return edges.sparkSession.read.schema(found[0].schema).parquet(*paths).filter("component is not null")


def leader(rows: DataFrame, threshold: float, min_cluster_size: int = 2, depth: int = 100, simple: bool = False, most_rows: int = 20_000, unit: bool = False, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """Seeds in order of id take their unassigned neighbours; too few make the seed noise, which leaves (``simple``: which a
    later seed may still take). A seed touches its neighbours only, so the components of the edge table are independent:
    those of up to ``most_rows`` rows are walked in a task each, larger ones in waves of about ``wave_rows`` edges, alike."""
    edges = materialize(similarity_edges(rows, threshold, depth, unit=unit), "edges")
    parts = materialize(connected_components(edges, "seed", "id"), "leader-parts")
    large = materialize(parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("component"), "leader-large")
    in_waves = None
    if not large.isEmpty():
        nodes = parts.join(large, "component", "left_semi").select(F.col("node").alias("seed"))
        in_waves = _leader_waves(edges.join(nodes, "seed", "left_semi"), min_cluster_size, simple, wave_rows)
        parts = parts.join(large, "component", "left_anti")
    tagged = edges.join(parts.select(F.col("node").alias("seed"), "component"), "seed").select("component", "seed", "id")
    walked = tagged.groupBy("component").applyInArrow(_walk(min_cluster_size, simple), "id long, component long").filter("component is not null")
    return numbered_clusters(rows, walked if in_waves is None else walked.unionByName(in_waves))


def pca_2d(rows: DataFrame) -> DataFrame:
    """(id, x, y, explained_x, explained_y): centred projection on two components; each component's largest weight is positive."""
    data = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred")
    data = data.fit(features(rows)).transform(features(rows))
    model = PCA(k=2, inputCol="centred", outputCol="p").fit(data)
    weights, shares = model.pc.toArray(), model.explainedVariance.toArray()
    sign = [1.0 if weights[abs(weights[:, j]).argmax(), j] > 0 else -1.0 for j in (0, 1)]
    p = vector_to_array("p")
    return model.transform(data).select("id", (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"), F.lit(float(shares[0])).alias("explained_x"), F.lit(float(shares[1])).alias("explained_y"))


#: Clusterers by name: (rows, **parameters) to labels. Users add their own.
CLUSTERERS: dict[str, Callable[..., DataFrame]] = {"kmeans": kmeans, "gmm": gmm, "dbscan": dbscan, "leader": leader}


def register_clusterer(name: str, function: Callable[..., DataFrame]) -> None:
    CLUSTERERS[name] = function
