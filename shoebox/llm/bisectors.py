"""Centroid clustering by a tournament of bisectors, in integers throughout.

Of two centroids a and b (numbers a < b) the nearer one is told by the side of their bisector on which a vector x lies: with
the normal 2(a - b) and the threshold |a|² - |b|², both integers made once a round, a is nearer or as near where
normal·x - threshold is zero or more. k - 1 such sign tests leave one centroid a vector, ties go to the smaller number, and only
the distance to the winner is computed. Tasks return sums and counts of their own vectors for each centroid, which Spark adds
up; the driver sees k centroids only.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import map_batches
from shoebox.session import materialize

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64

#: Sums travel as two decimals, so that components of any float column have exact sums.
LIMB = 10**18


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): vectors with exactly that many components, none null or non-finite, as doubles."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter((F.size(vector_column) == dimensions) & finite).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


def scaled(flat: np.ndarray, dimensions: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers where the sign tests cannot overflow with them, else Python's."""
    x = np.asarray(flat, np.float64).reshape(-1, dimensions)
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    if not len(x) or np.abs(whole).max() <= largest(dimensions):
        return whole.astype(np.int64)
    return np.array([math.floor(Fraction(a) * scale) for a in x.ravel().tolist()], object).reshape(x.shape)


def largest(dimensions: int) -> int:
    """Components up to this keep every normal·x - threshold within 63 bits."""
    return math.isqrt(2**60 // max(1, dimensions))


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        top = max((abs(x) for c in centroids for x in c), default=0)
        self.narrow = top <= largest(len(centroids[0]))
        c = np.array(centroids, np.int64 if self.narrow else object)
        self.centroids = c
        self.normals = 2 * (c[:, None] - c[None])
        square = (c * c).sum(1)
        self.thresholds = square[:, None] - square[None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance to it) of each row."""
        best = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.centroids)):
            side = (self.normals[best, rival] * x).sum(1) - self.thresholds[best, rival]
            best = np.where(side < 0, rival, best)  # the champion so far always has the smaller number
        off = x - self.centroids[best]
        return best, (off * off).sum(1)


def _vectors(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False), dimensions, scale)


def _limbs(sums, n: int) -> list[Decimal]:
    parts = [Decimal(p) for s in sums for p in divmod(int(s), LIMB)]
    return [*parts, Decimal(n)]


def seeds(vectors: DataFrame, k: int, seed: str, dimensions: int, scale: int = SCALE) -> list[list[int]]:
    """The k vectors whose '<seed>:<id>' has the smallest SHA-256, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return [[int(c) for c in scaled(np.array(r.v), dimensions, scale)[0]] for r in rows]


def update(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Each centroid replaced by floor(sum / count) of the vectors nearest to it; one without vectors stays."""
    dimensions, k = len(centroids[0]), len(centroids)
    kind = pa.list_(pa.decimal128(38, 0))

    def run(batches):
        game = Tournament(centroids)
        sums, counts = [[0] * dimensions for _ in range(k)], [0] * k
        for batch in batches:
            x = _vectors(batch.column(0), dimensions, scale)
            if not len(x):
                continue
            best, _ = game.nearest(x)
            for c in np.unique(best).tolist():
                mine = x[best == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(0))]
        full = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_limbs(sums[c], counts[c]) for c in full], kind)], ["cluster", "part"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, part array<decimal(38,0)>")
    added = parts.select("cluster", F.posexplode("part").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    total = {(r.cluster, r["at"]): int(r.x) for r in added.collect()}  # k * (2 * dimensions + 1) numbers
    out = []
    for c, old in enumerate(centroids):
        n = total.get((c, 2 * dimensions), 0)
        out.append([(total[c, 2 * d] * LIMB + total[c, 2 * d + 1]) // n for d in range(dimensions)] if n else old)
    return out


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of each vector; a distance beyond 63 bits is null."""
    dimensions = len(centroids[0])

    def make():
        game = Tournament(centroids)

        def step(batch):
            best, distance = game.nearest(_vectors(batch.column(1), dimensions, scale))
            if distance.dtype == object:
                distance = [d if d < 2**63 else None for d in distance.tolist()]
            yield {"vec_id": batch.column(0), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance, pa.int64())}

        return step

    return map_batches(vectors.select("vec_id", "v"), "vec_id long, cluster int, distance long", make)


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1", dimensions: int = DIMENSIONS, scale: int = SCALE) -> list[list[int]]:
    """Integer centroids after that many rounds; fewer than k vectors give as many centroids, none gives none."""
    centroids = seeds(vectors, k, seed, dimensions, scale)
    for _ in range(rounds if centroids else 0):
        centroids = update(vectors, centroids, scale)
    return centroids


def cluster_vectors(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors of another length, with null or non-finite components, and null vectors are left out. Repeated rows stay and count
    as often as they occur; a null id stays null (its hash is that of an empty number). A distance that does not fit 63 bits is
    null, and so are the sums that hold it. Components beyond about 1e50 raise, as their sums would not be exact. An empty
    table gives no rows; other columns are ignored."""
    spark, vectors = rows.sparkSession, usable(rows, dimensions=dimensions)
    centroids = fit(vectors, k, rounds, seed, dimensions, scale)
    kind = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long").join(spark.createDataFrame([], kind), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assigned = materialize(assign(vectors, centroids, scale), "bisectors")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("wide")).collect()  # k rows
    fits = lambda x: x if x is not None and x < 2**63 else None
    of = {r.cluster: None if r.wide else int(r.s) for r in sums}
    whole = None if None in of.values() else fits(sum(of.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    told = spark.createDataFrame([(c, fits(s), whole, digest(c)) for c, s in of.items()], kind)
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """DuckDB SQL for ``cluster_vectors`` of the table ``embeddings`` with distances to all centroids."""
    steps = [
        f"kept as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"d as (select unnest(range(1, {dimensions + 1})) as i)",
        "x as materialized (select r, i, v[i] as x from kept, d)",
        f"first as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v from kept qualify c < {k})",
        "c0 as materialized (select c, i, v[i] as y from first, d)",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} as materialized (select r, min_by(c, (s, c)) as c, min(s) as s from (select r, c, sum((x - y) * (x - y)) as s from x join c{n} using (i) group by all) group by r)")
        if n < rounds:
            steps.append(f"m{n} as (select c, i, sum(x) as t, count(*) as n from x join a{n} using (r) group by all)")
            steps.append(f"c{n + 1} as materialized (select c, i, coalesce(cast((t - ((t % n) + n) % n) // n as bigint), y) as y from c{n} left join m{n} using (c, i))")
    steps.append(f"h as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) as h from c{rounds} group by c)")
    return (
        "with " + ", ".join(steps) + f" select vec_id, cast(c as int) as cluster, cast(s as bigint) as distance, cast(sum(s) over (partition by c) as bigint) as cluster_inertia, "
        f"cast(sum(s) over () as bigint) as inertia, h as centroid_sha256 from kept join a{rounds} using (r) join h using (c)"
    )
