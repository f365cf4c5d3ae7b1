"""Neighbour graph of all rows: exact, or approximate by descent over neighbours of neighbours (Dong, Moses and Li, 2011).

From random neighbours on, each round brings the neighbours of a row, and the rows whose neighbour it is, together: any two of
them may be neighbours of each other. Pairs are compared once at least one of the two is new to the row, and kept where they are
nearer than what a row has. A round is joins and grouped minima of a table of rows x pool edges; a row in very many lists takes
part with its nearest ones only. Rounds end when few edges change.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shoebox.operators.knn import all_nearest
from shoebox.operators.numbering import numbered
from shoebox.session import materialize

#: Neighbours a row keeps while searching; rounds at most; share of edges that change in the last round.
POOL, ROUNDS, LEAST_CHANGE = 25, 12, 0.002


@dataclass
class NeighbourGraph:
    """``edges``: (target, id, score, rank), score the squared distance; ``compared`` and ``possible``: numbers of unordered pairs."""

    edges: DataFrame
    compared: int
    possible: int
    rounds: int


def _compare(schema_width: int):
    """Task function over rows (w, m, new, bar, v) sorted by w: pairs of one w of which one is new, where nearer than a bar.

    Returns (u, v, d) rows for both ends, and one row (-1, -1, number of pairs) a task."""

    def pairs(m, new, bar, x, out):
        d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
        asked = np.triu(new[:, None] | new[None], 1)
        i, j = np.nonzero(asked & ((d < bar[:, None]) | (d < bar[None])))
        for a, b in ((i, j), (j, i)):
            near = d[a, b] < bar[a]
            out.append((m[a[near]], m[b[near]], d[a[near], b[near]]))
        return int(asked.sum())

    def run(batches):
        names, held, total = ["u", "v", "d"], None, 0

        def batch_of(out):
            u, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names)

        def groups(rows, last):
            """Compares all whole groups; hands back the last one, which may go on in the next batch."""
            w = rows[0]
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            stops = np.append(starts[1:], len(w))
            whole = len(starts) if last else len(starts) - 1
            out, n = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)], 0
            for a, b in zip(starts[:whole], stops[:whole]):
                n += pairs(*(c[a:b] for c in rows[1:]), out)
            return out, n, [c[starts[-1] :] for c in rows]

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, schema_width)
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), x]
            rows = now if held is None else [np.concatenate(c) for c in zip(held, now, strict=True)]
            out, n, held = groups(rows, last=False)
            total += n
            yield batch_of(out)
        if held is not None:
            out, n, _ = groups(held, last=True)
            total += n
            yield batch_of(out)
        yield batch_of([(np.array([-1]), np.array([-1]), np.array([float(total)]))])

    return run


def _best(edges: DataFrame, pool: int) -> DataFrame:
    """The nearest ``pool`` of each row's edges, each once; an edge that was there before is not new."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= pool)


def neighbour_graph(rows: DataFrame, k: int = 10, pool: int = POOL, rounds: int = ROUNDS, least_change: float = LEAST_CHANGE, seed: int = 42) -> NeighbourGraph:
    """The k nearest rows (squared distance), approximately, of every row (id, v). Ids are unique; null vectors are left out;
    with fewer than k others a row has those. How many true neighbours are found depends on the vectors: measure it."""
    spark = rows.sparkSession
    given = rows.filter("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    nodes = materialize(numbered(given, [], ["id"], "node"), "graph-nodes")
    n = nodes.count()
    result = "target long, id long, score double, rank int"
    if n < 2:
        return NeighbourGraph(spark.createDataFrame([], result), 0, 0, 0)
    width, pool = len(nodes.first()["v"]), max(pool, k)
    vectors = nodes.select("node", "v")

    def squared(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)

    drawn = vectors.select(F.col("node").alias("u"), F.col("v").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(pool))).alias("i"))
    drawn = drawn.withColumn("v", F.pmod(F.xxhash64("u", "i", F.lit(seed)), F.lit(n)) + 1).filter("u <> v")
    first = drawn.join(vectors.select(F.col("node").alias("v"), F.col("v").alias("b")), "v").select("u", "v", squared(F.col("a"), F.col("b")).alias("d"), F.lit(True).alias("new"))
    edges, compared, done = materialize(_best(first, pool), "graph-edges"), 0, 0
    compared += edges.count()
    for done in range(1, rounds + 1):
        # the bar: a row whose list is not full takes any
        bars = edges.groupBy("u").agg(F.when(F.count("*") >= pool, F.max("d")).otherwise(F.lit(float("inf"))).alias("bar"))
        back = edges.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).filter(F.col("r") <= pool)
        both = edges.select(F.col("u").alias("w"), F.col("v").alias("m"), "new").unionByName(back.select(F.col("v").alias("w"), F.col("u").alias("m"), "new"))
        member = vectors.join(bars.withColumnRenamed("u", "node"), "node", "left").select(F.col("node").alias("m"), F.coalesce("bar", F.lit(float("inf"))).alias("bar"), "v")
        together = both.groupBy("w", "m").agg(F.max("new").alias("new")).join(member, "m").select("w", "m", "new", "bar", "v")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        found = together.repartition(parts, "w").sortWithinPartitions("w").mapInArrow(_compare(width), "u long, v long, d double")
        found = materialize(found, "graph-found")
        compared += int(found.filter("u = -1").agg(F.sum("d")).first()[0] or 0)
        merged = edges.select("u", "v", "d", F.lit(False).alias("new")).unionByName(found.filter("u <> -1").withColumn("new", F.lit(True)))
        edges = materialize(_best(merged, pool), "graph-edges")
        if edges.filter("new").count() <= least_change * n * pool:
            break
    name = nodes.select("node", "id")
    top = edges.filter(F.col("rank") <= k).join(name.select(F.col("node").alias("u"), F.col("id").alias("target")), "u").join(name.withColumnRenamed("node", "v"), "v")
    ranked = F.row_number().over(Window.partitionBy("target").orderBy("d", "id"))
    return NeighbourGraph(top.select("target", "id", F.col("d").alias("score"), ranked.alias("rank")), compared, n * (n - 1) // 2, done)


def exact_graph(rows: DataFrame, k: int = 10) -> NeighbourGraph:
    """The k nearest rows (squared distance) of every row (id, v), all found. The work is that of all pairs, in matrix products; what
    moves is a few copies of the vectors, where a round of the descent moves twice the pool. Null vectors are left out."""
    given = rows.filter("v is not null").select("id", "v")
    n = given.count()
    return NeighbourGraph(all_nearest(given, k, "l2", own=False), n * (n - 1) // 2, n * (n - 1) // 2, 0)
