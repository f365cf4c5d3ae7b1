"""Similarity search. Vectors are rows (id, v); searches are exact unless they say otherwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shoebox.operators import vectors as V

#: Rows of either side in a block of an exact search (each row is copied to all blocks of the other side, so large ones move less),
#: and queries and rows whose scores are held at once. Where all rows are queries: least and most queries, and rows, of a block.
BLOCK_ROWS, HELD_QUERIES, HELD_ROWS = 16_384, 512, 8192
LEAST_QUERIES, MOST_QUERIES, MOST_ROWS = 512, 16_384, 65_536


def topk(rows: DataFrame, query: DataFrame, k: int = 30, metric: str = "ip", exclude: DataFrame | None = None) -> DataFrame:
    """The k best rows for the one query vector: inner product descending or squared distance ascending."""
    kept = rows if exclude is None else rows.join(exclude.select("id"), "id", "left_anti")
    both = kept.join(F.broadcast(query.select(F.col("v").alias("q"))))  # one row
    score = V.dot(F.col("v"), F.col("q")) if metric == "ip" else V.squared_distance(F.col("v"), F.col("q"))
    best = F.desc("score") if metric == "ip" else F.asc("score")
    return both.select("id", score.alias("score")).orderBy(best, "id").limit(k)


def _block(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), F.col("id").cast("long"), F.col("v").cast("array<double>"))


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, best first; of equal scores the first columns."""
    m = scores.shape[1]
    if m <= 4 * k:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    top.sort(axis=1)
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)
    least = np.take_along_axis(scores, top[:, -1:], 1)
    tied = np.flatnonzero((scores >= least).sum(1) > k)  # which of the equal ones are taken is not left to the partition
    top[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return top


def _products(metric: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Scores of which greater is better: inner products, or squared distances below zero."""
    s = q @ r.T
    return s if metric == "ip" else -np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * s, 0)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_within(q: np.ndarray, r: np.ndarray, k: int, metric: str = "ip", least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, score) of the k greatest scores that reach ``least`` of each row of q, best first; of equal ones the first
    rows of r. Scores are made in parts; once a row has k, only what reaches the last of them is looked at."""
    bar, held = np.full(len(q), least), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def best(i, j, s):
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == k - 1
        bar[i[last]] = s[last]
        return tuple(c[rank < k] for c in (i, j, s))

    for a in range(0, len(r), HELD_ROWS):
        s = _products(metric, q, r[a : a + HELD_ROWS])
        if not a and np.isneginf(least) and s.shape[1] > 4 * k:
            bar = np.partition(s, -k, axis=1)[:, -k].copy()
        i, j = np.nonzero(s >= bar[:, None])
        held = tuple(np.concatenate(c) for c in zip(held, (i, a + j, s[i, j]), strict=True))
        if len(held[0]) > 2 * k * len(q):
            held = best(*held)
    return best(*held)


def knn_join(queries: DataFrame, rows: DataFrame, k: int = 50, metric: str = "ip", exclude: DataFrame | None = None, blocks: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(target, id, score, rank): the k best rows for each query.

    Queries and rows are dealt to blocks of about ``block_rows``; each pair of blocks is a series of matrix products that return k
    rows a query, so memory is bounded by a block pair and what is shuffled behind it by blocks x k."""
    kept = rows if exclude is None else rows.join(exclude.select("id"), "id", "left_anti")
    nq = blocks or max(1, -(-queries.count() // block_rows))
    nr = blocks or max(1, -(-kept.count() // block_rows))
    return _ranked(_met(queries, kept, nq, nr, _best_of(k, metric, own=True)), k, metric)


def all_nearest(rows: DataFrame, k: int, metric: str = "ip", least: float | None = None, own: bool = True) -> DataFrame:
    """(target, id, score, rank): the k best rows for every row, exactly, of those whose score reaches ``least`` (``ip`` only); without
    ``own``, a row is none of its own. The work is that of all pairs. A row is copied once for each block of queries and of rows,
    and a query returns k rows for each block of rows, of which there are few and large ones."""
    n = rows.count()
    nq, nr = max(1, -(-n // MOST_QUERIES), min(16, n // LEAST_QUERIES)), max(1, -(-n // MOST_ROWS))
    return _ranked(_met(rows, rows, nq, nr, _best_of(k, metric, own, -np.inf if least is None else least)), k, metric)


def _met(queries: DataFrame, rows: DataFrame, nq: int, nr: int, function) -> DataFrame:
    """What a group function over (side, id, v) makes of every pair of blocks of queries and rows."""
    left = _block(queries, nq, "qb").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("side", F.lit(0))
    right = _block(rows, nr, "rb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("side", F.lit(1))
    both = left.select("qb", "rb", "side", "id", "v").unionByName(right.select("qb", "rb", "side", "id", "v"))
    return both.groupBy("qb", "rb").applyInArrow(function, "target long, id long, score double")


def _best_of(k: int, metric: str, own: bool, least: float = -np.inf):
    """Group function over (side, id, v): the k best of side 1 for each row of side 0; without ``own``, a row is none of its own."""

    def best(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        out = {"target": [], "id": [], "score": []}
        if 0 < side.sum() < len(side):
            x = _vectors(table["v"])
            q, r, qi, ri = x[side == 0], x[side == 1], ids[side == 0], ids[side == 1]
            order = np.argsort(ri)
            r, ri = r[order], ri[order]
            found = [best_within(q[a : a + HELD_QUERIES], r, k if own else k + 1, metric, least) for a in range(0, len(q), HELD_QUERIES)]
            target, got, score = np.concatenate([qi[a * HELD_QUERIES + f[0]] for a, f in enumerate(found)]), *(np.concatenate([f[c] for f in found]) for c in (1, 2))
            got = ri[got]
            keep = np.ones(len(target), bool) if own else target != got
            out = {"target": target[keep], "id": got[keep], "score": score[keep] if metric == "ip" else -score[keep]}
        return pa.table({"target": pa.array(out["target"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return best


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    order = F.desc("score") if metric == "ip" else F.asc("score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(order, "id"))).filter(F.col("rank") <= k)


def dealt_by_key(queries: DataFrame, rows: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of both sides (key and the same other columns, among them id) with side (0: query), dealt so that each query of a key meets each row of it once,
    in a group (key, qb, rb) of at most about ``block_rows`` rows of either side. However many rows a key has, no group holds
    more; a key of b blocks of rows and c of queries copies each query b times and each row c times."""
    size = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    blocks = size(rows, "nr").join(size(queries, "nq"), key)  # keys that one side lacks have no pairs
    home = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(blocks, key).withColumn("side", F.lit(0)).withColumn("qb", home("nq")).withColumn("rb", all_of("nr"))
    right = rows.join(blocks, key).withColumn("side", F.lit(1)).withColumn("rb", home("nr")).withColumn("qb", all_of("nq"))
    return left.drop("nq", "nr").unionByName(right.drop("nq", "nr"))


def pairs_within(rows: DataFrame, bound: float, metric: str = "ip", block_rows: int = 2048) -> DataFrame:
    """(seed, id, score) of all pairs of rows, both ways and each row with itself, whose inner product is at least ``bound``,
    or whose squared distance (``l2``) is at most that.

    Each pair of blocks is one matrix product that returns only what is within the bound: no ranking, nothing shuffled behind it."""
    n = max(1, -(-rows.count() // block_rows))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    dealt = _block(rows, n, "own").select("own", "id", "v", other).select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "v")

    def within(table: pa.Table) -> pa.Table:
        own, ids, x = table["own"].to_numpy(), table["id"].to_numpy(), np.stack(table["v"].to_numpy())
        first = own == table["a"][0].as_py()
        second = first if table["a"][0] == table["b"][0] else ~first
        s = x[first] @ x[second].T
        if metric == "l2":
            norms = (x * x).sum(1)
            s = np.maximum(norms[first][:, None] + norms[second][None, :] - 2 * s, 0)
        i, j = np.nonzero(s >= bound if metric == "ip" else s <= bound)
        seed, other_id, score = ids[first][i], ids[second][j], s[i, j]
        if second is not first:
            seed, other_id, score = np.append(seed, other_id), np.append(other_id, seed), np.append(score, score)
        return pa.table({"seed": pa.array(seed, pa.int64()), "id": pa.array(other_id, pa.int64()), "score": pa.array(score, pa.float64())})

    return dealt.groupBy("a", "b").applyInArrow(within, "seed long, id long, score double")


def topk_in_cluster(rows: DataFrame, labels: DataFrame, targets: DataFrame, k: int = 30, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(target, id, score, rank) among the members of the target's own cluster; noise has none.

    A cluster is cut into blocks, each of which returns its k best for a target; so a cluster may hold most of all rows."""
    own = rows.join(labels.filter("cluster_id <> -1").select("id", "cluster_id"), "id").select("cluster_id", "id", F.col("v").cast("array<double>").alias("v"))
    asked = own.join(targets.select("id"), "id", "left_semi").select("cluster_id", "id", "v")
    groups = dealt_by_key(asked, own, "cluster_id", block_rows).groupBy("cluster_id", "qb", "rb")
    return _ranked(groups.applyInArrow(_best_of(k, "ip", own=False), "target long, id long, score double"), k, "ip")


def similarity_edges(rows: DataFrame, threshold: float, depth: int = 100, metric: str = "ip", unit: bool = False) -> DataFrame:
    """(seed, id, score) of each row's neighbours within its depth list whose similarity reaches the threshold.

    For ``l2`` the similarity is exp(-d / (population deviation of the row's own list + 1e-6)). If all vectors are ``unit``
    vectors, only what reaches the threshold is ranked. The pairs beyond a row's depth list, whose number may grow with the square
    of the rows, leave no task."""
    if unit and metric == "ip":
        return all_nearest(rows.filter("v is not null"), depth, least=threshold).select(F.col("target").alias("seed"), "id", "score")
    near = knn_join(rows, rows, depth, metric).select(F.col("target").alias("seed"), "id", "score")
    if metric == "l2":
        spread = F.stddev_pop("score").over(Window.partitionBy("seed"))
        near = near.withColumn("score", F.exp(-F.col("score") / (spread + 1e-6)))
    return near.filter(F.col("score") >= threshold)


# several targets ----------------------------------------------------------------------------------------------------------


def weighted_union(found: DataFrame, decay: float = 0.9, k: int = 30) -> DataFrame:
    """Sum of score * decay^i over the targets' order i (column ``position``)."""
    return found.groupBy("id").agg(F.sum(F.col("score") * F.pow(F.lit(decay), F.col("position"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def intersection(found: DataFrame, n_targets: int, decay: float = 0.9, k: int = 30) -> DataFrame:
    """Ids found by min(2, targets) or more: mean weighted score times the share of targets; with too few, the union."""
    w = F.col("score") * F.pow(F.lit(decay), F.col("position"))
    both = found.groupBy("id").agg(F.avg(w).alias("m"), F.count_distinct("target").alias("n")).filter(F.col("n") >= min(2, n_targets))
    out = both.select("id", (F.col("m") * F.col("n") / n_targets).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return out if out.count() >= k // 2 else weighted_union(found, decay, k)


def rank_fusion(found: DataFrame, k: int = 30, constant: int = 60) -> DataFrame:
    """Sum of 1 / (rank from 0 + constant), over the largest sum."""
    sums = found.groupBy("id").agg(F.sum(1 / (F.col("rank") - 1 + constant)).alias("s")).orderBy(F.desc("s"), "id").limit(k)
    top = sums.agg(F.max("s").alias("top"))
    return sums.join(F.broadcast(top)).select("id", (F.col("s") / F.col("top")).alias("score"))


def rerank_pose(results: DataFrame, poses: DataFrame, target, weight: float = 0.3) -> DataFrame:
    """Results (id, score) sorted by 0.7 score + 0.3 pose similarity with the first target; without a pose, the score stays."""
    own = poses.select("id", "points")
    first = poses.filter(F.col("id") == target).select(F.col("points").alias("target_points"))
    j = results.join(own, "id", "left").join(F.broadcast(first), how="left")
    pose = F.when(F.col("points").isNotNull() & F.col("target_points").isNotNull(), V.pose_similarity(F.col("points"), F.col("target_points")))
    final = F.when(pose.isNotNull(), (1 - weight) * F.col("score") + weight * pose).otherwise(F.col("score"))
    return j.select("id", "score", pose.alias("pose_score"), final.alias("final_score")).orderBy(F.desc("final_score"), "id")


def pair_rank(pairs: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Rank and score of known pairs in results (target, id, score, rank), both ways; found if within k."""
    both = pairs.select(F.col("a").alias("target"), F.col("b").alias("id")).unionByName(pairs.select(F.col("b").alias("target"), F.col("a").alias("id")))
    return both.distinct().join(results, ["target", "id"], "left").select("target", "id", "rank", "score", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("found"))
