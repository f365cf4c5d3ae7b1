"""SimHash near-duplicate groups, linked exactly by a generalised pigeonhole search.

1. Fingerprint every document (64-bit majority of XXH64 over 4-word shingles) and keep one row per distinct fingerprint.
2. Count, over all fingerprints, how often each pair of bits is set together; group correlated bits into partitions.
3. For each number of partitions, estimate from the partitions' value counts how many candidates a threshold would
   bring, and allocate the thresholds by dynamic programming so that they sum to ``radius - partitions + 1``
   (-1 leaves a partition out). Two fingerprints within ``radius`` then agree in some partition within its threshold.
4. Every fingerprint is filed under its own partition values and probes all values within the threshold. A bucket
   returns verified links only, and for a large bucket only a spanning forest of them; buckets with more members
   than ``bucket_rows`` are cut into block pairs, so that no task holds one and no link is lost.
5. Connected components over the links.

Exact copies share a fingerprint and never multiply links. Nothing but 64 x 64 bit counts and a few partition totals
reaches the driver.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shoebox.llm.common import columns_of, free_name, map_batches, texts_as_bytes
from shoebox.operators.components import connected_components
from shoebox.session import materialize

SEED = 42
SHINGLE = 4
RADIUS = 4
BUCKET_ROWS = 8192


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def row_mark(docs: DataFrame) -> Column:
    """MD5 of all of a row's columns: rows of one id are told apart by it, and only wholly equal rows share it."""
    return F.md5(F.to_json(F.struct(*columns_of(docs))))


def fingerprints(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """(doc_id, mark, fp long) for every row; null or blank text has fingerprint zero. ``mark`` passes through."""

    def make():
        def step(batch):
            yield {"doc_id": batch.column(0), "mark": batch.column(1), "fp": pa.array([fingerprint(t) for t in texts_as_bytes(batch.column(2))], pa.int64())}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), (F.lit(None) if mark is None else mark).cast("string").alias("mark"), "text"), "doc_id long, mark string, fp long", make)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pair_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (a fixed 64 x 64 table)."""

    def count(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cell = np.append(np.arange(4096), 4096)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "n": pa.array(np.append(both.ravel(), n).astype(np.int64))})

    rows = distinct.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of nearly equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` and least cost; ``costs[i][t + 1]`` is the cost of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, picks) in best.items():
            for t in range(-1, len(cost) - 1):
                key, value = used + t, so_far + cost[t + 1]
                if key not in new or value < new[key][0]:
                    new[key] = (value, [*picks, t])
        best = new
    return best[total]


def _values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    u = fps.astype(np.int64).view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for j, b in enumerate(part):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out.astype(np.int64)


def _ball(width: int, t: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``t`` set; the first is zero."""
    masks, level = [0], [(0, -1)]
    for _ in range(t):
        level = [(m | 1 << b, b) for m, last in level for b in range(last + 1, width)]
        masks += [m for m, _ in level]
    return np.array(masks, np.int64)


def value_counts(distinct: DataFrame, plans: list[list[list[int]]]) -> DataFrame:
    """(part, value, n): how many distinct fingerprints hold each value, for every partition of every plan."""
    parts = [p for plan in plans for p in plan]

    def make():
        def step(batch):
            fps = batch.column(0).to_numpy()
            for k, part in enumerate(parts):
                yield {"part": pa.array(np.full(len(fps), k), pa.int32()), "value": pa.array(_values(fps, part))}

        return step

    return map_batches(distinct.select("fp"), "part int, value long", make).groupBy("part", "value").agg(F.count("*").alias("n"))


def choose_plan(n: int, plans: list[list[list[int]]], collisions: dict[int, float], radius: int, probe_cost: float = 1.0, check_cost: float = 0.05, max_ball: int = 6000):
    """The partitions and thresholds of least estimated cost: probes cost a shuffled row each, candidates a comparison."""
    best, at = None, 0
    for plan in plans:
        costs = []
        for part in plan:
            seen, width, row = collisions.get(at, 0.0), len(part), [0.0]
            for t in range(radius + 1):
                ball = sum(comb(width, i) for i in range(t + 1))
                row.append(probe_cost * n * ball + check_cost * seen * ball if ball <= max_ball else float("inf"))
            costs.append(row)
            at += 1
        cost, picks = allocate(costs, radius - len(plan) + 1)
        if best is None or cost < best[0]:
            best = (cost, plan, picks)
    return best[1], best[2]


def _forest(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Spanning forest of the links within one bucket: each point is compared with the points not yet reached."""
    left, a, b = fps.copy(), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        here = queue.pop()
        near = np.bitwise_count(left ^ here) <= radius
        if near.any():
            found = left[near]
            left = left[~near]
            a += [here] * len(found)
            b += found.tolist()
            queue += list(found)
    return a, b


def _bucket_links(radius: int, small: int = 48):
    """Task function over rows sorted by key: verified links of each bucket that holds an indexed fingerprint."""

    def links(key, fp, own):
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        indexed = np.add.reduceat(own.astype(np.int64), starts)
        keep = (sizes > 1) & (indexed > 0)
        a, b = [], []
        inside = np.repeat(keep & (sizes <= small), sizes)
        key, fp, large = np.asarray(key), np.asarray(fp), np.flatnonzero(keep & (sizes > small))
        k, f = key[inside], fp[inside]
        for lag in range(1, small):
            same = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(same):
                break
            x, y = f[same], f[same + lag]
            near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            a.append(x[near])
            b.append(y[near])
        for g in large:
            x, y = _forest(np.unique(fp[starts[g] : starts[g] + sizes[g]]), radius)
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2

    def out(a, b):
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_pydict({"u": pa.array(pairs[0]), "v": pa.array(pairs[1])})

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
            key, fp, own = (np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(key):
                continue
            cut = np.searchsorted(key, key[-1])  # the last bucket may go on in the next batch
            held = [key[cut:], fp[cut:], own[cut:]]
            if cut:
                yield out(*links(key[:cut], fp[:cut], own[:cut]))
        if len(held[0]):
            yield out(*links(*held))

    return run


def hot_keys(counts: DataFrame, balls: dict[int, np.ndarray], bucket_rows: int) -> DataFrame | None:
    """(key, blocks) of the buckets with more than ``bucket_rows`` members, rows that probe them included.

    ``balls`` has the probing masks of the partitions in which a bucket can be so large at all: those whose most common value,
    taken as often as it is probed, exceeds the bound. Their values' counts are sent to the buckets that they probe and summed."""
    out = None
    for part, ball in balls.items():
        masks = F.from_json(F.lit(str(ball.tolist())), "array<bigint>")
        probed = counts.filter(F.col("part") == part).select("value", "n", F.explode(masks).alias("mask")).select(F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "n")
        sizes = probed.groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") > bucket_rows)
        keys = sizes.select((F.col("value").bitwiseOR(F.lit(part << 48))).alias("key"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
        out = keys if out is None else out.unionByName(keys)
    return None if out is None else materialize(out, "simhash-hot")


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v) links that connect exactly the fingerprints of ``distinct`` (one column ``fp``, no repeats) which any chain
    of pairs within ``radius`` bits connects. Every returned link is verified; within large buckets only a spanning
    forest is returned."""
    n, both = bit_pair_counts(distinct)
    plans = [group_bits(n, both, m) for m in range(2, radius + 2)]
    counts = materialize(value_counts(distinct, plans), "simhash-values")
    totals = counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("c"), F.max("n").alias("most")).collect()
    seen = {r["part"]: float(r["c"] or 0) for r in totals}
    plan, picks = choose_plan(n, plans, seen, radius)
    first = sum(len(p) for p in plans[: plans.index(plan)])
    balls = [_ball(len(part), t) if t >= 0 else np.zeros(0, np.int64) for part, t in zip(plan, picks, strict=True)]

    def make():
        def step(batch):
            fps = batch.column(0).to_numpy()
            for k, (part, ball) in enumerate(zip(plan, balls, strict=True)):
                if len(ball):
                    values, size = _values(fps, part), max(1, 200_000 // max(len(fps), 1))
                    for at in range(0, len(ball), size):
                        some = ball[at : at + size]
                        key = (values[:, None] ^ some[None, :]) | (first + k) << 48
                        own = np.broadcast_to(some == 0, key.shape)
                        yield {"key": pa.array(key.ravel()), "fp": pa.array(np.repeat(fps, len(some))), "own": pa.array(own.ravel())}

        return step

    rows = map_batches(distinct.select("fp"), "key long, fp long, own boolean", make)
    most = {r["part"]: r["most"] for r in totals}
    hot = hot_keys(counts, {first + k: ball for k, ball in enumerate(balls) if most.get(first + k, 0) * len(ball) > bucket_rows}, bucket_rows)
    if hot is None or hot.isEmpty():
        dealt = rows
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
        cell = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(block, "other"), F.greatest(block, "other")))
        dealt = rows.join(hot, "key", "left").select("key", "fp", "own", "blocks", other).select(cell.alias("key"), "fp", "own")
    n_parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(n_parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_bucket_links(radius), "u long, v long").distinct()


def _groups_of_fingerprints(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, low, head): each distinct fingerprint of ``rows`` (doc_id, fp), its smallest doc_id, and its group."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    groups = connected_components(near_links(distinct.select("fp"), radius, bucket_rows))
    return distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("head"))


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reached over links of at most ``radius`` differing bits, the row's own included.
    Null or blank texts have fingerprint zero and link like any other. Rows with a null doc_id are kept; their
    component_id is the smallest id of their group, null if the group has none. Repeated rows stay repeated; an empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    rows = materialize(fingerprints(docs).drop("mark"), "simhash-docs")
    named = materialize(_groups_of_fingerprints(rows, radius, bucket_rows), "simhash-named")
    # written before it is joined, so that the rows of one large group need not meet in one task
    lows = materialize(named.groupBy("head").agg(F.min("low").alias("component_id")), "simhash-lows")
    ids = named.join(lows, "head").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``.

    It is the row with the smallest doc_id; rows without an id come last, and rows of one id are ordered by the MD5 of
    all their columns, so that the choice is the same in every run. Of wholly equal rows one stays. Unlike texts that
    share an id (or have none) are rows of their own: each stays if it heads its group. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, row_mark(docs)), "simhash-docs")
    named = _groups_of_fingerprints(rows.select("doc_id", "fp"), radius, bucket_rows).select("fp", "head")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))
    heads = rows.groupBy("fp").agg(F.min(order).alias("first")).join(named, "fp").groupBy("head").agg(F.min("first").alias("first"))
    own = free_name(docs, "mark")
    marks = heads.select(F.col("first.mark").alias(own))
    return docs.withColumn(own, row_mark(docs)).join(marks, own, "left_semi").dropDuplicates([own]).select(*columns_of(docs))
