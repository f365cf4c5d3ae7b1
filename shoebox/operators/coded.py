"""Approximate search over coded vectors, with exact scores for what it returns.

An index files every row under its nearest of about sqrt(rows) centres and holds, beside the vector, a code of one byte for
each few components: the number of the nearest word of that sub-space's codebook. A query reads the codes of its nearest
cells only, scores them from a table of its products with all words, and the best of them are scored again by their vectors.
Centres and codebooks are fitted on a bounded sample; the number of cells to probe is measured once, when the index is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shoebox.operators import vectors as V
from shoebox.operators.knn import _ranked, best_rows, dealt_by_key, knn_join
from shoebox.operators.numbering import smallest
from shoebox.session import materialize

#: Rows of the sample on which centres and codebooks are fitted; rows from which the number of probed cells is measured.
TRAIN_ROWS, MEASURED_ROWS = 16_384, 128
MOST_CELLS, WORDS, STEPS = 4096, 256, 10
#: Components that share one byte of the code; rows of either side in a block of a cell.
PART, BLOCK_ROWS = 4, 4096


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    """k means of a sample; a mean without rows stays where it is."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


@dataclass
class CodedIndex:
    """``rows``: (cell, id, code, v), written once; a search reads the codes and, for what it scores again, the vectors."""

    rows: DataFrame
    n: int
    centres: np.ndarray
    words: list[np.ndarray]  # of each sub-space: up to 256 x PART
    metric: str
    probes: int


def _cells_in_order(vector: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres * centres).sum(1)[None] - 2 * vector @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def build_index(rows: DataFrame, metric: str = "ip", cells: int | None = None, recall: float = 0.95, k: int = 10, probes: int | None = None, seed: int = 42, train_rows: int = TRAIN_ROWS) -> CodedIndex:
    """Index of all rows (id, v); null vectors are left out. Probes as many cells as hold the share ``recall`` of the k exact
    neighbours of ``MEASURED_ROWS`` rows, unless ``probes`` is given. ``ip`` is meant for unit vectors."""
    rows = rows.filter("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    n, rng = rows.count(), np.random.default_rng(seed)
    if not n:
        return CodedIndex(rows.select(F.lit(0).alias("cell"), "id", F.lit(b"").alias("code"), "v").limit(0), 0, np.zeros((1, 1)), [], metric, 1)
    x = np.array([r["v"] for r in sorted(smallest(rows, train_rows, key).collect())], np.float64)
    width = x.shape[1]
    centres = _lloyd(x, cells or min(MOST_CELLS, max(1, isqrt(n))), rng)
    words = [_lloyd(x[:, a : a + PART], WORDS, rng) for a in range(0, width, PART)]

    def file(batches):
        for batch in batches:
            m = _matrix(batch.column(1), width)
            codes = np.stack([_nearest(m[:, i * PART : (i + 1) * PART], w) for i, w in enumerate(words)], 1).astype(np.uint8)
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_pydict({"cell": pa.array(_nearest(m, centres), pa.int32()), "id": batch.column(0), "code": code, "v": batch.column(1)})

    filed = materialize(rows.mapInArrow(file, "cell int, id long, code binary, v array<double>"), "coded-rows")
    index = CodedIndex(filed, n, centres, words, metric, probes or len(centres))
    if probes is None and len(centres) > 1:
        some = materialize(smallest(rows, MEASURED_ROWS, key), "measured")
        true = knn_join(some, rows, k + 1, metric).filter("id <> target").select("target", "id")
        at = true.join(filed.select("id", "cell"), "id").groupBy("target").agg(F.collect_list("cell").alias("cells")).collect()  # MEASURED_ROWS rows of k
        own = {r["id"]: np.array(r["v"]) for r in some.collect()}
        places = sorted(int(np.flatnonzero(_cells_in_order(own[r["target"]][None], centres, len(centres))[0] == c)[0]) + 1 for r in at for c in r["cells"])
        index.probes = places[min(len(places) - 1, int(recall * len(places)))] if places else len(centres)
    return index


def _asked(queries: DataFrame, index: CodedIndex, probes: int) -> DataFrame:
    """(cell, id, v): each query once for each cell that it probes."""
    width, centres = index.centres.shape[1], index.centres

    def run(batches):
        for batch in batches:
            near = _cells_in_order(_matrix(batch.column(1), width), centres, probes)
            row = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(near.ravel(), pa.int32()), "id": batch.column(0).take(row), "v": batch.column(1).take(row)})

    rows = queries.filter("v is not null").select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    return rows.mapInArrow(run, "cell int, id long, v array<double>")


def candidates(queries: DataFrame, index: CodedIndex, n: int, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(target, id): the n rows of best coded score in the cells that each query probes; no vector of a row is read."""
    asked = _asked(queries, index, min(probes or index.probes, len(index.centres)))
    none = F.lit(None)
    groups = dealt_by_key(asked.withColumn("code", none.cast("binary")), index.rows.select("cell", "id", F.lit(None).cast("array<double>").alias("v"), "code"), "cell", block_rows)
    words, metric, width = index.words, index.metric, index.centres.shape[1]

    def best(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        target, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if 0 < side.sum() < len(side):
            q = _matrix(table["v"].filter(pa.array(side == 0)).combine_chunks(), width)
            codes = np.frombuffer(b"".join(table["code"].filter(pa.array(side == 1)).to_pylist()), np.uint8).reshape(-1, len(words))
            qi, ri = ids[side == 0], ids[side == 1]
            order = np.argsort(ri)
            codes, ri, s = codes[order], ri[order], np.zeros((len(q), len(ri)))
            for i, w in enumerate(words):
                part = q[:, i * PART : (i + 1) * PART]
                told = part @ w.T if metric == "ip" else 2 * part @ w.T - (w * w).sum(1)[None]
                s += told[:, codes[:, i]]
            top = best_rows(s, n + 1)
            target, found, score = np.repeat(qi, top.shape[1]), ri[top].ravel(), np.take_along_axis(s, top, 1).ravel()
            keep = target != found
            target, found, score = target[keep], found[keep], score[keep]
        return pa.table({"target": target, "id": found, "score": score})

    scored = groups.groupBy("cell", "qb", "rb").applyInArrow(best, "target long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select("target", "id")


def search(queries: DataFrame, index: CodedIndex, k: int = 30, rescored: int | None = None, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(target, id, score, rank): the k best of the ``rescored`` rows (10 k unless given) that the codes name, by exact inner product
    or squared distance. A query finds no row of its own id."""
    named = candidates(queries, index, rescored or 10 * k, probes, block_rows)
    pairs = named.join(index.rows.select("id", "v"), "id").join(queries.select(F.col("id").alias("target"), F.col("v").alias("q")), "target")
    score = V.dot(F.col("v"), F.col("q")) if index.metric == "ip" else V.squared_distance(F.col("v"), F.col("q"))
    return _ranked(pairs.select("target", "id", score.alias("score")), k, index.metric)


def bytes_read(index: CodedIndex, rescored: int, probes: int | None = None) -> float:
    """Share of the rows' vector bytes that a query reads: the codes of the cells that it probes, and the vectors scored again."""
    cells, width = len(index.centres), 8 * index.centres.shape[1]
    return min(probes or index.probes, cells) / cells * len(index.words) / width + rescored / max(index.n, 1)


def knn_ivf(queries: DataFrame, rows: DataFrame, k: int = 30, cells: int | None = None, probes: int | None = None, seed: int = 42, metric: str = "ip", recall: float = 0.95, rescored: int | None = None) -> DataFrame:
    """Approximate (target, id, score, rank) from an index built for the rows."""
    return search(queries, build_index(rows, metric, cells, recall, k, probes, seed), k, rescored)
