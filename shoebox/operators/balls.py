"""Vectors in blocks with the ball that holds each: what is gone through many times, written once as matrices.

A block is compared only with those centres that its ball leaves possible, which is exact: where rows lie in no groups, these are all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shoebox.session import materialize

#: Most cells by which rows are put in blocks; rows from which their pivots are chosen; rows of a block; least rows and most bytes of a task.
MOST_CELLS, SAMPLE_ROWS, BLOCK_ROWS, LEAST_TASK_ROWS, TASK_BYTES = 32, 4096, 1024, 4096, 32 << 20


def nearest_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it."""
    label, least, half = np.empty(len(x), np.int64), np.empty(len(x)), (centres * centres).sum(1) / 2
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ centres.T
        s -= half
        label[a : a + 1024] = s.argmax(1)
        least[a : a + 1024] = s[np.arange(len(s)), label[a : a + 1024]]
    return label, np.maximum((x * x).sum(1) - 2 * least, 0)


class BallBlocks:
    """Vectors (v) in blocks, written once: x the matrix of a block, middle and radius of its ball, and each row's partition and place in it.

    A block holds rows nearest to one and the same of up to ``cells`` pivots, so that its ball is small where the rows lie in groups.
    ``sizes``: rows of each partition; ``plain``: all numbers are finite; ``tasks``: number of tasks that read the blocks."""

    def __init__(self, data: DataFrame, cells: int):
        self.spark, data = data.sparkSession, data.select("v")
        self.n, self.width, self.plain, self.sizes = data.count(), 0, True, []
        if not self.n:
            return
        some = data.sample(min(1.0, SAMPLE_ROWS / self.n), seed=0).toArrow() if cells > 1 else data.limit(1).toArrow()
        some = some if len(some) else data.limit(1).toArrow()
        self.width = width = len(some["v"][0])
        some = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        pivots, far = some[:1], ((some - some[0]) ** 2).sum(1)
        while len(pivots) < min(MOST_CELLS, cells) and far.max() > 0:
            pivots = np.vstack([pivots, some[far.argmax()]])
            far = np.minimum(far, ((some - pivots[-1]) ** 2).sum(1))

        def block(x, place):
            with np.errstate(all="ignore"):
                middle = x.mean(0)
                radius = float(np.sqrt(((x - middle) ** 2).sum(1).max()))
            found = {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [len(x)], "plain": [bool(np.isfinite(x).all())], "middle": pa.array([middle.tobytes()], pa.binary()), "radius": [radius]}
            return pa.RecordBatch.from_pydict(found | {"place": pa.array([place.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

        def pack(batches):
            held, at = [[] for _ in pivots], 0
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                cell, place, at = nearest_of(x, pivots)[0], np.arange(at, at + len(x)), at + len(x)
                for j in np.unique(cell):
                    held[j].append((x[cell == j], place[cell == j]))
                    if sum(len(h) for h, _ in held[j]) >= BLOCK_ROWS:
                        full, places = (np.concatenate(c) for c in zip(*held[j]))
                        last = len(full) // BLOCK_ROWS * BLOCK_ROWS
                        yield from (block(full[i : i + BLOCK_ROWS], places[i : i + BLOCK_ROWS]) for i in range(0, last, BLOCK_ROWS))
                        held[j] = [(full[last:], places[last:])] if last < len(full) else []
            yield from (block(*(np.concatenate(c) for c in zip(*h))) for h in held if h)

        self.tasks = max(1, min(-(-self.n // LEAST_TASK_ROWS), max(self.spark.sparkContext.defaultParallelism, -(-self.n * width * 8 // TASK_BYTES))))
        blocks = data.mapInArrow(pack, "part int, n long, plain boolean, middle binary, radius double, place binary, x binary").repartition(self.tasks)
        often = {f"parquet.{k}.size.row.check.min": "2" for k in ("page", "block")}  # rows of up to half a megabyte
        self.packed = materialize(blocks, "kmeans-blocks", compression="none", **often)
        parts = {r["part"]: r for r in self.packed.groupBy("part").agg(F.sum("n").alias("n"), F.min("plain").alias("plain")).collect()}
        self.sizes = [parts[p]["n"] if p in parts else 0 for p in range(max(parts) + 1)]
        self.plain = all(r["plain"] for r in parts.values())

    def each(self, function: Callable, schema: str) -> DataFrame:
        """What ``function`` yields for a task's blocks, an iterator of (part, place, middle, radius, x)."""
        width = self.width

        def run(batches):
            def rows():
                for batch in batches:
                    for part, middle, radius, place, x in zip(*batch.columns):
                        yield part.as_py(), np.frombuffer(place.as_buffer(), np.int64), np.frombuffer(middle.as_buffer()), radius.as_py(), np.frombuffer(x.as_buffer()).reshape(-1, width)

            yield from function(rows())

        return self.packed.select("part", "middle", "radius", "place", "x").mapInArrow(run, schema)


def in_reach(middle: np.ndarray, radius: float, centres: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The centres that can be the nearest one of a row within ``radius`` of ``middle``. If c is nearest to the middle m, another one e is nearer
    to x than c only where |m - e|^2 - |m - c|^2 <= 2 (x - m)(e - c) <= 2 |x - m| |e - c|."""
    slack = 1e-9 * (squares.max() + middle @ middle)
    d = squares - 2 * (centres @ middle)
    first = d.argmin()
    apart = np.sqrt(np.maximum(squares + squares[first] - 2 * (centres @ centres[first]), 0) + slack)
    return np.flatnonzero(~(d - d[first] > 2 * radius * apart + slack))
