"""All pairs of vectors within a radius, exactly, without comparing what the triangle inequality rules out.

Pivots are chosen far apart from a bounded sample, and every row is filed in the cell of its nearest one. For each pair of cells
the rows' least distance to the bisector of the two pivots is known. Along its normal, a row is as far from another cell's rows as
the two distances add up to; it is sent there only if that is within the radius, and if its distance to that pivot
lies within the radius of the distances that the cell's rows have. Of two cells one compares the pair, and large cells are cut
into blocks, so that no task holds one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoebox.operators.numbering import smallest
from shoebox.session import materialize

#: Rows from which pivots are chosen; least and most pivots; rows a cell is meant to have.
SAMPLE_ROWS, LEAST_PIVOTS, MOST_PIVOTS, CELL_ROWS = 4096, 32, 256, 8192
#: Rows of a block (each row is copied to all blocks that it meets, so large ones move less); rows of a block whose products are held
#: at once; copies of rows that a task makes at once.
BLOCK_ROWS, STRIP, COPIES = 8192, 512, 20_000
#: Bounds are widened by this, so that rounding loses no pair.
SLACK = 1e-6


@dataclass
class RadiusJoin:
    """``pairs``: (seed, id, score), both ways and each row with itself; ``compared`` and ``possible``: numbers of unordered pairs."""

    pairs: DataFrame
    cells: int
    compared: int
    possible: int

    @property
    def share(self) -> float:
        return self.compared / self.possible if self.possible else 0.0


def choose_pivots(rows: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """n rows of a sample of ``SAMPLE_ROWS``, each the one farthest from those before."""
    some = smallest(rows.select("id", "v"), SAMPLE_ROWS, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")))
    got = sorted((r["id"], r["v"]) for r in some.collect())
    x = np.array([v for _, v in got], np.float64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _squares(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column, which are arrays, or their bytes without nulls."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _file_rows(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, d): each row with its nearest pivot and the distance to it. Vectors are kept as bytes, which are copied as they are."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1])
            d = _squares(x, pivots)
            cell = d.argmin(1)
            ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * pivots.shape[1])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "v": pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))]), "cell": pa.array(cell, pa.int32()), "d": np.sqrt(d[np.arange(len(d)), cell])})

    return rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "id long, v binary, cell int, d double")


def _cells(filed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, n, near, far, margin): each cell's rows, their least and greatest distance to its pivot, and for each other pivot
    by how much the squared distance to it exceeds that to their own, at least. Tasks return one row a cell that they have."""
    schema = "cell int, n long, near double, far double, margin array<double>"

    def part(batches):
        k = len(pivots)
        n, near, far, margin = np.zeros(k, np.int64), np.full(k, np.inf), np.full(k, -np.inf), np.full((k, k), np.inf)
        for batch in batches:
            d = _squares(_matrix(batch.column(0), pivots.shape[1]), pivots)
            cell, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            n += np.bincount(cell, minlength=k)
            np.minimum.at(near, cell, at)
            np.maximum.at(far, cell, at)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            some = cell[order][starts]
            margin[some] = np.minimum(margin[some], np.minimum.reduceat((d - d[np.arange(len(d)), cell][:, None])[order], starts)) if len(some) else margin[some]
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(full, pa.int32()), "n": n[full], "near": near[full], "far": far[full], "margin": pa.array(list(margin[full]), pa.list_(pa.float64()))})

    def least(table: pa.Table) -> pa.Table:
        margin = np.stack(table["margin"].to_numpy()).min(0)
        found = {"cell": table["cell"][:1], "n": [sum(table["n"].to_pylist())], "near": [min(table["near"].to_pylist())], "far": [max(table["far"].to_pylist())], "margin": [margin]}
        return pa.table(found, schema=pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("near", pa.float64()), ("far", pa.float64()), ("margin", pa.list_(pa.float64()))]))

    return filed.select("v", "cell", "d").mapInArrow(part, schema).groupBy("cell").applyInArrow(least, schema)


class _Reach:
    """Which other cells a row is sent to; of two cells the one of smaller number compares them."""

    def __init__(self, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, margin: np.ndarray, radius: float):
        self.pivots, self.near, self.far, self.margin = pivots, near - radius - SLACK, far + radius + SLACK, margin.T
        self.most = 2 * (radius + SLACK) * np.sqrt(_squares(pivots, pivots)) + SLACK

    def __call__(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _squares(x, self.pivots)
        own = d[np.arange(len(d)), cell]
        to = np.sqrt(d)
        gap = d - own[:, None] + self.margin[cell]  # both sides' distances to the bisector, times twice that of the pivots
        return np.nonzero((gap <= self.most[cell]) & (to >= self.near) & (to <= self.far) & (np.arange(d.shape[1])[None] < cell[:, None]))


@dataclass
class Meeting:
    """Two blocks of rows, or one with itself (``same``): ids and vectors of both, core (0 or 1) and mark of their rows."""

    same: bool
    ids: tuple[np.ndarray, np.ndarray]
    x: tuple[np.ndarray, np.ndarray]
    core: tuple[np.ndarray, np.ndarray]
    mark: tuple[np.ndarray, np.ndarray]
    bound: float
    metric: str

    def hits(self, first: np.ndarray | slice = slice(None), second: np.ndarray | slice = slice(None)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, which pairs are within the bound, scores) of strips of the chosen rows."""
        p, q = self.x[0][first], self.x[1][second]
        norms = (q * q).sum(1)[None, :]
        for a in range(0, len(p) if len(q) else 0, STRIP):
            some = p[a : a + STRIP]
            s = some @ q.T
            if self.metric == "l2":
                s = np.maximum((some * some).sum(1)[:, None] + norms - 2 * s, 0)
            yield a, s >= self.bound if self.metric == "ip" else s <= self.bound, s


class RadiusBlocks:
    """Rows (id, v) filed by pivots, so that all rows within a radius of each other meet in some pair of blocks, each pair of rows once.

    Pairs are those whose inner product is at least ``bound`` (``ip``: unit vectors), or whose squared distance is at most that
    (``l2``: any vectors of one width). Null vectors are left out; ids are unique. ``filed`` (id, v as bytes, cell, d) is None without rows."""

    def __init__(self, rows: DataFrame, bound: float, metric: str = "ip", block_rows: int | None = None, cells: int | None = None):
        self.spark, self.bound, self.metric, rows = rows.sparkSession, bound, metric, rows.filter("v is not null")
        n = rows.count()
        self.filed, self.cells, self.compared, self.possible = None, 0, 0, n * (n + 1) // 2
        if not n:
            return
        self.block_rows = block_rows or BLOCK_ROWS
        radius = float(np.sqrt(max(2 - 2 * bound, 0.0) if metric == "ip" else max(bound, 0.0)))
        pivots = choose_pivots(rows, cells or min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-n // CELL_ROWS))))
        self.filed = materialize(_file_rows(rows, pivots), "radius-cells")
        self.cells, self.width = len(pivots), pivots.shape[1]
        k, width = self.cells, self.width
        own, near, far, margin = np.zeros(k, np.int64), np.full(k, np.inf), np.full(k, -np.inf), np.full((k, k), np.inf)
        for r in _cells(self.filed, pivots).collect():  # k rows
            own[r["cell"]], near[r["cell"]], far[r["cell"]], margin[r["cell"]] = r["n"], r["near"], r["far"], r["margin"]
        reach = _Reach(pivots, near, far, margin, radius)

        def count(batches):
            total = np.zeros(k, np.int64)
            for batch in batches:
                total += np.bincount(reach(_matrix(batch.column(1), width), batch.column(2).to_numpy())[1], minlength=k)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(full, pa.int32()), "n": pa.array(total[full])})

        sent = np.zeros(k, np.int64)
        for r in self.filed.select("id", "v", "cell").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            sent[r["cell"]] = r["n"]
        self.reach, self.blocks, self.chunks = reach, np.maximum(1, -(-own // self.block_rows)), -(-sent // self.block_rows)
        self.compared = int((own * (own + 1) // 2 + own * sent).sum())

    def _deal(self) -> Callable:
        reach, blocks, chunks, width = self.reach, self.blocks, self.chunks, self.width

        def copies(at: np.ndarray, cell: np.ndarray, guest: np.ndarray, ids: np.ndarray):
            """(row, cell, a, b, guest) of every pair of blocks that a row takes part in; b from ``blocks`` on are chunks of guests."""
            b, q = blocks[cell], np.maximum(chunks[cell], 1)
            mine = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            times = np.where(guest, b, b + chunks[cell])
            r = np.repeat(np.arange(len(at)), times)
            j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            home, place = mine[r] % np.where(guest[r], q[r], b[r]), np.where(guest[r], j, 0)
            low = np.where(guest[r], place, np.where(j < b[r], np.minimum(home, j), home))
            high = np.where(guest[r], b[r] + home, np.where(j < b[r], np.maximum(home, j), j))
            return at[r], cell[r], low, high, guest[r], home

        def deal(batches):
            for batch in batches:
                x, cell, ids = _matrix(batch.column(1), width), batch.column(2).to_numpy(), batch.column(0).to_numpy()
                guest_of, guest_in = reach(x, cell)
                at = np.concatenate([np.arange(len(x)), guest_of])
                where, guest = np.concatenate([cell, guest_in]), np.arange(len(at)) >= len(x)
                step = max(1, COPIES // int((blocks + chunks).max()))
                for s in range(0, len(at), step):
                    row, c, a, b, g, home = copies(at[s : s + step], where[s : s + step], guest[s : s + step], ids)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.where(g, 1, np.where(home == a, 0, 2)), pa.int32()), *[batch.column(i).take(take) for i in (0, 1, 3, 4)]],
                        ["cell", "a", "b", "side", "id", "v", "core", "mark"],
                    )

        return deal

    def meet(self, function: Callable[[Meeting], dict], schema: str, rows: DataFrame | None = None) -> DataFrame:
        """What ``function`` makes of every pair of blocks. ``rows``: ``filed`` with core (int) and mark (long) of each row, else 0."""
        if self.filed is None:
            return self.spark.createDataFrame([], schema)
        rows = self.filed.withColumns({"core": F.lit(0), "mark": F.lit(0).cast("long")}) if rows is None else rows
        width, bound, metric = self.width, self.bound, self.metric
        empty = self.spark.createDataFrame([], schema).schema
        types = {f.name: pa.float64() if f.dataType.typeName() == "double" else pa.int64() for f in empty}

        def run(table: pa.Table) -> pa.Table:
            x, first, same = _matrix(table["v"].combine_chunks(), width), table["side"].to_numpy() == 0, table["a"][0] == table["b"][0]
            second = first if same else ~first
            both = lambda c: (c[first], c[second])
            found = function(Meeting(same, both(table["id"].to_numpy()), both(x), both(table["core"].to_numpy()), both(table["mark"].to_numpy()), bound, metric))
            return pa.table({n: pa.array(found[n], t) for n, t in types.items()})

        dealt = rows.select("id", "v", "cell", "core", "mark").mapInArrow(self._deal(), "cell int, a long, b long, side int, id long, v binary, core int, mark long")
        return dealt.groupBy("cell", "a", "b").applyInArrow(run, schema)


def _pairs(m: Meeting) -> dict:
    seed, other, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, hit, s in m.hits():
        i, j = np.nonzero(hit)
        u, v, d = m.ids[0][a + i], m.ids[1][j], s[i, j]
        seed, other, score = [*seed, u], [*other, v], [*score, d]
        if not m.same:
            seed, other, score = [*seed, v], [*other, u], [*score, d]
    return {"seed": np.concatenate(seed), "id": np.concatenate(other), "score": np.concatenate(score)}


def radius_join(rows: DataFrame, bound: float, metric: str = "ip", block_rows: int = BLOCK_ROWS, cells: int | None = None) -> RadiusJoin:
    """All pairs within a radius, see ``RadiusBlocks``; as many rows as there are such pairs."""
    blocks = RadiusBlocks(rows, bound, metric, block_rows, cells)
    return RadiusJoin(blocks.meet(_pairs, "seed long, id long, score double"), blocks.cells, blocks.compared, blocks.possible)


def counts(m: Meeting) -> dict:
    """Group function: (id, n) the rows within the radius of each row, itself included."""
    n, other = np.zeros(len(m.ids[0]), np.int64), np.zeros(len(m.ids[1]), np.int64)
    for a, hit, _ in m.hits():
        n[a : a + len(hit)] = np.count_nonzero(hit, axis=1)
        if not m.same:
            other += np.count_nonzero(hit, axis=0)
    got = (m.ids[0], n) if m.same else (np.concatenate(m.ids), np.concatenate([n, other]))
    return {"id": got[0][got[1] > 0], "n": got[1][got[1] > 0]}


def links(m: Meeting) -> dict:
    """Group function: (u, v) a star for each connected part of the core rows of a pair of blocks, at most one edge a row."""
    first, second = (np.flatnonzero(c) for c in m.core)
    ids, hit = (m.ids[0][first], m.ids[1][second]), np.zeros((len(first), len(second)), bool)
    for a, some, _ in m.hits(first, second):
        hit[a : a + len(some)] = some
    left = [np.ones(len(i), bool) for i in ids]
    head, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(len(first)):
        if not left[0][start]:
            continue
        new, side, members = np.array([start]), 0, []
        left[0][start] = False
        if m.same:
            while len(new):
                members.append(ids[0][new])
                new = np.flatnonzero(hit[new].any(0) & left[0])
                left[0][new] = False
        else:
            while len(new):
                members.append(ids[side][new])
                side = 1 - side
                new = np.flatnonzero((hit[new].any(0) if side else hit[:, new].any(1)) & left[side])
                left[side][new] = False
        if m.same or len(members) > 1:
            node.append(np.concatenate(members))
            head.append(np.full(len(node[-1]), ids[0][start]))
    return {"u": np.concatenate(head), "v": np.concatenate(node)}


def least_marks(m: Meeting) -> dict:
    """Group function: (id, component) the least mark of the core rows within the radius of each row that is none."""
    most, out = np.iinfo(np.int64).max, {"id": [np.zeros(0, np.int64)], "component": [np.zeros(0, np.int64)]}
    for side in (0,) if m.same else (0, 1):
        mine, theirs = np.flatnonzero(m.core[side] == 0), np.flatnonzero(m.core[1 - side])
        turned = m if side == 0 else Meeting(False, m.ids[::-1], m.x[::-1], m.core[::-1], m.mark[::-1], m.bound, m.metric)
        mark = turned.mark[1][theirs]
        for a, hit, _ in turned.hits(mine, theirs):
            best = np.where(hit, mark[None], most).min(1)
            some = np.flatnonzero(hit.any(1))
            out["id"].append(turned.ids[0][mine[a + some]])
            out["component"].append(best[some])
    return {k: np.concatenate(v) for k, v in out.items()}
