"""Repeated byte strings across documents, by column-wise construction of a collection's Burrows-Wheeler transform.

Every byte string of ``least`` bytes that starts at two places of the corpus is found, and what such strings cover is removed.

The corpus is dealt out so that no task needs more than a bounded collection. The least hash among the 32-byte strings of a
window of ``least`` bytes is its anchor (leftmost on ties). Neighbouring windows with one anchor, at most ``SPANS[0]`` of them,
form a segment; the bytes that all windows of such a segment must share are its core. Equal windows have equal anchors at equal
places, so they have equal cores and meet in the collection of that core, aligned at it. Segments whose core occurs once
in the corpus cannot repeat and are not moved; equal segments are held once with a count.

A task takes collections of segments, aligned at their cores, and builds their transform column by column from the right: each
round inserts one symbol of every segment. The transform of a column lists the symbols before the suffixes in order of these; sorting it
stably gives the order of the suffixes one symbol longer, and minima over the common-prefix table (LCP) between equal symbols
give theirs. Symbols, order and LCP are kept in scratch files that each round goes through from front to back,
a bounded block of whole collections at a time. Neighbouring suffixes with a common prefix of ``least`` or more are repeats.

A collection of more than ``most_segments`` different segments is dealt again: its segments are cut into pieces of fewer windows, which
share longer cores (``SPANS``). Pieces of a single window meet equal ones only, so dealing always ends.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.bpe import _byte_values
from shoebox.llm.common import map_batches, pack_texts, unpack_texts
from shoebox.session import materialize

LEAST = 200
GRAM = 32
SPANS = (85, 11, 1)  # windows of a segment, and of its pieces where a collection is dealt again
STRETCH = 1 << 16  # bytes looked at together
MOST_SEGMENTS = 8192
BLOCK_ROWS = 1 << 15  # rows of the transform in memory
BATCH_ROWS = 1 << 18  # segments whose transform is built together


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte strings, by doubling."""
    with np.errstate(over="ignore"):
        h, power, width = _byte_values()[data], np.uint64(0x9E3779B97F4A7C15), 1
        while width < GRAM:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _string_hashes(grams: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at the given places, from those of the 32-byte strings that cover them."""
    steps = -(-(size - GRAM) // GRAM)
    out = grams[at]
    with np.errstate(over="ignore"):
        for i in range(1, steps + 1):
            out = out * np.uint64(0x9E3779B97F4A7C15) + grams[at + (size - GRAM) * i // steps]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by minima from both ends of fixed blocks."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes], least: int = LEAST, span: int = SPANS[0]) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, bytes from there to the core, core hash) of the segments of some texts.

    Each window start belongs to one segment only. The texts are looked at as one run of bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = np.ones(len(data), bool)  # the window that starts here ends in the same text
    cut = np.minimum(sizes, least - 1)
    whole[np.repeat(stops - np.cumsum(cut), cut) + np.arange(cut.sum())] = False
    low, found = np.uint64((1 << 17) - 1), []
    for at in range(0, len(data) - least + 1, STRETCH):
        part = data[at : at + STRETCH + least - 1]
        n = len(part) - least + 1
        ok = whole[at : at + n]
        if not ok.any():
            continue
        grams = _gram_hashes(part)
        anchor = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), least - GRAM + 1) & low).astype(np.int32)
        band = (anchor - np.arange(n, dtype=np.int32)) // span
        new = np.ones(n + 1, bool)
        new[1:-1] = (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(new[:-1] & ok)
        count = np.flatnonzero(new[1:] & ok) + 1 - first
        core = anchor[first] - band[first] * span
        found.append((first + at, count, core - first, _string_hashes(grams, core, least - span + 1)))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    first, count, lead, core = (np.concatenate(x) for x in zip(*found))
    text = np.searchsorted(stops, first, "right")
    return text, first - (stops - sizes)[text], count, lead, core


class _Scratch:
    """A table in a task's own scratch file, gone through from front to back."""

    def __init__(self, dtype):
        self.file, self.dtype = tempfile.TemporaryFile(), np.dtype(dtype)

    def rewind(self) -> None:
        self.file.seek(0)

    def write(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.dtype))

    def read(self, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(n * self.dtype.itemsize), self.dtype)

    def close(self) -> None:
        self.file.close()


def _range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of values[start:stop] for each pair, start < stop <= len(values)."""
    if not len(start):
        return np.zeros(0, values.dtype)
    return np.minimum.reduceat(np.append(values, values[-1]), np.stack([start, stop], 1).ravel())[::2]


def _insert(symbol: np.ndarray, order: np.ndarray, lcp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and LCP after a round: ``symbol`` is the transform of the column, ``order`` the segments in order of their suffixes,
    ``lcp`` the common prefix with the suffix before, ``group`` the collection (numbers that do not fall). Symbol 0 is none."""
    same = np.append(False, group[1:] == group[:-1])
    if not (same[1:] & (symbol[1:] != symbol[:-1])).any():
        return order, np.where(same & (symbol > 0), lcp + 1, 0)
    by = np.argsort(symbol, kind="stable")
    by = by[np.argsort(group[by], kind="stable")]
    sorted_ = symbol[by]
    tie = np.flatnonzero(same & np.append(False, sorted_[1:] == sorted_[:-1]) & (sorted_ > 0))
    out = np.zeros(len(lcp), lcp.dtype)
    out[tie] = _range_minima(lcp, by[tie - 1] + 1, by[tie] + 1) + 1
    return order[by], out


def repeated_windows(strings: list[bytes], lead: np.ndarray, windows: np.ndarray, group: np.ndarray, least: int = LEAST, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """(strings, windows) True where a string of ``least`` bytes starts that stands at the same place in another string of its group.

    Strings are UTF-8 or other bytes below 255, different within a group, aligned ``lead`` bytes from their start; ``group``
    has numbers that do not fall."""
    n, left = len(strings), int(lead.max(initial=0))
    sizes = np.array([len(s) for s in strings])
    width = int((sizes - lead).max(initial=0)) + left
    hits = np.zeros((n, int(windows.max(initial=0))), bool)
    change = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n)
    bounds = [0]
    for a, b in zip(change, change[1:]):  # blocks of whole groups
        if b - bounds[-1] > block_rows and a > bounds[-1]:
            bounds.append(int(a))
    bounds = [(a, b) for a, b in zip(bounds, [*bounds[1:], n]) if a < b]
    symbols, tables = _Scratch(np.uint8), [_Scratch(np.int32), _Scratch(np.int16)]
    next_tables = [_Scratch(np.int32), _Scratch(np.int16)]
    try:
        for a, b in bounds:  # for each block its columns, the last one first
            grid = np.zeros((width, b - a), np.uint8)
            flat = np.frombuffer(b"".join(strings[a:b]), np.uint8)
            row = np.repeat(np.arange(b - a), sizes[a:b])
            column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b]) + np.repeat(left - lead[a:b], sizes[a:b])
            grid[width - 1 - column, row] = flat + 1
            symbols.write(grid)
        tables[0].write(np.arange(n))
        tables[1].write(np.zeros(n))
        for column in range(width - 1, -1, -1):
            for t in (*tables, *next_tables):
                t.rewind()
            for a, b in bounds:
                symbols.file.seek(a * width + (width - 1 - column) * (b - a))
                order, lcp = (t.read(b - a) for t in tables)
                own = (group[a:b] - group[a]).astype(np.uint16)
                order, lcp = _insert(symbols.read(b - a)[order - a], order, lcp, own)
                if column + least <= width:
                    found = lcp >= least
                    found[:-1] |= found[1:].copy()
                    at = order[found]
                    hits[at, column - left + lead[at]] = True
                next_tables[0].write(order)
                next_tables[1].write(lcp)
            tables, next_tables = next_tables, tables
    finally:
        for t in (symbols, *tables, *next_tables):
            t.close()
    return hits


def _runs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the maximal runs of True in each row."""
    edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


_FOUND = "core long, segment binary, starts array<int>, stops array<int>"


def _collections(least: int, batch_rows: int):
    """Task function over segments (core, segment, lead, windows, body) sorted by core: runs of repeated window starts of each."""

    def run(batches):
        held: dict[bytes, tuple] = {}  # of the core now read
        ready: list[tuple] = []
        core = None
        schema = pa.schema([("core", pa.int64()), ("segment", pa.binary()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])

        def close():
            if len(held) > 1:
                ready.extend((core, k, *v) for k, v in held.items())
            held.clear()

        def build():
            cores, names, leads, windows, bodies = zip(*ready)
            ready.clear()
            cores = np.array(cores, np.int64)
            group = np.cumsum(np.append(False, cores[1:] != cores[:-1]))
            row, start, stop = _runs(repeated_windows(list(bodies), np.array(leads), np.array(windows), group, least))
            some, counts = np.unique(row, return_counts=True)
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, stop)]
            return pa.RecordBatch.from_arrays([pa.array(cores[some]), pa.array([names[i] for i in some.tolist()], pa.binary()), *lists], schema=schema)

        for batch in batches:
            for a, k, *rest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if a != core:
                    close()
                    core = a
                    if len(ready) >= batch_rows:
                        yield build()
                held[k] = rest
        close()
        if ready:
            yield build()

    return run


def _name(body: bytes, lead: int) -> bytes:
    return xxhash.xxh3_128_digest(body + lead.to_bytes(2, "little"))


def _cut(segment: bytes, lead: int, windows: int, span: int):
    """(first window, number, lead, core hash, body) of a segment's pieces: windows by their distance from the core's start."""
    least = len(segment) - windows + 1
    grams = _gram_hashes(np.frombuffer(segment, np.uint8))
    band = (lead - np.arange(windows)) // span
    first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
    count = np.diff(np.append(first, windows))
    at = lead - band[first] * span
    cores = _string_hashes(grams, at, least - span + 1)
    return [(a, n, c - a, h, segment[a : a + n + least - 1]) for a, n, c, h in zip(first.tolist(), count.tolist(), at.tolist(), cores.tolist(), strict=True)]


def _dealt_again(hot: DataFrame, least: int, spans: tuple[int, ...], most_segments: int, batch_rows: int) -> DataFrame:
    """Runs of the segments in collections that are too large, from pieces of ``spans[0]`` windows."""

    def make():
        def step(batch):
            rows = [(core, segment, *piece) for core, segment, lead, windows, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for piece in _cut(body, lead, windows, spans[0])]
            out = {k: [r[i] for r in rows] for i, k in enumerate(("of_core", "of_segment", "first", "windows", "lead", "core", "body"))}
            yield out | {"segment": [_name(b, n) for b, n in zip(out["body"], out["lead"], strict=True)]}

        return step

    schema = "of_core long, of_segment binary, first int, windows int, lead int, core long, body binary, segment binary"
    # a window of two segments of the whole corpus may repeat within other collections only if its core does: all in here
    rows = materialize(map_batches(hot.select("core", "segment", "lead", "windows", "body"), schema, make), "pieces")
    settled = _settled(rows, least, spans, most_segments, batch_rows)
    spans_ = rows.select("of_core", "of_segment", "first", "windows", "core", "segment").join(settled, ["core", "segment"])
    starts = F.when(F.col("places") > 1, F.sequence("first", F.col("first") + F.col("windows") - 1))
    inner = F.flatten(F.transform(F.arrays_zip("starts", "stops"), lambda x: F.sequence(x["starts"], x["stops"] - 1)))
    each = spans_.select("of_core", "of_segment", F.explode(F.coalesce(starts, F.transform(inner, lambda x: x + F.col("first")))).alias("at"))
    found = each.groupBy(F.col("of_core").alias("core"), F.col("of_segment").alias("segment")).agg(F.collect_set("at").alias("starts"))
    return found.select("core", "segment", "starts", F.transform("starts", lambda x: x + 1).alias("stops"))


def _settled(rows: DataFrame, least: int, spans: tuple[int, ...], most_segments: int, batch_rows: int) -> DataFrame:
    """(core, segment, places, starts, stops) of the segments that stand at several places or have repeated windows."""
    counts = rows.groupBy("core", "segment").agg(F.count("*").alias("places"))
    bodies = rows.filter("body is not null").select("core", "segment", "lead", "windows", "body")
    if len(spans) == 1:  # single windows: only equal ones meet
        none = F.lit(None).cast("array<int>")
        return counts.filter("places > 1").select("core", "segment", "places", none.alias("starts"), none.alias("stops"))
    sizes = materialize(counts.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "collections")
    usual, hot = sizes.filter(F.col("n") <= most_segments).select("core"), sizes.filter(F.col("n") > most_segments).select("core")
    n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = bodies.join(usual, "core", "left_semi").repartition(n_parts, "core").sortWithinPartitions("core")
    found = dealt.mapInArrow(_collections(least, batch_rows), _FOUND)
    if not hot.isEmpty():
        large = bodies.join(hot, "core", "left_semi").dropDuplicates(["core", "segment"])
        found = found.unionByName(_dealt_again(large, least, spans[1:], most_segments, batch_rows))
    return counts.join(found, ["core", "segment"], "left").filter("places > 1 or starts is not null")


def repeated_spans(texts: DataFrame, least: int = LEAST, most_segments: int = MOST_SEGMENTS, batch_rows: int = BATCH_ROWS, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """(key, spans): byte ranges (start, stop) of each text that repeated strings cover, not merged; texts without any are left out.

    ``texts`` has a binary ``key``, unlike for each row, and ``packed`` (the compressed text). A segment's windows that
    occur in one place only are settled by its collection; those of a segment that occurs twice are repeats by its count.
    """

    def make_cores():
        def step(batch):
            text, first, count, lead, core = segments(unpack_texts(batch.column(1)), least, spans[0])
            yield {"key": batch.column(0).take(pa.array(text)), "place": pa.array((first << 16) + (count << 8) + lead), "core": pa.array(core)}

        return step

    cores = map_batches(texts.select("key", "packed"), "key binary, place long, core long", make_cores)
    place = F.xxhash64("key", "place")
    # written before it is joined, as what is settled below: the rows of one very common core need not meet in one task then
    twice = materialize(cores.groupBy("core").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("core"), "cores")
    wanted = cores.join(twice, "core").groupBy("key").agg(F.collect_list("place").alias("places"), F.collect_list("core").alias("cores"))

    def make_segments():
        seen: set[bytes] = set()

        def step(batch):
            rows = {k: [] for k in ("segment", "body")}
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            place = batch.column(2).flatten().to_numpy()
            texts_, first, windows, lead = unpack_texts(batch.column(1)), place >> 16, (place >> 8) & 255, place & 255
            text = np.repeat(np.arange(len(sizes)), sizes)
            for t, a, n, before in zip(text.tolist(), first.tolist(), windows.tolist(), lead.tolist(), strict=True):
                body = texts_[t][a : a + n + least - 1]
                name = _name(body, before)
                rows["segment"].append(name)
                rows["body"].append(None if name in seen else body)  # once for each task
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
            yield {
                "key": batch.column(0).take(pa.array(text)), "first": pa.array(first), "windows": pa.array(windows, pa.int32()), "lead": pa.array(lead, pa.int32()),
                "core": batch.column(3).flatten(), "segment": pa.array(rows["segment"], pa.binary()), "body": pa.array(rows["body"], pa.binary()),
            }

        return step

    schema = "key binary, first long, windows int, lead int, core long, segment binary, body binary"
    rows = materialize(map_batches(texts.join(wanted, "key").select("key", "packed", "places", "cores"), schema, make_segments), "segments")
    settled = materialize(_settled(rows, least, spans, most_segments, batch_rows), "settled")
    spans_ = rows.select("key", "first", "windows", "core", "segment").join(settled, ["core", "segment"])
    whole = F.col("places") > 1
    starts = F.when(whole, F.array(F.col("first"))).otherwise(F.transform("starts", lambda x: x + F.col("first")))
    stops = F.when(whole, F.array(F.col("first") + F.col("windows") + (least - 1))).otherwise(F.transform("stops", lambda x: x + F.col("first") + (least - 1)))
    each = spans_.select("key", F.explode(F.arrays_zip(starts.alias("start"), stops.alias("stop"))).alias("span")).select("key", "span.*")
    return each.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, least: int = LEAST, most_segments: int = MOST_SEGMENTS, batch_rows: int = BATCH_ROWS, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of byte ranges start/stop, merged).

    A byte goes if a string of ``least`` bytes that covers it starts anywhere else, in the same text or another row's, too.
    Null text is empty. Repeated rows count as rows: a text that comes twice goes as a whole, if it has ``least`` bytes.
    Null ids stay; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    texts = map_batches(rows.select("key", "text"), "key binary, packed binary", pack_texts).filter("key is not null").dropDuplicates(["key"])
    spans_ = repeated_spans(texts, least, most_segments, batch_rows, spans)

    def make():
        def step(batch):
            out = []
            for text, copies_, ranges in zip(unpack_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = np.frombuffer(text, np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if copies_ > 1 and len(data) >= least:
                    edge[0], edge[-1] = 1, -1
                elif ranges.is_valid and len(ranges.values):
                    np.add.at(edge, ranges.values.field(0).to_numpy(), 1)
                    np.add.at(edge, ranges.values.field(1).to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                merged = [{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()]
                out.append((len(data), int(gone.sum()), len(merged), hashlib.sha256(data[~gone].tobytes()).hexdigest(), merged))
            yield {"key": batch.column(0)} | {k: [r[j] for r in out] for j, k in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))}

        return step

    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    joined = texts.join(copies, "key").join(spans_, "key", "left").select("key", "packed", "copies", "spans")
    return rows.select("doc_id", "key").join(map_batches(joined, schema, make), "key").drop("key")
