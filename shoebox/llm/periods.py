"""Periodic runs of words: stretches in which one sequence of words comes four times or more.

A run of period q and length 4q or more holds each of its words four times at least, so a word that occurs less often within
a segment lies in no run of it and splits it. Splitting goes on within the new segments until each has only words that are
frequent in it; in ordinary prose little is left. What survives is scanned by lags: the lags 1 to 8 by comparing the words
with themselves shifted, longer ones from blocks. A run of a lag in (b, 2b] repeats at least 3b words that lag further
on, hence a whole block of b words at a multiple of b; hashes of windows of b words nominate the lags of each block, and each
is checked word by word and extended to both sides. All documents of a batch are scanned at once, with unlike words between their
segments; the work is n log n in the words that survive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import map_batches, texts_as_bytes

#: A run has this many periods and words at least.
PERIODS, LEAST = 4, 6
#: Lags up to this are compared one by one.
SHORT_LAGS = 8
#: Bytes of text whose words are held as objects at once, and of texts that are scanned together.
PIECE, BATCH_BYTES = 1 << 20, 1 << 23

_SPACE = re.compile(rb"[ \t-\r]")


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about a megabyte."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def split_by_frequency(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Sorted places of the words that survive: in segments in which each word occurs PERIODS times or more. ``segment`` does not fall."""
    place, kept = np.arange(len(words)), [np.zeros(0, np.int64)]
    span = int(words.max(initial=0)) + 1
    while len(place):
        key = segment * span + words[place]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        counts = np.diff(first, append=len(order))
        rare = np.empty(len(order), bool)
        rare[order] = np.repeat(counts < PERIODS, counts)
        changed = np.zeros(int(segment[-1]) + 1, bool)
        changed[segment[rare]] = True
        stable = ~changed[segment]
        kept.append(place[stable])
        go = ~(rare | stable)
        place, segment = place[go], segment[go]
        if len(place):
            new = np.diff(place, prepend=-2) != 1
            new[1:] |= segment[1:] != segment[:-1]
            segment = np.cumsum(new) - 1
            long = np.bincount(segment)[segment] >= LEAST
            place = place[long]
            segment = np.unique(segment[long], return_inverse=True)[1]
    return np.sort(np.concatenate(kept))


def _reach(x: np.ndarray, lag: int, lo: int, hi: int) -> tuple[int, int]:
    """The largest stretch around [lo, hi) in which each word equals the one that lag behind it."""
    step, n = 64, len(x) - lag
    while hi < n:
        end = min(n, hi + step)
        off = np.flatnonzero(x[hi:end] != x[hi + lag : end + lag])
        if len(off):
            hi += int(off[0])
            break
        hi, step = end, step * 2
    step = 64
    while lo > 0:
        start = max(0, lo - step)
        off = np.flatnonzero(x[start:lo] != x[start + lag : lo + lag])
        if len(off):
            lo = start + int(off[-1]) + 1
            break
        lo, step = start, step * 2
    return lo, hi


def _short_lags(x: np.ndarray, runs: dict[tuple[int, int], int]) -> None:
    for lag in range(1, min(SHORT_LAGS, len(x) - 1) + 1):
        edges = np.flatnonzero(np.diff((x[lag:] == x[:-lag]).astype(np.int8), prepend=0, append=0))
        for lo, hi in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2))[:, 0] >= max(LEAST, PERIODS * lag) - lag].tolist():
            runs.setdefault((lo, hi + lag), lag)


def _long_lags(x: np.ndarray, longest: int, runs: dict[tuple[int, int], int]) -> None:
    odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    h, width, b = x.astype(np.uint64) * odd, 1, SHORT_LAGS
    while PERIODS * (b + 1) <= longest and len(x) > 2 * b:
        while width < b:  # a window's hash from those of its halves
            h = (h ^ (h >> shift)) * odd
            h = h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width:]
            width *= 2
        rows = -(-(len(h) - b - 1) // b)
        if rows <= 0:
            break
        ahead = np.zeros(rows * b, np.uint64)
        ahead[: len(h) - b - 1] = h[b + 1 :]
        block, lag = np.nonzero(ahead.reshape(rows, b) == h[: rows * b : b][:, None])
        at, lag = block * b, lag + b + 1
        if runs and len(at):
            # inside a run of a shorter period d every such lag is a multiple of d, and no smallest period
            spans = np.array(sorted(k for k, d in runs.items() if d <= b), np.int64).reshape(-1, 2)
            if len(spans):
                behind = np.searchsorted(spans[:, 0], at, "right") - 1
                cover = np.where(behind >= 0, np.maximum.accumulate(spans[:, 1])[behind], 0)
                fresh = cover < at + lag + b
                at, lag = at[fresh], lag[fresh]
        order = np.lexsort((at, lag))
        seen = (0, 0)
        for lo, q in zip(at[order].tolist(), lag[order].tolist()):
            if q == seen[0] and lo + b <= seen[1] or lo + b + q > len(x) or not np.array_equal(x[lo : lo + b], x[lo + q : lo + q + b]):
                continue
            start, stop = _reach(x, q, lo, lo + b)
            seen = (q, stop)
            if stop - start >= (PERIODS - 1) * q:
                runs.setdefault((start, stop + q), q)
        b *= 2


def scan_lags(words: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs within the stretches of consecutive places, by start, then period."""
    if not len(places):
        return []
    gaps = np.flatnonzero(np.diff(places) != 1) + 1
    x = np.insert(words[places].astype(np.int64), gaps, np.arange(len(gaps)) + int(words.max()) + 1)
    where = np.insert(places, gaps, -1)
    runs: dict[tuple[int, int], int] = {}  # ascending periods: of equal stretches the smallest period stays
    _short_lags(x, runs)
    _long_lags(x, int(np.diff([0, *gaps, len(places)]).max()), runs)
    return sorted((int(where[lo]), hi - lo, q) for (lo, hi), q in runs.items())


def find_runs(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(number of words, runs) of each text."""
    known: dict[bytes, int] = {}
    ids, sizes = [], []
    for text in texts:
        n = 0
        for piece in word_pieces(text):
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in piece), np.int64, len(piece)))
            n += len(piece)
        sizes.append(n)
    words = np.concatenate([np.zeros(0, np.int64), *ids])
    segment = np.repeat(np.arange(len(texts)), sizes)
    places = split_by_frequency(words, segment)
    # a place between texts is left free, so that no stretch goes over their bounds
    spread = words if not len(texts) else np.insert(words, np.cumsum(sizes)[:-1], 0)
    runs, starts = [[] for _ in texts], np.cumsum(sizes) - sizes + np.arange(len(texts))
    for at, length, period in scan_lags(spread, places + segment[places]):
        doc = int(np.searchsorted(starts, at, "right")) - 1
        runs[doc].append((at - int(starts[doc]), length, period))
    return list(zip(sizes, runs))


def collapse(text: bytes, n: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those behind the first period of a run."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    flags, out = keep.tolist(), []
    for piece in word_pieces(text):
        out += [b" ".join(compress(piece, flags[: len(piece)]))]
        flags = flags[len(piece) :]
    return b" ".join(x for x in out if x)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeated periods.

    Words are runs of characters other than blanks and control white space. Null text is empty: no words, no runs, empty collapsed
    text. Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored."""

    def make():
        def step(batch):
            keys, held, size = [], [], 0

            def out():
                found = find_runs(held)
                collapsed = [collapse(t, n, r).decode("utf-8", "replace") for t, (n, r) in zip(held, found)]
                runs = [[{"start": a, "length": b, "period": c} for a, b, c in r] for _, r in found]
                return {"doc_id": keys, "n_words": [n for n, _ in found], "runs": runs, "collapsed": collapsed}

            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                keys.append(doc_id)
                held.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield out()
                    keys, held, size = [], [], 0
            yield out()

        return step

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every text whose hash h = crc32(doc_id) ends in 0 made periodic from word a = (h // 10) % n on, with
    period 1 + (n - a) // (3 + h // 10 % 8); others as they are. A null id counts as empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(F.col("doc_id").cast("long"), "text", (h % 10 == 0).alias("_on"), F.floor(h / 10).cast("long").alias("_g"))
    chosen = chosen.withColumn("_w", F.when(F.col("_on"), words)).withColumn("_n", F.size("_w"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    chosen = chosen.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    unit = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    tail = F.flatten(F.array_repeat(unit, F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    text = F.concat_ws(" ", F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")))
    return chosen.select("doc_id", F.when(F.col("_on") & (F.col("_n") > 0), text).otherwise(F.col("text")).alias("text"))


def run_report(runs: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: doc_id, n_runs, the run of greatest length / period (ties: smallest start, then period; null
    without runs) with exponent_milli, and the digests of the listed runs and of the collapsed text."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    told = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest(F.concat_ws("", lines)).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return told.select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
