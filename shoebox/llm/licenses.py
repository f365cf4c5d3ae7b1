"""License scans: exact phrases by words, and short notices with a bounded number of edits.

A notice with at most k edits holds one of k + 1 pieces unchanged (pigeonhole), so every piece is searched exactly;
around the hits the ``regex`` library says whether the whole notice may stand there with at most k errors, and an alignment
reports all spans. Words that tell licenses apart (version numbers, nc, sa, mit) take no edit.
"""

from __future__ import annotations

from bisect import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import map_batches, texts_as_bytes

#: Phrases that count wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices (words as scanned) and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
}

#: One edit is allowed for every so many characters of a notice, one at least.
CHARS_AN_EDIT = 12

#: Words of a notice, or their first letters, in which no edit is allowed, as one edit there makes another license.
TELLING = regex.compile(rb"(?<=\bversion )\d+|\b(?:nc|sa|mit)\b|\bnon(?=commercial)")

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def edits(notice: str) -> int:
    return max(1, len(notice) // CHARS_AN_EDIT)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) that cover the notice, of nearly equal length."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _seeds(notices: tuple) -> list:
    out = []
    for notice, label in notices:
        k = edits(notice)
        pattern = regex.compile(b"(?:" + regex.escape(notice.encode()) + b"){e<=%d}" % k)
        out.append((notice.encode(), label, k, pattern, [(o, p.encode()) for o, p in pieces(notice, k)]))
    return out


def _places(text: bytes, part: bytes):
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def spans(text: bytes, start: int, end: int, notice: bytes, k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in text[start:end], at most k edits and none in telling words; no two overlap.

    The alignment of least edits for every end, one row for each character of the notice; then the best spans first. A cell
    is edits * m + (length - start), so that of two starts with as many edits the later one is less."""
    fixed, inside, whole = set(), set(), set()
    for t in TELLING.finditer(notice):
        fixed |= set(range(*t.span()))
        inside |= set(range(t.start(), t.end() - 1))
        if t[0].isdigit():
            whole |= {(t.start(), -1), (t.end() - 1, 1)}
    n = end - start
    m, none = n + 2, (len(notice) + 2 * n + 9) * (n + 2)
    fenced = np.frombuffer((text[start - 1 : start] if start else b" ") + text[start:end] + (text[end : end + 1] or b" "), np.uint8)
    digit = (fenced >= 48) & (fenced <= 57)
    chars, steps = fenced[1:-1], np.arange(n + 1, dtype=np.int64) * m
    row = n - np.arange(n + 1, dtype=np.int64)
    for i, c in enumerate(notice):
        same = chars == c
        for side in (-1, 1):
            if (i, side) in whole:
                same = same & ~digit[1 + side : n + 1 + side]
        new = np.concatenate([[none], row[:-1] + np.where(same, 0, none if i in fixed else m)])
        if i not in fixed:
            new = np.minimum(new, row + m)
        if i not in inside:
            new = np.minimum.accumulate(new - steps) + steps
        row = np.minimum(new, none)
    ends = np.flatnonzero(row < (k + 1) * m)
    found: list[tuple[int, int, int]] = []
    for e, b, stop in sorted((int(row[j]) // m, n - int(row[j]) % m, int(j)) for j in ends):
        at = bisect(found, (b,))
        if (at == 0 or found[at - 1][1] <= b) and (at == len(found) or stop <= found[at][0]):
            found.insert(at, (b, stop, e))
    return [(start + b, start + stop, e) for b, stop, e in found]


def fuzzy(text: bytes, notices: dict = NOTICES) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, score) of the notices found in scanned text; spans of one notice do not overlap."""
    found = []
    for notice, label, k, pattern, seeds in _seeds(tuple(notices.items())):
        windows = sorted((max(0, at - o - k), min(len(text), at - o + len(notice) + k)) for o, part in seeds for at in _places(text, part))
        at = 0
        while at < len(windows):
            start, end = windows[at]
            at += 1
            while at < len(windows) and windows[at][0] <= end:
                end = max(end, windows[at][1])
                at += 1
            if pattern.search(text, start, end):
                found += [(a, b, label, n, 1 - n / len(notice)) for a, b, n in spans(text, start, end, notice, k)]
    return sorted(found)


def scan(text: bytes, phrases: dict = PHRASES, notices: dict = NOTICES) -> dict:
    """Words, exact phrase places (start words) and fuzzy spans of one text."""
    words = text.translate(_WORDS).split()
    line = b" ".join(words)
    fenced = b" " + line + b" "
    blanks = np.flatnonzero(np.frombuffer(fenced, np.uint8) == 32)
    before = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  blanks before a place of the fenced line
    base = sorted((before(at), label) for phrase, label in phrases.items() for at in _places(fenced, b" " + phrase.encode() + b" "))
    return {"n_words": len(words), "base": base, "fuzzy": [(before(a + 1) - 1, before(max(a, b - 1) + 1), label, n, s) for a, b, label, n, s in fuzzy(line, notices)]}


def license_scan(docs: DataFrame, phrases: dict | None = None, notices: dict | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and notices.

    base_* come from exact phrases; labels adds those of notices within their edits; score is 1 - edits / length of the
    best match, 1 for an exact phrase, 0 for none; notices is an array of (label, first_word, stop_word, edits).
    Null text is empty: zero words, empty labels, null words. Repeated rows and null ids stay; other columns are ignored.
    """
    known, fuzzed = phrases or PHRASES, notices or NOTICES

    def make():
        def step(batch):
            rows = []
            for text in texts_as_bytes(batch.column(1)):
                r = scan(text, known, fuzzed)
                at, own = [w for w, _ in r["base"]], {label for _, label in r["base"]}
                more = {x[2] for x in r["fuzzy"]}
                score = 1.0 if at else max((x[4] for x in r["fuzzy"]), default=0.0)
                spans = [{"label": x[2], "first_word": x[0], "stop_word": x[1], "edits": x[3]} for x in r["fuzzy"]]
                rows.append((r["n_words"], len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(own)), ",".join(sorted(own | more)), score, spans))
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")
            yield {"doc_id": batch.column(0)} | {k: [r[j] for r in rows] for j, k in enumerate(names)}

        return step

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:long,stop_word:long,edits:long>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)
