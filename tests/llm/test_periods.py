import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from shoebox.llm import periods
from shoebox.llm.queries import QUERIES


def plain_runs(w):
    """All runs of a list of words: every lag, every stretch, kept where no smaller period covers it."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *told, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def told(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def odd_words(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(4)
        if kind == 0:
            out += [str(rng.randrange(400)) for _ in range(rng.randrange(30))]
        elif kind == 1:
            out += [rng.choice("ab") for _ in range(rng.randrange(60))]
        else:
            unit = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 40]))]
            out += (unit * 9)[: rng.randrange(len(unit) * 8 + 1)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(6)
    cases = [odd_words(rng) for _ in range(400)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, ["a", "b"] * 300, ["a", "b"] * 4, ["a", "b", "a"] * 4]
    found = periods.find_runs([" ".join(c).encode() for c in cases])
    for words, (n, runs) in zip(cases, found):
        assert n == len(words) and runs == plain_runs(words)
    assert sum(len(r) for _, r in found) > 300


def test_splitting_leaves_every_run_and_only_frequent_words():
    rng = random.Random(7)
    for _ in range(100):
        words = odd_words(rng)
        ids = np.unique(np.array(words, dtype="U8"), return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        left = set(periods.split_by_frequency(ids, np.zeros(len(ids), np.int64)).tolist())
        assert all(set(range(s, s + k)) <= left for s, k, _ in plain_runs(words))
        places = sorted(left)
        for part in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1) if places else []:
            assert np.unique(ids[part], return_counts=True)[1].min() >= periods.PERIODS and len(part) >= periods.LEAST


def test_very_long_texts():
    rng = random.Random(8)
    unit = [str(rng.randrange(50)) for _ in range(3001)]
    noise = [str(rng.randrange(300)) for _ in range(100_000)]
    text = " ".join([*noise, *(unit * 6)[:15_000], *noise, *["x"] * 200_000, "y", *["x"] * 7])
    n, runs = periods.find_runs([text.encode()])[0]
    assert n == 415_008 and {(k, q) for _, k, q in runs if k > 6} >= {(200_000, 1), (7, 1)}
    assert [q for _, k, q in runs if k >= 15_000] == [3001, 1]
    kept = periods.collapse(text.encode(), n, runs).split()
    assert kept.count(b"x") == 2 and len(kept) == n - len({i for s, k, q in runs for i in range(s + q, s + k)})


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: told(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got == {i: plain_report(i, t) for i, t in docs.items() if len((t or "").split()) < 3000} | {i: v for i, v in got.items() if len((docs[i] or "").split()) >= 3000}
    assert set(got) == set(docs) and sum(v[0] for v in got.values()) > 5


def test_edge_rows(spark):
    rng = random.Random(9)
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:12] + [None, None, 1, 2, 2, 3, 4, 5]
    odd = ["", " \t\n", "one", "a\x0bb\x0ca\rb", "é　é \xa0 é", None]
    texts = [" ".join(str(rng.randrange(30)) for _ in range(rng.randrange(200))) for _ in ids[:-6]] + odd
    texts[:5] = ["", None, "one", " two  words ", "\n a b  c\td e f g h i j"]
    df = spark.createDataFrame([(i, t, 5, [1]) for i, t in zip(ids, texts)], "doc_id long, text string, _n int, runs array<int>")
    key = lambda x: tuple(str(y) for y in x)
    got = sorted(((r.doc_id, *told(r)) for r in periods.run_report(periods.periodic_runs(periods.plant_periods(df))).collect()), key=key)
    assert got == sorted(((i, *plain_report(i, t)) for i, t in zip(ids, texts)), key=key)
    assert periods.run_report(periods.periodic_runs(periods.plant_periods(df.limit(0)))).count() == 0
