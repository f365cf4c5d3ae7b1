import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from shoebox.llm import suffix_dedup
from shoebox.llm.queries import QUERIES


def slow(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - least + 1):
            k = hash(t[i : i + least])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[hash(t[i : i + least])] > 1:
                gone[i : i + least] = True
        turns = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(t), int(gone.sum()), int((turns > 0).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=24).map(str.encode), st.integers(0, 8), st.integers(0, 2)), min_size=1, max_size=14), st.integers(1, 6), st.integers(1, 5))
def test_column_wise_construction(rows, least, block_rows):
    rows = sorted({(g, s, min(lead, len(s) - 1)) for s, lead, g in rows if len(s) >= least})
    if not rows:
        return
    group, strings, lead = (list(x) for x in zip(*rows))
    places = {}
    for i, (g, s, before) in enumerate(rows):
        for o in range(len(s) - least + 1):
            places.setdefault((g, o - before, s[o : o + least]), []).append((i, o))
    want = sorted(x for v in places.values() if len(v) > 1 for x in v)
    windows = np.array([len(s) - least + 1 for s in strings])
    hits = suffix_dedup.repeated_windows(strings, np.array(lead), windows, np.array(group), least, block_rows)
    assert sorted(zip(*(x.tolist() for x in np.nonzero(hits)))) == want


def test_segments_cover_every_window_once():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab \xc3\xa9") for _ in range(n)) for n in (0, 199, 200, 201, 5000, 1, 150_000, 200)] + [b"x" * 3000]
    for span in (85, 1):
        text, first, count, lead, core = suffix_dedup.segments(texts, 200, span)
        assert count.max() <= span and len(core) == len(text)
        for i, t in enumerate(texts):
            own = text == i
            at = np.concatenate([np.arange(a, a + c) for a, c in zip(first[own], count[own])]) if own.any() else np.zeros(0)
            assert at.tolist() == list(range(max(0, len(t) - 199)))
        # every window of a segment holds the core whole
        assert ((lead >= count - 1) & (lead + 200 - span + 1 <= 200)).all()


def test_equal_windows_have_equal_cores():
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(700))
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(400))) + passage + bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(400))) for _ in range(9)]
    text, first, count, lead, core = suffix_dedup.segments(texts)
    seen = {}
    for t, a, n, before, c in zip(text.tolist(), first.tolist(), count.tolist(), lead.tolist(), core.tolist()):
        for w in range(n):
            seen.setdefault(texts[t][a + w : a + w + 200], set()).add((c, before - w))
    assert all(len(v) == 1 for v in seen.values()) and any(passage[i : i + 200] in seen for i in range(501))


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, slow([d.text for d in docs], 200))]
    assert rows_of(QUERIES["op2_suffix_dedup"](spark, sf)) == sorted(want, key=str) and sum(x[2] for x in want) > 0


def test_edge_rows_and_large_collections(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(30), text(90)
    texts = [None, "", "short", "x" * 5000, "ab" * 300, passage, passage, text(60000)]
    texts += [text(rng.randrange(60)) + line + text(rng.randrange(60)) for _ in range(40)]
    texts += [text(20) + passage + text(20) + passage[: rng.randrange(150, 400)] for _ in range(20)]
    docs = [(i if i != 4 else None, t, 3) for i, t in enumerate(texts)] + [(9, texts[9], 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_bytes int")
    want = sorted(((d[0], *x) for d, x in zip(docs, slow([d[1] for d in docs], 200))), key=str)
    for most, size in ((4096, 1 << 19), (5, 2000)):
        assert rows_of(suffix_dedup.remove_repeats(df, 200, most, size)) == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
