import random

import numpy as np
import xxhash

from shoebox.llm import simhash


def slow_fingerprint(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table(spark, sf):
    from shoebox.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_near_dedup"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    groups = slow_groups(fps)
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in texts}
    assert len(set(groups.values())) < len(groups)


def test_edge_rows(spark):
    rows = [(3, None), (4, ""), (5, " \t\n"), (6, "One two"), (7, "one two"), (7, "one two"), (None, "one TWO"), (None, "x y z w v"), (9, "É a b c d " * 3000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(df).collect()), key=str)
    want = [(i, f"{slow_fingerprint(t):016x}", {3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 9: 9}.get(i, 6 if "T" in (t or "") else None)) for i, t in rows]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0


def test_links_in_split_buckets_and_uneven_bits(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(20) << 30  # many bits that never vary
        for _ in range(60):
            fps.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**63 - 1))
    ids = sorted(fps)
    want = slow_groups({f: f for f in ids})
    df = spark.createDataFrame([(f,) for f in ids], "fp long")
    for size in (8192, 7):
        links = [(r.u, r.v) for r in simhash.near_links(df, 4, size).collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
        root = {f: f for f in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert {f: find(f) for f in ids} == want


def test_one_row_of_each_group(spark):
    text, other = "the words of a text that is here", "quite another text with words of its own"
    rows = [(7, text, "a"), (1, text, "b"), (1, text, "b"), (1, other, "b"), (None, text, "c"), (None, "a text without any id at all", "d"), (None, "a text without any id at all", "e"), (3, "", None), (4, None, "x"), (2, other, "f"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    want = None
    for parts in (1, 5):
        got = [tuple(r) for r in simhash.one_of_each_group(df.repartition(parts)).collect()]
        assert sorted((r[0] or 0, r[1] or "") for r in got) == [(0, "a text without any id at all"), (1, other), (1, text), (3, "")]
        assert want in (None, sorted(map(repr, got)))
        want = sorted(map(repr, got))
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 9, 30], [0, 4, 20, 50], [0, 1, 2, 3]]
    cost, picks = simhash.allocate(costs, 2)
    assert (cost, sum(picks)) == (3, 2) or sum(picks) == 2
    best = min(sum(c[t + 1] for c, t in zip(costs, p)) for p in np.ndindex(4, 4, 4) for p in [tuple(x - 1 for x in p)] if sum(p) == 2)
    assert cost == best


def test_rows_that_probe_a_bucket_count_for_its_size(spark):
    rng = np.random.default_rng(4)
    fps = np.unique((rng.random((4000, 24)) < np.linspace(0.02, 0.5, 24)) @ (1 << np.arange(24, dtype=np.int64)))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    parts, balls = [list(range(8)), list(range(8, 24))], {0: simhash._ball(8, 1), 1: simhash._ball(16, 2)}
    counts = simhash.value_counts(df, [parts])
    got = {r.key: r.blocks for r in simhash.hot_keys(counts, balls, 150).collect()}
    want = {}
    for k, part in enumerate(parts):
        values, n = np.unique((simhash._values(fps, part)[:, None] ^ balls[k][None]).ravel(), return_counts=True)
        want |= {int(v) | k << 48: -(-int(c) // 150) for v, c in zip(values, n) if c > 150}
    assert got == want and len({x >> 48 for x in want}) == 2
    assert simhash.hot_keys(counts, {}, 150) is None
