import random

import numpy as np

from shoebox.llm import decontam
from shoebox.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        assert decontam.common_length(a, b) == slow_common(a, b)


def brute(docs, items):
    """Pairs in which some stretch of a document of the item's length holds 0.8 of the item's words in order."""
    out = set()
    split = {i: decontam.words_of((t or "").encode()) for i, t in items}
    for d, t in docs:
        words = decontam.words_of((t or "").encode())
        have = set(words)
        for i, item in split.items():
            if item and sum(w in have for w in item) >= 0.8 * len(item) and decontam.common_length(item, words) >= 0.8 * len(item):
                step = max(1, len(item) // 8)
                if any(decontam.common_length(item, words[s : s + len(item) + step]) >= 0.8 * len(item) for s in range(0, max(1, len(words) - len(item) + 1), step)):
                    out.add((d, i))
    return out


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    want = brute(docs, items)
    assert len(want) > 5 and len(got & want) >= 0.9 * len(want) and got == want | (got - want)
    assert len({d for d, _ in got - want}) <= 0.002 * len(docs)


def test_paraphrases_and_edge_rows(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60)), "x") for i in range(30)] + [(90, None, "x"), (91, "", "x"), (None, items_text := text(40), "x"), (92, text(6), "x")]
    docs = [(i, text(rng.randrange(5, 400)), 0.1) for i in range(300)] + [(900, None, 0.1), (901, "", 0.1), (None, text(30) + " " + items_text, 0.1)]
    leaked = set()
    for i in range(30):
        words = items[i][1].split()
        for j in rng.sample(range(len(words)), len(words) // 6):  # a paraphrase: some words replaced
            words[j] = rng.choice(vocab)
        docs.append((1000 + i, text(70) + " " + " ".join(words).upper() + ". " + text(50), 0.1))
        leaked.add((1000 + i, i))
    docs.append((2000, text(300) + " " + items[-1][1] + " " + text(30), 0.1))
    d = spark.createDataFrame(docs, "doc_id long, text string, cosine double")
    b = spark.createDataFrame(items, "item_id long, text string, answer string")
    for size in (256, 10):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, b, size).collect()}
        assert len(leaked & got) >= 0.9 * len(leaked) and (None, None) in got and (2000, 92) in got
        assert {x for x, _ in got} <= {x for x, _ in leaked} | {None, 2000}
    clean = decontam.drop_leaked(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} >= {i for i in range(300)} | {900, 901}
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def test_latent_space_spans_the_largest_directions(spark):
    rng = np.random.default_rng(1)
    vocab = {b"w%d" % i: i for i in range(60)}
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 60, 25)) for _ in range(80)]
    basis = decontam.latent_space(spark.createDataFrame([(t,) for t in texts], "text string"), vocab, np.ones(60, np.float32), 40)
    a = decontam._dense([decontam._cut(decontam.words_of(t.encode()), vocab)[0] for t in texts], np.ones(60, np.float32))
    s = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a @ basis) ** 2 > 0.999 * (s[:40] ** 2).sum()


def test_an_item_in_half_of_all_documents(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(20, 50))) for i in range(8)]
    docs = [(i, text(40) + " " + (items[0][1] if i % 2 else text(30)) + " " + text(40)) for i in range(80)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 80, 2)}


def test_every_window_of_an_item_is_verified(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [words(59) for _ in range(6)]
    rewritten = list(items[0])
    for j in range(0, 59, 4):
        rewritten[j] = rng.choice(vocab)
    text = " ".join(words(48) + items[0][:32] + words(400) + rewritten + words(100))
    docs = [(0, text)] + [(i, " ".join(words(200))) for i in range(1, 60)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 0)] and got[0].common_share >= 0.7 and got[0].first_word > 300


def test_rare_neighbours_do_not_hide_an_item_of_common_words(spark):
    rng = random.Random(9)
    made = iter(range(10**6))
    rare = lambda n: [f"rare{next(made)}x" for _ in range(n)]
    common, other = [f"word{i}" for i in range(16)], rare(16)
    docs = [(i, " ".join(common[::-1] + rare(30))) for i in range(60)]
    docs += [(100, " ".join(rare(32) + common + rare(32))), (101, " ".join(other + common + other)), (102, " ".join(rare(200)))]
    rng.shuffle(docs)
    items = spark.createDataFrame([(1, " ".join(common)), (2, " ".join(other))], "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 1), (101, 1), (101, 2)} and all(r.common_share == 1 for r in got)


def planted(share, clauses, seed):
    """Documents with one item each, rewritten, between 60 words of the same vocabulary on either side; and as many without."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    words = lambda n: [vocab[int(len(vocab) * rng.random() ** 2)] for _ in range(n)]  # noqa: E731  some words are common
    items, docs = [words(rng.randrange(24, 60)) for _ in range(60)], []
    for i, item in enumerate(items):
        text = list(item)
        for j in rng.sample(range(len(text)), round(share * len(text))):
            text[j] = words(1)[0]
        if clauses:
            parts = [text[a : a + 8] for a in range(0, len(text), 8)]
            rng.shuffle(parts)
            text = [w for p in parts for w in p]
        docs += [(i, " ".join(words(60) + text + words(60))), (1000 + i, " ".join(words(160)))]
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)]


def test_recall_of_rewritten_items(spark):
    for share, clauses in ((0.1, False), (0.2, False), (0.35, False), (0.0, True)):
        docs, items = planted(share, clauses, 11)
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert len(got & {(i, i) for i in range(60)}) >= 57 and not got - {(i, i) for i in range(60)}


def test_clauses_in_any_order():
    item = [b"w%d" % i for i in range(24)]
    assert decontam.clause_share(item, [b"x"] * 5 + item[8:16] + item[:8] + [b"y"] + item[16:]) == 1
    assert decontam.clause_share(item, item[:8] + [b"x"] * 40) == 8 / 24
    spread = [w for x in item for w in (x, b"a", b"b", b"c", b"d")]
    assert decontam.clause_share(item, spread) == 0 and decontam.common_length(item, spread) == 24
