import math
import zlib

import numpy as np

from shoebox.llm import langid, quality
from shoebox.llm.common import held_out
from shoebox.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    test = [(rows[i].predicted, q) for i, q in labels.items() if held(i)]
    assert np.mean([p == q for p, q in test]) > 0.97 and len(test) > 50


def test_density_equals_the_formula():
    rng = np.random.default_rng(0)
    x = {k: np.hstack([np.ones((300, 1)), rng.normal(k, 1 + k, (300, quality.N_STATISTICS))]) for k in (0, 1)}
    model = quality.fit({k: v.T @ v for k, v in x.items()}, 0.0, 0.0)
    z = rng.normal(0, 1, (20, quality.N_STATISTICS))
    dens = []
    for k in (0, 1):
        c = np.cov(x[k][:, 1:].T, bias=True) + 1e-4 * np.eye(quality.N_STATISTICS)
        d = z - x[k][:, 1:].mean(axis=0)
        dens.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.score(z), 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-8)


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "a b", 0.5), (4, "word " * 20000, 0.5), (4, "word " * 20000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_languages_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == v for i, v in langs.items() if held(i)]) > 0.97


def test_language_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "12 !?", "x"), (None, "é", "x"), (4, "a" * 300000, None), (4, "b", "y")], "doc_id long, text string, lang string")
    rows = langid.language_ids(docs).collect()
    assert len(rows) == 5 and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert all(r.lang_pred in ("x", "y") for r in rows if r.doc_id in (None, 4))
    assert {r.lang_pred for r in langid.language_ids(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("doc_id = 9")).collect()} == set()
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    docs = spark.range(920).selectExpr("id doc_id", "concat('l', id % 230) lang", "concat('text of ', id % 230) text")
    x, y = langid.sample_windows(docs, windows_per_doc=1)
    known = {r.lang for r in docs.filter(~held_out()).select("lang").distinct().collect()}
    assert set(y) == known and len(known) > 200 and len(x) == len(y) == docs.filter(~held_out()).count()


def test_convolution_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (4, 20), np.uint8)
    net = langid.train(x, np.array([0, 1, 0, 1]), ["a", "b"], epochs=2, batch=2)
    for k, width in enumerate(langid.WIDTHS):
        want = np.zeros((4, 20 - width + 1, langid.FILTERS))
        for i in range(4):
            for at in range(20 - width + 1):
                hot = np.zeros((width, 256))
                hot[np.arange(width), x[i, at : at + width]] = 1
                want[i, at] = np.tensordot(hot, net.tables[k], 2)
        assert np.allclose(net.convolve(x, k), want, atol=1e-5)


def test_windows_cover_the_text():
    for n in (0, 1, 127, 128, 129, 1000):
        text = bytes(np.random.default_rng(n).integers(97, 122, n, np.uint8))
        w = langid.windows(text)
        assert w.shape == (max(1, -(-n // 128)), 128) and bytes(w[0][: min(n, 128)]) == text[:128] and (n < 128 or bytes(w[-1]) == text[-128:])
    net = langid.train(langid.windows(b"abc" * 900), np.zeros(22, int), ["l"], epochs=1)
    texts = ["abc", None, "zz " * 90000, "é"]
    for a, b in zip(langid._classify_batch(texts, net), [langid.classify(t, net) for t in texts]):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6


def plain_statistics(text):
    """The 16 statistics, character class by character class and word by word."""
    kinds = {}
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c", b"!?", b".,;:'\"()-", b"#$%&*@^~|<>[]{}=+_\\/`")):
        kinds |= dict.fromkeys(chars, k)
    n, seen = len(text), [0] * 8
    for c in text:
        seen[kinds.get(c, 7)] += 1
    prior = [0.02, 0.75, 0.01, 0.15, 0.001, 0.03, 0.002, 0.02]
    out = [math.log((s + 40 * p) / (n + 40)) for s, p in zip(seen, prior)]
    words, lines = text.split(), text.split(b"\n")
    entropy = -sum(text.count(bytes([c])) / n * math.log(text.count(bytes([c])) / n) for c in set(text)) if n else 0.0
    count = len(words)
    capital = sum(w[:1].isupper() for w in words)
    symbol = sum(w[-1] < 128 and not w[-1:].isalnum() for w in words)
    return out + [
        math.log((n - seen[3] + 50) / (count + 10)), math.log((len(set(words)) + 8) / (count + 8)), math.log((len(set(lines)) + 4) / (len(lines) + 4)),
        math.log((len(lines) + 1) / (n + 300)), (entropy * n + 2.9 * 40) / (n + 40), math.log((capital + 1) / (count + 10)), math.log((symbol + 1) / (count + 10)), math.log(n + 50),
    ]


def test_quality_scores_equal_the_plain_discriminant(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = {i: np.array(plain_statistics(t)) for i, t in docs.items()}
    own = {k: np.array([x[i] for i, q in labels.items() if q == k and not held(i)]) for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(len(own[k]) * cov[k] for k in (0, 1)) / sum(map(len, own.values()))
    log = {}
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
        log[k] = {i: -0.5 * ((v - own[k].mean(0)) @ np.linalg.inv(c) @ (v - own[k].mean(0)) + np.linalg.slogdet(c)[1]) for i, v in x.items()}
    prior = math.log((len(own[1]) + 1) / (len(own[0]) + 1))
    rows = {r.doc_id: r.score for r in QUERIES["op1_quality_classifier"](spark, SF).collect()}
    assert all(abs(rows[i] - 1 / (1 + math.exp(-max(-500, min(500, log[1][i] - log[0][i] + prior))))) < 1e-6 for i in docs)
