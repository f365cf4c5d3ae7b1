import hashlib

from tokenizers import Tokenizer

from shoebox.llm import decontam, langid, secrets
from shoebox.llm.queries import vocabulary
from tests.llm.test_decontam import brute
from tests.llm.test_secrets import slow_spans
from tests.llm.test_simhash import slow_fingerprint, slow_groups


def test_run_equals_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    net = langid.fit(docs)
    texts = {i: t for i, t in texts.items() if (lambda p: p[0] != "und" and p[1] >= langid.MIN_SCORE)(langid.classify(t, net))}
    groups = slow_groups({i: slow_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute(list(texts.items()), items)}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    tok = Tokenizer.from_file(vocabulary())
    model = secrets.fit_markov(docs.filter(docs.doc_id.isin(list(texts))))
    assert set(got) == set(texts) and 0 < len(texts) < docs.count()
    for i, text in texts.items():
        at, out = 0, ""
        for span in slow_spans(text, model):
            a, b = map(int, span.split(":")[1:])
            if a >= at:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        out += text[at:]
        ids = tok.encode(out, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())


def test_stages_on_edge_rows(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the words of a text that is here", "en", None, 1), (3, "the words of a text that is here", "en", None, 1), (None, "another text of words", "en", "s", 2), (5, "password=abcdefgh in a text", "de", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {3, None, 5}
    one = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert one.columns == docs.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 3, 5]
    clean = {r.doc_id: r for r in corpus_pipeline.no_secrets(spark, docs, "").collect()}
    assert clean[5].text == "[REDACTED] in a text" and clean[5].n_chars == 20 and clean[1].text is None and clean[3].n_chars == 1
    assert corpus_pipeline.token_digests(spark, docs.limit(0), "").count() == 0


def test_stages_leave_every_column_of_the_user(spark):
    import corpus_pipeline
    from shoebox.llm.common import free_name

    names = ["_key", "row_key", "row_key_", "base_spans", "secret_spans", "_base_spans", "_secret_spans", "mark", "Score", "held_out", "lang_pred", "fp", "key", "a.b", "x`y"]
    rows = [(i, " ".join(f"{w}{i}" for w in "the words of one text after another as they stand here with some more".split()) + f" password=abcdefgh{i}", "en", "s", 50, *[f"{n}{i}" for n in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    benchmark = spark.createDataFrame([(1, "an item that is in no document of all these"), (2, rows[3][1])], "item_id long, text string")
    want = {r[0]: r[5:] for r in rows}
    stages = [lambda d: corpus_pipeline.known_language(spark, d, ""), lambda d: corpus_pipeline.one_of_each_group(spark, d, ""), lambda d: decontam.drop_leaked(d, benchmark), lambda d: corpus_pipeline.no_secrets(spark, d, "")]
    for stage in stages:
        out = stage(docs)
        got = out.collect()
        assert out.columns == docs.columns and got and all(tuple(r)[5:] == want[r.doc_id] for r in got)
    assert free_name(docs, "ROW_KEY") == "ROW_KEY__"
