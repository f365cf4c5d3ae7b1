import hashlib
import random
import re
import string
import uuid

from pyspark.sql import functions as F

from shoebox.llm import secrets
from shoebox.llm.queries import QUERIES

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def slow_base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def slow_ratio(value, model):
    place = lambda c: secrets.ALPHABET.index(c) + 1 if c in secrets.ALPHABET else 0
    width, pairs = len(secrets.ALPHABET) + 1, list(zip(value, value[1:]))
    return sum(model.ratios[place(a) * width + place(b)] for a, b in pairs) / len(pairs)


def slow_spans(text, model):
    text, spans = text or "", [x.split(":") for x in slow_base(text)]
    spans = [(int(a), ("assign", "access", "hex").index(k), k, int(b)) for k, a, b in spans]
    base = list(spans)
    for m in re.finditer(secrets.CANDIDATE, text):
        if slow_ratio(m[1], model) > model.threshold and not re.match(secrets.UUID, m[1]) and not any(a < m.end() and m.start() < b for a, _, _, b in base):
            spans.append((m.start(), 3, "markov", m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


def check(rows, texts, model):
    for r in rows:
        base = slow_base(texts[r.doc_id])
        n = [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert [r.n_assign, r.n_access, r.n_hex] == n
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x] == slow_spans(texts[r.doc_id], model)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_secret_scans"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and sum(r.n_assign for r in rows) > 0
    check(rows, texts, secrets.fit_markov(spark.read.parquet(f"{sf}/documents.parquet")))


def test_planted_secrets_that_no_base_rule_finds(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.filter("lang = 'en' and n_chars between 50 and 3000").orderBy("doc_id").limit(600).collect()]
    words = re.findall("[a-z]{3,}", " ".join(texts))
    letters = string.ascii_letters + string.digits
    ordinary = lambda: rng.choice([
        "_".join(rng.sample(words, 4)), "/".join(f"{rng.choice(words)}{rng.randrange(100)}" for _ in range(4)), "".join(w.title() for w in rng.sample(words, 4)) + str(rng.randrange(2000)),
        str(uuid.UUID(int=rng.getrandbits(128))), "-".join([*rng.sample(words, 3), "v2", "20240131"]), "_".join(rng.sample(words, 4)).upper(), "0123456789" * 2 + str(rng.randrange(9999)),
    ])
    rows, keys = [], {}
    for i, t in enumerate(texts):
        keys[i] = i % 2 == 0
        value = "".join(rng.choice(letters) for _ in range(rng.randrange(24, 48))) if keys[i] else ordinary()
        rows.append((i, f"see {value} there {t}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: "markov:4:" in r.spans for r in secrets.secret_scan(df, model=secrets.fit_markov(docs)).collect()}
    found = sum(got[i] for i in got if keys[i]) / sum(keys.values())
    false = sum(got[i] for i in got if not keys[i]) / (len(keys) - sum(keys.values()))
    print("found", found, "false", false)
    assert found >= 0.95 and false <= 0.02


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [(None, f"word{i} text of some-kind {i}") for i in range(40)] + [(1, "same text in here")] * 30
    schema = "doc_id long, text string"
    a, b = (spark.createDataFrame(r, schema).repartition(p) for r, p in ((rows, 1), (rows[::-1], 5)))
    assert secrets.fit_markov(a, 9) == secrets.fit_markov(b, 9)


def test_edge_rows_and_markov(spark):
    ordinary = " ".join(["configuration_manager", "the_quick_brown_fox_jumps", "internationalization", "responsibility", "counterrevolutionaries"] * 20)
    texts = {
        1: None, 2: "", 3: "é token = 'a' secret=token: abcdef PASSWORD:\"x.y-z_/+=9\" 日本 apikey=1234567 😀 api_key = abcdef",
        4: "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA", 5: "f" * 23 + " " + "0" * 24 + "g", 6: "x" * 30000 + " password=hunter22 ",
        7: ordinary, 8: "look: qZ7xV9bK2mW4tR8yP1sD and internationalization_responsibility here", 9: "passwd=aaaaaa" * 3,
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, base_spans int")
    model = secrets.fit_markov(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = secrets.secret_scan(df, model=model).collect()
    check(rows, texts, model)
    by = {r.doc_id: r.spans for r in rows}
    assert by[8] == "markov:6:26" and by[7] == "" and by[1] == by[2] == ""
    assert secrets.secret_scan(df.limit(0)).count() == 0
    ordinary_rows = spark.createDataFrame([(w,) for w in ordinary.split()[:5]], "w string").select(secrets.mean_ratio(F.col("w"), model.ratios).alias("x"))
    assert max(r.x for r in ordinary_rows.collect()) < model.threshold
    clean = {r.doc_id: r.text for r in secrets.redact(df, model=model).collect()}
    assert clean[8] == "look: [REDACTED] and internationalization_responsibility here" and clean[7] == ordinary and clean[1] is None
    assert clean[9].count("[REDACTED]") == len(slow_base(texts[9])) and "hunter22" not in clean[6] and len(clean[6]) > 30000
    assert secrets.redact(df).columns == df.columns


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op10_secret_scans"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
