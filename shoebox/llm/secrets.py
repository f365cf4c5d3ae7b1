"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. Further spans come from two character Markov models,
one of random strings and one of ordinary identifiers: a long run of key-like characters is a secret where the mean
log-likelihood ratio of its character pairs passes a threshold. Both models are trained from labelled samples of a bounded number of
documents. Random: values that the base rules find, and digests in hexadecimal and base 64. Ordinary: all other runs of key-like
characters, and identifiers made of neighbouring words (snake and camel case, paths, numbers behind words). A quarter of
the samples is held out to set the threshold.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from shoebox.llm.common import columns_of, free_name
from shoebox.session import materialize

#: The base rules (kind, pattern, group whose length counts, least length), in the order of kinds.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,})"
#: Runs of a text that train the ordinary class, where they do not touch a base value.
ORDINARY = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{4,})(?![A-Za-z0-9+/_-])"
#: Identifiers by their format, never a Markov span.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
LONG = 20  # characters of a candidate
THRESHOLD = 2.0  # mean log-likelihood ratio a pair, in nats, where no held-out sample tells it
SAMPLE_DOCUMENTS = 2000  # of each kind, for training


class Markov(NamedTuple):
    """Log-likelihood ratio (random over ordinary) of each pair of alphabet places, and the mean above which a run is a secret."""

    ratios: list[float]
    threshold: float


_SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches as (start, stop, kind, value) in code points, those with a short group dropped.

    The pieces between matches and the matches' own lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        out = F.when(F.length(x["value"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.when(x["whole"].isNull(), acc).otherwise(F.struct(stop.alias("at"), out.alias("out")))

    return F.when(text.rlike(pattern), F.aggregate(parts, empty, add, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """All spans of the base rules, by start, then kind as listed."""
    return F.array_sort(F.concat(*[matches(text, p, g, n, k) for k, (_, p, g, n) in enumerate(RULES)]))


def _pairs(value: Column) -> Column:
    """Alphabet places of neighbouring characters as one number; a character outside the alphabet has place 0."""
    codes = F.transform(F.split(value, ""), lambda c: F.when(F.length(c) == 1, F.instr(F.lit(ALPHABET), c)).otherwise(0))
    size = F.size(codes)
    width = len(ALPHABET) + 1
    return F.zip_with(F.slice(codes, 1, F.greatest(size - 1, F.lit(0))), F.slice(codes, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: a * width + b)


def labelled_sample(docs: DataFrame, n: int) -> DataFrame:
    """(value, label, held_out): label 1 random, 0 ordinary.

    Documents are those with the least hashes of id and text; equal rows count once, so ties do not matter. Random values come
    from n documents in which the base rules find any, and from the digests of n documents' hashes; ordinary ones from the texts of
    these n. The bound of the hashes is found on the hashes alone, so no task gathers whole texts."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").withColumn("mark", F.xxhash64("doc_id", "text"))
    found = rows.filter(F.greatest(*[F.col("text").rlike(p) for _, p, _, _ in RULES])).select("mark", base_spans(F.col("text"))["value"].alias("values"))
    random = found.orderBy("mark", "values").limit(n).select(F.explode("values").alias("value"), F.lit(1).alias("label"))
    bound = rows.select("mark").distinct().orderBy("mark").limit(n).agg(F.max("mark")).first()[0]
    some = rows.limit(0) if bound is None else rows.filter(F.col("mark") <= bound).dropDuplicates(["mark"])
    digest = F.sha2(F.col("mark").cast("string").cast("binary"), 256)
    digests = F.array(digest, F.upper(digest), F.translate(F.base64(F.unhex(digest)), "=", ""))
    made = some.select(F.explode(digests).alias("value"), F.lit(1).alias("label"))
    plain = some.select(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(1)).alias("words"), base_spans(F.col("text"))["value"].alias("known"))
    both = F.arrays_zip("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))
    plain = plain.select(F.explode(both).alias("x"), "known").select(F.col("x.words").alias("word"), F.col("x.next").alias("next"), "known")
    apart = lambda w: ~F.exists("known", lambda k: F.contains(w, k) | F.contains(k, w))
    made_of = F.when(apart(F.col("next")), _identifier(F.col("word"), F.col("next")))
    plain = plain.filter(apart(F.col("word"))).select(F.explode(F.array_compact(F.array("word", made_of))).alias("value"), F.lit(0).alias("label"))
    return random.unionByName(made).unionByName(plain).withColumn("held_out", F.pmod(F.xxhash64("value"), F.lit(4)) == 0)


def _identifier(a: Column, b: Column) -> Column:
    """An identifier of two neighbouring words; null for three of four pairs."""
    turn = F.pmod(F.xxhash64(a, b), F.lit(2000))
    number = (turn % 97).cast("string")
    forms = [
        F.concat(a, F.lit("_"), b, F.lit("_"), number), F.concat(F.lower(a), F.initcap(b), F.initcap(a), number), F.concat(a, number, F.lit("/"), b, number, F.lit("/"), a),
        F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(b, F.lit("-v"), number, F.lit("-"), a, (turn + 1000).cast("string")),
    ]
    return F.when((turn % 4 == 0) & b.isNotNull(), F.get(F.array(*forms), ((turn / 4).cast("int") % len(forms))))


def fit_markov(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Markov:
    """Both models and the threshold from ``labelled_sample``.

    An unseen pair counts 1 for random strings (a uniform prior) and 0.1 for ordinary ones. The threshold is half way between what
    one in a thousand of the held-out ordinary runs and all but one in a hundred of the held-out random ones pass; never below
    the former. A corpus without ordinary samples gives a table of zeros (no further spans).
    """
    sample = materialize(labelled_sample(docs, sample_documents), "secret-samples")
    seen = sample.filter("not held_out").select("label", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    width = len(ALPHABET) + 1
    counts = {0: [0.1] * width * width, 1: [1.0] * width * width}
    total = {0: 0, 1: 0}
    for r in seen.collect():  # at most 2 x 67 x 67 rows
        counts[r["label"]][r["pair"]] += r["n"]
        total[r["label"]] += r["n"]
    if not total[0]:
        return Markov([0.0] * width * width, THRESHOLD)
    out, neutral = [], {0, *(ALPHABET.index(c) + 1 for c in "+/_-")}  # word separators and repeats say nothing
    for a in range(width):
        one, none = (counts[k][a * width : (a + 1) * width] for k in (1, 0))
        p, q = sum(one), sum(none)
        out += [0.0 if a == b or a in neutral or b in neutral else round(math.log(x / p) - math.log(y / q), 6) for b, (x, y) in enumerate(zip(one, none, strict=True))]
    scored = sample.filter(F.col("held_out") & (F.length("value") >= LONG)).select("label", mean_ratio(F.col("value"), out).alias("x"))
    at = lambda label, share: F.percentile(F.when(F.col("label") == label, F.col("x")), F.lit(share))
    low, high = scored.agg(at(0, 0.999), at(1, 0.01)).first()
    if low is None or high is None:
        return Markov(out, THRESHOLD)
    return Markov(out, round(max(low, (low + high) / 2), 6))


def mean_ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs; 0 for less than two characters."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    pairs = _pairs(value)
    total = F.aggregate(pairs, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda acc, p: F.struct((acc["sum"] + F.get(ratios, p)).alias("sum"), (acc["n"] + 1).alias("n")), lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(0.0))
    return total


def with_spans(docs: DataFrame, model: Markov, base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """Adds two columns to a table with a text column: the base rules' spans, and these with the Markov spans.

    Spans are (start, stop, kind, value) in code points, kind an index of KINDS; a Markov span that overlaps a base span
    is left out, and a UUID is none. Null text has none. All columns pass through; existing columns of the two names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr(f"cast(array() as {_SPAN})")
    secret = lambda x: (mean_ratio(x["value"], model.ratios) > model.threshold) & ~x["value"].rlike(UUID)
    likely = F.filter(matches(text, CANDIDATE, 1, LONG, KINDS.index("markov")), secret)
    out = docs.withColumns({base: base_spans(text), spans: likely})
    apart = F.when(F.size(spans) == 0, none).otherwise(
        F.filter(F.col(spans), lambda x: ~F.exists(F.col(base), lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    )
    return out.withColumn(spans, F.array_sort(F.concat(F.col(base), apart)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, model: Markov | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Null text is empty (no spans, the hash of an empty string). Repeated rows and null ids stay; an empty table gives no
    rows; other columns are ignored.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), model or fit_markov(docs, sample_documents))
    count = lambda k: F.size(F.filter(F.col("base_spans"), lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, mark: str = "[REDACTED]", model: Markov | None = None) -> DataFrame:
    """``docs`` with every found span of its texts replaced by ``mark``; same columns, n_chars follows if it is there.

    Overlapping spans give one mark. Texts without spans, null ones included, are unchanged.
    """
    base, spans = free_name(docs, "base_spans"), free_name(docs, "secret_spans")
    found = with_spans(docs, model or fit_markov(docs, sample_documents), base, spans)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc, x):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.when(x["start"] >= acc["at"], F.struct(x["stop"].alias("at"), kept.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(F.col(spans), start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns_of(docs))
