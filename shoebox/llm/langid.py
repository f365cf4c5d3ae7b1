"""Language identification by a byte convolutional network written in numpy.

Filters of several widths run over the bytes of fixed-length windows (ASCII letters lower-cased), each filter keeps its
maximum over the window, and a softmax over the maxima gives the language of the window. A text is cut into windows that
cover all of it; its language has the largest mean log-probability. A filter is stored as one table row for each (offset, byte),
so a convolution is a sum of table look-ups.

Training takes a bounded sample: ``docs_per_language`` documents a language on average, fewer where that would
be over ``SAMPLE_DOCUMENTS`` in all, and ``windows_per_doc`` windows each. Every language that has a label is learnt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import columns_of, free_name, held_out, map_batches, texts_as_bytes

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 3
SAMPLE_DOCUMENTS = 80_000
UNKNOWN = "und"
MIN_SCORE = 0.4

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, filters)
    bias: list[np.ndarray]
    dense: np.ndarray  # (filters x widths, labels)
    offset: np.ndarray

    def convolve(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter outputs of width number k: (windows, places, filters)."""
        width = WIDTHS[k]
        places = x.shape[1] - width + 1
        out = self.tables[k][0][x[:, :places]]
        for j in range(1, width):
            out += self.tables[k][j][x[:, j : j + places]]
        return out

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.maximum(self.convolve(x, k).max(axis=1) + self.bias[k], 0) for k in range(len(WIDTHS))])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.dense + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes that cover the text: side by side, the last one ending with it; a short text is padded with spaces."""
    data = np.frombuffer(text.lower().ljust(WINDOW), np.uint8)
    whole = len(data) // WINDOW
    out = data[: whole * WINDOW].reshape(whole, WINDOW)
    return out if whole * WINDOW == len(data) else np.vstack([out, data[-WINDOW:]])


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the cross-entropy of windows ``x`` (n, WINDOW) with label numbers ``y``; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    n_labels = len(labels)
    net = Network(
        labels,
        [rng.normal(0, 0.3 / w**0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_labels)).astype(np.float32),
        np.zeros(n_labels, np.float32),
    )
    params = [*net.tables, *net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(y) / (n_labels * np.maximum(np.bincount(y, minlength=n_labels), 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            xb, yb = x[some], y[some]
            tops, maxima = [], []
            for k in range(len(WIDTHS)):
                c = net.convolve(xb, k)
                top = c.argmax(axis=1)
                tops.append(top)
                maxima.append(np.take_along_axis(c, top[:, None, :], 1)[:, 0, :] + net.bias[k])
            pre = np.hstack(maxima)
            h = np.maximum(pre, 0)
            z = h @ net.dense + net.offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(yb)), yb] -= 1
            g *= (weight[yb] / len(yb))[:, None].astype(np.float32)
            back = (g @ net.dense.T) * (pre > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(net.tables[k])
                columns = np.broadcast_to(np.arange(FILTERS), own.shape)
                for j in range(w):
                    np.add.at(grad[j], (np.take_along_axis(xb, tops[k] + j, 1), columns), own)
                grads.append(grad + 1e-4 * net.tables[k])
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads += [h.T @ g + 1e-4 * net.dense, g.sum(axis=0)]
            step += 1
            for i, (p_, g_) in enumerate(zip(params, grads, strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g_
                second[i] = 0.99 * second[i] + 0.01 * g_ * g_
                p_ -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def sample_windows(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC):
    """Training windows of labelled documents that are not held out: (bytes, label) pairs, bounded in number.

    Documents are chosen by the hash of their id and text against a share of the language's count; a window starts at a
    place given by that hash. Every language is learnt; with very many of them, each has a smaller share of the sample.
    """
    known = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter("lang is not null and text is not null").filter(~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    docs_per_language = max(1, min(docs_per_language, SAMPLE_DOCUMENTS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, docs_per_language / n))])[F.col("lang")]
    mark = F.xxhash64("doc_id", F.lit("train"))
    chosen = known.withColumn("mark", mark).filter(F.pmod("mark", F.lit(1 << 20)) < share * (1 << 20)).filter(F.col("text").rlike(r"\p{L}"))
    length = F.greatest(F.length("text") - WINDOW, F.lit(1))
    places = F.array(*[F.pmod(F.xxhash64("mark", F.lit(i)), length).cast("int") + 1 for i in range(windows_per_doc)])
    cut = chosen.select("lang", "mark", F.explode(F.transform(places, lambda p: F.substring("text", p, F.lit(WINDOW)))).alias("w"))
    most = 2 * docs_per_language * windows_per_doc * len(counts)
    rows = cut.orderBy("mark", "lang", "w").limit(most).collect()
    return [r["w"].encode() for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """The network learnt from ``docs`` (doc_id, text, lang); None if nothing is labelled."""
    texts, langs = sample_windows(docs, docs_per_language, windows_per_doc)
    if not texts:
        return None
    labels = sorted(set(langs))
    x = np.vstack([windows(t)[:1] for t in texts])
    return train(x, np.array([labels.index(v) for v in langs]), labels)


def classify(text: str | None, net: Network | None, batch: int = 2048) -> tuple[str, float]:
    if net is None or not text or not _LETTER.search(text):
        return UNKNOWN, 0.0
    x = windows(text.encode())
    total = sum(net.log_probabilities(x[at : at + batch]).sum(axis=0, dtype=np.float64) for at in range(0, len(x), batch)) / len(x)
    p = np.exp(total - total.max())
    best = int(p.argmax())
    return net.labels[best], float(p[best] / p.sum())


def _classify_batch(texts: list, net: Network | None, most: int = 2048):
    """As ``classify`` for many texts, whose windows share the matrix products."""
    out: list = [None] * len(texts)
    group: list[tuple[int, np.ndarray]] = []

    def flush():
        if group:
            logs = net.log_probabilities(np.vstack([x for _, x in group])).astype(np.float64)
            starts = np.cumsum([0] + [len(x) for _, x in group])[:-1]
            for (i, x), total in zip(group, np.add.reduceat(logs, starts, axis=0), strict=True):
                p = np.exp(total / len(x) - (total / len(x)).max())
                best = int(p.argmax())
                out[i] = (net.labels[best], float(p[best] / p.sum()))
            group.clear()

    size = 0
    for i, text in enumerate(texts):
        if net is None or not text or not _LETTER.search(text):
            out[i] = (UNKNOWN, 0.0)
            continue
        x = windows(text.encode())
        if len(x) > most:
            out[i] = classify(text, net)
            continue
        if size + len(x) > most:
            flush()
            size = 0
        group.append((i, x))
        size += len(x)
    flush()
    return out


def predict(docs: DataFrame, net: Network | None, names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """Adds held_out, lang_pred and score to ``docs``, under other ``names`` if given; existing columns of these names are replaced.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt. Other columns
    and repeated rows pass through; an empty table gives no rows.
    """
    rows = docs.select(*[c for c, name in zip(columns_of(docs), docs.columns) if name.lower() not in names], held_out().alias(names[0]))
    at = rows.columns.index("text")
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(names[1], T.StringType()), T.StructField(names[2], T.DoubleType())])

    def make():
        def step(batch):
            got = _classify_batch(batch.column(at).to_pylist(), net)
            yield {f.name: batch.column(j) for j, f in enumerate(schema.fields[:-2])} | {names[1]: [g[0] for g in got], names[2]: pa.array([g[1] for g in got], pa.float64())}

        return step

    return map_batches(rows, schema, make)


def keep_known(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scored under ``least``; same columns, whatever their names."""
    held, lang, score = (free_name(docs, c) for c in ("held_out", "lang_pred", "score"))
    rows = predict(docs, fit(docs), (held, lang, score))
    return rows.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*columns_of(docs))


def language_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learnt from its rows that are labelled and not held out."""
    net = fit(docs)
    return predict(docs.select(F.col("doc_id").cast("long"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")
