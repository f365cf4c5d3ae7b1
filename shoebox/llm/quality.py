"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a fixed number of statistics (shares of byte classes, word and line shape, repetition, entropy), as logs of
smoothed shares, so that very short texts stay near the prior. From labelled documents each class gets a mean and a
covariance, shrunk towards the pooled one and towards its own diagonal; their Cholesky factors are kept. The score is the logistic
of the difference of the two log-densities (Mahalanobis distance and determinant from the factor) and the log prior.

Sums of statistics and of their products are reduced per task and then by key; the driver sees 2 x d x d numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import held_out, map_batches, texts_as_bytes
from shoebox.session import materialize

CUT = 0.7
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.1

_CLASS = np.full(256, 7)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c", b"!?", b".,;:'\"()-", b"#$%&*@^~|<>[]{}=+_\\/`")):
    _CLASS[list(_chars)] = _k
#: Prior share of each byte class and the weight, in bytes, that it has.
_PRIOR, _WEIGHT = np.array([0.02, 0.75, 0.01, 0.15, 0.001, 0.03, 0.002, 0.02]), 40.0
N_STATISTICS = 16


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one text; those of an empty text are the prior's."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, counts, 8)
    shares = np.log((classes + _WEIGHT * _PRIOR) / (n + _WEIGHT))
    words = text.split()
    lines = text.split(b"\n")
    distinct, forms = len(set(words)), len(set(lines))
    p = counts[counts > 0] / max(n, 1)
    entropy = (-(p * np.log(p)).sum() * n + 2.9 * _WEIGHT) / (n + _WEIGHT)
    # distinct words fall with length by themselves; the log of the count takes that out
    variety = np.log((distinct + 8.0) / (len(words) + 8.0))
    capital = sum(1 for w in words if w[:1].isupper())
    symbols = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    more = (
        np.log((n - classes[3] + 50.0) / (len(words) + 10.0)),
        variety,
        np.log((forms + 4.0) / (len(lines) + 4.0)),
        np.log((len(lines) + 1.0) / (n + 300.0)),
        entropy,
        np.log((capital + 1.0) / (len(words) + 10.0)),
        np.log((symbols + 1.0) / (len(words) + 10.0)),
        np.log(n + 50.0),
    )
    return np.concatenate([shares, more])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x array<double>) for every row; null text counts as empty."""

    def make():
        def step(batch):
            xs = [statistics(t) for t in texts_as_bytes(batch.column(2))]
            flat = pa.array(np.concatenate(xs) if xs else np.zeros(0))
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "x": pa.ListArray.from_arrays(np.arange(len(xs) + 1, dtype=np.int32) * N_STATISTICS, flat)}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return map_batches(rows, "doc_id long, held_out boolean, x array<double>", make)


@dataclass
class Discriminant:
    """Two classes (0, 1): means, inverse Cholesky factors, log-determinants and the log prior ratio."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        log_density = [-0.5 * ((((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) + self.logdets[k]) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.prior, -500, 500)))


def class_sums(labelled: DataFrame, d: int = N_STATISTICS) -> dict[int, np.ndarray]:
    """For each class the (d + 1) x (d + 1) sums of products of (1, x)."""

    def sums(batches):
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            label = batch.column(1).to_numpy()
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                own = x[label == k]
                total[k] += own.T @ own
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "value": pa.array(total.ravel())})

    out = np.zeros((2, d + 1, d + 1))
    rows = labelled.select("x", F.col("label").cast("int")).mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    for r in rows.collect():
        out.ravel()[r["cell"]] = r["value"]
    return {k: out[k] for k in (0, 1)}


def fit(sums: dict[int, np.ndarray], shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """The discriminant of given sums. A class without rows takes the other's moments; without any, all scores are 0.5."""
    d = len(sums[0]) - 1
    n = {k: sums[k][0, 0] for k in (0, 1)}
    means, covs = {}, {}
    for k in (0, 1):
        s = sums[k] if n[k] else sums[1 - k]
        m = max(s[0, 0], 1.0)
        means[k] = s[0, 1:] / m
        covs[k] = s[1:, 1:] / m - np.outer(means[k], means[k])
    total = max(n[0] + n[1], 1.0)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    factors, logdets = [], []
    for k in (0, 1):
        c = (1 - shrink_pooled) * covs[k] + shrink_pooled * pooled
        c = (1 - shrink_diagonal) * c + shrink_diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    return Discriminant(np.stack([means[0], means[1]]), np.stack(factors), np.array(logdets), prior)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The discriminant is fit on rows of ``docs`` that ``labels`` (doc_id, quality 0 or 1) marks and that are not held out; an
    id with contradicting or null labels teaches nothing. Null text is empty and gets the score of the prior's statistics.
    Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(with_statistics(docs), "quality")
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    model = fit(class_sums(rows.filter("not held_out").join(known.select("doc_id", "label"), "doc_id")))

    def make():
        def step(batch):
            score = model.score(batch.column(2).flatten().to_numpy().reshape(-1, N_STATISTICS))
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= cut).astype(np.int32)}

        return step

    return map_batches(rows, "doc_id long, held_out boolean, score double, predicted int", make)
