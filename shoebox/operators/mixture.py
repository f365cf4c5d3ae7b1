"""Gaussian mixtures by expectation and maximisation, with full, tied or diagonal covariances.

Tasks weigh their rows by the current components and return sums of weights, of vectors and of squares for each component;
these are added up in two steps, many components in a group, and the driver sees k sets of sums. Diagonal densities are matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shoebox.operators.balls import BallBlocks

#: Added to the covariances' diagonal; least change of the mean log-likelihood; groups in which tasks' sums are added first.
RIDGE, TOLERANCE, SPREAD = 1e-6, 1e-3, 64
#: Numbers of the components that are added in one group, and bytes of all tasks' sums that the driver adds itself; squares up to which
#: products are exact to a millionth; rows weighed at once; log of the share of a row that no sum has digits for.
SLAB, FEW_BYTES, MOST_SQUARE, STRIP, LEAST_LOG = 1 << 16, 32 << 20, 1e9, 512, -200.0


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # k x d for diagonal ones, k x d x d for full, d x d for tied
    kind: str
    log_likelihood: float = -np.inf

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row under each component."""
        k, d = self.means.shape
        if self.kind == "diag" and (fast := self._products(x)) is not None:
            return fast
        out = np.empty((len(x), k))
        for j in range(k):
            off = x - self.means[j]
            if self.kind == "diag":
                square, log_det = (off * off / self.covariances[j]).sum(1), np.log(self.covariances[j]).sum()
            else:
                low = np.linalg.cholesky(self.covariances if self.kind == "tied" else self.covariances[j])
                square, log_det = (np.linalg.solve(low, off.T) ** 2).sum(0), 2 * np.log(np.diag(low)).sum()
            out[:, j] = np.log(max(self.weights[j], 1e-300)) - 0.5 * (square + log_det + d * np.log(2 * np.pi))
        return out

    def _products(self, x: np.ndarray) -> np.ndarray | None:
        """``log_joint`` of diagonal covariances as one matrix product; None if it would lose what distances are about."""
        inverse, off = 1 / self.covariances, self.means.mean(0)
        y, m = x - off, self.means - off
        squares = y * y
        if not (squares.sum(1).max(initial=0) * inverse.max() < MOST_SQUARE and (m * m * inverse).sum(1).max() < MOST_SQUARE):
            return None
        rest = np.log(np.maximum(self.weights, 1e-300)) - 0.5 * ((m * m * inverse + np.log(self.covariances)).sum(1) + x.shape[1] * np.log(2 * np.pi))
        return np.hstack([squares, y, np.ones((len(x), 1))]) @ np.hstack([-0.5 * inverse, m * inverse, rest[:, None]]).T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _sums(x: np.ndarray, share: np.ndarray, kind: str) -> np.ndarray:
    """Rows of (weight, sums of x, sums of squares or of products) by component."""
    squares = share.T @ (x * x) if kind == "diag" else np.einsum("nk,ni,nj->kij", share, x, x, optimize=True).reshape(share.shape[1], -1)
    return np.hstack([share.sum(0)[:, None], share.T @ x, squares])


def _added(parts: DataFrame, k: int, width: int, tasks: int) -> np.ndarray:
    """Sums of (salt, part) over all rows; a part is a matrix of ``width`` columns with a row for each of the k components. It is added in slabs
    of components, so that no group has more than ``SLAB`` numbers of a task, nor of more than one of ``SPREAD`` tasks at first."""
    if tasks * k * width * 8 <= FEW_BYTES:
        return sum(np.frombuffer(x) for x in parts.select("part").toArrow()["part"].to_pylist()).reshape(k, width)
    step = max(1, SLAB // width)
    slabs = -(-k // step)

    def cut(batches):
        for batch in batches:
            for salt, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = np.frombuffer(part.as_buffer()).reshape(k, width)
                for i in range(slabs):
                    yield pa.RecordBatch.from_pydict({"slab": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "part": pa.array([m[i * step : (i + 1) * step].tobytes()], pa.binary())})

    def add(keys: list[str]):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in table["part"].to_pylist())
            return pa.table({c: table[c][:1] for c in keys} | {"part": pa.array([total.tobytes()], pa.binary())})

        return run

    some = parts.mapInArrow(cut, "slab int, salt int, part binary").groupBy("slab", "salt").applyInArrow(add(["slab", "salt"]), "slab int, salt int, part binary")
    got = some.groupBy("slab").applyInArrow(add(["slab"]), "slab int, part binary").toArrow()
    found = dict(zip(got["slab"].to_pylist(), got["part"].to_pylist()))
    return np.vstack([np.frombuffer(found[i]).reshape(-1, width) for i in range(slabs)])


def _maximised(sums: np.ndarray, d: int, kind: str) -> Mixture:
    n, total = sums[:, 0], sums[:, 1 : d + 1]
    safe = np.maximum(n, 1e-12)
    means = total / safe[:, None]
    if kind == "diag":
        covariances = np.maximum(sums[:, d + 1 :] / safe[:, None] - means**2, 0) + RIDGE
    else:
        products = sums[:, d + 1 :].reshape(-1, d, d)
        if kind == "tied":
            covariances = (products.sum(0) - np.einsum("k,ki,kj->ij", n, means, means)) / n.sum() + RIDGE * np.eye(d)
        else:
            covariances = products / safe[:, None, None] - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
    return Mixture(n / n.sum(), means, covariances, kind)


def fit_mixture(rows: DataFrame, start: DataFrame, k: int, kind: str = "full", max_iter: int = 100) -> Mixture:
    """Mixture of k components over (id, v), started from the labels ``start`` (id, cluster_id from 0 to k - 1)."""
    if kind not in ("full", "tied", "diag"):
        raise ValueError(f"no such covariances: {kind}")
    data = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    width = len(rows.first()["v"])
    columns = width + 2 + (width if kind == "diag" else width * width)
    blocks = BallBlocks(data, k // 8)

    def part(total, likely=0.0):
        if isinstance(total, np.ndarray):
            salt = TaskContext.get().partitionId() % SPREAD
            yield pa.RecordBatch.from_pydict({"salt": pa.array([salt], pa.int32()), "part": pa.array([np.hstack([total, np.full((k, 1), likely)]).tobytes()], pa.binary())})

    def first(batches):
        total = 0
        for batch in batches:
            x, label = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            for a in range(0, len(x), STRIP):
                total = total + _sums(x[a : a + STRIP], np.eye(k)[label[a : a + STRIP]], kind)
        yield from part(total)

    schema = "salt int, part binary"
    joined = max(blocks.tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = _maximised(_added(data.join(start, "id").select("v", "cluster_id").mapInArrow(first, schema), k, columns, joined)[:, :-1], width, kind)
    for _ in range(max_iter):

        def weigh(rows, model=model):
            total, likely = np.zeros((k, columns - 1)), 0.0
            for *_, block in rows:
                for a in range(0, len(block), STRIP):
                    x = block[a : a + STRIP]
                    log = model.log_joint(x)
                    top = log.max(1)
                    log -= top[:, None]
                    some = np.flatnonzero(~(log.max(0) < LEAST_LOG))  # rows of a block are near each other: few components have a share
                    share = np.exp(log[:, some])
                    all_of = share.sum(1)
                    likely += float((top + np.log(all_of)).sum())
                    share /= all_of[:, None]
                    total[some] += _sums(x, share, kind)
            yield from part(total, likely)

        got = _added(blocks.each(weigh, schema), k, columns, blocks.tasks)
        before, n = model.log_likelihood, got[:, 0].sum()
        model = _maximised(got[:, :-1], width, kind)
        model.log_likelihood = float(got[0, -1] / n)
        if abs(model.log_likelihood - before) < TOLERANCE:
            break
    return model


def components(rows: DataFrame, model: Mixture) -> DataFrame:
    """(id, cluster_id): the most probable component of each row."""
    width = model.means.shape[1]

    def run(batches):
        for batch in batches:
            best = model.log_joint(_matrix(batch.column(1), width)).argmax(1)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "cluster_id": pa.array(best, pa.int32())})

    return rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "id long, cluster_id int")
