"""Parameter sets, the experiment store, mixtures and silhouettes of every row."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import clustering as K
from shoebox.operators import evaluation as E
from shoebox.operators import experiments as X
from shoebox.operators.mixture import fit_mixture
from shoebox.plans.tables import Tables


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_parameter_sets_of_three_sizes():
    assert [X.cluster_counts("fast", n) for n in (2_000, 48_642, 1_000_000)] == [[10, 15], [121, 182, 243, 300], [300, 2500, 3750, 5000]]
    assert [X.cluster_counts("debug", n) for n in (2_000, 48_642, 1_000_000)] == [[10], [243], [5000]]
    assert X.cluster_counts("balanced", 2_000) == [10, 18, 26, 34] and X.cluster_counts("balanced", 48_642) == list(range(48, 200, 8))
    assert X.cluster_counts("comprehensive", 48_642) == list(range(48, 300, 5)) and X.cluster_counts("comprehensive", 400) == []
    assert [X.component_counts("fast", n) for n in (2_000, 48_642, 1_000_000)] == [[10, 12], [100, 182, 243], [100, 3750, 5000]]
    assert X.component_counts("balanced", 48_642) == list(range(10, 120, 15)) and X.component_counts("comprehensive", 2_000) == [10, 20]
    fast = X.grid("fast", 2_000)
    assert {a: sum(b == a for b, _ in fast) for a in ("kmeans", "dbscan", "gmm")} == {"kmeans": 2, "dbscan": 6, "gmm": 2}
    whole = X.grid("comprehensive", 48_642)
    assert {a: sum(b == a for b, _ in whole) for a in ("kmeans", "dbscan", "gmm")} == {"kmeans": 102, "dbscan": 35, "gmm": 57}
    assert len({X.experiment_id(a, p) for a, p in whole}) == len(whole)


def test_a_failing_run_is_a_row_and_a_second_call_starts_nothing(spark, tmp_path, sf):
    rows, store, calls = Tables(spark, sf).sep, str(tmp_path / "store"), []

    def odd(rows, k):
        calls.append(k)
        if k == 1:
            raise ValueError("no such k")
        return rows.select("id", (F.col("id") * 0 - 1 if k == 2 else F.col("id") % k).cast("int").alias("cluster_id"))

    K.register_clusterer("odd", odd)
    runs = [("odd", {"k": 1}), ("odd", {"k": 2}), ("odd", {"k": 3}), ("kmeans", {"k": 10, "restarts": 1, "max_iter": 30}), ("kmeans", {"k": 0})]
    got = {r.experiment_id: r for r in X.run_experiments(rows, runs, store).collect()}
    assert {k: r.status for k, r in got.items()} == {"odd_k1": "failed", "odd_k2": "low", "odd_k3": "done", "kmeans_k10_max_iter30_restarts1": "done", "kmeans_k0": "failed"}
    assert "no such k" in got["odd_k1"].error and got["kmeans_k10_max_iter30_restarts1"].composite_score > 0.5 and got["odd_k3"].parameters == {"k": "3"}
    labels = X.stored_labels(spark, store).groupBy("experiment_id").count().collect()
    assert {r[0]: r[1] for r in labels} == {"odd_k3": rows.count(), "kmeans_k10_max_iter30_restarts1": rows.count()}
    assert X.run_experiments(rows, runs, store).count() == 5 and sorted(calls) == [1, 2, 3]
    assert X.run_experiments(rows, [*runs, ("odd", {"k": 4})], store, retry_failed=True).count() == 6 and sorted(calls) == [1, 1, 2, 3, 4]
    K.CLUSTERERS.pop("odd")


def test_a_run_that_takes_too_long_is_ended(spark, tmp_path):
    wait = F.udf(lambda i: time.sleep(0.2) or 0, "int")
    K.register_clusterer("slow", lambda rows: rows.select("id", wait("id").alias("cluster_id")))
    rows = spark.range(2000).select("id", F.array(F.lit(1.0)).alias("v"))
    began = time.time()
    got = X.run_experiments(rows, [("slow", {})], str(tmp_path / "late"), limit=2.0).first()
    K.CLUSTERERS.pop("slow")
    assert got.status == "failed" and got.error.startswith("timed out") and time.time() - began < 30


@pytest.mark.parametrize("kind", ["diag", "full", "tied"])
def test_mixtures_find_planted_components(spark, kind):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, s, (80, 3)) for c, s in (((0, 0, 0), 0.3), ((6, 0, 1), 0.5), ((0, 6, 2), 0.4))])
    rows = frame(spark, x).repartition(3)
    got = [r.cluster_id for r in K.gmm(rows, 3, covariance=kind).orderBy("id").collect()]
    assert [len(set(got[i : i + 80])) for i in (0, 80, 160)] == [1, 1, 1] and len(set(got)) == 3
    start = spark.createDataFrame([(i, i // 80) for i in range(240)], "id long, cluster_id int")
    model = fit_mixture(rows, start, 3, kind, 30)
    assert np.allclose(model.means, [x[i : i + 80].mean(0) for i in (0, 80, 160)], atol=0.02) and np.allclose(model.weights, 1 / 3, atol=0.01)
    own = [np.cov(x[i : i + 80].T, bias=True) for i in (0, 80, 160)]
    want = np.array([np.diag(c) for c in own]) if kind == "diag" else np.mean(own, 0) if kind == "tied" else np.array(own)
    assert np.allclose(model.covariances, want, atol=0.02)


def test_mixture_of_all_dimensions(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    labels = K.gmm(t.sep, 10, max_iter=20, covariance="diag").join(t.emb.select("id", "label"), "id")
    pure = labels.groupBy("cluster_id", "label").count().groupBy("cluster_id").agg((F.max("count") / F.sum("count")).alias("p"), F.sum("count").alias("n"))
    assert pure.agg(F.sum(F.col("p") * F.col("n")) / F.sum("n")).first()[0] > 0.85


def test_silhouette_of_every_row(spark):
    rng = np.random.default_rng(7)
    n = 6000
    x, label = rng.normal(size=(n, 4)), rng.integers(-1, 4, n)
    x[label == 1] += 2
    x[10], label[10] = x[11], 9  # a cluster of one
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    kinds = [c for c in np.unique(label) if c != -1]
    sums = np.stack([d[:, label == c].sum(1) for c in kinds], 1)
    sizes = np.array([(label == c).sum() for c in kinds])
    want = {}
    for i in np.flatnonzero(label != -1):
        k = kinds.index(label[i])
        if sizes[k] == 1:
            want[int(i)] = 0.0
            continue
        a, b = sums[i, k] / (sizes[k] - 1), min(sums[i, j] / sizes[j] for j in range(len(kinds)) if j != k)
        want[int(i)] = (b - a) / max(a, b)
    rows, labels = frame(spark, x), spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, cluster_id int")
    got = {r.id: r.silhouette for r in E.silhouette_rows(rows, labels, 1000).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-6)
    assert E.silhouette(rows, labels).first()[0] == pytest.approx(np.mean(list(want.values())), abs=1e-6)
    large = labels.filter("cluster_id <> 9")
    assert E.silhouette(rows, large, 1500).first()[0] == pytest.approx(E.silhouette(rows, large).first()[0], abs=0.03)
    assert E.silhouette(rows, labels.limit(0)).first()[0] == -1


def test_blocks_of_silhouettes(spark, monkeypatch):
    """FINDINGS_r03 F13: a row was copied to rows / 2048 blocks, 293 at 6 GB. Strips that do not end with a block change nothing."""
    assert E._blocks(600_000) == 37 and E._blocks(100_000) == 12 and E._blocks(0) == 1
    rng = np.random.default_rng(3)
    rows = frame(spark, rng.normal(size=(700, 5)))
    labels = spark.createDataFrame([(i, i % 3) for i in range(700)], "id long, cluster_id int")
    want = E.silhouette(rows, labels).first()[0]
    monkeypatch.setattr(E, "STRIP", 37)
    monkeypatch.setattr(E, "LEAST_ROWS", 100)
    assert E.silhouette(rows, labels).first()[0] == pytest.approx(want, abs=1e-9)
