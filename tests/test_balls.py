"""FINDINGS_r04 F1: the experiment grid's k-means, mixtures and silhouettes at size, with the results that they had."""

import numpy as np
import pyarrow as pa
import pytest

from shoebox.operators import balls as B
from shoebox.operators import clustering as K
from shoebox.operators import evaluation as E
from shoebox.operators.mixture import Mixture


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)], "id long, v array<double>")


def test_first_centres_are_those_of_spark_ml_without_a_fit_each(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = frame(spark, np.concatenate([rng.normal(c, 0.3, (130, 4)) for c in np.eye(4) * 2])).repartition(3).sortWithinPartitions("id").persist()
    data = K.features(rows).persist()
    want = [np.array(K.KMeans(k=24, seed=s, maxIter=0).fit(data).clusterCenters()) for s in (42, 43, -7)]
    got = K._starts(B.BallBlocks(rows, 3), 24, [42, 43, -7])
    assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(got, want, strict=True))
    data.unpersist()
    monkeypatch.setattr(K, "KMeans", None)  # before, each restart was a fit of its own
    assert K.kmeans(rows, 24, restarts=3).select("cluster_id").distinct().count() == 24
    rows.unpersist()


def test_a_ball_leaves_out_no_nearest_centre():
    rng = np.random.default_rng(5)
    for spread in (0.05, 0.5, 3.0):
        centres = rng.normal(size=(60, 6))
        for _ in range(40):
            x = rng.normal(size=6) + rng.normal(size=(50, 6)) * spread
            middle = x.mean(0)
            some = B.in_reach(middle, float(np.sqrt(((x - middle) ** 2).sum(1).max())), centres, (centres * centres).sum(1))
            assert np.isin(((x[:, None] - centres[None]) ** 2).sum(2).argmin(1), some).all()
    near = rng.normal(size=(50, 6)) * 0.01 + centres[3]
    assert len(B.in_reach(near.mean(0), 0.05, centres, (centres * centres).sum(1))) < 10


def test_vectors_that_are_not_plain_go_the_old_way(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    x[5, 1] = np.nan
    assert not B.BallBlocks(frame(spark, x), 1).plain
    with pytest.raises(Exception, match="NaN"):
        K.kmeans(frame(spark, x), 3, restarts=1).collect()
    with pytest.raises(Exception):
        K.kmeans(frame(spark, x[:5]), 1, restarts=1).collect()


def test_mixture_densities_as_products():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 5))
    m = Mixture(np.array([0.2, 0.8, 0.0]), rng.normal(size=(3, 5)), rng.uniform(1e-6, 2, (3, 5)), "diag")
    want = [[np.log(max(m.weights[j], 1e-300)) - 0.5 * (((v - m.means[j]) ** 2 / m.covariances[j]).sum() + np.log(2 * np.pi * m.covariances[j]).sum()) for j in range(3)] for v in x]
    assert m._products(x) is not None and np.allclose(m.log_joint(x), want, rtol=1e-9)
    far = Mixture(m.weights, m.means + 1e7 * np.arange(3)[:, None], np.full((3, 5), 1e-6), "diag")
    assert far._products(x) is None and far.log_joint(x).shape == (70, 3)


def test_silhouettes_of_one_block_as_of_many(spark):
    rng = np.random.default_rng(9)
    ids = np.append(np.arange(300), [7, 7])
    x, label = rng.normal(size=(302, 4)), rng.integers(-1, 40, 302)
    rows, labels = frame(spark, x, ids), spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, label)], "id long, cluster_id int")
    one, many = (sorted(map(tuple, E.silhouette_rows(rows, labels, n).collect())) for n in (None, 60))
    assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[2] for r in one], [r[2] for r in many])
    found = E._of_one_block(pa.table({"id": pa.array([1, 2]), "v": pa.array([[0.0], [1.0]]), "cluster_id": pa.array([4, 4], pa.int32())}))
    assert found["silhouette"].to_pylist() == [None, None]
