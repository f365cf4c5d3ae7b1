"""Operators that SQL cannot express, against brute force; and edge frames."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoebox.operators import catalog as C
from shoebox.operators import clustering as K
from shoebox.operators import coded as CV
from shoebox.operators import evaluation as E
from shoebox.functions import geometry as G
from shoebox.operators import knn as N
from shoebox.operators import paging as P
from shoebox.operators import rollups as R
from shoebox.operators import vectors as V
from shoebox.operators.components import connected_components
from shoebox.operators.infer import batch_infer
from shoebox.plans.tables import Tables
from shoebox.sources import files as S


@pytest.fixture(scope="module")
def t(spark, sf):
    return Tables(spark, sf)


def vecs(df):
    rows = sorted(df.select("id", "v").collect())
    return np.array([r.id for r in rows]), np.array([r.v for r in rows])


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 900)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {k: find(k) for k in root}
    assert connected_components(df.limit(0)).count() == 0


def test_knn_does_not_depend_on_blocks(spark, t):
    u = V.with_unit_vectors(t.emb)
    ids, x = vecs(u)
    want = {(int(ids[i]), int(ids[j])) for i in range(0, 100, 9) for j in np.lexsort((ids, -(x[i] @ x.T)))[:15]}
    q = u.filter(F.col("id").isin([int(ids[i]) for i in range(0, 100, 9)]))
    for blocks in (1, 3, 7):
        assert {(r.target, r.id) for r in N.knn_join(q, u, 15, blocks=blocks).collect()} == want
    near = N.knn_join(q, u, 5, "l2", blocks=2).filter("rank = 1").collect()
    assert all(r.target == r.id and r.score < 1e-9 for r in near)


def test_ivf_recall(spark, t):
    u = V.with_unit_vectors(t.sep)
    q = u.filter("id % 20 = 0")
    exact = {(r.target, r.id) for r in N.knn_join(q, u, 11).filter("target <> id and rank <= 11").collect()}
    got = {(r.target, r.id) for r in CV.knn_ivf(q, u, 10, probes=4).collect()}
    assert len(got & exact) >= 0.9 * len(got) and len(got) == 10 * q.count()


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ivf_recall_of_the_registered_search(spark, metric):
    big = Tables(spark, "/root/testdata/sf0.1")
    u = V.with_unit_vectors(big.emb) if metric == "ip" else big.emb
    ids, x = vecs(u)
    near = x @ x.T if metric == "ip" else -((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T)
    np.fill_diagonal(near, -np.inf)
    asked = np.flatnonzero(ids % 100 == 0)
    exact = {(int(ids[i]), int(ids[j])) for i in asked for j in np.argsort(-near[i], kind="stable")[:10]}
    got = {(r.target, r.id) for r in CV.knn_ivf(u.filter("id % 100 = 0"), u, 10, metric=metric).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def slow_leader(ids, x, threshold, least, simple):
    sims, head = x @ x.T, {}
    for i in range(len(ids)):
        if i in head and (head[i] is not None or not simple):
            continue
        order = np.lexsort((ids, -sims[i]))[:100]
        free = [j for j in order if sims[i, j] >= threshold and (j not in head or (simple and head[j] is None))]
        members = {i, *free}
        if len(members) >= least:
            head |= dict.fromkeys(members, i)
        else:
            head[i] = None
    names = {h: k for k, h in enumerate(sorted({h for h in head.values() if h is not None}))}
    return {int(ids[i]): names.get(head.get(i), -1) if head.get(i) is not None else -1 for i in range(len(ids))}


@pytest.mark.parametrize("simple", [False, True])
def test_leader(spark, t, simple):
    u = V.with_unit_vectors(t.emb)
    got = {r.id: r.cluster_id for r in K.leader(u, 0.3, 4, simple=simple).collect()}
    assert got == slow_leader(*vecs(u), 0.3, 4, simple)


@pytest.mark.parametrize("simple", [False, True])
def test_leader_in_rounds(spark, simple):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.35, (45, 3)) for c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    u = frame(spark, (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(135)])
    want = slow_leader(*vecs(u), 0.9, 6, simple)
    assert {r.id: r.cluster_id for r in K.leader(u, 0.9, 6, simple=simple, most_rows=2).collect()} == want and -1 in want.values() and len(set(want.values())) > 3


@pytest.mark.parametrize("simple", [False, True])
def test_leader_in_waves(spark, simple):
    """FINDINGS_r03 F6, F7: seeds that wait for each other in one long chain, in waves of few edges."""
    angle = np.arange(150) * 0.02
    u = frame(spark, np.stack([np.cos(angle), np.sin(angle)], 1))
    want = slow_leader(*vecs(u), 0.9998, 2, simple)
    assert {r.id: r.cluster_id for r in K.leader(u, 0.9998, 2, simple=simple, most_rows=2, wave_rows=60).collect()} == want and len(set(want.values())) > 40


def test_dbscan_border_noise_and_hot_cluster(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.array([1, 0, 0]) + rng.normal(0, 0.05, (80, 3)), np.array([0, 1, 0]) + rng.normal(0, 0.05, (15, 3)), [[0, 0, 1]]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = [r.cluster_id for r in K.dbscan(frame(spark, x), 0.1, 4).orderBy("id").collect()]
    assert got == [0] * 80 + [1] * 15 + [-1]
    plain = [r.cluster_id for r in K.dbscan(frame(spark, x * 3), 1.0, 4, "l2").orderBy("id").collect()]
    assert plain == got


def test_pairs_within_equals_all_pairs(spark):
    ids, x = np.arange(90), np.random.default_rng(8).normal(size=(90, 4))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for metric, near in (("ip", x @ x.T >= 1.5), ("l2", d <= 1.5)):
        for size in (2048, 13):
            got = [(r.seed, r.id) for r in N.pairs_within(frame(spark, x), 1.5, metric, size).collect()]
            assert sorted(got) == [(i, j) for i in ids for j in ids if near[i, j]]
    assert N.pairs_within(frame(spark, x).limit(0), 1.0).count() == 0


def test_mixture_and_auto_k_find_planted_clusters(spark, t):
    rng = np.random.default_rng(6)
    blobs = frame(spark, np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (8, 0), (0, 8))]))
    got = [r.cluster_id for r in K.gmm(blobs, 3, max_iter=15).orderBy("id").collect()]
    assert [len(set(got[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(got)) == 3
    assert K.choose_k({2: 100, 3: 50, 4: 45, 5: 44}, {2: 0.1, 3: 0.2, 4: 0.1, 5: 0.1}) == 2
    assert K.choose_k({2: 1, 3: 1}, {2: 0.4, 3: 0.6}) == 3


def test_silhouette_edges(spark):
    x = frame(spark, [[0, 0], [0, 1], [5, 5], [9, 9]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, -1)], "id long, cluster_id int")
    d = lambda a, b: float(np.hypot(*(np.array(a) - b)))
    want = [(d([0, 0], [5, 5]) - 1) / d([0, 0], [5, 5]), (d([0, 1], [5, 5]) - 1) / d([0, 1], [5, 5]), 0]
    assert E.silhouette(x, labels).first()[0] == pytest.approx(np.mean(want))
    one = labels.withColumn("cluster_id", F.lit(0))
    assert E.silhouette(x, one).first()[0] == -1 and E.balance_score(one).first()[0] == 0
    assert E.noise_ratio(labels.limit(0)).first()["noise_ratio"] == 0
    assert E.validation_pairs(spark.createDataFrame([], "a long, b long"), labels).first()["validation_score"] == 1.0


def test_pca(spark, t):
    ids, x = vecs(t.sep)
    c = x - x.mean(axis=0)
    w, v = np.linalg.eigh(c.T @ c)
    rows = K.pca_2d(t.sep).orderBy("id").collect()
    assert np.allclose(np.abs([r.x for r in rows]), np.abs(c @ v[:, -1]), atol=1e-6)
    assert rows[0].explained_x == pytest.approx(w[-1] / w.sum())


def test_dedupe_people(spark):
    rng = np.random.default_rng(1)
    people = [[float(a) for a in rng.random(4) * 0.3] for _ in range(12)]
    kept = []
    for p in people:
        if not any(np.mean([np.hypot(p[i] - k[i], p[i + 1] - k[i + 1]) for i in (0, 2)]) < 0.1 for k in kept):
            kept.append(p)
    kind = "array<struct<landmarks:array<double>>>"
    df = spark.createDataFrame([([(p,) for p in people],), ([],)], f"people {kind}")
    got = [r[0] for r in df.select(G.dedupe_people(F.col("people"), kind)).collect()]
    assert [list(x.landmarks) for x in got[0]] == kept and 1 < len(kept) < 12 and got[1] == []


def test_dedupe_people_of_large_groups(spark, monkeypatch):
    """FINDINGS_r03 F9: the fold over arrays of rows took the time of all pairs in lambdas; odd landmarks are as they were."""
    rng = np.random.default_rng(6)
    marks = [[float(a) for a in rng.random(4)] for _ in range(3000)]
    odd = [None, [], [0.5], None, [0.5, 0.5], [0.5, 0.5, 0.9, 0.9], [0.5], [0.5, None, 0.1, 0.1], [0.5, 0.51], [float("nan")] * 4, marks[0]]
    kind = "array<struct<id:int,landmarks:array<double>>>"
    df = spark.createDataFrame([([(i, m) for i, m in enumerate(x)],) for x in (marks + odd, odd + marks[:300])] + [(None,)], f"people {kind}")
    near = lambda k, p: G.mean_distance(k["landmarks"], p["landmarks"]) < 0.05
    slow = F.aggregate("people", F.expr(f"cast(array() as {kind})"), lambda kept, p: F.when(F.exists(kept, lambda k: near(k, p)), kept).otherwise(F.array_append(kept, p)))
    want = [r[0] for r in df.select(slow.cast("string")).collect()]
    got = df.select(G.dedupe_people(F.col("people"), kind, 0.05).cast("string"))
    assert [r[0] for r in got.collect()] == want and "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_infer_keeps_or_drops(spark):
    def load():
        def model(b: pd.DataFrame):
            if (b.x < 0).any():
                raise ValueError("negative")
            return b.assign(y=b.x * 2)[["id", "y"]]

        return model

    df = spark.createDataFrame([(i, -1 if i == 5 else i) for i in range(20)], "id long, x long")
    assert batch_infer(df, load, "id long, y long", batch_size=4).count() == 19
    kept = batch_infer(df.select("id", "x"), load, "id long, y long", "keep", 4).filter("error is not null").collect()
    assert [(r.id, r.y) for r in kept] == [(5, None)]


def test_zero_vectors_and_empty_frames(spark):
    x = frame(spark, [[0, 0], [3, 4]])
    assert [list(r.v) for r in V.with_unit_vectors(x).collect()] == [[0.6, 0.8]]
    assert x.select(V.l2_normalize(F.col("v")).alias("v")).filter("v is null").count() == 1
    none = x.limit(0)
    assert V.target_embedding(none, none).count() == 0 and N.knn_join(none, none, 3).count() == 0
    labels = spark.createDataFrame([], "id long, cluster_id int")
    assert R.cluster_statistics(R.cluster_analysis(labels)).first()["total_images"] == 0
    assert R.search_metrics(spark.createDataFrame([], "score double")).first()["average"] == 0
    assert P.page(x, ["id"], 9, 5).count() == 0
    assert P.sample_subset(x, 0.5, x).count() == 2 and P.sample_subset(x, 0.0001).count() == 1
    assert V.zscore(frame(spark, [[3, 4]])).first()["v"] == [0.6, 0.8]


def test_sampling_is_the_same_for_any_partitioning(spark):
    df = spark.range(500)
    a, b = (sorted(r.id for r in P.sample_subset(d, 0.1).collect()) for d in (df.repartition(3), df.repartition(11)))
    assert a == b and len(a) == 50


def test_scene_forms(spark):
    images = spark.createDataFrame([("x_set_10_a",), ("set_1",), ("none",)], "image_id string")
    scenes = spark.createDataFrame([("set_1",), ("set_10",)], "scene string")
    assert {r.image_id: r.scene for r in C.scene_of_image(images, scenes).collect()} == {"x_set_10_a": "set_1", "set_1": "set_1"}
    assert {r.image_id: r.scene for r in C.scene_of_image(images, scenes, True).collect()} == {"x_set_10_a": "set_10", "set_1": "set_1"}


def test_uuid_is_an_id(spark):
    u = "0a1b2c3d-0000-4000-8000-00000000000f"
    df = spark.createDataFrame([(u, "a.jpg", "p/a.jpg"), ("z", u + ".jpg", "q")], "id string, filename string, file_path string")
    assert C.find_by_pattern(df, u).first().id == u and C.find_by_pattern(df, "q").first().id == "z"


def test_sources(spark, tmp_path):
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets/one.json").write_text(json.dumps({"actors": ["A"], "tags": ["t"], "date": "May 3, 2021"}))
    (tmp_path / "sets/two.json").write_text(json.dumps({"actors": [], "date": "soon"}))
    (tmp_path / "sets/bad.json").write_text("{nope")
    good, bad = S.read_photoset_json(spark, str(tmp_path / "sets"))
    good = good.cache()
    assert {r.scene: r.year for r in good.collect()} == {"one": "2021", "two": None}
    assert [r.scene for r in bad.collect()] == ["bad"]
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps/a_caption.txt").write_text("  hello\nthere ")
    (tmp_path / "caps/b_caption.txt").write_text("known")
    known = spark.createDataFrame([("b",)], "image_id string")
    assert [(r.image_id, r.caption) for r in S.read_captions_txt(spark, str(tmp_path / "caps"), known).collect()] == [("a", "hello\nthere")]
    (tmp_path / "crops").mkdir()
    for size in (256, 768, 512):
        (tmp_path / f"crops/a_crop_{size}.json").write_text(json.dumps({"targetSize": size, "normalizedDeltas": {"x": 0.1, "y": size}}))
    assert [tuple(r) for r in S.read_crop_json(spark, str(tmp_path / "crops")).collect()] == [("a", 768, 0.1, 768.0)]
    for name in ("a.JPG", "b_crop_1.png", "c.txt"):
        (tmp_path / "sets" / name).write_bytes(b"x")
    files = S.list_files(spark, str(tmp_path / "sets"))
    assert C.discover_images(files).count() == 2 and C.discover_images(files, True).count() == 1 and C.split_crop_files(files).count() == 1
    S.write_features(spark.createDataFrame([(1, "m", [1.0]), (2, "m", [1.0, 2.0]), (3, "m", None)], "image long, method string, v array<double>"), str(tmp_path / "features"))
    assert {r.image: list(r.v) for r in spark.read.parquet(str(tmp_path / "features")).collect()} == {1: [1.0, 0.0], 2: [1.0, 2.0]}


def test_upsert_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6), (2, 1, None, 7)], "k long, seq long, x string, created long")
    once = C.upsert_latest(rows, "k", ["seq"], "created")
    assert sorted(map(tuple, C.upsert_latest(once.select("k", "seq", "x", "created"), "k", ["seq"], "created").collect())) == sorted(map(tuple, once.collect())) == [(1, 5, 2, "b"), (2, 7, 1, None)]


def test_bridge_remove_says_what_existed(spark):
    b = spark.createDataFrame([(1, "x"), (2, "y")], "image_id long, name string")
    left, had = C.bridge_remove(b, spark.createDataFrame([(1, "x"), (9, "z")], "image_id long, name string"), ["image_id", "name"])
    assert [tuple(r) for r in left.collect()] == [(2, "y")] and {r.image_id: r.existed for r in had.collect()} == {1: True, 9: False}


def test_restarts_move_together(spark):
    """FINDINGS_r03 F2: all restarts of k-means in one pass an iteration, each as a plain loop would; an empty cluster stays."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in np.eye(3) * 3])
    starts = [x[rng.choice(180, 4, replace=False)] for _ in range(3)] + [np.concatenate([x[:2], [[99.0, 99, 99]]])]
    got = K._lloyd(frame(spark, x).repartition(3), starts, 50)
    for c, (centres, inertia) in zip(starts, got, strict=True):
        for _ in range(50):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            new = np.array([x[d.argmin(1) == j].mean(0) if (d.argmin(1) == j).any() else c[j] for j in range(len(c))])
            done, c = (((new - c) ** 2).sum(1) <= 1e-8).all(), new
            if done:
                break
        assert np.allclose(centres, c) and inertia == pytest.approx(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    assert got[3][0][2].tolist() == [99, 99, 99]
