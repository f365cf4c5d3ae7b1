"""The neighbour graph: its recall and how many pairs it compares, against all pairs."""

import numpy as np
import pytest

from shoebox.operators.graph import exact_graph, neighbour_graph
from shoebox.plans.tables import Tables
from shoebox.plans.vector_queries import QUERIES


def recall(got, x, ids, k, every=1):
    at = {int(i): n for n, i in enumerate(ids)}
    lists = {}
    for r in got:
        lists.setdefault(at[r.target], []).append(at[r.id])
    hit = total = 0
    for i in range(0, len(x), every):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        true = set(np.argsort(d, kind="stable")[:k].tolist())
        hit, total = hit + len(true & set(lists[i])), total + k
    return hit / total


def test_recall_below_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 5000)] * 2 + rng.normal(size=(5000, 12)) @ rng.normal(size=(12, 12)) * 0.2
    df = spark.createDataFrame([(i * 7, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    graph = neighbour_graph(df, 10, pool=16)
    got = graph.edges.collect()
    assert len(got) == 50_000 and recall(got, x, np.arange(5000) * 7, 10, 7) >= 0.95
    assert graph.compared < 0.35 * graph.possible and graph.rounds < 12
    for r in got[:100]:
        assert r.target != r.id and r.score == pytest.approx(((x[r.target // 7] - x[r.id // 7]) ** 2).sum())
    ranks = {}
    for r in got:
        ranks.setdefault(r.target, []).append((r["rank"], r.score))
    assert all([k for k, _ in sorted(v)] == list(range(1, 11)) and sorted(s for _, s in v) == [s for _, s in sorted(v)] for v in ranks.values())


def test_recall_on_the_given_vectors(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    rows = sorted(t.sep.select("id", "v").collect())
    ids, x = np.array([r.id for r in rows]), np.array([r.v for r in rows])
    graph = neighbour_graph(t.sep.select("id", "v"), 10)
    assert recall(graph.edges.collect(), x, ids, 10) >= 0.95


def test_small_tables(spark):
    f = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert neighbour_graph(f([]), 3).edges.count() == 0 and neighbour_graph(f([(1, [1.0])]), 3).edges.count() == 0
    got = neighbour_graph(f([(1, [0.0]), (2, [1.0]), (3, [5.0]), (4, None), (5, [5.0])]), 2).edges.collect()
    assert {(r.target, r.id) for r in got if r["rank"] == 1} == {(1, 2), (2, 1), (3, 5), (5, 3)} and len(got) == 8


def test_knn_graph_finds_all(spark, sf):
    """FINDINGS_r03 F10: the registered graph is exact; of rows at equal distances the smaller ids are taken."""
    t = Tables(spark, sf)
    x = np.array([r.v for r in t.sep.orderBy("id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = {(r.target, r["rank"]): (r.id, r.score) for r in QUERIES["knn_graph"](spark, sf).collect()}
    assert len(got) == 10 * len(x)
    near = np.sort(d, axis=1)[:, :10]
    assert all(abs(got[i, k + 1][1] - near[i, k]) < 1e-9 for i in range(len(x)) for k in range(10))
    f = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0]), (4, None), (5, [5.0]), (6, [5.0])], "id long, v array<double>")
    assert {(r.target, r.id, r["rank"]) for r in exact_graph(f, 1).edges.collect()} == {(1, 2, 1), (2, 1, 1), (3, 5, 1), (5, 3, 1), (6, 3, 1)}
    assert exact_graph(f.limit(0), 3).edges.count() == 0
