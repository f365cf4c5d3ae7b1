import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np

from shoebox.llm import bisectors
from shoebox.llm.queries import ORACLE, QUERIES


def plain(rows, k=16, rounds=3):
    """Rows (vec_id, integers) clustered by distances to all centroids."""
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(rows, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(rows, own) if c == j]
            centroids[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else centroids[j]
    got = [(i, *near(v)) for i, v in rows]
    of = {j: sum(d for _, d, c in got if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i if i is not None else -1), j, d, of[j], sum(of.values()), digest[j]) for i, d, j in got)


def collected(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def whole(v):
    return [math.floor(Fraction(x) * 64) for x in v]


def test_whole_table(spark, sf):
    rows = [(r.vec_id, whole(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert collected(QUERIES["op11_bisector_clustering"](spark, sf)) == plain(rows)


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = sorted(con.execute(f"select {names} from ({ORACLE['op11_bisector_clustering']})").fetchall())
    assert collected(QUERIES["op11_bisector_clustering"](spark, sf)) == want


def test_tournament_takes_the_smaller_of_ties():
    rng = np.random.default_rng(1)
    for high in (3, 2**26, 10**30):
        draw = lambda n: [[int(x) * (1 if high < 2**60 else 10**24) for x in r] for r in rng.integers(-min(high, 10**6), min(high, 10**6) + 1, (n, 3))]
        c, x = draw(6), draw(200)
        c[4] = c[1]
        best, distance = bisectors.Tournament(c).nearest(np.array(x, np.int64 if high < 2**60 else object))
        want = [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]
        assert [(int(d), int(b)) for d, b in zip(distance, best)] == want


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i % 20 if i % 7 else None, [float(x) for x in rng.integers(-2, 3, 64) / 64 * (i % 3)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [math.nan] + [1.0] * 63), (106, [math.inf] + [1.0] * 63), (107, [-math.inf] + [1.0] * 63)]
    kind = "vec_id long, embedding array<float>, cluster int, v int"
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], kind)
    assert collected(bisectors.cluster_vectors(df)) == plain([(i, whole(v)) for i, v in good])
    assert collected(bisectors.cluster_vectors(df.limit(0))) == []
    one = df.filter("vec_id = 5").limit(1)
    assert [r[1:3] for r in collected(bisectors.cluster_vectors(one))] == [(0, 0)]
    wide = [(i, [float(np.float32(x)) for x in rng.normal(0, 3e37, 64)]) for i in range(20)] + [(30, [0.0] * 64), (30, [0.0] * 64)]
    got = {r.vec_id: r for r in bisectors.cluster_vectors(spark.createDataFrame(wide, "vec_id long, embedding array<float>"), 3).collect()}
    want = {r[0]: r for r in plain([(i, whole(v)) for i, v in wide], 3)}
    assert len(got) == 21 and all(got[i].cluster == w[1] and got[i].centroid_sha256 == w[5] and got[i].inertia is None for i, w in want.items())
    assert all(got[i].distance == (w[2] if w[2] < 2**63 else None) for i, w in want.items())
