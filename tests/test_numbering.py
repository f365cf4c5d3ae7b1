"""Positions and selections in a total order: equal to a plain sort, and no task with a whole group or sample."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shoebox.operators import paging as P
from shoebox.operators.numbering import numbered, smallest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_in_groups_of_any_size(spark):
    rows = [("hot", (i * 7919) % 4001) for i in range(4001)] + [(f"g{i % 50}", i) for i in range(500)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = sorted(tuple(r) for r in numbered(df, ["g"], ["x"], "at", "n", parts=16).select(F.coalesce("g", F.lit("")), "x", "at", "n").collect())
    groups = {}
    for g, x in rows:
        groups.setdefault(g or "", []).append(x)
    assert got == sorted((g, x, i + 1, len(xs)) for g, xs in groups.items() for i, x in enumerate(sorted(xs)))
    parts = numbered(df.filter("g = 'hot'"), ["g"], [F.desc("x")], parts=16)
    assert [r.x for r in parts.orderBy("position").collect()] == list(range(4000, -1, -1))
    windows = re.findall(r"Window \[.*?\]", plan(parts))
    assert windows and not any("row_number" in w and "part" not in w for w in windows)
    assert numbered(df.limit(0), [], ["x"]).count() == 0


def test_positions_of_a_whole_table_and_clashing_names(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("x"), F.lit(1).alias("part"), F.lit(2).alias("position"), F.lit(3).alias("size"), F.lit(4).alias("a.b"))
    out = numbered(df, [], ["x"], parts=8)
    got = [(r.x, r.position, r.part, r.size, r["a.b"]) for r in out.orderBy("position").collect()]
    assert [x for x, *_ in got] == sorted(x for x, *_ in got) and [p for _, p, *_ in got] == list(range(1, 3001)) and {tuple(g[2:]) for g in got} == {(1, 3, 4)}
    dealt = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(dealt) < 1500


def least(ids, n):
    return sorted(sorted(ids, key=lambda i: hashlib.md5(f"42:{'' if i is None else i}".encode()).hexdigest().removesuffix("\n"))[:n], key=str)


@pytest.mark.parametrize("bound", [1, 7, 10_000])
@pytest.mark.parametrize("n", [0, 1, 2, 333, 2999, 3000, 5000])
def test_smallest_equals_a_sort(spark, n, bound):
    df = spark.range(3000).withColumn("key", F.lit("x"))
    got = smallest(df, n, P.draw(42, F.col("id")), bound)
    assert got.columns == ["id", "key"] and sorted((r.id for r in got.collect()), key=str) == least(range(3000), n)


def test_smallest_among_rows_of_one_key(spark):
    rows = [(5, "a")] * 40 + [(5, f"b{i}") for i in range(40)] + [(i, "c") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x string")
    for n in (1, 15, 30, 60, 99):
        for k in (3, 1):
            got = [tuple(r) for r in smallest(df.repartition(k), n, P.draw(42, F.col("id")), 4).collect()]
            assert len(got) == n and sorted({i for i, _ in got}) == sorted(set(least([i for i, _ in rows], n))) and all(got.count(g) <= rows.count(g) for g in got)
            if k == 3:
                first = sorted(got)
        assert first == sorted(got)


def test_no_task_holds_a_sample(spark):
    df = spark.range(200_000)
    out = P.sample_subset(df, 0.3)
    text = plan(out)
    assert out.count() == 60_000 and all(int(x) <= 10_000 for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", text)) and "GlobalLimit" not in text
    assert "SinglePartition" not in text


def test_samples_with_forced_rows(spark):
    df = spark.createDataFrame([(i,) for i in [*range(100), 7, 7, None]], "id long")
    forced = spark.createDataFrame([(7,), (3,), (500,)], "id long")
    got = [r.id for r in P.sample_subset(df, 0.1, forced).collect()]
    assert len(got) == 10 and got.count(7) == 3 and 3 in got
    assert sorted(r.id for r in P.sample_subset(df, 0.01, forced).collect()) == [3, 7, 7, 7]
    assert P.sample_percentage(df, 100).count() == 103 and P.sample_subset(df.limit(0), 0.5).count() == 0


def test_pages_past_the_first(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    got = sorted((r.page, r.x) for r in P.page_batch(df, "x", 38, 5, 25).collect())
    assert got == [(p, (p - 1) * 25 + i) for p in (38, 39, 40) for i in range(25)]
    with pytest.raises(ValueError):
        P.page_batch(df, "x", 1, 6, 25)


def test_even_examples_of_a_hot_cluster(spark):
    rows = [(0, i) for i in range(4000)] + [(1, i) for i in range(3)] + [(2, 9)]
    df = spark.createDataFrame(rows, "cluster_id int, image long")
    got = sorted(tuple(r) for r in P.cluster_examples_even(df, 5).select("cluster_id", "image").collect())
    assert got == sorted([(0, i * 3999 // 4) for i in range(5)] + [(1, i) for i in range(3)] + [(2, 9)])
    assert sorted(tuple(r) for r in P.cluster_examples_even(df, 1).select("cluster_id", "image").collect()) == [(0, 0), (1, 0), (2, 9)]
