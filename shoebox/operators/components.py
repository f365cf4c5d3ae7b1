"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every star is a grouped minimum and one equi-join on the node; no neighbour list is ever gathered. The minima are written before
they are joined: a join whose side is grouped in the same stage has to keep all rows of a hub in one task, one that reads both
sides as they are may be split by AQE, or broadcasts minima that are few. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoebox.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    low = materialize(low, "components-low")
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("u > v")
    low = materialize(down.groupBy("u").agg(F.min("v").alias("low")), "components-low")
    moved = down.join(low, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that it reaches.

    Edges are undirected; loops and repeated edges are harmless, edges with a null end are ignored (their other end
    keeps no row unless another edge has it). A node only in loops is its own component.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    loops = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = pairs.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(stars, "components")
    mark = _mark(stars)
    while mark[0]:  # every round that changes something brings nodes nearer to their heads
        stars = materialize(_small_star(_large_star(stars)), "components")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    heads = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return loops.join(heads, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
