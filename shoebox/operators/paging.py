"""Pages, ranks, examples and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.operators.numbering import numbered, smallest


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows [(number - 1) * size, number * size) in order: a top-k, not a full sort."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def total_pages(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def page_batch(rows: DataFrame, order: str, first: int, n_pages: int, size: int) -> DataFrame:
    """(page, row columns) of pages first … first + n - 1; pages past the end are empty."""
    if not 1 <= n_pages <= 5:
        raise ValueError("a batch has 1 to 5 pages")
    at = F.col("page") - 1  # the position from 0
    placed = numbered(rows, [], [order], "page").filter((at >= (first - 1) * size) & (at < (first + n_pages - 1) * size))
    return placed.withColumn("page", F.floor(at / size) + 1)


def rank_results(scores: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Rank from 1 by score, ties by id, within each of ``by``."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.filter(F.col("rank") <= n)


def top_experiments(runs: DataFrame, least: int, most: int, n: int, gate: float = 0.2) -> DataFrame:
    return runs.filter(F.col("n_clusters").between(least, most) & (F.col("composite_score") > gate)).orderBy(F.desc("composite_score"), "experiment_id").limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("service").agg(F.max("run_id").alias("run_id"))


def draw(seed: int, key: Column) -> Column:
    """A reproducible random order: the same text in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def cluster_examples_random(labels: DataFrame, most: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy(draw(seed, F.col("image")), "image")
    return labels.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def cluster_examples_even(labels: DataFrame, most: int) -> DataFrame:
    """Members at the indexes trunc(i * (n - 1) / (most - 1)) in order of image; all, if there are not more."""
    placed = numbered(labels, ["cluster_id"], ["image"], "at", "n").withColumn("at", F.col("at") - 1)
    if most == 1:
        return placed.filter("at = 0").drop("at", "n")
    # the i for which the index can be this row's: the one just at or above at * (most - 1) / (n - 1)
    i = F.ceil(F.col("at") * F.lit(most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("n") - 1) / F.lit(most - 1)) == F.col("at")
    return placed.filter((F.col("n") <= most) | hit).drop("at", "n")


def extract_names(labels: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    """(cluster_id, image, directory, name): repeated file names in a cluster get _001, _002, …"""
    kept = labels if clusters is None else labels.filter(F.col("cluster_id").isin(*clusters))
    file = F.substring_index("image_path", "/", -1)
    name = F.when(F.col("k") == 0, F.col("file")).otherwise(F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.format_string("_%03d", "k"), F.regexp_extract("file", r"(\.[^.]*)$", 1)))
    folder = F.when(F.col("cluster_id") == -1, "noise_cluster").otherwise(F.format_string("cluster_%03d", "cluster_id"))
    placed = numbered(kept.withColumn("file", file), ["cluster_id", "file"], ["image_path"], "k").withColumn("k", F.col("k") - 1)
    return placed.select("cluster_id", "image_path", folder.alias("directory"), name.alias("name"))


def extract_index(names: DataFrame) -> DataFrame:
    """Per cluster a 1-based index with both paths."""
    return numbered(names, ["cluster_id"], ["image_path"]).select("cluster_id", "position", F.concat_ws("/", "directory", "name").alias("copied"), F.col("image_path").alias("original"))


def sample_subset(rows: DataFrame, fraction: float, forced: DataFrame | None = None, seed: int = 42, id_: str = "id") -> DataFrame:
    """max(1, int(N * fraction)) rows: forced ones that exist come first; if they are as many or more, they are all.

    The others are those of smallest ``draw``, found by counts of its digits: no task gathers the sample. Rows of one id
    are rows of their own; a null id is drawn like any other. An empty table gives none."""
    if forced is None:
        return smallest(rows, lambda total: max(1, int(total * fraction)), draw(seed, F.col(id_)))
    own, rest = rows.join(forced.select(id_), id_, "left_semi"), rows.join(forced.select(id_), id_, "left_anti")
    have = own.count()
    return own.unionByName(smallest(rest, lambda others: max(1, int((have + others) * fraction)) - have, draw(seed, F.col(id_))))


def sample_percentage(rows: DataFrame, percentage: float, always: DataFrame | None = None, seed: int = 42, id_: str = "id") -> DataFrame:
    """As sample_subset, but the rows that must be in may exceed the number; 100 or more gives all."""
    if percentage >= 100:
        return rows
    return sample_subset(rows, percentage / 100, always, seed, id_)
