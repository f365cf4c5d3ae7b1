"""Counts and summaries over the catalog, clusterings, poses and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def available_filters(actors: DataFrame, scene_tags: DataFrame, image_tags: DataFrame, years: DataFrame) -> DataFrame:
    """(kind, value): distinct actors, tags of scenes and images that are no actor's name, and years."""
    names = actors.select(F.col("actor").alias("value")).distinct()
    tags = scene_tags.select(F.col("tag").alias("value")).unionByName(image_tags.select(F.col("tag").alias("value"))).distinct().join(names, "value", "left_anti")
    ys = years.select(F.col("year").cast("string").alias("value")).filter("value is not null").distinct()
    parts = [d.select(F.lit(k).alias("kind"), "value") for k, d in (("actor", names), ("tag", tags), ("year", ys))]
    return reduce(DataFrame.unionByName, parts)


def tags_grouped(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_type").agg(F.array_sort(F.collect_list("name")).alias("names"))


def photoset_image_counts(photosets: DataFrame, images: DataFrame) -> DataFrame:
    """(id, n_images) for every set, 0 included: images are counted before the join."""
    counts = images.groupBy(F.col("photoset_id").alias("id")).agg(F.count("*").alias("n"))
    return photosets.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_images"))


def table_counts(tables: dict[str, DataFrame], may_be_empty: tuple[str, ...] = ("captions",)) -> DataFrame:
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n", ((F.col("n") > 0) | F.lit(k in may_be_empty)).alias("ok")) for k, d in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def cluster_analysis(labels: DataFrame, min_cluster_size: int = 1) -> DataFrame:
    """(cluster_id, size, percentage, is_noise); a noise cluster below the least size is left out."""
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    out = sizes.join(F.broadcast(total)).select("cluster_id", "size", (F.col("size") * 100.0 / F.col("total")).alias("percentage"), (F.col("cluster_id") == -1).alias("is_noise"))
    return out.filter(~F.col("is_noise") | (F.col("size") >= min_cluster_size))


def cluster_statistics(summary: DataFrame) -> DataFrame:
    own = lambda c: F.when(~F.col("is_noise"), c)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return summary.agg(
        zero(F.sum("size")).alias("total_images"), F.count(own(F.col("size"))).alias("n_clusters"), zero(F.max(own(F.col("size")))).alias("largest"),
        zero(F.min(own(F.col("size")))).alias("smallest"), F.coalesce(F.avg(own(F.col("size"))), F.lit(0.0)).alias("average"),
        zero(F.sum(F.when(F.col("is_noise"), F.col("size")))).alias("noise_count"),
    ).withColumn("noise_percentage", ratio(F.col("noise_count") * 100.0, F.col("total_images")))


def cluster_top_sizes(labels: DataFrame, n: int = 10) -> DataFrame:
    return labels.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_id").limit(n)


def cluster_members(labels: DataFrame) -> DataFrame:
    """(cluster_id, image) long form, noise left out; the long form is the safe one for large clusters."""
    return labels.filter("cluster_id <> -1").select("cluster_id", "image")


def search_metrics(scores: DataFrame) -> DataFrame:
    f = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return scores.agg(f(F.avg("score"), "average"), f(F.max("score"), "maximum"), f(F.min("score"), "minimum"), f(F.stddev_pop("score"), "deviation"), F.count("*").alias("n"))


def pose_statistics(poses: DataFrame) -> DataFrame:
    """Totals, success rate, mean confidence and people of pictures with a pose, detections of pictures with any."""
    got = F.col("has_pose")
    return poses.agg(
        F.count("*").alias("total"), F.count_if(got).alias("successful"), F.coalesce(F.avg(F.when(got, F.col("pose_confidence"))), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.sum(F.when(got, F.col("person_count"))), F.lit(0)).alias("people"), F.coalesce(F.sum("total_detections"), F.lit(0)).alias("detections"),
        F.count_if(F.col("total_detections") > 0).alias("with_detections"),
    ).select("total", "successful", ratio(F.col("successful"), F.col("total")).alias("success_rate"), "confidence", ratio(F.col("people"), F.col("successful")).alias("people_per_image"), ratio(F.col("detections"), F.col("with_detections")).alias("detections_per_image"))


def feature_statistics(features: DataFrame, images: DataFrame) -> DataFrame:
    """(method, successes, rate) over all images; ``features`` is long: image, method."""
    total = images.agg(F.count("*").alias("total"))
    return features.groupBy("method").agg(F.count_distinct("image").alias("successes")).join(F.broadcast(total)).select("method", "successes", ratio(F.col("successes"), F.col("total")).alias("rate"))


def algorithm_summary(runs: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("experiment_id", "n_clusters", "noise_ratio"), F.struct("composite_score", "experiment_id"))
    return runs.groupBy("algorithm").agg(
        F.count("*").alias("runs"), F.max("composite_score").alias("best_score"), best.alias("best"), F.avg("composite_score").alias("mean_score"),
        F.stddev_pop("composite_score").alias("deviation"), F.min("composite_score").alias("least_score"),
    ).select("algorithm", "runs", "best_score", "best.experiment_id", "best.n_clusters", "best.noise_ratio", "mean_score", "deviation", "least_score")


def comembers(labels: DataFrame, targets: DataFrame, cap: int = 50) -> DataFrame:
    """(experiment_id, target, image): images that share a target's cluster, at most ``cap`` each, by image id.

    Of a cluster only its first cap + 1 images can be any target's, and each task hands on no more than those of a cluster."""
    own = labels.filter("cluster_id <> -1").select("experiment_id", "cluster_id", "image")
    seeds = own.join(targets.select(F.col("image").alias("image")), "image", "left_semi").withColumnRenamed("image", "target")
    place = F.row_number().over(Window.partitionBy("experiment_id", "cluster_id").orderBy("image"))
    first = own.withColumn("rn", place).filter(F.col("rn") <= cap + 1).drop("rn")
    pairs = seeds.join(first, ["experiment_id", "cluster_id"]).filter("image <> target")
    rank = F.row_number().over(Window.partitionBy("experiment_id", "target").orderBy("image"))
    return pairs.withColumn("rn", rank).filter(F.col("rn") <= cap).select("experiment_id", "target", "image")


def consistent_similars(members: DataFrame, n: int = 10) -> DataFrame:
    return members.groupBy("image").agg(F.count_distinct("experiment_id").alias("experiments")).orderBy(F.desc("experiments"), "image").limit(n)


def extraction_summary(labels: DataFrame, extracted: DataFrame) -> DataFrame:
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    got = extracted.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.join(got, "cluster_id", "left").select("cluster_id", "size", F.coalesce("n", F.lit(0)).alias("extracted"), ratio(F.coalesce("n", F.lit(0)), F.col("size")).alias("success_rate"))


def experiment_audit(labels: DataFrame, target) -> DataFrame:
    """One row an experiment: images, clusters, noise, cluster sizes, and where the target is (clustered, noise, missing)."""
    own = labels.filter("cluster_id <> -1").groupBy("experiment_id", "cluster_id").agg(F.count("*").alias("s")).groupBy("experiment_id")
    sizes = own.agg(F.count("*").alias("clusters"), F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))
    at = F.max(F.when(F.col("image") == target, F.when(F.col("cluster_id") == -1, "noise").otherwise("clustered")))
    base = labels.groupBy("experiment_id").agg(F.count("*").alias("images"), F.count_if(F.col("cluster_id") == -1).alias("noise"), F.coalesce(at, F.lit("missing")).alias("target_status"))
    return base.join(sizes, "experiment_id", "left").select("experiment_id", "images", F.coalesce("clusters", F.lit(0)).alias("clusters"), "noise", "least", "most", "mean", "target_status")


def common_images(labels: DataFrame) -> DataFrame:
    """Images that every experiment has."""
    n = labels.agg(F.count_distinct("experiment_id").alias("n"))
    return labels.groupBy("image").agg(F.count_distinct("experiment_id").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("image")
