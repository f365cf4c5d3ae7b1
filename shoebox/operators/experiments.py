"""Clustering experiments: parameter sets, and a store to which each run adds a row, whether it succeeds or not."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.operators import clustering as K
from shoebox.operators import evaluation as E
from shoebox.session import materialize

#: Radii and least neighbours of density clustering by mode.
DENSITY = {
    "debug": ((0.3,), (10,)),
    "fast": ((0.2, 0.25, 0.3), (10, 15)),
    "balanced": ((0.15, 0.2, 0.25, 0.3, 0.35), (5, 10, 15, 20)),
    "comprehensive": ((0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4), (5, 10, 15, 20, 30)),
}
#: Covariances of mixtures by mode.
COVARIANCES = {"debug": ("diag",), "fast": ("diag",), "balanced": ("diag", "full"), "comprehensive": ("diag", "full", "tied")}
#: Rows a cluster is meant to have, least and most clusters, restarts and iterations of k-means.
TARGET_SIZE, MIN_CLUSTERS, MAX_CLUSTERS, RESTARTS, ITERATIONS = 200, 10, 300, 10, 300
#: Silhouettes of experiments are those of so many sampled rows.
SILHOUETTE_ROWS = 5000

RUN = "algorithm string, parameters map<string,string>, status string, error string, n_clusters long, n_points long, noise_ratio double, silhouette double, balance_score double, composite_score double, seconds double"


def cluster_counts(mode: str, n: int, target: int = TARGET_SIZE, least: int = MIN_CLUSTERS, most: int = MAX_CLUSTERS) -> list[int]:
    """Numbers of k-means clusters to try for n rows."""
    low, high, base = max(least, n // 1000), min(most, n // 50), n // target
    if mode == "debug":
        return [max(low, base)]
    if mode == "fast":
        return sorted({*(max(low, int(base * f)) for f in (0.5, 0.75, 1)), min(high, int(base * 1.5))})
    return list(range(low, min(high, 200), 8)) if mode == "balanced" else list(range(low, high, 5))


def component_counts(mode: str, n: int, target: int = TARGET_SIZE) -> list[int]:
    """Numbers of mixture components to try for n rows."""
    base = max(10, n // target)
    if mode in ("debug", "fast"):
        return [base] if mode == "debug" else sorted({max(10, int(base * 0.75)), base, min(100, int(base * 1.25))})
    return list(range(10, min(120, base * 2), 15)) if mode == "balanced" else list(range(10, min(200, base * 3), 10))


def grid(mode: str, n: int, algorithms: Iterable[str] = ("kmeans", "dbscan", "gmm")) -> list[tuple[str, dict]]:
    """Parameter sets of a mode (debug, fast, balanced, comprehensive) for n rows."""
    starts = ("k-means||", "random") if mode in ("balanced", "comprehensive") else ("k-means||",)
    radii, neighbours = DENSITY[mode]
    sets = {
        "kmeans": [{"k": k, "init": s, "restarts": RESTARTS, "max_iter": ITERATIONS} for k in cluster_counts(mode, n) for s in starts],
        "dbscan": [{"eps": e, "min_samples": m} for e in radii for m in neighbours],
        "gmm": [{"k": k, "covariance": c, "max_iter": 100} for k in component_counts(mode, n) for c in COVARIANCES[mode]],
    }
    return [(a, p) for a in algorithms for p in sets[a]]


def experiment_id(algorithm: str, params: dict) -> str:
    return re.sub(r"[^\w.=-]+", "-", algorithm + "_" + "_".join(f"{k}{v}" for k, v in sorted(params.items())))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What runs have stored below a path, with the experiment's id; empty before the first."""
    try:
        return spark.read.schema(f"{schema}, experiment_id string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, experiment_id string")


def stored_runs(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, f"{store}/runs", RUN)


def stored_labels(spark: SparkSession, store: str) -> DataFrame:
    """(id, cluster_id, experiment_id) of the runs that passed the gate."""
    good = stored_runs(spark, store).filter("status = 'done'").select("experiment_id")
    return _stored(spark, f"{store}/labels", "id long, cluster_id int").join(good, "experiment_id", "left_semi")


def _one(rows: DataFrame, store: str, name: str, algorithm: str, params: dict, gate: float, limit: float | None) -> None:
    """Runs one parameter set and stores its row; each run has folders of its own, so runs side by side do not meet."""
    spark, began, scores = rows.sparkSession, time.time(), (None,) * 6
    late = threading.Event()
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    clock = threading.Timer(limit, lambda: (late.set(), spark.sparkContext.cancelJobGroup(name))) if limit else None
    if clock:
        clock.daemon = True
        clock.start()
    try:
        labels = K.CLUSTERERS[algorithm](rows, **params).select(F.col("id").cast("long").alias("id"), F.col("cluster_id").cast("int").alias("cluster_id"))
        path = f"{store}/labels/experiment_id={name}"
        labels.write.mode("overwrite").parquet(path)
        s = E.scores(rows, spark.read.schema("id long, cluster_id int").parquet(path), SILHOUETTE_ROWS).first()
        status, error = "done" if s["composite_score"] > gate else "low", None
        scores = tuple(s[c] for c in ("n_clusters", "n_points", "noise_ratio", "silhouette", "balance_score", "composite_score"))
    except Exception as failure:  # whatever a clusterer raises is that run's result
        status, error = "failed", ("timed out: " if late.is_set() else "") + f"{type(failure).__name__}: {failure}"[:2000]
    finally:
        if clock:
            clock.cancel()
    if late.is_set():
        spark.sparkContext.setJobGroup(f"{name}-end", name)
    row = (algorithm, {k: str(v) for k, v in params.items()}, status, error, *scores, time.time() - began)
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("overwrite").parquet(f"{store}/runs/experiment_id={name}")


def run_experiments(rows: DataFrame, runs: Iterable[tuple[str, dict]], store: str, gate: float = 0.1, side_by_side: int = 4, retry_failed: bool = False, limit: float | None = 600.0) -> DataFrame:
    """Runs the parameter sets that the store does not have, several side by side; returns all stored runs.

    A run's row has status done, low (its composite score is at most the gate) or failed (with the error, among them runs of over
    ``limit`` seconds); it is stored when the run ends, so that a lost session loses no finished run. Failed ones count as had,
    unless they are to be tried again. Labels are stored for all runs that gave some and read for those that are done."""
    spark = rows.sparkSession
    had = stored_runs(spark, store).filter("status <> 'failed'" if retry_failed else "true")
    old = {r["experiment_id"] for r in had.select("experiment_id").collect()}  # as many as the grid has sets
    todo = {experiment_id(a, p): (a, p) for a, p in runs}
    data = materialize(rows.select("id", "v"), "experiment-rows") if todo.keys() - old else rows
    with ThreadPoolExecutor(side_by_side) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(_one), data, store, name, a, p, gate, limit) for name, (a, p) in todo.items() if name not in old]
        for one in started:
            one.result()
    return stored_runs(spark, store)
