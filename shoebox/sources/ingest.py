"""Incremental ingest of side files: a store of parsed rows and a manifest of the files that they came from.

A file is known by path, length and modification time. Rows are written first, under a key of their own; the manifest's entry
makes them visible. A run that is lost in between leaves rows that no reader sees, and its files are read again. A file that has
changed is read again, and its latest rows are the ones that count.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.session import materialize
from shoebox.sources.files import list_files, whole_files

MANIFEST = "path string, length long, modificationTime timestamp, batch long, written string"
#: Files that one job reads; the driver holds so many paths at once.
FILES_AT_ONCE = 10_000


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(path, length, modificationTime, batch, written) of all files that the store has read; empty for a new store."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{store}/files")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _groups(rows: Iterator, size: int) -> Iterator[list]:
    while group := list(islice(rows, size)):
        yield group


def _literal(path: str) -> str:
    """The path with the characters escaped that readers take as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def ingest_files(spark: SparkSession, path: str, store: str, parse: Callable[[DataFrame], DataFrame], files_at_once: int = FILES_AT_ONCE) -> int:
    """Reads the files below ``path`` that the store has not read as they are now; returns their number.

    ``parse`` makes rows, with the column path, of (path, value); it may give none for a file, which counts as read all the same."""
    known = manifest(spark, store)
    fresh = materialize(list_files(spark, path).join(known, ["path", "length", "modificationTime"], "left_anti"), "fresh-files")
    batch, n = known.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0], 0
    for group in _groups(fresh.toLocalIterator(), files_at_once):
        batch, n, written = batch + 1, n + len(group), uuid.uuid4().hex
        rows = parse(whole_files(spark, [_literal(r["path"]) for r in group]))
        rows.withColumn("written", F.lit(written)).write.mode("append").partitionBy("written").parquet(f"{store}/rows")
        spark.createDataFrame([(r["path"], r["length"], r["modificationTime"], batch, written) for r in group], MANIFEST).write.mode("append").parquet(f"{store}/files")
    return n


def stored_rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows of every file as it was read last."""
    last = manifest(spark, store).groupBy("path").agg(F.max_by("written", "batch").alias("written"))
    return spark.read.parquet(f"{store}/rows").join(last, ["path", "written"], "left_semi").drop("written")
