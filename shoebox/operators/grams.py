"""Search of texts by parts of them: which strings contain which keys, and which names contain a pattern, without comparing all.

A string contains a key only if it contains every run of a few characters of it. Keys are joined with strings on one such run,
the one that the fewest strings have; patterns are looked up in a stored table of the names' runs. What is found is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of a run by which keys and strings are joined, and of one in the stored table.
KEY_RUN, NAME_RUN = 5, 3
#: Most ids in a row of the stored table, so that a run that all names have is many rows, which many files share.
POSTED = 256
#: Bytes of names whose runs are sorted at once.
SORTED_BYTES = 1 << 20


def runs_of(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text; none of a shorter one."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda p: F.substring(text, p, n)))).otherwise(F.array().cast("array<string>"))


def containing(rows: DataFrame, keys: DataFrame, text: str = "text", key: str = "key", n: int = KEY_RUN) -> DataFrame:
    """Rows of ``rows`` with each of the distinct ``keys`` that their text contains (a column ``key``).

    Keys shorter than n characters are joined as whole runs of their own length, of which there are n - 1 at most; the empty
    key is in every text, null in none. The work is linear in the texts' length and in what is found under the keys' rarest runs."""
    wanted = keys.select(F.col(key).alias("_key")).filter("_key is not null").distinct()
    long = wanted.filter(F.length("_key") >= n).select("_key", F.explode(runs_of(F.col("_key"), n)).alias("_run"))
    seen = rows.select(F.explode(runs_of(F.col(text), n)).alias("_run")).groupBy("_run").agg(F.count("*").alias("_n"))
    # a run that no text has gives its key away as absent, so counts are joined inner only where all runs are there
    counted = long.join(seen, "_run", "left").groupBy("_key").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("r"))).alias("_run"))
    short = wanted.filter((F.length("_key") > 0) & (F.length("_key") < n)).select("_key", F.col("_key").alias("_run"))
    lengths = {n, *(r["m"] for r in short.select(F.length("_key").alias("m")).distinct().collect())}  # runs of other lengths meet no key
    parts = F.flatten(F.array(*[runs_of(F.col(text), m) for m in sorted(lengths)]))
    found = rows.withColumn("_run", F.explode(parts)).join(counted.select("_key", "_run").unionByName(short), "_run").drop("_run")
    found = found.filter(F.col(text).contains(F.col("_key")))
    empty = rows.filter(F.col(text).isNotNull()).join(F.broadcast(wanted.filter("_key = ''")))  # one row at most
    return found.unionByName(empty.select(*found.columns)).withColumnRenamed("_key", key)


def _postings(names: pa.Array, n: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(runs, offsets, rows): rows of ``names`` with each run of n characters, from offset to offset, at most ``POSTED`` a run.

    A run and its row are one number, a letter's place among the letters at hand for each character and then the row; where that
    takes over 63 bits, the halves of ``names`` are taken by themselves."""
    points = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), "<u4")
    if len(points) < n:
        return
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters, spots = np.flatnonzero(seen), (np.cumsum(seen) - 1)[points]
    wide, deep = max(1, (len(letters) - 1).bit_length()), (len(names) - 1).bit_length()
    if n * wide + deep > 63:
        if len(names) == 1:
            raise ValueError(f"runs of {n} characters out of {len(letters)} do not fit a number")
        half = len(names) // 2
        for start, part in ((0, names[:half]), (half, names[half:])):
            for runs, offsets, rows in _postings(part, n):
                yield runs, offsets, rows + start
        return
    row = np.repeat(np.arange(len(names)), pc.utf8_length(names).to_numpy(zero_copy_only=False))
    code = np.zeros(len(row) - n + 1, np.int64)
    for k in range(n):
        code = code << wide | spots[k : len(code) + k]
    key = np.sort((code << deep | row[: len(code)])[row[: len(code)] == row[n - 1 :]])  # runs across two names are left out
    key = key[np.diff(key, prepend=-1) > 0]
    code = key >> deep
    first = np.flatnonzero(np.diff(code, prepend=-1))
    within = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    cut = np.flatnonzero(within % POSTED == 0)
    shifts = wide * np.arange(n - 1, -1, -1)
    text = letters[code[cut][:, None] >> shifts & (1 << wide) - 1].astype("<u4").tobytes().decode("utf-32-le")
    yield [text[i : i + n] for i in range(0, len(text), n)], np.r_[cut, len(key)], key & (1 << deep) - 1


def write_name_index(rows: DataFrame, path: str, id_: str, name: str | Column, files: int = 64, n: int = NAME_RUN) -> None:
    """Stores (run, ids) for every run of a lower-case name, dealt and sorted by run: readers skip files and pages by it.
    The lower case of Σ depends on what follows, which a pattern's end hides, so both its forms are one letter.

    The ids of one run are in several rows, of ``POSTED`` ids at most, made in the tasks that read the names; so few rows
    are shuffled and sorted."""
    text = F.replace(F.lower(F.make_valid_utf8(F.col(name) if isinstance(name, str) else name)), F.lit("ς"), F.lit("σ"))

    def post(batches):
        for batch in batches:
            ids, names = batch.column(0), batch.column(1)
            before = np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False))
            cuts = np.r_[0, np.flatnonzero(np.diff(before // SORTED_BYTES)) + 1, len(names)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                for runs, offsets, at in _postings(names[start:end], n):
                    lists = pa.ListArray.from_arrays(offsets.astype(np.int32), ids.take(pa.array(at + start)))
                    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), lists], ["run", "ids"])

    named = rows.select(F.col(id_).alias("id"), text.alias("name"))
    kind = named.schema["id"].dataType.simpleString()
    each = named.filter(F.length("name") >= n).mapInArrow(post, f"run string, ids array<{kind}>")
    each.repartitionByRange(files, "run", F.get("ids", F.lit(0))).sortWithinPartitions("run", F.get("ids", F.lit(0))).write.mode("overwrite").parquet(path)


def candidates(spark: SparkSession, path: str, parts: list[str], n: int = NAME_RUN) -> DataFrame | None:
    """(id) of the names that the index has under every run of all ``parts``; None where no part is as long as a run."""
    runs = sorted({low[i : i + n] for low in (part.lower().replace("ς", "σ") for part in parts) for i in range(len(low) - n + 1)})
    if not runs:
        return None
    posted = spark.read.parquet(path).filter(F.col("run").isin(*runs)).select("run", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("run").alias("k"))
    return posted.filter(F.col("k") == len(runs)).select("id")


def search_names(spark: SparkSession, path: str, rows: DataFrame, pattern: str, id_: str, name: str) -> DataFrame:
    """Rows whose name is like ``%pattern%``, in either case; % and _ in it match any characters and any one.

    Only rows that the index has under all runs of the pattern's literal parts are checked; without such a run, or with an escape
    character in the pattern, all are."""
    named = None if "\\" in pattern else candidates(spark, path, re.split("[%_]", pattern))
    some = rows if named is None else rows.join(named.withColumnRenamed("id", id_), id_, "left_semi")
    return some.filter(F.col(name).ilike(f"%{pattern}%"))
