"""Positions and selections in a total order without a task that holds the whole group or table.

``numbered`` cuts the table into ranges of (group, order), numbers the rows of each range and adds what lies before it;
``smallest`` finds the range in which the n-th row falls from counts by key prefix and looks closer only there. Both work the
same whether one group holds a row or a third of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.session import materialize

#: Hexadecimal digits that one pass of ``smallest`` looks at: 65,536 counts reach the driver, whatever the table's size.
DIGITS = 4
#: A range of so many rows is sorted as it is.
BOUND = 10_000


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in either case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "position", total: str | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with their position from 1 in ``order`` within each group ``by`` (none: the whole table), and the group's number of
    rows as ``total`` if asked. Rows that tie in ``order`` are numbered in any order; null keys form a group like any other.

    The table is written once, dealt by range of (by, order), so a large group lies in many parts; each window covers one group
    in one part. Counts by part, of which a group has at most ``parts``, are what is added up."""
    spark = rows.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    part, within, before, size = (unused(rows, c) for c in ("part", "within", "before", "size"))
    dealt = materialize(rows.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id()), "numbered")
    keys = [*by, part]
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias(size))
    ahead = Window.partitionBy(*by).orderBy(part)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(size).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum(size).over(Window.partitionBy(*by)))
    renamed = sizes.select(*[F.col(f"`{k}`").alias(f"{part}_{i}") for i, k in enumerate(keys)], before, *([total] if total else []))
    local = dealt.withColumn(within, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [local[f"`{k}`"].eqNullSafe(renamed[f"{part}_{i}"]) for i, k in enumerate(keys)])
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (name, total)]
    return local.join(renamed, same).select(*kept, (F.col(before) + F.col(within)).alias(name), *([total] if total else []))


def smallest(rows: DataFrame, n: int | Callable[[int], int], key: Column, bound: int = BOUND) -> DataFrame:
    """The n rows of smallest ``key``, a text of hexadecimal digits of one length; ``n`` may be a function of the number of rows.

    Each pass counts rows by the next digits of the key, within the range in which the n-th row falls. All ranges before it are
    taken by a filter; only the last range, of at most ``bound`` rows, is sorted. Rows beyond that with one and the same key are
    told apart by the digest of all their columns; of wholly equal ones any are taken."""
    own = unused(rows, "key")
    dealt, prefix = rows.withColumn(own, key), ""
    left = None if callable(n) else n
    while True:
        here = dealt.filter(F.col(own).startswith(prefix)) if prefix else dealt
        width = len(prefix) + DIGITS
        counts = sorted((r["p"], r["n"]) for r in here.groupBy(F.substring(own, 1, width).alias("p")).agg(F.count("*").alias("n")).collect())
        if left is None:
            left = n(sum(c for _, c in counts))
        if left <= 0:
            return rows.limit(0) if not prefix else dealt.filter(F.col(own) < prefix).drop(own)
        for p, c in counts:
            if c > left:
                break
            left -= c
        else:  # only in the first pass: all rows are asked for
            return rows
        before, at = dealt.filter(F.col(own) < p).drop(own), dealt.filter(F.col(own).startswith(p))
        if left == 0:
            return before
        if c <= bound:
            return before.unionByName(at.orderBy(own).limit(left).drop(own))
        if p == prefix:  # no digit is left: rows of one key
            same = at.drop(own)
            digest = F.md5(F.to_json(F.struct(*[F.col(f"`{x}`") for x in rows.columns])))
            rest = same.limit(left) if same.select(digest).distinct().limit(2).count() == 1 else smallest(same, left, digest, bound)
            return before.unionByName(rest)
        prefix = p
