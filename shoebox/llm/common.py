"""What the text operators share: reading columns, Arrow helpers, the held-out rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in either case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def columns_of(df: DataFrame) -> list:
    """All columns, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def held_out(doc_id="doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """``mapInArrow`` with state made once per task: ``make()`` returns a function from a batch to dicts of columns."""

    def run(batches):
        step = make()
        for batch in batches:
            for columns in step(batch):
                yield pa.RecordBatch.from_pydict(columns, schema=target)

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(kind)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names with dots or backticks are not taken as they are
    return plain.mapInArrow(run, kind)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack_texts():
    """Task function from (key, text) to (key, compressed text): texts are shuffled once, compressed."""
    squeeze = zstandard.ZstdCompressor(level=3)

    def step(batch):
        yield {"key": batch.column(0), "packed": pa.array([squeeze.compress(t) for t in texts_as_bytes(batch.column(1))], pa.binary())}

    return step


def unpack_texts(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(p) for p in column.to_pylist()]
