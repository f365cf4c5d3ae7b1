"""Token counts of documents in flat token files without an index.

A flat file is a run of fixed-width token ids in which an end-of-document id closes each document; here it is read as, or held
as, a table of its blocks (file, block, data), cut at a fixed number of bytes wherever that falls. Each block is searched with one vector
comparison and gives its separators and its open ends; a two-level prefix scan over the block summaries (blocks within
super-blocks, then super-blocks) numbers the documents and closes those that run over block bounds. Only summaries,
never tokens, are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shoebox.llm.bpe import load_codec
from shoebox.llm.common import map_batches, texts_as_bytes
from shoebox.session import materialize
from shoebox.sources.files import list_files

BLOCK_TOKENS = 1 << 18
SUPER_BLOCK = 1024
#: Bytes of a flat file that one task may hold; larger ones are refused.
LARGEST_FILE = 1 << 28


def write_token_blocks(docs: DataFrame, vocabulary: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenizes texts into flat files, one for each task: rows (file, block, data) of the files, and rows
    (file, ordinal, doc_id) that say which document came where. Written once to the shared folder."""

    def run(batches):
        codec, file = load_codec(vocabulary), TaskContext.get().partitionId()
        held, size, block, ordinal = [], 0, 0, 0
        row = lambda **x: {"file": file, "block": None, "data": None, "ordinal": None, "doc_id": None} | x
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                ids = np.append(codec.encode_plain(text), codec.dtype.type(end_id))
                rows.append(row(ordinal=ordinal, doc_id=doc_id))
                ordinal += 1
                held.append(ids)
                size += len(ids)
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    for at in range(0, size - block_tokens + 1, block_tokens):
                        rows.append(row(block=block, data=flat[at : at + block_tokens].tobytes()))
                        block += 1
                    held, size = [flat[size - size % block_tokens :]], size % block_tokens
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if size:
            yield pa.RecordBatch.from_pylist([row(block=block, data=np.concatenate(held).tobytes())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file long, block long, data binary, ordinal long, doc_id long")
    return materialize(rows, "tokens", compression="zstd")


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, largest: int = LARGEST_FILE) -> DataFrame:
    """(file, block, data): the blocks of all flat token files below ``path``, file being a file's path.

    Spark hands a binary file to a task as a whole, so files of over ``largest`` bytes raise here, and are to be written in
    parts; a file whose length is no whole number of tokens raises in its task. Empty files have no blocks."""
    width = np.dtype(dtype).itemsize
    over = list_files(spark, path).filter(F.col("length") > largest).limit(1).collect()
    if over:
        raise ValueError(f"{over[0]['path']} has {over[0]['length']} bytes, more than {largest}")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = data.as_buffer()
                if view.size % width:
                    raise ValueError(f"{name} holds no whole number of tokens")
                for block, at in enumerate(range(0, view.size, block_tokens * width)):
                    part = view.slice(at, min(block_tokens * width, view.size - at)).to_pybytes()
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([block], pa.int64()), "data": pa.array([part], pa.binary())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "file string, block long, data binary")


def block_separators(blocks: DataFrame, end_id: int, dtype: str) -> DataFrame:
    """(file, block, tokens, ends): each block's length in tokens and the places of its end-of-document ids."""
    kind = np.dtype(dtype)

    def make():
        def step(batch):
            sizes, ends = [], []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data or b"", kind)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield {"file": batch.column(0), "block": batch.column(1), "tokens": sizes, "ends": ends}

        return step

    return map_batches(blocks.select("file", "block", "data"), f"file {dict(blocks.dtypes)['file']}, block long, tokens long, ends array<long>", make)


def document_lengths(blocks: DataFrame, end_id: int, dtype: str = "<u2", super_block: int = SUPER_BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens): tokens of each document in file order, end-of-document ids not counted.

    Blocks of a file are consecutive numbers, in any row order; empty or null blocks are allowed. Tokens behind the last
    end-of-document id of a file form a document of their own, if there are any. No blocks, no rows.
    """
    found = materialize(block_separators(blocks, end_id, dtype), "separators").withColumn("over", F.floor(F.col("block") / super_block))
    each = found.select("file", "over", "block", "tokens", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    inside = Window.partitionBy("file", "over").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = each.select(
        "file", "over", "block", "tokens",
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("docs_before"),
        "last",
    )
    local = local.withColumn("end_here", F.col("tokens_before") + F.col("last"))
    local = local.withColumn("end_before", F.max("end_here").over(inside)).drop("last")
    supers = each.groupBy("file", "over").agg(F.sum("tokens").alias("s_tokens"), F.sum("n").alias("s_docs")).join(
        local.groupBy("file", "over").agg(F.max("end_here").alias("s_end")), ["file", "over"]
    )
    across = Window.partitionBy("file").orderBy("over").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.withColumn("base", F.coalesce(F.sum("s_tokens").over(across), F.lit(0))).withColumn("docs", F.coalesce(F.sum("s_docs").over(across), F.lit(0)))
    supers = supers.withColumn("s_before", F.max(F.col("base") + F.col("s_end")).over(across)).select("file", "over", "base", "docs", "s_before")
    placed = local.join(supers, ["file", "over"]).select(
        "file", "block",
        (F.col("base") + F.col("tokens_before")).alias("at"),
        (F.col("docs") + F.col("docs_before")).alias("ordinal"),
        F.coalesce(F.col("base") + F.col("end_before"), F.col("s_before"), F.lit(-1)).alias("previous"),
    )
    closed = found.join(placed, ["file", "block"]).select("file", "ordinal", "previous", F.transform("ends", lambda e: e + F.col("at")).alias("ends"))
    before = F.slice(F.concat(F.array("previous"), "ends"), F.lit(1), F.size("ends"))
    closed = closed.select("file", "ordinal", F.posexplode(F.zip_with("ends", before, lambda end, last: end - last - 1)).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens")
    totals = placed.join(found.select("file", "block", "tokens", "ends"), ["file", "block"]).groupBy("file").agg(
        F.max(F.col("at") + F.col("tokens")).alias("stop"),
        F.max(F.greatest("previous", F.col("at") + F.try_element_at("ends", F.lit(-1)))).alias("end"),
        F.max(F.col("ordinal") + F.size("ends")).alias("ordinal"),
    )
    rest = totals.filter("stop - end - 1 > 0").select("file", "ordinal", (F.col("stop") - F.col("end") - 1).alias("n_tokens"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, vocabulary: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) for every row, counted from the flat files that the texts were written to.

    Null or empty text has no tokens; repeated rows and null ids stay; other columns are ignored.
    """
    rows = write_token_blocks(docs, vocabulary, end_id, block_tokens)
    lengths = document_lengths(rows.filter("block is not null"), end_id)
    order = rows.filter("block is null").select("file", "ordinal", "doc_id")
    return order.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
