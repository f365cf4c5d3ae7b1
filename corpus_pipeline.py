"""Corpus pipeline over ``documents``: language ID, near-dedup, decontamination, secret redaction, BPE digests.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. What a stage returns is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import bpe, decontam, langid, secrets, simhash
from shoebox.llm.queries import table, vocabulary
from shoebox.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: not ``und``, and scored at least ``langid.MIN_SCORE``."""
    return langid.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies, told apart by all its columns; see simhash."""
    return simhash.one_of_each_group(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; all documents stay."""
    return secrets.redact(docs)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", no_benchmark),
    ("secret_scan", no_secrets),
    ("bpe_encoding", token_digests),
]

#: BPE and a trained network cannot be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
