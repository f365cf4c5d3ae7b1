"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import bisectors, bpe, decontam, langid, licenses, media, periods, quality, rank_bpe, secrets, simhash, suffix_dedup, token_scan
from shoebox.llm.common import table


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary; nothing of it is kept here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The end-of-document id of that vocabulary.
END_ID = 50256


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op11_bisector_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.cluster_vectors(table(spark, sf_dir, "embeddings"))


def ranks() -> tuple[str, str]:
    """Path of the same vocabulary as ranks, and the pattern that splits text before the merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encoding_digests(table(spark, sf_dir, "documents"), *ranks())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(periods.periodic_runs(periods.plant_periods(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_suffix_dedup, op3_media_columns, op4_token_counts, op5_language_id, op6_bpe_encoding, op7_license_scans, op8_decontamination, op9_simhash_near_dedup, op10_secret_scans, op11_bisector_clustering, op12_rank_bpe, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op11_bisector_clustering": bisectors.oracle()}
