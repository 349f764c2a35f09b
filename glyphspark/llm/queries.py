"""The registered queries of this subpackage and their SQL.

Each query applies its operator to the whole documents table and derives the
columns that its contract names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, licenses, media, mixing, pii, quality, quality_classifier, resampling, runs, simhash, substring_dedup, suffix_dedup, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), ids=False)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir), files=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("found")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir), texts=False)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir), texts=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return runs.find_runs(docs.select("doc_id", runs.planted(docs["doc_id"], docs["text"]).alias("text")), details=False)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_bpe, op3_media, op4_simhash, op5_licenses, op6_quality, op7_substring_dedup, op8_suffix_dedup, op9_token_counts, op10_pii, op11_quality_classifier, op12_runs, op13_resampling)}
ORACLE_SQL = {"op1_mixing": mixing.SQL, "op6_quality": quality.SQL, "op7_substring_dedup": substring_dedup.SQL, "op8_suffix_dedup": suffix_dedup.SQL, "op13_resampling": resampling.SQL}
