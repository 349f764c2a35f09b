"""From documents to a tokenized training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Null and empty texts have too few words
and are rejected by the first stage; an id with several texts or hosts goes row
by row there. Repeated rows are reduced by the second. Null ids and sources pass
all stages. Empty tables give empty results; further columns of documents, of
any names but the operators' own, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.llm import bpe, common, mixing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, each row by its own verdict.

    Boilerplate lines stay in the texts here: what is boilerplate differs by
    host, and copies on two hosts must still be alike for the next stage (the
    README has the copies that would be lost). An empty table stays empty.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays, that of least id; null ids come last. An empty table stays empty."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows. Null texts stay null; an empty table stays empty."""
    clean = pii.redact(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, as repeated rows. Null sources are one source; an empty table stays empty."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digests of ids and decoded bytes. A null text has no tokens; an empty table gives no rows."""
    return bpe.encode(docs).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = common.materialize(docs, f"stage{i}")
    return docs


#: SimHash has no SQL here; the tests hold run() against a brute-force version.
ORACLE_SQL = None
