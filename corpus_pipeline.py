"""A corpus pipeline made of the operators in quotemill.llm.

Every stage takes and (but for the last) returns the columns of documents; further columns pass through whatever their
names.  Null and letterless texts go in the first stage, so do rows whose text no model accepts; rows with a null doc_id
stay unless they are exact copies; repeated rows are exact copies, of which one stays.  Ties go to the smallest doc_id.  An
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup, workspace


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts (texts without letters among them)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return language_id.identify(rows, language_id.train(docs)).filter("NOT rejected").select("_row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space one stays."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat or go by their fitted rates; documents of the clean domains stay once at least."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("q0_t0", "q1_t0", "all"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and what they decode to, as digests."""
    return byte_bpe.round_trip_digests(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("byte_bpe", encode),
]

#: The fitted stages are not expressible in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
