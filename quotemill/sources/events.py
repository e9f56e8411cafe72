"""The driver's events table as ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_ticks(spark: SparkSession, sf_dir: str, two_sources: bool = False) -> DataFrame:
    """timestamp_utc, symbol, source, bid, ask, volume, seq; zero-spread and inverted rows among them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = F.when(F.col("event_id") % 2 == 0, "dukascopy").otherwise("mt5") if two_sources else F.lit("dukascopy")
    offset = F.when(F.col("event_id") % 97 == 0, F.lit(-0.5)).otherwise(F.lit(0.05) * (F.col("event_id") % 4))
    return e.select(
        F.col("ts").alias("timestamp_utc"), F.col("event_type").alias("symbol"), source.alias("source"), F.col("value").alias("bid"),
        (F.col("value") + offset).alias("ask"), (F.lit(1) + F.col("user_id") % 50).cast("double").alias("volume"), F.col("event_id").alias("seq"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid ticks with unrounded mid and spread, as the feature operators take them."""
    t = raw_ticks(spark, sf_dir).filter("bid > 0 AND ask > 0 AND ask >= bid")
    return t.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid"))
