"""The bronze lake: ticks as Parquet partitioned by symbol, year and month, and its compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.silver import DUKASCOPY_COLUMNS, dedup_first


def write_ticks(ticks: DataFrame, path: str, mode: str = "append") -> None:
    parts = ticks.withColumn("year", F.year("timestamp_utc")).withColumn("month", F.month("timestamp_utc"))
    parts.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year", "month").parquet(path)


def scan(spark: SparkSession, path: str, start_month: tuple[int, int] | None = None, end_month: tuple[int, int] | None = None) -> DataFrame:
    """Ticks of the months from start to end, both included; partition predicates prune what is not read, and months
    written with or without a leading zero are one."""
    df = spark.read.parquet(path)
    number = F.col("year") * 12 + F.col("month")
    if start_month:
        df = df.filter(number >= start_month[0] * 12 + start_month[1])
    if end_month:
        df = df.filter(number <= end_month[0] * 12 + end_month[1])
    return df


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file or folder, which must have the vendor's columns."""
    df = spark.read.parquet(path)
    missing = [c for c in DUKASCOPY_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Every (timestamp_utc, symbol) once, the first by file and place, sorted within its month, written to target."""
    df = spark.read.parquet(path).withColumn("_file", F.input_file_name()).withColumn("_place", F.monotonically_increasing_id())
    once = dedup_first(df, ["timestamp_utc", "symbol"], ["_file", "_place"]).drop("_file", "_place")
    once.repartition("symbol", "year", "month").sortWithinPartitions("timestamp_utc").write.mode("overwrite").partitionBy("symbol", "year", "month").parquet(target)
