"""Bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import floor_to


def ohlc(ticks: DataFrame, width: str, volume: bool = False, price: str = "mid", tie: str = "seq") -> DataFrame:
    """symbol, source, bar_time, bar_open, bar_high, bar_low, bar_close (bar_volume): left-closed bars with ticks.

    Open and close go by (timestamp_utc, tie).  Partial aggregation leaves a row per bar and task to shuffle.
    """
    at = F.struct("timestamp_utc", tie)
    aggs = [F.min_by(price, at).alias("bar_open"), F.max(price).alias("bar_high"), F.min(price).alias("bar_low"), F.max_by(price, at).alias("bar_close")]
    if volume:
        aggs.append(F.sum("volume").alias("bar_volume"))
    return floor_to(ticks, "timestamp_utc", width, "bar_time").groupBy(*P.KEY, "bar_time").agg(*aggs)


def minute_ranges(ticks: DataFrame) -> DataFrame:
    return floor_to(ticks, "timestamp_utc", "1 minute", "minute").groupBy(*P.KEY, "minute").agg(F.max("mid").alias("high"), F.min("mid").alias("low"))


def daily_ranges(bars: DataFrame) -> DataFrame:
    """High and low of each day from bars."""
    return bars.groupBy(*P.KEY, F.to_date("bar_time").alias("day")).agg(F.max("bar_high").alias("day_high"), F.min("bar_low").alias("day_low"))


def volume_of(ticks: DataFrame, width: str) -> DataFrame:
    return floor_to(ticks, "timestamp_utc", width, "bar_time").groupBy(*P.KEY, "bar_time").agg(F.sum("volume").alias("bar_volume"))
