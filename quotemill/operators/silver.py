"""Validation and normalisation of vendor ticks into unified ticks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import as_float

DUKASCOPY_COLUMNS = ("timestamp_utc", "ask", "bid", "ask_volume", "bid_volume")


def present(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & as_float(n).isNotNull()
    return out


def valid_mt5(df: DataFrame) -> DataFrame:
    """Rows with positive prices, ask above bid, a time and a symbol, which is trimmed and upper-cased."""
    symbol = F.upper(F.trim("symbol"))
    ok = present("bid", "ask") & (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") > F.col("bid")) & (F.col("time_msc") > 0) & (F.length(symbol) > 0)
    return df.filter(ok).withColumn("symbol", symbol)


def valid_dukascopy(df: DataFrame) -> DataFrame:
    ok = present("bid", "ask", "ask_volume", "bid_volume") & (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("ask_volume") >= 0) & (F.col("bid_volume") >= 0)
    return df.filter(ok).withColumn("bid", F.round("bid", 5)).withColumn("ask", F.round("ask", 5))


def valid_unified(df: DataFrame) -> DataFrame:
    ok = present("bid", "ask") & (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")) & F.col("source").isin("mt5", "dukascopy")
    return df.filter(ok).withColumn("bid", F.round("bid", 5)).withColumn("ask", F.round("ask", 5))


def with_mid_spread(df: DataFrame) -> DataFrame:
    return df.withColumn("mid", F.round((F.col("bid") + F.col("ask")) / 2, 5)).withColumn("spread", F.round(F.col("ask") - F.col("bid"), 5))


def unify_mt5(df: DataFrame, min_notional: float = P.MIN_NOTIONAL) -> DataFrame:
    """time_msc (milliseconds) to UTC, notional from lots, the notional floor."""
    v = valid_mt5(df).withColumn("volume_usd", F.col("volume") * F.lit(P.LOT_USD)).filter(F.col("volume_usd") >= min_notional)
    return with_mid_spread(v.select(F.timestamp_millis("time_msc").alias("timestamp_utc"), "symbol", "bid", "ask", "volume", "volume_usd", F.lit("mt5").alias("source")))


def _judged(df: DataFrame, min_notional: float) -> DataFrame:
    """Each Dukascopy row with the first rule that it breaks, or ok."""
    for c in ("bid", "ask", "ask_volume", "bid_volume"):
        df = df.withColumn(c, as_float(c))
    df = df.withColumn("volume", (F.col("ask_volume") + F.col("bid_volume")) / 2)
    df = df.withColumn("volume_usd", F.col("volume") * (F.col("bid") + F.col("ask")) / 2)
    whole = F.col("timestamp_utc").isNotNull() & F.col("bid").isNotNull() & F.col("ask").isNotNull() & F.col("ask_volume").isNotNull() & F.col("bid_volume").isNotNull()
    rule = (
        F.when(~whole, "invalid").when((F.col("bid") <= 0) | (F.col("ask") <= 0), "invalid").when(F.col("ask") < F.col("bid"), "inverted")
        .when(F.col("volume_usd") < min_notional, "below_notional").otherwise("ok")
    )
    return df.withColumn("rule", rule)


def unify_dukascopy(df: DataFrame, symbol: str = "XAUUSD", min_notional: float = P.MIN_NOTIONAL, told: Observation | None = None) -> DataFrame:
    """Prices and mean volume of good rows; zero spreads stay, inverted rows and small notionals go."""
    missing = [c for c in DUKASCOPY_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol))
    judged = _judged(df, min_notional)
    if told is not None:
        judged = judged.observe(told, *_counters())
    good = judged.filter("rule = 'ok'").select("timestamp_utc", F.upper(F.trim(F.coalesce("symbol", F.lit(symbol)))).alias("symbol"), F.round("bid", 5).alias("bid"), F.round("ask", 5).alias("ask"), "volume", "volume_usd", F.lit("dukascopy").alias("source"))
    return with_mid_spread(good)


def _counters() -> list[Column]:
    named = [F.count_if(F.col("rule") == r).alias(r) for r in ("invalid", "inverted", "below_notional", "ok")]
    return [F.count(F.lit(1)).alias("raw"), *named, F.count_if((F.col("ask") == F.col("bid")) & (F.col("rule") == "ok")).alias("zero_spread")]


def quality_counters(df: DataFrame, min_notional: float = P.MIN_NOTIONAL) -> DataFrame:
    """One row: raw, invalid, inverted, zero_spread, below_notional, ok; a single partial aggregate."""
    return _judged(df, min_notional).agg(*_counters())


def unify_observed(df: DataFrame, symbol: str = "XAUUSD", min_notional: float = P.MIN_NOTIONAL) -> tuple[DataFrame, Observation]:
    """unify_dukascopy, and an observation that has quality_counters' figures once the rows have been written or counted:
    they are gathered in the same pass, no second scan."""
    told = Observation(f"quality-{uuid.uuid4().hex[:8]}")
    return unify_dukascopy(df, symbol, min_notional, told), told


def in_days(df: DataFrame, start, end, ts: str = "timestamp_utc") -> DataFrame:
    """Rows of the days start to end, both included, as a half-open range that the scan can use."""
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end) + F.expr("INTERVAL 1 DAY")))


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; max_by-style aggregation combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What an insert adds: the new rows, one for each key, whose key is not there yet."""
    return dedup_first(new, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
