"""Fair value gaps on 1-minute bars: detection, filling, and the active gap of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import over
from .asof import asof_backward


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(over()))


def find_gaps(bars: DataFrame, structured: DataFrame, atr: str = "atr_20_1m", fallback: bool = True) -> DataFrame:
    """Gaps around bar i within 20 bars after the last 15-minute trigger: formed_at, bar_no, fvg_high, fvg_low, fvg_side,
    fvg_trend (of that time, 'unknown' before the first), bos_bar_time, fvg_filled, filled_at.

    A gap is filled by the first close beyond its far edge among bars i+2 to i+21.  fallback: bars without an ATR take the
    key's median, otherwise they make no gaps.
    """
    w = over()
    trig = structured.filter("bos_detected_15m OR choch_detected_15m").select(*P.KEY, F.col("bar_time").alias("trigger_time"))
    trend = structured.select(*P.KEY, F.col("bar_time").alias("_tt"), F.col("smc_trend_15m").alias("fvg_trend"))
    b = numbered(bars)
    # The trigger's place among 1-minute bars: the number of the first bar at or after it.
    spot = asof_backward(trig, b, "trigger_time", "bar_time", ["bar_no", "bar_time"]).select(*P.KEY, "trigger_time", (F.coalesce("bar_no", F.lit(0)) + F.when(F.col("bar_time") == F.col("trigger_time"), 0).otherwise(1)).alias("trigger_no"))
    mean = bars.filter(F.col(atr).isNotNull()).groupBy(*P.KEY).agg(F.median(atr).alias("_median"))
    ahead = F.collect_list(F.struct("bar_time", "bar_close")).over(w.rowsBetween(2, P.GAP_AGE + 1))
    b = b.withColumn("_atr", F.col(atr))
    for name, col, shift in (("_h0", "bar_high", 1), ("_l0", "bar_low", 1), ("_h2", "bar_high", -1), ("_l2", "bar_low", -1)):
        b = b.withColumn(name, F.lag(col, shift).over(w))
    b = b.withColumn("_ahead", ahead).join(mean, list(P.KEY), "left").withColumn("_atr", F.coalesce("_atr", "_median") if fallback else F.col("_atr"))
    floor = F.greatest(F.col("_atr") * P.GAP_ATR, F.lit(P.GAP_FLOOR))
    bull, bear = F.col("_l2") > F.col("_h0"), F.col("_h2") < F.col("_l0")
    g = b.filter(F.col("_h0").isNotNull() & F.col("_h2").isNotNull() & (F.abs(F.col("bar_close") - F.col("bar_open")) > F.col("_atr") * P.DISPLACEMENT) & (bull | bear))
    g = g.withColumn("fvg_side", F.when(bull, "bullish_fvg").otherwise("bearish_fvg")).withColumn("fvg_high", F.when(bull, F.col("_l2")).otherwise(F.col("_l0"))).withColumn("fvg_low", F.when(bull, F.col("_h0")).otherwise(F.col("_h2")))
    g = g.filter(F.col("fvg_high") - F.col("fvg_low") >= floor)
    through = F.filter("_ahead", lambda a: ((F.col("fvg_side") == "bullish_fvg") & (a["bar_close"] < F.col("fvg_low"))) | ((F.col("fvg_side") == "bearish_fvg") & (a["bar_close"] > F.col("fvg_high"))))
    g = g.select(*P.KEY, F.col("bar_time").alias("formed_at"), "bar_no", "fvg_high", "fvg_low", "fvg_side", F.try_element_at(through, F.lit(1))["bar_time"].alias("filled_at"))
    g = asof_backward(g, spot, "formed_at", "trigger_time", ["trigger_time", "trigger_no"]).filter(F.col("bar_no") - F.col("trigger_no") <= P.GAP_AGE)
    g = asof_backward(g, trend, "formed_at", "_tt", ["fvg_trend"])
    return g.select(
        *P.KEY, "formed_at", "bar_no", "fvg_high", "fvg_low", "fvg_side", F.col("filled_at").isNotNull().alias("fvg_filled"), "filled_at",
        F.coalesce("fvg_trend", F.lit("unknown")).alias("fvg_trend"), F.col("trigger_time").alias("bos_bar_time"),
    )


def active_gaps(bars: DataFrame, gaps: DataFrame, structured: DataFrame) -> DataFrame:
    """Each 1-minute bar's nearest open gap: formed 1 to 20 bars before, on the trend's side, not filled by then.

    An equi-join on the bar number after each gap is spread over its next 20 bars; equal distances go to the earliest.
    """
    trend = structured.filter("smc_trend_15m IS NOT NULL").select(*P.KEY, F.col("bar_time").alias("_tt"), "smc_trend_15m")
    b = asof_backward(numbered(bars.select(*P.KEY, "bar_time", "bar_close")), trend, "bar_time", "_tt", ["smc_trend_15m"])
    spread = gaps.filter("fvg_trend <> 'unknown'").withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(P.GAP_AGE)))).withColumn("bar_no", F.col("bar_no") + F.col("age"))
    side = F.when(F.col("smc_trend_15m") == "bull", "bullish_fvg").when(F.col("smc_trend_15m") == "bear", "bearish_fvg")
    met = b.join(spread, [*P.KEY, "bar_no"]).filter((F.col("fvg_side") == side) & (F.col("filled_at").isNull() | (F.col("filled_at") > F.col("bar_time"))))
    distance = F.abs((F.col("fvg_high") + F.col("fvg_low")) / 2 - F.col("bar_close"))
    best = met.groupBy(*P.KEY, "bar_time").agg(F.min_by(F.struct("fvg_high", "fvg_low", "fvg_side", "age", "formed_at"), F.struct(distance, F.col("formed_at"))).alias("g"))
    out = b.join(best, [*P.KEY, "bar_time"], "left")
    return out.select(*P.KEY, "bar_time", F.col("g.fvg_high").alias("fvg_high"), F.col("g.fvg_low").alias("fvg_low"), F.col("g.fvg_side").alias("fvg_side"), F.lit(False).alias("fvg_filled"), F.coalesce(F.col("g.age"), F.lit(0)).alias("fvg_age_bars"), F.col("g.formed_at").alias("fvg_timestamp"))


def gaps_v3(bars: DataFrame) -> DataFrame:
    """All three-bar gaps, prices to 5 places, filled by the first later bar whose wick reaches the far edge."""
    w = over()
    after = w.rowsBetween(2, W.unboundedFollowing)
    b = bars.withColumn("_h0", F.lag("bar_high").over(w)).withColumn("_l0", F.lag("bar_low").over(w)).withColumn("_h2", F.lead("bar_high").over(w)).withColumn("_l2", F.lead("bar_low").over(w))
    b = b.withColumn("_min", F.min("bar_low").over(after)).withColumn("_max", F.max("bar_high").over(after))
    bull, bear = F.col("_l2") > F.col("_h0"), F.col("_h2") < F.col("_l0")
    g = b.filter(bull | bear)
    high, low = F.round(F.when(bull, F.col("_l2")).otherwise(F.col("_l0")), 5), F.round(F.when(bull, F.col("_h0")).otherwise(F.col("_h2")), 5)
    g = g.select(*P.KEY, F.col("bar_time").alias("formed_at"), high.alias("fvg_high"), low.alias("fvg_low"), F.when(bull, "bullish").otherwise("bearish").alias("side"), "_min", "_max")
    filled = F.when(F.col("side") == "bullish", F.col("_min") <= F.col("fvg_low")).otherwise(F.col("_max") >= F.col("fvg_high"))
    return g.withColumn("filled", F.coalesce(filled, F.lit(False))).drop("_min", "_max")
