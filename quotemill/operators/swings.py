"""Williams fractals as windows, and counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import over


def fractals(bars: DataFrame, left: int, right: int | None, high: str = "is_swing_high", low: str = "is_swing_low") -> DataFrame:
    """bars with strict fractal flags: above (below) all of ``left`` bars before and ``right`` after, all of which exist.

    right None takes each bar's r_dynamic (2 to 5).  The bars whose windows are cut by an end are no fractals.
    """
    w = over()

    def beats(col: str, agg, better) -> Column:
        before = better(F.col(col), agg(col).over(w.rowsBetween(-left, -1))) & F.lag(col, left).over(w).isNotNull()

        def after(r: int) -> Column:
            return better(F.col(col), agg(col).over(w.rowsBetween(1, r))) & F.lead(col, r).over(w).isNotNull()

        if right is not None:
            return before & after(right)
        chosen = F.lit(False)
        for r in range(P.FRACTAL_RIGHT_MIN, P.FRACTAL_RIGHT_MAX + 1):
            chosen = F.when(F.col("r_dynamic") == r, after(r)).otherwise(chosen)
        return before & chosen

    return bars.withColumn(high, F.coalesce(beats("bar_high", F.max, lambda a, b: a > b), F.lit(False))).withColumn(low, F.coalesce(beats("bar_low", F.min, lambda a, b: a < b), F.lit(False)))


def swing_rows(flagged: DataFrame, high: str = "is_swing_high", low: str = "is_swing_low") -> DataFrame:
    """One row per swing: symbol, source, bar_time, kind, price; highs before lows of the same bar."""
    kinds = F.array(F.when(F.col(high), F.struct(F.lit("high").alias("kind"), F.col("bar_high").alias("price"))), F.when(F.col(low), F.struct(F.lit("low").alias("kind"), F.col("bar_low").alias("price"))))
    return flagged.select(*P.KEY, "bar_time", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("s")).select(*P.KEY, "bar_time", "s.kind", "s.price")


def known_swings(flagged: DataFrame, width: str, kept: int = P.EQUAL_LOOKBACK) -> DataFrame:
    """swing_rows with ``visible``, when the bar that confirms it (r_dynamic bars later) has closed, and ``until``, when
    the swing of its kind ``kept`` places later is visible.  Of one kind, swings are confirmed in their order."""
    at = F.lit(None).cast(flagged.schema["bar_time"].dataType)
    for r in range(P.FRACTAL_RIGHT_MIN, P.FRACTAL_RIGHT_MAX + 1):
        at = F.when(F.col("r_dynamic") == r, F.lead("bar_time", r).over(over())).otherwise(at)
    rows = flagged.withColumn("visible", at + F.expr(f"INTERVAL {width}"))
    found = swing_rows(rows).join(rows.select(*P.KEY, "bar_time", "visible"), [*P.KEY, "bar_time"])
    return found.withColumn("until", F.lead("visible", kept).over(W.partitionBy(*P.KEY, "kind").orderBy("bar_time")))


def swing_counts(swings: DataFrame) -> DataFrame:
    """Swings with running numbers of highs and lows, in the order (bar_time, kind)."""
    w = over(order=("bar_time", "kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return swings.withColumn("n_highs", F.count_if(F.col("kind") == "high").over(w)).withColumn("n_lows", F.count_if(F.col("kind") == "low").over(w))


def last_confirmed(bars: DataFrame, side: int = P.FRACTAL_1M) -> DataFrame:
    """bars with the prices of the last 1-minute swings that ``side`` later bars have confirmed."""
    w = over()
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    f = fractals(bars, side, side, "_h", "_l")
    f = f.withColumn("_hp", F.lag(F.when(F.col("_h"), F.col("bar_high")), side).over(w)).withColumn("_lp", F.lag(F.when(F.col("_l"), F.col("bar_low")), side).over(w))
    return f.withColumn("confirmed_1m_swing_high", F.last("_hp", ignorenulls=True).over(run)).withColumn("confirmed_1m_swing_low", F.last("_lp", ignorenulls=True).over(run)).drop("_h", "_l", "_hp", "_lp")


def last_n(swings: DataFrame, n: int) -> DataFrame:
    """The last n swings of each key and kind."""
    w = W.partitionBy(*P.KEY, "kind").orderBy(F.col("bar_time").desc())
    return swings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def fractals_v3(bars: DataFrame, window: int = P.V3_WINDOW, minimum: float = P.V3_SWING_ATR, atr: str = "atr_14") -> DataFrame:
    """Older swings: strict on both sides, prices to 5 places, bar range at least ``minimum`` ATR (mean ATR where null)."""
    rounded = bars.withColumn("bar_high", F.round("bar_high", 5)).withColumn("bar_low", F.round("bar_low", 5))
    f = fractals(rounded, window, window)
    mean = F.avg(atr).over(W.partitionBy(*P.KEY))
    size = F.coalesce(F.col(atr), mean, (F.col("bar_high") - F.col("bar_low")) * 0.005)
    big = (F.col("bar_high") - F.col("bar_low")) >= size * minimum
    return f.withColumn("is_swing_high", F.col("is_swing_high") & big).withColumn("is_swing_low", F.col("is_swing_low") & big)


def bias_4h(bars: DataFrame, side: int = P.FRACTAL_4H) -> DataFrame:
    """bars with market_bias_4h, from fractals known ``side`` bars later; neutral before the first and in short series.

    A high above the last higher high is bullish once a higher low exists, else bearish once a lower high's mirror
    exists; lows mirror it and are judged after the bar's high.
    """
    w = over()
    run, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    f = fractals(bars, side, side, "_h", "_l")
    f = f.withColumn("_hp", F.when(F.col("_h"), F.col("bar_high"))).withColumn("_lp", F.when(F.col("_l"), F.col("bar_low")))
    f = f.withColumn("_top", F.max("_hp").over(before)).withColumn("_bottom", F.min("_lp").over(before))
    higher = F.col("_h") & (F.col("_top").isNull() | (F.col("_hp") > F.col("_top")))
    lower = F.col("_l") & (F.col("_bottom").isNull() | (F.col("_lp") < F.col("_bottom")))
    f = f.withColumn("_HH", higher).withColumn("_LH", F.col("_h") & ~higher).withColumn("_LL", lower).withColumn("_HL", F.col("_l") & ~lower)
    seen = lambda c, frame: F.coalesce(F.max(F.col(c).cast("int")).over(frame), F.lit(0)) == 1
    f = f.withColumn("_had_hl", seen("_HL", before)).withColumn("_had_ll", seen("_LL", before)).withColumn("_had_hh", seen("_HH", run)).withColumn("_had_lh", seen("_LH", run))
    from_high = F.when(F.col("_HH") & F.col("_had_hl"), "bullish").when(F.col("_LH") & F.col("_had_ll"), "bearish")
    from_low = F.when(F.col("_LL") & F.col("_had_lh"), "bearish").when(F.col("_HL") & F.col("_had_hh"), "bullish")
    f = f.withColumn("_event", F.coalesce(from_low, from_high))
    f = f.withColumn("_state", F.last("_event", ignorenulls=True).over(run)).withColumn("_known", F.lag("_state", side).over(w))
    return f.withColumn("market_bias_4h", F.coalesce("_known", F.lit("neutral"))).select(*bars.columns, "market_bias_4h")
