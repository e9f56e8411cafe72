"""Day and session levels from minute ranges or ticks, with windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import floor_to, over, session_by_start
from .candles import daily_ranges


def session_levels(minutes: DataFrame, sessions_back: int = 2) -> DataFrame:
    """A snapshot at each minute whose session (by start hour) differs from the minute before.

    prev_day_*: range of the day before by day of year; current_session_*: the boundary minute's own range;
    prev_session_*: the session ``sessions_back`` rolls before (2 as the snapshot precedes the roll; 1 for the older rule).
    """
    w = over(order=("minute",))
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    m = minutes.withColumn("session_name", session_by_start("minute")).withColumn("_day", F.dayofyear(F.to_date("minute")))
    changed = lambda c: (~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    m = m.withColumn("_new_day", changed("_day")).withColumn("_new_session", changed("session_name"))
    m = m.withColumn("_d", F.sum("_new_day").over(run)).withColumn("_s", F.sum("_new_session").over(run))

    def earlier(group: str, back: int, prefix: str) -> DataFrame:
        g = m.groupBy(*P.KEY, group).agg(F.max("high").alias("h"), F.min("low").alias("l"))
        return g.select(*P.KEY, (F.col(group) + back).alias(group), F.col("h").alias(f"{prefix}_high"), F.col("l").alias(f"{prefix}_low"))

    snap = m.filter("_new_session = 1")
    out = snap.join(earlier("_d", 1, "prev_day"), [*P.KEY, "_d"], "left").join(earlier("_s", sessions_back, "prev_session"), [*P.KEY, "_s"], "left")
    return out.select(
        *P.KEY, F.col("minute").alias("snapshot_time"), F.lit(True).alias("session_boundary"), "session_name", "prev_day_high", "prev_day_low",
        F.col("high").alias("current_session_high"), F.col("low").alias("current_session_low"), "prev_session_high", "prev_session_low",
    )


def tick_session_levels(ticks: DataFrame, bars_4h: DataFrame) -> DataFrame:
    """The older rule: a snapshot at each tick, by (timestamp_utc, seq), whose session differs from the tick's before.

    A key's first tick is silent and counts as asian whatever its hour.  current_session_*: the boundary tick's mid;
    prev_session_*: range of the ticks since the boundary before; prev_day_*: yesterday's range of 4-hour bars, taken
    at a boundary within hour 0 if yesterday has any, otherwise as at the boundary before.

    Ticks are aggregated to minutes first, as no boundary lies within one; only the silent tick stands alone.
    """
    at = F.struct("timestamp_utc", "seq")
    silent = ticks.groupBy(*P.KEY).agg(F.min(at).alias("_silent"))
    t = floor_to(ticks, "timestamp_utc", "1 minute", "minute").join(F.broadcast(silent), [*P.KEY]).withColumn("_silent", at == F.col("_silent"))
    m = t.groupBy(*P.KEY, "minute", "_silent").agg(F.min(F.struct("timestamp_utc", "seq", "mid")).alias("_first"), F.max("mid").alias("high"), F.min("mid").alias("low"))
    w = over(order=("_first",))
    m = m.withColumn("_name", F.when(F.col("_silent"), "asian").otherwise(session_by_start("minute")))
    m = m.withColumn("_turn", F.coalesce(F.col("_name") != F.lag("_name").over(w), F.lit(False)).cast("int"))
    m = m.withColumn("_s", F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    before = m.groupBy(*P.KEY, (F.col("_s") + 1).alias("_s")).agg(F.max("high").alias("prev_session_high"), F.min("low").alias("prev_session_low"))
    # A null day joins nothing, so only boundaries within hour 0 meet yesterday.
    snap = m.filter("_turn = 1").withColumn("day", F.when(F.hour("minute") == 0, F.date_sub(F.to_date("minute"), 1)))
    out = snap.join(before, [*P.KEY, "_s"], "left").join(daily_ranges(bars_4h), [*P.KEY, "day"], "left")
    known = over(order=("_s",)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.select(
        *P.KEY, F.col("_first.timestamp_utc").alias("snapshot_time"), F.lit(True).alias("session_boundary"),
        F.last("day_high", ignorenulls=True).over(known).alias("prev_day_high"), F.last("day_low", ignorenulls=True).over(known).alias("prev_day_low"),
        F.col("_first.mid").alias("current_session_high"), F.col("_first.mid").alias("current_session_low"), "prev_session_high", "prev_session_low",
    )


LEVELS = [("prev_day_high", "high", 1), ("prev_day_low", "low", 1), ("current_session_high", "high", 2), ("current_session_low", "low", 2), ("prev_session_high", "high", 2), ("prev_session_low", "low", 2)]


def _each_level(snapshots: DataFrame, *more: str) -> DataFrame:
    each = F.array(*[F.struct(F.col(c).alias("price"), F.lit(d).alias("direction"), F.lit(t).alias("tier"), F.lit(i).alias("ordinal")) for i, (c, d, t) in enumerate(LEVELS)])
    return snapshots.select(*P.KEY, F.col("snapshot_time").alias("visible"), *more, F.explode(each).alias("l")).select(*P.KEY, "visible", *more, "l.*").filter("price IS NOT NULL")


def levels_of(snapshots: DataFrame) -> DataFrame:
    """Tier 1 and 2 levels with the time from which they count; of equal (price to 2 places, direction) the first stays."""
    key = [*P.KEY, "direction", F.rint(F.col("price") * 100).alias("_k")]
    first = _each_level(snapshots).groupBy(*key).agg(F.min_by(F.struct("price", "tier", "visible", "ordinal"), F.struct("visible", "ordinal")).alias("f"))
    return first.select(*P.KEY, "direction", "f.*")


def recent_levels(snapshots: DataFrame, kept: int = P.LEVEL_SNAPSHOTS) -> DataFrame:
    """Tier 1 and 2 levels of each snapshot, from its time until the snapshot ``kept`` places later."""
    return _each_level(snapshots.withColumn("until", F.lead("snapshot_time", kept).over(over(order=("snapshot_time",)))), "until")
