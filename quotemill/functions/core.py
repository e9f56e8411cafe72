"""Column functions that operators share; all stay in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P


def floor_to(df: DataFrame, ts: str, width: str, name: str) -> DataFrame:
    """df with the start of ts's epoch-aligned window of the given width ('15 minutes', '4 hours', '1 day')."""
    return df.withColumn(name, F.window(F.col(ts), width)["start"])


def slice_of(df: DataFrame, ts: str, width: str, name: str) -> DataFrame:
    """floor_to that keeps rows without a time, before all others."""
    first = F.lit("0001-01-01").cast(df.schema[ts].dataType)
    return floor_to(df.withColumn("_time", F.coalesce(F.col(ts), first)), "_time", width, name).drop("_time")


def known(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the other columns of values, which has a row for each of df's keys; a null is a key like others."""
    r = values.withColumnsRenamed({k: f"_{k}" for k in keys})
    return df.join(r, functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*r.columns[: len(keys)])


def over(keys=P.KEY, order=("bar_time",)) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def session_label(ts: str | Column) -> Column:
    """The market session of a time by priority; what no session covers is asian."""
    hour = F.hour(ts)
    out = None
    for name, start, end in P.SESSIONS:
        hit = (hour >= start) & (hour < end)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("asian")


def session_by_start(ts: str | Column) -> Column:
    """The session whose start hour was passed last; newyork lasts to midnight."""
    hour = F.hour(ts)
    out = None
    for name, start in P.SESSION_STARTS:
        out = F.when(hour >= start, name) if out is None else out.when(hour >= start, name)
    return out.otherwise("asian")


def as_float(c: str | Column) -> Column:
    """A double, null for NaN and for what doesn't parse."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def as_int(c: str | Column) -> Column:
    return as_float(c).cast("long")


def as_bool(c: str | Column) -> Column:
    """true for true, 1, yes and nonzero numbers; false for everything else, null included."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.trim(c.cast("string")))
    number = s.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), (number != 0) & ~F.isnan(number)).otherwise(s.isin("true", "yes")), F.lit(False))


def r_dynamic(atr: Column, median: Column) -> Column:
    """Bars a fractal waits for on its right: round(3 * median / atr), half to even, within 2 to 5; 5 without an ATR."""
    usable = atr.isNotNull() & ~F.isnan(atr) & (atr > 0)
    base = F.coalesce(F.nullif(median, F.lit(0.0)), F.lit(1.0))
    r = F.bround(F.lit(P.R_FACTOR) * base / F.when(usable, atr), 0)
    clipped = F.greatest(F.lit(float(P.FRACTAL_RIGHT_MIN)), F.least(F.lit(float(P.FRACTAL_RIGHT_MAX)), r))
    return F.when(usable, clipped).otherwise(float(P.FRACTAL_RIGHT_MAX)).cast("int")


def wide_spread(spread: Column, pips: float = P.WIDE_PIPS, pip: float = P.PIP) -> Column:
    return spread >= F.lit(pips * pip)


def spread_gate(spread: Column, atr: Column) -> Column:
    """True where the spread is too wide for the 15-minute ATR."""
    return F.coalesce((atr > 0) & (spread > atr * F.lit(P.SPREAD_ATR)), F.lit(False))
