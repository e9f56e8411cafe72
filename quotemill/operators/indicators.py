"""ATR, RSI, EMA and the values derived from them.

Wilder's recursion is linear but unbounded in the past, so it is not a window frame: it is a scan over slices of time
(``scan``), so that a key's history is many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.core import over, r_dynamic
from . import scan


def per_key(df: DataFrame, fn, added: list[T.StructField], keys=P.KEY, order: str = "bar_time") -> DataFrame:
    """df with columns that fn (sorted pandas frame of one key -> dict of arrays) computes."""
    names = {f.name for f in added}
    df = df.select(*[c for c in df.columns if c not in names])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable").reset_index(drop=True)
        return g.assign(**fn(g))

    return df.groupBy(*keys).applyInPandas(run, T.StructType([*df.schema.fields, *added]))


def _true_range() -> Column:
    return F.greatest(F.col("bar_high") - F.col("bar_low"), F.abs(F.col("bar_high") - F.col("_close")), F.abs(F.col("bar_low") - F.col("_close")))


def _atr(n: int, name: str, warmup: str) -> scan.Average:
    return scan.Average("_tr", name, 1 / n, seed=n, shown=n, early=0.0 if warmup == "zero" else None)


def _strength(n: int) -> list[scan.Average]:
    return [scan.Average("_up", "_rise", 1 / n, shown=n), scan.Average("_down", "_fall", 1 / n, shown=n)]


def _changes(price: str) -> dict[str, Column]:
    change = F.coalesce(F.col(price) - F.col("_close"), F.lit(0.0))
    return {"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))}


def _rsi() -> Column:
    return F.when(F.col("_rise").isNotNull(), F.when(F.col("_fall") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_rise") / F.col("_fall"))))


def atr(bars: DataFrame, n: int, name: str, warmup: str = "zero") -> DataFrame:
    """Wilder's average true range.  The first value, at bar n-1, is the mean of n true ranges; bars before it are 0
    (or null, by warmup); all null with fewer than n bars."""
    b = scan.previous(scan.sliced(bars, "bar_time"), "bar_close", "_close").withColumn("_tr", _true_range())
    return scan.averages(b, [_atr(n, name, warmup)]).select(*[c for c in bars.columns if c != name], name)


def rsi(bars: DataFrame, n: int = P.RSI, name: str = "rsi_14", price: str = "bar_close", order: str = "bar_time") -> DataFrame:
    """Relative strength from Wilder averages of rises and falls, which start as none at the first bar, from bar n-1 on; 100
    without falls."""
    b = scan.previous(scan.sliced(bars, order), price, "_close", order=order)
    found = scan.averages(b.withColumns(_changes(price)), _strength(n), order=order)
    return found.select(*[c for c in bars.columns if c != name], _rsi().alias(name))


def atr_rsi(bars: DataFrame, n: int, name: str, warmup: str = "zero") -> DataFrame:
    """atr(n) and rsi() of the same bars in one scan."""
    b = scan.previous(scan.sliced(bars, "bar_time"), "bar_close", "_close").withColumn("_tr", _true_range())
    found = scan.averages(b.withColumns(_changes("bar_close")), [_atr(n, name, warmup), *_strength(P.RSI)])
    return found.select(*[c for c in bars.columns if c not in (name, "rsi_14")], name, _rsi().alias("rsi_14"))


def ema(df: DataFrame, n: int = P.EMA, price: str = "bid", name: str = "ema_20", order: str = "bar_time") -> DataFrame:
    """Exponential mean with weight 2/(n+1), null for the first n-1 values; order is a time or a number."""
    d = scan.sliced(df, order).withColumn("_price", F.col(price).cast("double"))
    return scan.averages(d, [scan.Average("_price", name, 2 / (n + 1), shown=n)], order=order).select(*[c for c in df.columns if c != name], name)


def medians(bars: DataFrame, name: str, alias: str = "median_atr") -> DataFrame:
    """The exact median of each key, nulls and NaN left out."""
    return bars.filter(F.col(name).isNotNull() & ~F.isnan(name)).groupBy(*P.KEY).agg(F.median(name).alias(alias))


def with_r_dynamic(bars: DataFrame, atr_name: str = "atr_15_15m", trailing: int | None = None) -> DataFrame:
    """bars with r_dynamic, from the median of all of a key's values, or of the last ``trailing`` up to each bar."""
    if trailing:
        m = bars.withColumn("_median", F.percentile(F.when(~F.isnan(atr_name), F.col(atr_name)), F.lit(0.5)).over(over().rowsBetween(1 - trailing, W.currentRow)))
    else:
        m = bars.join(medians(bars, atr_name, "_median"), list(P.KEY), "left")
    return m.withColumn("r_dynamic", r_dynamic(F.col(atr_name), F.col("_median"))).drop("_median")


def fill_forward(df: DataFrame, cols: list[str], keys=P.KEY, order: str = "bar_time") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def trend_blocks(bars: DataFrame, col: str) -> DataFrame:
    """Runs of equal values: symbol, source, value, first and last bar and number of bars."""
    w = over()
    change = (~F.col(col).eqNullSafe(F.lag(col).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = bars.withColumn("_change", change)
    block = marked.withColumn("_block", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return block.groupBy(*P.KEY, "_block").agg(F.first(col).alias("value"), F.min("bar_time").alias("start"), F.max("bar_time").alias("end"), F.count(F.lit(1)).alias("bars")).drop("_block")
