"""Backtest metrics as aggregates over trades (columns pnl, session, trend, type, mae_pips, mfe_pips, exit_time, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from .scan import sliced


def summary(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, wins (pnl > 0), losses, gross, win rate, profit factor (infinite without losses), means of wins, losses and excursions."""
    win = F.col("pnl") > 0
    won, lost = F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~win, F.col("pnl"))), F.lit(0.0))
    a = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(win).alias("n_wins"), F.count_if(~win).alias("n_losses"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("gross_pnl"), won.alias("won"), lost.alias("lost"),
        F.coalesce(F.avg("mae_pips"), F.lit(0.0)).alias("avg_mae"), F.coalesce(F.avg("mfe_pips"), F.lit(0.0)).alias("avg_mfe"),
    )
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    factor = F.when(F.col("lost") < 0, F.col("won") / -F.col("lost")).when(F.col("won") > 0, F.lit(float("inf"))).otherwise(0.0)
    return a.select(*keys, "n_trades", "n_wins", "n_losses", "gross_pnl", share("n_wins", "n_trades").alias("win_rate"), factor.alias("profit_factor"), share("won", "n_wins").alias("avg_win"), share("lost", "n_losses").alias("avg_loss"), "avg_mae", "avg_mfe")


def by_domain(trades: DataFrame, col: str, domain: tuple[str, ...]) -> DataFrame:
    """n, wins and pnl for every value of a literal domain, zero where it has no trades."""
    spark = trades.sparkSession
    every = spark.createDataFrame([(d,) for d in domain], f"{col} string")
    stats = trades.groupBy(col).agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("pnl") > 0).alias("n_wins"), F.sum("pnl").alias("pnl"))
    j = every.join(stats, col, "left")
    return j.select(col, *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("n_trades", 0), ("n_wins", 0), ("pnl", 0.0))])


def equity_curve(trades: DataFrame, keys=P.KEY, order=("exit_time", "n"), capital: float = P.CAPITAL) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return trades.withColumn("equity", F.lit(capital) + F.sum("pnl").over(w))


def max_drawdown(trades: DataFrame, keys=P.KEY, order=("exit_time", "n"), capital: float = P.CAPITAL, width: str = "30 days") -> DataFrame:
    """The largest fall of equity below its running maximum, which starts at the capital.

    A scan over slices of time (by the first column of order): each slice is reduced to its sum, the highest and the lowest
    equity within it and its own largest fall; what earlier slices lead to is composed over a row per slice.
    """
    keys = list(keys)
    t = sliced(trades, order[0], width)
    within = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.select(*keys, "_slice", *[c for c in order if c not in keys], F.sum("pnl").over(within).alias("_sum"))
    t = t.withColumn("_top", F.greatest(F.lit(0.0), F.max("_sum").over(within)))
    s = t.groupBy(*keys, "_slice").agg(F.max_by("_sum", F.struct(*order)).alias("_end"), F.max("_sum").alias("_high"), F.min("_sum").alias("_low"), F.max(F.col("_top") - F.col("_sum")).alias("_fall"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_start", F.lit(capital) + F.coalesce(F.sum("_end").over(before), F.lit(0.0)))
    s = s.withColumn("_peak", F.greatest(F.lit(capital), F.max(F.col("_start") + F.col("_high")).over(before)))
    return s.groupBy(*keys).agg(F.max(F.greatest(F.col("_fall"), F.col("_peak") - F.col("_start") - F.col("_low"))).alias("max_drawdown"))


def sharpe(trades: DataFrame, keys=P.KEY) -> DataFrame:
    a = trades.groupBy(*keys).agg(F.count("pnl").alias("n"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"))
    return a.select(*keys, F.when((F.col("n") >= 2) & (F.col("s") > 0), F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"))


def funnel(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'reason'").groupBy(F.col("exit_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def detections(features: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.col(c).cast("int")).cast("long") if c in features.columns else F.lit(0).cast("long")
    gaps = F.count_distinct("fvg_timestamp") if "fvg_timestamp" in features.columns else F.lit(0).cast("long")
    return features.agg(one("bos_detected_15m").alias("bos"), one("choch_detected_15m").alias("choch"), one("is_swing_high_15m").alias("swing_highs"), one("is_swing_low_15m").alias("swing_lows"), gaps.alias("gaps"))


def unrealised(positions: DataFrame, pip: float = P.PIP, value: float = P.PIP_VALUE) -> DataFrame:
    """positions (side, entry_price, lot, mid) with their open profit; 0 when flat."""
    return positions.withColumn("unrealised", F.when((F.col("side") == 0) | F.col("entry_price").isNull(), 0.0).otherwise(F.col("side") * (F.col("mid") - F.col("entry_price")) * F.col("lot") * value / pip))
