"""Liquidity levels: equal highs and lows, sweeps by tier, and the older engine's scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import floor_to
from .ranges import Minima, count_up_to, first_hit
from .swings import last_n


def _cluster(prices: list[float], tolerance: float) -> list[tuple[float, int]]:
    """Greedy clusters around the earliest free price; the strongest of those within tolerance of each other stays."""
    free, found = list(prices), []
    while free:
        near = [abs(p - free[0]) <= tolerance for p in free]
        members = [p for p, n in zip(free, near) if n]
        free = [p for p, n in zip(free, near) if not n]
        if len(members) >= P.EQUAL_SIZE:
            found.append((sum(members) / len(members), len(members)))
    kept: list[tuple[float, int]] = []
    for price, strength in sorted(found, key=lambda c: -c[1]):
        if all(abs(price - k) > tolerance for k, _ in kept):
            kept.append((price, strength))
    return kept


def equal_levels(swings: DataFrame, bars: DataFrame, atr: str = "atr_20_1m") -> DataFrame:
    """symbol, source, direction, price, strength of clusters among the last 80 swings of a kind, within a quarter of the
    median ATR; those that the last five closes have all passed are left out.  A key's fold has 80 rows at most."""
    stats = bars.groupBy(*P.KEY).agg(F.median(F.when(~F.isnan(atr), F.col(atr))).alias("_m"))
    recent = last_n(swings, P.EQUAL_LOOKBACK).join(stats, list(P.KEY))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_time", kind="stable")
        rows = _cluster(g["price"].tolist(), float(g["_m"].iloc[0]) * P.EQUAL_ATR)
        return pd.DataFrame([(g["symbol"].iloc[0], g["source"].iloc[0], g["kind"].iloc[0], p, s) for p, s in rows], columns=["symbol", "source", "direction", "price", "strength"])

    found = recent.groupBy(*P.KEY, "kind").applyInPandas(run, "symbol string, source string, direction string, price double, strength int")
    w = W.partitionBy(*P.KEY).orderBy(F.col("bar_time").desc())
    last = bars.select(*P.KEY, "bar_time", "bar_close").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= P.CONSUMED_BARS)
    closes = last.groupBy(*P.KEY).agg(F.count(F.lit(1)).alias("_k"), F.min("bar_close").alias("_lo"), F.max("bar_close").alias("_hi"))
    j = found.join(closes, list(P.KEY)).join(stats, list(P.KEY))
    tol = F.greatest(F.col("_m") * P.SWEEP_ATR, F.lit(P.SWEEP_FLOOR))
    gone = (F.col("_k") >= P.CONSUMED_BARS) & F.when(F.col("direction") == "high", F.col("_lo") > F.col("price") + tol).otherwise(F.col("_hi") < F.col("price") - tol)
    return j.filter(~gone).select(*P.KEY, "direction", "price", "strength")


def swept(direction: Column, price: Column, tol: Column) -> Column:
    """The wick reaches the level within tolerance and the close is back on its other side."""
    return F.when(direction == "high", (F.col("bar_high") >= price - tol) & (F.col("bar_close") < price)).otherwise((F.col("bar_low") <= price + tol) & (F.col("bar_close") > price))


def by_cells(bars: DataFrame, low: Column, high: Column, levels: DataFrame, keys=P.KEY) -> tuple[DataFrame, DataFrame]:
    """(bars, a row for each price cell between low and high; levels with the cell of their ``price``), both with ``_cell``.

    A key's cells are as wide as its bars reach on average, so whatever the instrument there are at most three rows for
    a bar on average.  Levels of keys without bars and rows without prices go.
    """
    slack = (F.abs(low) + F.abs(high)) * 1e-9
    reach = bars.withColumn("_from", low - slack).withColumn("_to", high + slack)
    mean = F.greatest(F.avg(F.col("_to") - F.col("_from")), F.max(F.abs("_to")) * 1e-9)
    width = reach.groupBy(*keys).agg(F.when(mean > 0, mean).otherwise(1.0).alias("_width"))
    cell = lambda x: F.floor(x / F.col("_width"))
    spread = reach.join(width, list(keys)).withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to"))))).drop("_from", "_to", "_width")
    return spread, levels.join(width, list(keys)).withColumn("_cell", cell(F.col("price"))).drop("_width")


SWEPT = "tier int, visible timestamp_ntz, ordinal bigint, direction string"


def _swept_in_cell(bars: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
    """The first level of the lowest tier that each bar sweeps: bar's row number and the level's.

    Levels of a tier and direction are sorted by price; a bar's are a stretch of them, whose least rank (by visible, then
    ordinal) is looked up.  If that one isn't visible yet, none of them is.
    """
    high, low, close, tol = (bars[c].to_numpy(float) for c in ("bar_high", "bar_low", "bar_close", "_tol"))
    levels = levels.sort_values(["visible", "ordinal"], kind="stable", na_position="first").reset_index(drop=True)
    visible = pd.to_datetime(levels["visible"]).to_numpy("datetime64[us]")
    visible = np.where(np.isnat(visible), np.datetime64("0001-01-01", "us"), visible)
    price, kinds = levels["price"].to_numpy(float), levels["tier"].to_numpy() * 2 + (levels["direction"] == "low").to_numpy()
    time = bars["bar_time"].to_numpy("datetime64[us]")
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(price[own], kind="stable")]
        p = price[own]
        if kind % 2:
            a, b = np.searchsorted(p, low - tol, "left"), np.searchsorted(p, close, "left")
            reaches = lambda k, i: low[i] <= p[k] + tol[i]
            a = _settled(a, len(p), reaches, -1)
        else:
            a, b = np.searchsorted(p, close, "right"), np.searchsorted(p, high + tol, "right")
            reaches = lambda k, i: high[i] >= p[k] - tol[i]
            b = _settled(b, len(p), reaches, 1)
        some = np.flatnonzero(a < b)
        if len(some):
            first = Minima(own)(a[some], b[some])
            seen = visible[first] <= time[some]
            found[0].append(some[seen])
            found[1].append(first[seen])
    bar, level = np.concatenate(found[0]), np.concatenate(found[1])
    keep = ["tier", "visible", "ordinal", "direction"]
    return pd.concat([bars[[*P.KEY, "bar_time"]].iloc[bar].reset_index(drop=True), levels[keep].iloc[level].reset_index(drop=True)], axis=1)


def _settled(edge: np.ndarray, n: int, reaches, out: int) -> np.ndarray:
    """The edge of a stretch, moved where the rule as it is rounded includes a level more or less than the sum did.

    out: the way that leads out of the stretch, 1 for its end, -1 for its start.
    """
    edge = edge.copy()
    bars = np.arange(len(edge))
    while True:
        beyond = edge if out > 0 else edge - 1
        at = bars[(beyond >= 0) & (beyond < n)]
        at = at[reaches(beyond[at], at)]
        if not len(at):
            break
        edge[at] += out
    while True:
        inside = edge - 1 if out > 0 else edge
        at = bars[(inside >= 0) & (inside < n)]
        at = at[~reaches(inside[at], at)]
        if not len(at):
            return edge
        edge[at] -= out


def _first_swept(bars: DataFrame, levels: DataFrame, width: str = "90 days") -> DataFrame:
    """(key, bar_time, tier, visible, ordinal, direction) of the first level of each tier and direction that a bar sweeps
    in a cell.  A cell's bars are parted by time, so that a task has a season's at most; levels go to the seasons in which
    they show and the cell has bars."""
    b = floor_to(bars, "bar_time", width, "_slice").select(*P.KEY, "_cell", "_slice", "bar_time", "bar_high", "bar_low", "bar_close", "_tol")
    places = b.select(*P.KEY, "_cell", "_slice").distinct()
    lv = levels.join(places, [*P.KEY, "_cell"]).filter(F.col("visible").isNull() | (F.col("visible") < F.col("_slice") + F.expr(f"INTERVAL {width}")))
    lv = lv.select(*P.KEY, "_cell", F.col("_slice").alias("_slice"), "direction", "price", "tier", "visible", "ordinal")
    kind = bars.schema["bar_time"].dataType.simpleString()
    result = f"symbol string, source string, bar_time {kind}, {SWEPT.replace('timestamp_ntz', kind)}"
    group = [*P.KEY, "_cell", "_slice"]
    return b.groupBy(*group).cogroup(lv.groupBy(*group)).applyInPandas(lambda x, y: _swept_in_cell(x, y), result)


def sweeps(bars: DataFrame, session_levels: DataFrame, swings: DataFrame, equal: DataFrame | None, atr: str = "atr_20_1m", causal: bool = False) -> DataFrame:
    """bars with liq_swept, liq_side, sweep_tier and the sweep candle's low, high, wick and body.

    Levels are tier 1 and 2 session levels from when they show, then all swings and clusters (tier 3); the lowest tier
    wins, then the earliest level.  The range join goes by price cells (``by_cells``): a bar meets the cells between its
    low and high, widened by its tolerance, and a level lies in one cell.  There the first level that a bar sweeps is found
    by two looks into a table of minima (``_first_swept``), however many levels the cell has gathered.

    causal: swings have ``visible`` and, as session levels, ``until``, from and before which a bar must start to sweep
    them; bars without an ATR take the least tolerance, as a median is not known yet, and there are no clusters.
    """
    level_cols = [*P.KEY, "direction", "price", "tier", "visible", "until", "ordinal"]
    never = F.lit(None).cast(bars.schema["bar_time"].dataType)
    median = F.lit(None).cast("double") if causal else F.median(F.when(~F.isnan(atr), F.col(atr)))
    stats = bars.groupBy(*P.KEY).agg(F.count(F.lit(1)).alias("_n"), median.alias("_m")).drop("_n")
    b = bars.join(stats, list(P.KEY), "left").withColumn("_tol", F.greatest(F.coalesce(F.when(~F.isnan(atr), F.col(atr)), F.col("_m"), F.lit(0.0)) * P.SWEEP_ATR, F.lit(P.SWEEP_FLOOR)))
    order = F.struct(F.col("tier"), F.col("visible"), F.col("ordinal"))
    place = F.row_number().over(W.partitionBy(*P.KEY, "kind").orderBy("bar_time"))
    levels = swings.select(*P.KEY, F.col("kind").alias("direction"), "price", F.lit(3).alias("tier"), F.col("visible") if causal else never.alias("visible"), F.col("until") if causal else never.alias("until"), (F.when(F.col("kind") == "high", 0).otherwise(1) * F.lit(1 << 40) + place).cast("long").alias("ordinal"))
    if equal is not None:
        levels = levels.unionByName(equal.select(*P.KEY, "direction", "price", F.lit(3).alias("tier"), never.alias("visible"), never.alias("until"), (F.lit(1 << 42) + F.when(F.col("direction") == "high", 0).otherwise(1)).cast("long").alias("ordinal")))
    levels = levels.unionByName(session_levels.select(*level_cols[:-2], F.col("until") if causal else never.alias("until"), F.col("ordinal").cast("long").alias("ordinal")))
    # Equal levels sweep at the same bars; only the first of each matters.
    levels = levels.groupBy(*level_cols[:-1]).agg(F.min("ordinal").alias("ordinal"))
    b, lv = by_cells(b, F.col("bar_low") - F.col("_tol"), F.col("bar_high") + F.col("_tol"), levels)
    if causal:
        # A bar's low sweeps levels down to its close and its high levels up to its close, both inside its own widened range.
        met = b.join(lv, [*P.KEY, "_cell"]).filter((F.col("visible") <= F.col("bar_time")) & (F.col("until").isNull() | (F.col("until") > F.col("bar_time"))) & swept(F.col("direction"), F.col("price"), F.col("_tol")))
    else:
        met = _first_swept(b, lv)
    best = met.groupBy(*P.KEY, "bar_time").agg(F.min_by(F.struct("direction", "tier"), order).alias("s"))
    out = bars.join(best, [*P.KEY, "bar_time"], "left")
    hit = F.col("s").isNotNull()
    top, bottom = F.greatest("bar_open", "bar_close"), F.least("bar_open", "bar_close")
    return out.select(
        *bars.columns, hit.alias("liq_swept"), F.col("s.direction").alias("liq_side"), F.col("s.tier").alias("sweep_tier"),
        F.when(hit, F.col("bar_low")).alias("sweep_candle_low"), F.when(hit, F.col("bar_high")).alias("sweep_candle_high"),
        F.when(F.col("s.direction") == "high", F.col("bar_high") - top).when(F.col("s.direction") == "low", bottom - F.col("bar_low")).alias("sweep_wick"),
        F.when(hit, F.abs(F.col("bar_open") - F.col("bar_close"))).alias("sweep_body"),
    )


def nearest_levels(points: DataFrame, levels: DataFrame, n: int = P.V3_NEAREST, keys=P.KEY) -> DataFrame:
    """points (…, price) with the nearest level above and below, and the best score among the n nearest; equally near
    levels count from the lower one.

    A key's distinct levels, in order of price, part its prices into intervals, each of which holds the n + 1 levels
    up to it and the n beyond it; a point lies in one interval and meets it by price cells as wide as the mean interval,
    at most three for an interval on average.  Each point keeps its row, repeated ones too; one without a price gets
    nulls, and points of keys without levels go.
    """
    lv = levels.filter(F.col("price").isNotNull()).groupBy(*keys, F.col("price").alias("_level")).agg(F.max("score").alias("_score"))
    ends = lv.groupBy(*keys).agg(F.min("_level").alias("_low"), F.max("_level").alias("_high"), F.count(F.lit(1)).alias("_n"))
    width = F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / F.col("_n")).otherwise(1.0)
    ends = ends.select(*keys, "_low", "_n", width.alias("_width"))
    below_all = F.lit(float("-inf"))
    lv = lv.unionByName(ends.select(*keys, below_all.alias("_level"), F.lit(None).cast(lv.schema["_score"].dataType).alias("_score")))
    rung, up = F.when(F.col("_level") > below_all, F.struct("_level", "_score")), W.partitionBy(*keys).orderBy("_level")
    lv = lv.select(*keys, "_level", F.lead("_level").over(up).alias("_next"), F.concat(F.collect_list(rung).over(up.rowsBetween(-n, 0)), F.collect_list(rung).over(up.rowsBetween(1, n))).alias("_around"))
    cell = lambda x: F.floor(F.least(F.greatest((x - F.col("_low")) / F.col("_width"), F.lit(-1.0)), F.col("_n") + F.lit(1.0)))
    last = F.when(F.col("_next").isNull(), F.col("_n") + 1).otherwise(cell(F.col("_next")))
    lv = lv.join(ends, list(keys)).withColumn("_cell", F.explode(F.sequence(cell(F.col("_level")), last))).drop(*ends.columns[len(keys) :])
    p = points.join(ends, list(keys)).select(*[points[c] for c in points.columns], cell(F.col("price")).alias("_cell"), F.col("price").alias("_price"))
    inside = (F.col("_level") <= F.col("_price")) & (F.col("_next").isNull() | (F.col("_price") < F.col("_next")))
    met = p.alias("p").join(lv.alias("l"), [*(F.col(f"p.{k}") == F.col(f"l.{k}") for k in [*keys, "_cell"]), inside], "left")
    prices = F.transform("_around", lambda x: x["_level"])
    gaps = F.array_sort(F.transform("_around", lambda x: F.struct(F.abs(x["_level"] - F.col("_price")).alias("gap"), x["_level"].alias("level"), x["_score"].alias("score"))))
    return met.select(
        *[F.col(f"p.{c}") for c in points.columns], F.array_min(F.filter(prices, lambda x: x > F.col("_price"))).alias("nearest_above"),
        F.array_max(F.filter(prices, lambda x: x < F.col("_price"))).alias("nearest_below"), F.array_max(F.transform(F.slice(gaps, 1, n), lambda x: x["score"])).alias("best_score"),
    )


def first_sweeps(levels: DataFrame, bars: DataFrame, tolerance: float = P.V3_SWEEP) -> DataFrame:
    """levels (symbol, source, direction, price, formed_at; none null) with the first later bar that reaches beyond the
    level by ``tolerance`` of it and closes back; found by blocks of bars (``ranges.first_hit``)."""
    p, high = F.col("price"), F.col("direction") == "high"
    up, down = p * (1 + tolerance), p * (1 - tolerance)
    hit = F.when(high, (F.col("bar_high") > up) & (F.col("bar_close") < p)).otherwise((F.col("bar_low") < down) & (F.col("bar_close") > p))
    # A block has room for a sweep if some bar reaches beyond the level and some closes on its other side.
    possible = F.when(high, (F.col("max_high") > up) & (F.col("min_close") < p)).otherwise((F.col("min_low") < down) & (F.col("max_close") > p))
    extremes = {"max_high": F.max("bar_high"), "min_low": F.min("bar_low"), "min_close": F.min("bar_close"), "max_close": F.max("bar_close")}
    return first_hit(levels, "formed_at", bars.select(*P.KEY, "bar_time", "bar_high", "bar_low", "bar_close"), possible, hit, "swept_at", extremes)


def confluence(levels: DataFrame, within: float = P.V3_CONFLUENCE) -> DataFrame:
    """levels (symbol, source, timeframe, price, …) with the number of timeframes that have a level within 0.2 % of it.

    Logarithmic price cells one tolerance wide make it an equi-join on three neighbouring cells.
    """
    cell = F.floor(F.log("price") / F.lit(within)).cast("long")
    a = levels.withColumn("_cell", cell)
    b = a.select(*P.KEY, F.col("timeframe").alias("_tf"), F.col("price").alias("_p"), F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell"))
    met = a.join(b, [*P.KEY, "_cell"]).filter(F.abs(F.col("_p") - F.col("price")) <= F.col("price") * within)
    return met.groupBy(*levels.columns).agg(F.count_distinct("_tf").alias("timeframes"))


def confluence_score(timeframes: Column, timeframe: Column, is_swept: Column, confirmed: Column, touches: Column, hour: Column) -> Column:
    """-99 when swept; else timeframes beyond the first, confirmation, touches beyond the first, the timeframe's bonus and
    2 in the killzone."""
    bonus = F.lit(0)
    for tf, value in P.V3_TIMEFRAME_BONUS.items():
        bonus = F.when(timeframe == tf, value).otherwise(bonus)
    killzone = F.when((hour >= P.V3_KILLZONE[0]) & (hour < P.V3_KILLZONE[1]), 2).otherwise(0)
    return F.when(is_swept, -99).otherwise(timeframes - 1 + confirmed.cast("int") + (touches - 1) + bonus + killzone).cast("int")


def touches(levels: DataFrame, bars: DataFrame, within: float = P.V3_SWEEP) -> DataFrame:
    """levels with the number of bars whose range comes within ``within`` of the price (our own definition).

    A bar that doesn't touch lies below or above: the count is that of lows up to the upper edge less that of highs below
    the lower edge.  Levels and bars are sorted together, not compared.
    """
    p = F.col("price")
    low = count_up_to(levels, p + p * within, bars, "bar_low", "_upper")
    both = count_up_to(low, p - p * within, bars, "bar_high", "_lower", strict=True)
    return both.select(*levels.columns, (F.col("_upper") - F.col("_lower")).alias("touches"))


def round_number_levels(bars: DataFrame, step: float = 50.0) -> DataFrame:
    """A grid of round prices over each key's range, and its swing-free part of the older level list."""
    ends = bars.groupBy(*P.KEY).agg(F.min("bar_low").alias("lo"), F.max("bar_high").alias("hi"))
    grid = F.sequence(F.ceil(F.col("lo") / step).cast("long"), F.floor(F.col("hi") / step).cast("long"))
    return ends.filter(F.ceil(F.col("lo") / step) <= F.floor(F.col("hi") / step)).select(*P.KEY, F.explode(F.transform(grid, lambda x: x * F.lit(step))).alias("price"))
