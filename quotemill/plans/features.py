"""The feature pipeline from ticks to enriched ticks, end to end.

Ticks are aggregated to bars first, so every window and fold runs on bars; ticks meet bars and the sparse facts
(snapshots, swing counts, zones) again in one sliced as-of join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import session_label
from ..functions.stage import stage
from ..operators import asof, candles, gaps, indicators, liquidity, sessions, structure, swings


@dataclass
class Features:
    ticks: DataFrame
    bars_1m: DataFrame
    bars_15m: DataFrame
    bars_4h: DataFrame
    gaps: DataFrame
    snapshots: DataFrame


def bars_15m(ticks: DataFrame, mode: str = "bos", causal: bool = False) -> DataFrame:
    b = indicators.atr(candles.ohlc(ticks, "15 minutes"), P.ATR_15M, "atr_15_15m", "null" if causal else "zero")
    return structure.structure(swings.fractals(indicators.with_r_dynamic(b, trailing=P.MEDIAN_BARS if causal else None), P.FRACTAL_LEFT, None), mode, causal)


def bars_1m(ticks: DataFrame, causal: bool = False) -> DataFrame:
    return indicators.atr_rsi(candles.ohlc(ticks, "1 minute"), P.ATR_1M, "atr_20_1m", "null" if causal else "zero")


MINUTE = ["bar_open", "bar_high", "bar_low", "bar_close", "atr_20_1m", "rsi_14", "liq_swept", "liq_side", "sweep_tier", "sweep_wick", "sweep_body", "sweep_low_1m", "sweep_high_1m", "fvg_high", "fvg_low", "fvg_side", "fvg_filled", "fvg_age_bars", "fvg_timestamp", "confirmed_1m_swing_high", "confirmed_1m_swing_low"]
QUARTER = ["atr_15_15m", "r_dynamic", *[f.name for f in structure.ADDED if not f.name.startswith("zone")], "is_swing_high_15m", "is_swing_low_15m"]
COUNTS = ["n_confirmed_swing_highs_15m", "n_confirmed_swing_lows_15m"]
LEVELS = ["session_boundary", "session_name", "prev_day_high", "prev_day_low", "current_session_high", "current_session_low", "prev_session_high", "prev_session_low"]


def later(rows: DataFrame, at: str, width: str) -> DataFrame:
    """rows with the time ``at`` moved on by a width: when what began then is known."""
    return rows.withColumn(at, F.col(at) + F.expr(f"INTERVAL {width}"))


def build_features(ticks: DataFrame, mode: str = "bos", causal: bool = False) -> Features:
    """ticks: timestamp_utc, symbol, source, bid, ask, mid, spread, seq.

    Each tick gets its own bars' final values.  causal: nothing but what is known by then, as a live run has it
    (``streaming.features``): the last *closed* bar of each width; swings, breaks and gaps once the bars that confirm them
    have closed; r_dynamic from the median of the last ``MEDIAN_BARS`` bars; snapshots once their minute is over; swept
    levels are the last ``EQUAL_LOOKBACK`` swings of a kind and the last ``LEVEL_SNAPSHOTS`` snapshots, without clusters;
    averages are null until they have all their bars.

    Ticks move once: all facts meet them in one as-of join of many facts.
    """
    # Bars are few next to ticks; each kind is written once, as several steps read it.
    b15 = stage(bars_15m(ticks, mode, causal), "bars-15m")
    b4 = swings.bias_4h(candles.ohlc(ticks, "4 hours"))
    b1 = stage(bars_1m(ticks, causal), "bars-1m")
    snaps = stage(sessions.session_levels(candles.minute_ranges(ticks)), "snapshots")
    width = {"1m": "1 minute", "15m": "15 minutes", "4h": "4 hours"} if causal else {}
    shown = lambda rows, at, w: later(rows, at, width[w]) if causal else rows
    snaps = shown(snaps, "snapshot_time", "1m")
    if causal:
        b1 = liquidity.sweeps(b1, sessions.recent_levels(snaps), swings.known_swings(b15, width["15m"]), None, causal=True)
    else:
        turned = swings.swing_rows(b15)
        b1 = liquidity.sweeps(b1, sessions.levels_of(snaps), turned, liquidity.equal_levels(turned, b1))
    b1 = stage(swings.last_confirmed(b1), "bars-1m-swept")
    known = shown(b15, "bar_time", "15m")
    found = stage(gaps.find_gaps(b1, known, fallback=not causal), "gaps")
    active = gaps.active_gaps(b1, found, known)
    wide = b1.join(active, [*P.KEY, "bar_time"], "left").withColumnRenamed("sweep_candle_low", "sweep_low_1m").withColumnRenamed("sweep_candle_high", "sweep_high_1m")
    flags = {"swing_high_known": "is_swing_high_15m", "swing_low_known": "is_swing_low_15m"} if causal else {"is_swing_high": "is_swing_high_15m", "is_swing_low": "is_swing_low_15m"}
    quarter = known
    for name, alias in flags.items():
        quarter = quarter.withColumn(alias, F.col(name))
    facts = [
        asof.Fact(shown(wide, "bar_time", "1m"), "bar_time", MINUTE),
        asof.Fact(quarter, "bar_time", QUARTER + COUNTS if causal else QUARTER),
        asof.Fact(shown(b4, "bar_time", "4h"), "bar_time", ["market_bias_4h"]),
        asof.Fact(snaps, "snapshot_time", LEVELS),
        asof.Fact(structure.zones(known), "bar_time", ["zone_low", "zone_high"]),
    ]
    if not causal:
        counts = swings.swing_counts(turned).withColumnsRenamed({"n_highs": COUNTS[0], "n_lows": COUNTS[1]})
        facts.append(asof.Fact(counts, "bar_time", COUNTS, tie=COUNTS))
    out = asof.asof_many(ticks, "timestamp_utc", facts)
    # A zone's extreme comes before the extreme of the swept minute.
    out = out.withColumn("sweep_candle_low", F.coalesce("zone_low", "sweep_low_1m")).withColumn("sweep_candle_high", F.coalesce("zone_high", "sweep_high_1m")).drop("zone_low", "zone_high", "sweep_low_1m", "sweep_high_1m")
    out = out.withColumn("session_boundary", F.coalesce("session_boundary", F.lit(False))).withColumn("session", session_label("timestamp_utc"))
    return Features(out, b1, b15, b4, found, snaps)
