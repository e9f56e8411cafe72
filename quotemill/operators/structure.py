"""Market structure as an ordered fold over each key's 15-minute bars and swings.

Acceptance of a new level depends on the trend that earlier levels made, so no window frame expresses it.  The fold
runs per key; bars are few next to ticks.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from .indicators import per_key

_D, _B, _S, _L = T.DoubleType(), T.BooleanType(), T.StringType(), T.LongType()
ADDED = [
    T.StructField(n, t)
    for n, t in (
        ("smc_trend_15m", _S), ("hh_15m", _D), ("ll_15m", _D), ("strong_low_15m", _D), ("strong_high_15m", _D), ("bos_detected_15m", _B), ("bos_up_15m", _B), ("bos_down_15m", _B),
        ("choch_detected_15m", _B), ("choch_up_15m", _B), ("choch_down_15m", _B), ("bos_time_ms", _L), ("r_dynamic_at_bos", T.IntegerType()), ("zone_low", _D), ("zone_high", _D),
    )
]


KNOWN = [T.StructField(n, t) for n, t in (("n_confirmed_swing_highs_15m", _L), ("n_confirmed_swing_lows_15m", _L), ("swing_high_known", _B), ("swing_low_known", _B))]
NAMES = {1: "bull", -1: "bear", None: None}


@dataclasses.dataclass
class Side:
    """One direction's half of the state: the level a break must close beyond, the strong level behind it, and of the
    direction's swings the last price, the extreme, and the bars' extreme since the last one.

    Sign 1: highs, broken upwards; -1: lows, broken downwards.  Prices are compared times sign.
    """

    sign: int
    level: float | None = None
    strong: float | None = None
    last: float | None = None
    extreme: float | None = None
    since: float | None = None

    def beyond(self, price: float, level: float | None) -> bool:
        return level is not None and price * self.sign > level * self.sign

    def further(self, a: float | None, b: float) -> float:
        return b if a is None else self.sign * max(self.sign * a, self.sign * b)


class Structure:
    """The ordered rule, bar by bar, in a state of fixed size."""

    def __init__(self, mode: str = "bos"):
        self.mode, self.trend, self.sides = mode, None, {1: Side(1), -1: Side(-1)}

    def step(self, high: float, low: float, close: float, ms: int, r: int, swings: list[dict[int, tuple[float, float]]]) -> dict:
        """The bar's row.  swings: for each swing bar that counts from now on, in order, by sign its price and the bars'
        extreme on that side from it to this bar."""
        up, down = self.sides[1], self.sides[-1]
        row = dict.fromkeys((f.name for f in ADDED), None) | {f.name: False for f in ADDED if f.dataType == _B}
        for side, price in ((up, high), (down, low)):
            if side.since is not None:
                side.since = side.further(side.since, price)
        # The high of a swing bar goes first.  A swing in the direction of the trend may set a new level, and the strong
        # level becomes the last opposite swing of earlier bars.
        earlier = {s: x.extreme for s, x in self.sides.items()}
        for found in swings:
            previous = {s: x.last for s, x in self.sides.items()}
            for s, side in self.sides.items():
                if s in found:
                    price, since = found[s]
                    if self.trend in (None, s) and (side.level is None or side.beyond(price, side.level)):
                        side.level = price
                        if previous[-s] is not None:
                            side.strong = previous[-s]
                    side.last, side.since, side.extreme = price, since, side.further(side.extreme, price)

        def stamp(side: Side) -> None:
            s, other = side.sign, self.sides[-side.sign]
            if other.last is not None:
                side.strong = other.last
                if self.mode == "bos":
                    row["zone_low" if s > 0 else "zone_high"] = other.since
            row["bos_detected_15m"] = row["bos_up_15m" if s > 0 else "bos_down_15m"] = True
            row["bos_time_ms"], row["r_dynamic_at_bos"] = ms, r

        if self.mode == "bos":
            for side in (up, down):
                if side.beyond(close, side.level):
                    stamp(side)
                    self.trend = side.sign
        else:
            side, other = (up, down) if self.trend in (None, 1) else (down, up)
            if side.beyond(close, side.level):
                if self.trend == side.sign:
                    stamp(side)
                self.trend = side.sign
            elif side.strong is not None and other.beyond(close, side.strong):
                s = other.sign
                row["choch_detected_15m"] = row["choch_up_15m" if s > 0 else "choch_down_15m"] = True
                self.trend = s
                up.level = down.level = side.strong = None
                other.strong = earlier[-s]
        row["smc_trend_15m"] = NAMES[self.trend]
        row["hh_15m"], row["ll_15m"], row["strong_low_15m"], row["strong_high_15m"] = up.level, down.level, up.strong, down.strong
        return row


def _fold(g: pd.DataFrame, mode: str, confirmed: bool) -> dict:
    n = len(g)
    high, low, close = (g[f"bar_{k}"].to_numpy(float) for k in ("high", "low", "close"))
    flags = {1: g["is_swing_high"].to_numpy(bool), -1: g["is_swing_low"].to_numpy(bool)}
    ms = g["bar_time"].to_numpy("datetime64[ms]").astype(np.int64)
    r = g["r_dynamic"].to_numpy() if "r_dynamic" in g else np.full(n, P.FRACTAL_RIGHT_MAX)
    rule, out = Structure(mode), []
    counts = {1: 0, -1: 0}
    waiting: dict[int, list[int]] = {}
    for i in range(n):
        if flags[1][i] or flags[-1][i]:
            waiting.setdefault(i + int(r[i]) if confirmed else i, []).append(i)
        bars = waiting.pop(i, [])
        swings = [{s: ((high if s > 0 else low)[j], high[j : i + 1].max() if s > 0 else low[j : i + 1].min()) for s in (1, -1) if flags[s][j]} for j in bars]
        row = rule.step(high[i], low[i], close[i], int(ms[i]), int(r[i]), swings)
        if confirmed:
            for s in counts:
                counts[s] += sum(s in x for x in swings)
            row |= {"n_confirmed_swing_highs_15m": counts[1], "n_confirmed_swing_lows_15m": counts[-1], "swing_high_known": any(1 in x for x in swings), "swing_low_known": any(-1 in x for x in swings)}
        out.append(row)
    fields = [*ADDED, *(KNOWN if confirmed else [])]
    whole = {f.name: [row[f.name] for row in out] for f in fields}
    return {f.name: pd.array(whole[f.name], "Int64") if isinstance(f.dataType, (T.LongType, T.IntegerType)) else np.array(whole[f.name], bool) if f.dataType == _B else whole[f.name] for f in fields}


def structure(bars: DataFrame, mode: str = "bos", confirmed: bool = False) -> DataFrame:
    """15-minute bars (with swing flags and r_dynamic) and their structure.

    mode 'bos': breaks both ways, whatever the trend; they repeat while closes stay beyond the level.
    mode 'choch': breaks only with the trend, the first sets it silently; a close through the strong level turns it,
    clears the levels and takes the opposite extreme of all earlier swings as the new strong level.
    confirmed: a swing counts from the bar that confirms it, r_dynamic bars after its own; the numbers of swings so far and
    flags of the bars that confirm one are added.
    """
    if mode not in ("bos", "choch"):
        raise ValueError(mode)
    return per_key(bars, lambda g: _fold(g, mode, confirmed), [*ADDED, *(KNOWN if confirmed else [])])


def _breaks_v3(g: pd.DataFrame, window: int, horizon: int) -> dict:
    n = len(g)
    high, low, close = (g[f"bar_{k}"].to_numpy(float) for k in ("high", "low", "close"))
    # due[s][i]: the furthest swing, window to 2 * window bars back, that a close has confirmed by bar i.
    due = {1: np.full(n, np.nan), -1: np.full(n, np.nan)}
    for j in range(window, n - window):
        around = slice(j - window, j + window + 1)
        for s, x, y in ((1, high, low), (-1, low, high)):
            if s * x[j] >= (s * x[around]).max() - 1e-8:
                ahead = np.flatnonzero(s * close[j + 1 : j + 1 + horizon] < s * y[j])
                if len(ahead):
                    for i in range(max(j + window, j + 1 + int(ahead[0])), min(j + 2 * window, n - 1) + 1):
                        due[s][i] = x[j] if np.isnan(due[s][i]) else s * max(s * due[s][i], s * x[j])
    last, level = None, {1: None, -1: None}
    kinds = {"BOS": np.zeros(n, bool), "CHoCH": np.zeros(n, bool)}
    side = np.full(n, None, object)
    for i in range(window, n):
        for s in (1, -1):
            if not np.isnan(due[s][i]):
                level[s] = due[s][i] if level[s] is None else s * max(s * level[s], s * due[s][i])
        for s in (1, -1):
            if level[s] is not None and s * close[i] > s * level[s]:
                kinds["BOS" if last == s else "CHoCH"][i] = True
                last, level[s] = s, None
        side[i] = {1: "bullish", -1: "bearish", None: None}[last]
    return {"structure_direction": side, "bos_detected": kinds["BOS"], "choch_detected": kinds["CHoCH"]}


def breaks_v3(bars: DataFrame, window: int = P.V3_WINDOW, horizon: int = 20) -> DataFrame:
    """The older engine's breaks, per bar: swings within ``window`` bars on both sides, seen ``window`` to twice as many
    bars later, if a close has passed the swing bar's other end within ``horizon`` bars; a level moves outwards only.  A
    close beyond it in the last break's direction is BOS, else CHoCH (the first too), and spends it; highs go first."""
    return per_key(bars, lambda g: _breaks_v3(g, window, horizon), [T.StructField("structure_direction", _S), T.StructField("bos_detected", _B), T.StructField("choch_detected", _B)])


def triggers(structured: DataFrame) -> DataFrame:
    """The bars whose breaks start a search for gaps."""
    return structured.filter("bos_detected_15m OR choch_detected_15m").select(*P.KEY, F.col("bar_time").alias("trigger_time"))


def zones(structured: DataFrame) -> DataFrame:
    return structured.filter("zone_low IS NOT NULL OR zone_high IS NOT NULL").select(*P.KEY, "bar_time", "zone_low", "zone_high")


def latest_bias(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*P.KEY).agg(F.max_by("market_bias_4h", "bar_time").alias("latest_bias"))


