"""Features of one key, minute by minute, in a state of bounded size: what build_features(causal=True) gives, without history.

``Online`` takes the closed 1-minute bars of a key in order and says after each what a tick that follows it knows.  Wider
bars are made of them and close when a minute starts at or after their end.  The state is plain values, in the parts
that ``STATE`` types: the bars being made, the last closed bars that fractals and gaps look back at, the averages, both
sides of the structure, the 4-hour bias, open gaps, session ranges, the last swings and snapshots, and what is known now.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from .. import params as P
from . import structure as S
from .sessions import LEVELS

MINUTE = 60_000_000
QUARTER, FOUR_HOURS, DAY = 15 * MINUTE, 240 * MINUTE, 1440 * MINUTE

#: Typed parts of the state; lists hold rows of these columns.
BARS = "width bigint, start bigint, o double, h double, l double, c double"
STATE = {
    "open_bars": BARS,
    "closed_bars": f"{BARS}, atr double, r int, trend string, bar_no bigint, trigger_no bigint",
    "averages": "width bigint, n bigint, total double, atr double, rise double, fall double, before double",
    "atrs": "at bigint, atr double",
    "sides": "sign int, level double, strong double, last double, extreme double, since double, trend string, swings bigint, trigger_no bigint",
    "bias": "top double, bottom double, hh boolean, lh boolean, hl boolean, ll boolean, state string",
    "gaps": "bar_no bigint, formed_at bigint, high double, low double, side string",
    "ranges": "kind string, number bigint, name string, high double, low double",
    "levels": "kind string, visible bigint, ordinal bigint, direction string, tier int, price double",
}
#: What a tick sees, besides its own columns.
SEEN = (
    "bar_open double, bar_high double, bar_low double, bar_close double, atr_20_1m double, rsi_14 double, liq_swept boolean, liq_side string, sweep_tier int, sweep_wick double, sweep_body double, "
    "fvg_high double, fvg_low double, fvg_side string, fvg_filled boolean, fvg_age_bars int, fvg_timestamp timestamp, confirmed_1m_swing_high double, confirmed_1m_swing_low double, "
    "atr_15_15m double, r_dynamic int, smc_trend_15m string, hh_15m double, ll_15m double, strong_low_15m double, strong_high_15m double, bos_detected_15m boolean, bos_up_15m boolean, bos_down_15m boolean, "
    "choch_detected_15m boolean, choch_up_15m boolean, choch_down_15m boolean, bos_time_ms bigint, r_dynamic_at_bos int, is_swing_high_15m boolean, is_swing_low_15m boolean, "
    "n_confirmed_swing_highs_15m bigint, n_confirmed_swing_lows_15m bigint, market_bias_4h string, session_boundary boolean, session_name string, prev_day_high double, prev_day_low double, "
    "current_session_high double, current_session_low double, prev_session_high double, prev_session_low double, sweep_candle_low double, sweep_candle_high double"
)
#: Seen values that later ones are made of.
KEPT = "zone_low double, zone_high double, sweep_low_1m double, sweep_high_1m double"
NAMES = [c.split()[0] for c in SEEN.split(", ")]


def columns(part: str) -> list[str]:
    return [c.split()[0] for c in part.split(", ")]


@dataclasses.dataclass
class Bar:
    width: int
    start: int
    o: float
    h: float
    l: float  # noqa: E741
    c: float
    atr: float | None = None
    r: int | None = None
    trend: str | None = None
    bar_no: int = 0
    trigger_no: int | None = None

    def add(self, later: Bar) -> None:
        self.h, self.l, self.c = max(self.h, later.h), min(self.l, later.l), later.c


@dataclasses.dataclass
class Average:
    """Wilder's averages of a width: the true range's, seeded by the mean of the first n, and of rises and falls."""

    width: int
    n: int = 0
    total: float = 0.0
    atr: float | None = None
    rise: float = 0.0
    fall: float = 0.0
    before: float | None = None

    def add(self, bar: Bar, span: int) -> float | None:
        c = self.before
        tr = bar.h - bar.l if c is None else max(bar.h - bar.l, abs(bar.h - c), abs(bar.l - c))
        d = 0.0 if c is None else bar.c - c
        self.n, self.before = self.n + 1, bar.c
        self.rise += (max(d, 0.0) - self.rise) / P.RSI
        self.fall += (max(-d, 0.0) - self.fall) / P.RSI
        if self.n <= span:
            self.total += tr
            self.atr = self.total / span if self.n == span else None
        else:
            self.atr += (tr - self.atr) / span
        return self.atr

    def rsi(self) -> float | None:
        if self.n < P.RSI:
            return None
        return 100.0 if self.fall == 0 else 100 - 100 / (1 + self.rise / self.fall)


def _extreme(bars: list[Bar], at: int, left: int, right: int, sign: int) -> bool:
    """Whether bar ``at`` is a strict fractal of a sign: above (below) left bars before and right after, which all exist."""
    if at < left or at + right >= len(bars):
        return False
    value = [sign * (b.h if sign > 0 else b.l) for b in bars[at - left : at + right + 1]]
    return all(value[left] > v for k, v in enumerate(value) if k != left)


class Online:
    """The state and its rules.  ``parts`` and ``restore`` turn it to rows and back."""

    def __init__(self) -> None:
        self.open: dict[int, Bar] = {}
        self.closed: dict[int, list[Bar]] = {MINUTE: [], QUARTER: [], FOUR_HOURS: []}
        self.averages = {w: Average(w) for w in (MINUTE, QUARTER)}
        self.atrs: list[tuple[int, float]] = []
        self.rule = S.Structure()
        self.counts = {1: 0, -1: 0}
        self.trigger_no: int | None = None
        self.bias: dict = dict.fromkeys(columns(STATE["bias"])) | dict.fromkeys(("hh", "lh", "hl", "ll"), False)
        self.gaps: list[tuple] = []
        self.ranges: dict[str, list] = {}
        self.snapshots: list[tuple[int, list[tuple]]] = []
        self.swings: dict[str, list[tuple[int, float]]] = {"high": [], "low": []}
        self.now: dict = dict.fromkeys([*NAMES, *columns(KEPT)]) | {"session_boundary": False}

    # ---- ticks

    def tick_minute(self, start: int, o: float, h: float, l: float, c: float) -> dict:  # noqa: E741
        """Takes (part of) a minute's ticks as a bar; returns what they see, which is what was closed before them."""
        now = self.open.get(MINUTE)
        if now is not None and now.start < start:
            self._close(MINUTE)
        for width in (QUARTER, FOUR_HOURS):
            wide = self.open.get(width)
            if wide is not None and wide.start + width <= start:
                self._close(width)
        if MINUTE in self.open:
            self.open[MINUTE].add(Bar(MINUTE, start, o, h, l, c))
        else:
            self.open[MINUTE] = Bar(MINUTE, start, o, h, l, c)
        return self.now

    def _close(self, width: int) -> None:
        bar = self.open.pop(width)
        past = self.closed[width]
        if width == MINUTE:
            self._minute(bar, past)
            for wide in (QUARTER, FOUR_HOURS):
                if wide in self.open:
                    self.open[wide].add(bar)
                else:
                    self.open[wide] = Bar(wide, bar.start // wide * wide, bar.o, bar.h, bar.l, bar.c)
        elif width == QUARTER:
            self._quarter(bar, past)
        else:
            past.append(bar)
            self._four_hours(past)
        kept = {MINUTE: 2 * P.FRACTAL_1M + 1, QUARTER: P.FRACTAL_LEFT + P.FRACTAL_RIGHT_MAX + 1, FOUR_HOURS: 2 * P.FRACTAL_4H + 1}[width]
        del past[:-kept]

    # ---- one minute

    def _minute(self, bar: Bar, past: list[Bar]) -> None:
        bar.atr = self.averages[MINUTE].add(bar, P.ATR_1M)
        bar.bar_no = past[-1].bar_no + 1 if past else 1
        bar.trend, bar.trigger_no = S.NAMES[self.rule.trend], self.trigger_no
        self._sweep(bar)
        past.append(bar)
        self.now |= {"bar_open": bar.o, "bar_high": bar.h, "bar_low": bar.l, "bar_close": bar.c, "atr_20_1m": bar.atr, "rsi_14": self.averages[MINUTE].rsi()}
        at = len(past) - 1 - P.FRACTAL_1M
        if _extreme(past, at, P.FRACTAL_1M, P.FRACTAL_1M, 1):
            self.now["confirmed_1m_swing_high"] = past[at].h
        if _extreme(past, at, P.FRACTAL_1M, P.FRACTAL_1M, -1):
            self.now["confirmed_1m_swing_low"] = past[at].l
        self._gaps(bar, past)
        self._session(bar)

    def _gaps(self, bar: Bar, past: list[Bar]) -> None:
        if len(past) >= 3:
            first, middle, _ = past[-3:]
            bull, bear = bar.l > first.h, bar.h < first.l
            high, low = (bar.l, first.h) if bull else (first.l, bar.h)
            if (
                (bull or bear) and middle.atr is not None and abs(middle.c - middle.o) > middle.atr * P.DISPLACEMENT and high - low >= max(middle.atr * P.GAP_ATR, P.GAP_FLOOR)
                and middle.trigger_no is not None and middle.bar_no - middle.trigger_no <= P.GAP_AGE and middle.trend is not None
            ):
                self.gaps.append((middle.bar_no, middle.start, high, low, "bullish_fvg" if bull else "bearish_fvg"))
        filled = lambda g: g[0] + 2 <= bar.bar_no and (bar.c < g[3] if g[4] == "bullish_fvg" else bar.c > g[2])
        self.gaps = [g for g in self.gaps if bar.bar_no - g[0] <= P.GAP_AGE and not filled(g)]
        side = {"bull": "bullish_fvg", "bear": "bearish_fvg"}.get(bar.trend)
        best = min((g for g in self.gaps if g[4] == side), key=lambda g: (abs((g[2] + g[3]) / 2 - bar.c), g[1]), default=None)
        self.now |= {"fvg_high": best and best[2], "fvg_low": best and best[3], "fvg_side": best and best[4], "fvg_filled": False, "fvg_age_bars": bar.bar_no - best[0] if best else 0, "fvg_timestamp": best and best[1]}

    def _sweep(self, bar: Bar) -> None:
        tol = max((bar.atr or 0.0) * P.SWEEP_ATR, P.SWEEP_FLOOR)
        hit = lambda direction, price: bar.h >= price - tol and bar.c < price if direction == "high" else bar.l <= price + tol and bar.c > price
        best = min(((tier, visible, ordinal, direction) for visible, levels in self.snapshots for ordinal, direction, tier, price in levels if hit(direction, price)), default=None)
        if best is None:
            best = min(((3, visible, order, direction) for order, (direction, found) in enumerate(self.swings.items()) for visible, price in found if hit(direction, price)), default=None)
        side = best and best[3]
        wick = None if side is None else bar.h - max(bar.o, bar.c) if side == "high" else min(bar.o, bar.c) - bar.l
        self.now |= {"liq_swept": best is not None, "liq_side": side, "sweep_tier": best and best[0], "sweep_low_1m": bar.l if best else None, "sweep_high_1m": bar.h if best else None, "sweep_wick": wick, "sweep_body": abs(bar.o - bar.c) if best else None}
        self._candle()

    def _candle(self) -> None:
        """A zone's extreme comes before the extreme of the swept minute."""
        for end in ("low", "high"):
            zone = self.now[f"zone_{end}"]
            self.now[f"sweep_candle_{end}"] = self.now[f"sweep_{end}_1m"] if zone is None else zone

    def _session(self, bar: Bar) -> None:
        at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=bar.start)
        name = next((n for n, start in P.SESSION_STARTS if at.hour >= start), "asian")
        rolled = {}
        for kind, key in (("day", str(at.timetuple().tm_yday)), ("session", name)):
            runs = self.ranges.setdefault(kind, [])
            rolled[kind] = not runs or runs[-1][0] != key
            if rolled[kind]:
                runs.append([key, bar.h, bar.l])
                del runs[:-3]
            else:
                runs[-1][1], runs[-1][2] = max(runs[-1][1], bar.h), min(runs[-1][2], bar.l)
        if not rolled["session"]:
            return
        back = lambda kind, k: self.ranges[kind][-1 - k][1:] if len(self.ranges[kind]) > k else (None, None)
        row = dict(zip(columns("prev_day_high, prev_day_low, current_session_high, current_session_low, prev_session_high, prev_session_low"), (*back("day", 1), bar.h, bar.l, *back("session", 2))))
        self.now |= row | {"session_boundary": True, "session_name": name}
        self.snapshots.append((bar.start + MINUTE, [(i, direction, tier, row[c]) for i, (c, direction, tier) in enumerate(LEVELS) if row[c] is not None]))
        del self.snapshots[: -P.LEVEL_SNAPSHOTS]

    # ---- wider bars

    def _quarter(self, bar: Bar, past: list[Bar]) -> None:
        bar.atr = self.averages[QUARTER].add(bar, P.ATR_15M)
        if bar.atr is not None:
            self.atrs.append((bar.start, bar.atr))
            del self.atrs[: -P.MEDIAN_BARS]
        bar.r = r_dynamic(bar.atr, [a for _, a in self.atrs])
        past.append(bar)
        swings, seen = [], {1: False, -1: False}
        last = len(past) - 1
        for at in range(max(0, last - P.FRACTAL_RIGHT_MAX), last - P.FRACTAL_RIGHT_MIN + 1):
            if past[at].r != last - at:
                continue
            found = {}
            for sign in (1, -1):
                if _extreme(past, at, P.FRACTAL_LEFT, past[at].r, sign):
                    after = [b.h if sign > 0 else b.l for b in past[at:]]
                    found[sign] = (after[0], sign * max(sign * x for x in after))
                    seen[sign] = True
                    self.counts[sign] += 1
                    kind = self.swings["high" if sign > 0 else "low"]
                    kind.append((bar.start + QUARTER, after[0]))
                    del kind[: -P.EQUAL_LOOKBACK]
            if found:
                swings.append(found)
        row = self.rule.step(bar.h, bar.l, bar.c, bar.start // 1000, bar.r, swings)
        zones = {k: row.pop(k) for k in ("zone_low", "zone_high")}
        if any(v is not None for v in zones.values()):
            self.now |= zones
        if row["bos_detected_15m"] or row["choch_detected_15m"]:
            self.trigger_no = (self.closed[MINUTE][-1].bar_no if self.closed[MINUTE] else 0) + 1
        self.now |= row | {
            "atr_15_15m": bar.atr, "r_dynamic": bar.r, "is_swing_high_15m": seen[1], "is_swing_low_15m": seen[-1],
            "n_confirmed_swing_highs_15m": self.counts[1], "n_confirmed_swing_lows_15m": self.counts[-1],
        }
        self._candle()

    def _four_hours(self, past: list[Bar]) -> None:
        at, b, side = len(past) - 1 - P.FRACTAL_4H, self.bias, P.FRACTAL_4H
        if at >= 0:
            high, low = (past[at].h if _extreme(past, at, side, side, 1) else None), (past[at].l if _extreme(past, at, side, side, -1) else None)
            before = dict(b)
            higher, lower = high is not None and (b["top"] is None or high > b["top"]), low is not None and (b["bottom"] is None or low < b["bottom"])
            # Highs see the lows of earlier bars; lows see the highs of their own bar too.
            b["hh"] |= higher
            b["lh"] |= high is not None and not higher
            b["ll"] |= lower
            b["hl"] |= low is not None and not lower
            from_high = "bullish" if higher and before["hl"] else "bearish" if high is not None and not higher and before["ll"] else None
            from_low = "bearish" if lower and b["lh"] else "bullish" if low is not None and not lower and b["hh"] else None
            b["state"] = from_low or from_high or b["state"]
            b["top"] = high if higher else b["top"]
            b["bottom"] = low if lower else b["bottom"]
        self.now["market_bias_4h"] = b["state"] or "neutral"

    # ---- rows of the state

    def parts(self) -> dict[str, list[tuple]]:
        flat = lambda bar, names: tuple(getattr(bar, n) for n in names)
        trend = S.NAMES[self.rule.trend]
        return {
            "open_bars": [flat(b, columns(STATE["open_bars"])) for b in self.open.values()],
            "closed_bars": [flat(b, columns(STATE["closed_bars"])) for past in self.closed.values() for b in past],
            "averages": [dataclasses.astuple(a) for a in self.averages.values()],
            "atrs": list(self.atrs),
            "sides": [(*dataclasses.astuple(x), trend, self.counts[s], self.trigger_no) for s, x in self.rule.sides.items()],
            "bias": [tuple(self.bias.values())],
            "gaps": list(self.gaps),
            "ranges": [(kind, i, *r) for kind, runs in self.ranges.items() for i, r in enumerate(runs)],
            "levels": [("snapshot", at, i, d, t, p) for at, levels in self.snapshots for i, d, t, p in levels] + [("swing", at, i, k, 3, p) for k, found in self.swings.items() for i, (at, p) in enumerate(found)],
        }

    @classmethod
    def restore(cls, parts: dict[str, list[tuple]], now: dict | None) -> Online:
        me = cls()
        for row in parts["open_bars"]:
            me.open[row[0]] = Bar(*row)
        for row in parts["closed_bars"]:
            me.closed[row[0]].append(Bar(*row))
        for row in parts["averages"]:
            me.averages[row[0]] = Average(*row)
        me.atrs = [tuple(r) for r in parts["atrs"]]
        for row in parts["sides"]:
            me.rule.sides[row[0]] = S.Side(*row[:6])
            me.rule.trend = {v: k for k, v in S.NAMES.items()}[row[6]]
            me.counts[row[0]], me.trigger_no = row[7], row[8]
        for row in parts["bias"]:
            me.bias = dict(zip(columns(STATE["bias"]), row))
        me.gaps = [tuple(r) for r in parts["gaps"]]
        for kind, _, *run in sorted(parts["ranges"], key=lambda r: (r[0], r[1])):
            me.ranges.setdefault(kind, []).append(list(run))
        snapshots: dict[int, list] = {}
        for kind, at, i, direction, tier, price in sorted(parts["levels"], key=lambda r: (r[0], r[1], r[2])):
            if kind == "snapshot":
                snapshots.setdefault(at, []).append((i, direction, tier, price))
            else:
                me.swings[direction].append((at, price))
        me.snapshots = list(snapshots.items())
        if now is not None:
            me.now = now
        return me


def r_dynamic(atr: float | None, known: list[float]) -> int:
    """functions.core.r_dynamic with the median of the known values."""
    if not atr or atr <= 0:
        return P.FRACTAL_RIGHT_MAX
    x = sorted(known)
    median = (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    return int(max(P.FRACTAL_RIGHT_MIN, min(P.FRACTAL_RIGHT_MAX, round(P.R_FACTOR * (median or 1.0) / atr))))
