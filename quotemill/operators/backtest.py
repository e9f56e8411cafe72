"""The backtest: an ordered fold over each key's ticks, one output row per trade, event or reason.

Lots follow equity, so the trades of a key are serial; keys and parameter sets run side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .. import params as P
from .strategy import HOLD, T1_LONG, T1_SHORT, T2_LONG, T2_SHORT, Relay, Strategy, decide, fold_ticks, prepared

COLUMNS = [
    ("symbol", "string"), ("source", "string"), ("kind", "string"), ("n", "bigint"), ("type", "string"), ("pair_id", "int"), ("direction", "string"), ("entry_time", "timestamp_ntz"), ("exit_time", "timestamp_ntz"),
    ("entry_price", "double"), ("exit_price", "double"), ("pnl", "double"), ("pnl_pips", "double"), ("lot", "double"), ("exit_reason", "string"), ("entry_reason", "string"), ("session", "string"),
    ("point1_hit", "boolean"), ("point2_hit", "boolean"), ("hold_minutes", "double"), ("sl_pips", "double"), ("mae_pips", "double"), ("mfe_pips", "double"), ("trend", "string"), ("equity", "double"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)
TP_LEVELS = ("prev_day_high", "prev_day_low", "current_session_high", "current_session_low", "prev_session_high", "prev_session_low")


@dataclass
class Trade:
    """side is 1 for long and -1 for short; prices that favour the trade grow with side * price."""

    type: str
    pair: int
    side: int
    reason: str
    session: str
    sl: float
    lot: float
    trend: str
    pending: bool = False
    mid: float | None = None
    expires: int = 0
    entry: float = 0.0
    time: object = None
    risk: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    tp: float | None = None
    hit1: bool = False
    hit2: bool = False
    best: float | None = None
    worst: float | None = None

    def reached(self, price: float, level: float) -> bool:
        return self.side * price >= self.side * level


@dataclass(slots=True)
class Block:
    """What a run of ticks can do to an account: whether any of them may act by itself (a break, a first-stage action or a
    wide spread), and by side (1 and -1) the extremes of the price that closes a trade and of the swings that trail it."""

    acts: bool
    least: dict[int, float]
    most: dict[int, float]
    swing: dict[int, float]


def blocks(p: P.BacktestParams) -> Callable[[pa.RecordBatch, np.ndarray], list[Block]]:
    def watch(b: pa.RecordBatch, cuts: np.ndarray) -> list[Block]:
        number = lambda c, none: pc.fill_null(b.column(c), none).to_numpy(zero_copy_only=False).astype(float)
        flag = lambda c: pc.fill_null(b.column(c), False).to_numpy(zero_copy_only=False).astype(bool)
        bid, ask = number("bid", 0.0), number("ask", 0.0)
        acts = (ask - bid >= p.wide_pips * p.pip) | pc.is_valid(b.column("t1_action")).to_numpy(zero_copy_only=False) | flag("bos_detected_15m") | flag("choch_detected_15m")
        low, high = np.minimum.reduceat, np.maximum.reduceat
        swing_low, swing_high = high(number("confirmed_1m_swing_low", -np.inf), cuts), low(number("confirmed_1m_swing_high", np.inf), cuts)
        columns = (np.logical_or.reduceat(acts, cuts), low(bid, cuts), high(bid, cuts), low(ask, cuts), high(ask, cuts), swing_low, swing_high)
        return [Block(a, {1: bl, -1: al}, {1: bh, -1: ah}, {1: sl, -1: sh}) for a, bl, bh, al, ah, sl, sh in zip(*(c.tolist() for c in columns))]

    return watch


class Book:
    """One key's account: open trades by type, relay, equity and what was recorded."""

    def __init__(self, p: P.BacktestParams, strategy: Strategy = decide):
        self.seen = self.opened = 0
        self.p, self.strategy, self.relay, self.open = p, strategy, Relay(), {}
        self.equity, self.next_pair, self.recorded = p.capital, 1, 0
        self.rows: list[dict] = []  # since the last drain

    def lot(self, entry: float, sl: float, equity: float) -> float:
        pips = abs(entry - sl) / self.p.pip
        return 0.01 if pips <= 0 else max(0.01, round(equity * P.RISK / 2 / (pips * self.p.pip_value), 2))

    def fill(self, t: Trade, price: float, row: dict, atr: float, edge: float) -> None:
        """Entry at price: Point 1 at the bar's end or 0.3 ATR, Point 2 at 1.25 ATR and 0.3 ATR beyond Point 1 at least."""
        s = t.side
        t.pending, t.entry, t.time, t.risk, t.best = False, price, row["timestamp_utc"], abs(price - t.sl), price
        edge = row["bar_high" if s > 0 else "bar_low"] or edge
        t.p1 = s * max(s * edge, s * price + atr * P.P1_ATR)
        t.p2 = s * max(s * price + atr * P.P2_ATR, s * t.p1 + atr * P.P2_GAP)

    def target(self, t: Trade, row: dict) -> float | None:
        """The nearest session or day level ahead, if it pays twice the risk."""
        ahead = [row[c] for c in TP_LEVELS if row[c] is not None and t.side * row[c] > t.side * t.entry]
        if not ahead or t.risk <= 0:
            return None
        near = min(ahead, key=lambda x: abs(x - t.entry))
        return near if abs(near - t.entry) >= t.risk * P.TP_RATIO else None

    def close(self, t: Trade, row: dict, why: str) -> float:
        out = row["bid"] if t.side > 0 else row["ask"]
        pips = t.side * (out - t.entry) / self.p.pip
        pnl = pips * t.lot * self.p.pip_value
        self.equity += pnl
        excursion = lambda x: max(0.0, x / self.p.pip)
        self.record(
            row, "trade", type=t.type, pair_id=t.pair, direction="LONG" if t.side > 0 else "SHORT", entry_time=t.time, exit_time=row["timestamp_utc"], entry_price=t.entry, exit_price=out, pnl=pnl, pnl_pips=pips, lot=t.lot,
            exit_reason=why, entry_reason=t.reason, session=t.session, point1_hit=t.hit1, point2_hit=t.hit2, hold_minutes=(row["timestamp_utc"] - t.time).total_seconds() / 60, sl_pips=t.risk / self.p.pip,
            mae_pips=excursion(t.side * (t.entry - t.worst)) if t.worst else 0.0, mfe_pips=excursion(t.side * (t.best - t.entry)) if t.best else 0.0, trend=t.trend, equity=self.equity,
        )
        return pnl

    def record(self, row: dict, kind: str, **values) -> None:
        self.rows.append({"symbol": row["symbol"], "source": row["source"], "kind": kind, "n": self.recorded, **values})
        self.recorded += 1

    def drain(self) -> list[dict]:
        out, self.rows = self.rows, []
        return out

    def passes(self, block: Block, n: int) -> bool:
        """Whether none of the block's n ticks does anything but move the extremes of open trades, which is done here.

        A stopped first stage has its reasons written tick by tick, and a pending second one waits for more than prices.
        """
        self.seen += n
        if block.acts or any(t.pending for t in self.open.values()) or self.relay.stopped and "T2" not in self.open:
            self.opened += n
            return False
        for t in self.open.values():
            s = t.side
            worst, best = (block.least[s], block.most[s]) if s > 0 else (block.most[s], block.least[s])
            trails = t.hit2 and s * (block.swing[s] - s * P.TRAIL_BUFFER * self.p.pip) > s * t.sl
            if s * worst <= s * t.sl or t.tp is not None and t.reached(best, t.tp) or not t.hit1 and t.reached(best, t.p1) or t.hit1 and not t.hit2 and t.reached(best, t.p2) or trails:
                self.opened += n
                return False
        for t in self.open.values():
            s = t.side
            worst, best = (block.least[s], block.most[s]) if s > 0 else (block.most[s], block.least[s])
            t.best = s * max(s * t.best, s * best) if t.best else best
            t.worst = s * min(s * t.worst, s * worst) if t.worst else worst
        return True

    # ---- one tick, in this order

    def tick(self, row: dict, now: int, bar: int) -> None:
        row["bid"], row["ask"] = row["bid"] or 0.0, row["ask"] or 0.0
        equity = self.equity
        if row["ask"] - row["bid"] >= self.p.wide_pips * self.p.pip:
            return self.flee(row)
        self.pending(row, now, equity)
        self.manage(row)
        self.enter(row, now, bar, equity)

    def flee(self, row: dict) -> None:
        for name, t in list(self.open.items()):
            del self.open[name]
            if not t.pending:
                pnl = self.close(t, row, "wide_spread")
                if name == "T1":
                    self.relay.stopped = pnl < 0

    def pending(self, row: dict, now: int, equity: float) -> None:
        t = self.open.get("T2")
        if not t or not t.pending:
            return
        flipped = (t.trend, row["market_bias_4h"]) in (("bull", "bearish"), ("bear", "bullish"))
        if now >= t.expires or flipped or (row["bar_close"] is not None and row["fvg_filled"]):
            del self.open["T2"]
            self.relay.stopped = False
        elif (t.side > 0 and row["ask"] <= t.mid) or (t.side < 0 and row["bid"] >= t.mid):
            atr = row["atr_15_15m"]
            self.fill(t, t.mid, row, atr if atr and atr > 0 else 0.0, t.mid)
            t.tp = self.target(t, row)
            self.relay.stopped = False

    def manage(self, row: dict) -> None:
        for name, t in list(self.open.items()):
            if t.pending:
                continue
            s, price = t.side, row["bid"] if t.side > 0 else row["ask"]
            t.best = s * max(s * t.best, s * price) if t.best else price
            t.worst = s * min(s * t.worst, s * price) if t.worst else price
            if s * price <= s * t.sl:
                pnl = self.close(t, row, "sl")
                if name == "T1":
                    self.relay.stopped = not t.hit1 and pnl < 0
                del self.open[name]
                continue
            if t.tp is not None and t.reached(price, t.tp):
                self.close(t, row, "tp")
                del self.open[name]
                continue
            if not t.hit1 and t.reached(price, t.p1):
                t.hit1, t.sl = True, t.entry
            if t.hit1 and not t.hit2 and t.reached(price, t.p2):
                t.hit2 = True
            if t.hit2:
                swing = row["confirmed_1m_swing_low" if s > 0 else "confirmed_1m_swing_high"]
                if swing is not None:
                    t.sl = s * max(s * t.sl, s * swing - P.TRAIL_BUFFER * self.p.pip)

    def enter(self, row: dict, now: int, bar: int, equity: float) -> None:
        relay = self.relay
        bos, choch = row["bos_detected_15m"], row["choch_detected_15m"]
        if relay.taken_bar == bar:
            bos = choch = False
            if self.p.relay == "full":
                row |= {"t1_action": None, "t1_reason": None}
        action, reason, _ = self.strategy(row, now, relay, "T1" in self.open, "T2" in self.open)
        if relay.stopped and action == HOLD and "T2" not in self.open and reason.startswith("REASON_"):
            self.record(row, "reason", exit_reason=reason)
        session = row["session"]
        if bos or choch:
            up = row["bos_up_15m"] or row["choch_up_15m"]
            self.record(row, "event", type="BOS" if bos else "CHoCH", direction="bull" if up else "bear", entry_time=row["timestamp_utc"], entry_reason=action, session=session or "off", entry_price=row["bid"], exit_price=row["ask"])
        if action in (T1_LONG, T1_SHORT):
            s = 1 if action == T1_LONG else -1
            extreme, atr = row["sweep_candle_low" if s > 0 else "sweep_candle_high"], row["atr_15_15m"]
            if extreme is None or atr is None or atr <= 0:
                return
            price, sl = row["ask"] if s > 0 else row["bid"], extreme - s * P.T1_BUFFER * self.p.pip
            trend = "bull" if s > 0 else "bear"
            t = Trade("T1", self.next_pair, s, reason, session or "asian", sl, self.lot(price, sl, equity), trend)
            self.fill(t, price, row, atr, (row["bid"] + row["ask"]) / 2)
            self.open["T1"] = t
            relay.direction, relay.time_ms, relay.r, relay.taken_bar, relay.stopped = trend, now, row["r_dynamic"], bar, False
            self.next_pair += 1
        elif action in (T2_LONG, T2_SHORT):
            s = 1 if action == T2_LONG else -1
            sl = row["fvg_low" if s > 0 else "fvg_high"] - s * P.T2_BUFFER * self.p.pip
            self.open["T2"] = Trade("T2", self.next_pair - 1, s, reason, session or "asian", sl, self.lot(row["gap_mid"], sl, equity), "bull" if s > 0 else "bear", True, row["gap_mid"], now + self.p.timeout_ms)

    def finish(self, row: dict) -> None:
        for name, t in list(self.open.items()):
            del self.open[name]
            if not t.pending:
                self.close(t, row, "end_of_data")


def backtest(features: DataFrame, params: P.BacktestParams | None = None, strategy: Strategy = decide) -> DataFrame:
    """Rows of kind trade, event (breaks) and reason (why a stopped first stage got no second).

    ``strategy`` is called for each tick as ``decide`` is.  A key's ticks stream through its book, so a task holds one
    batch of ticks and the book, however long the key.  With ``decide`` blocks of ticks in which nothing can happen are
    passed over by their extremes; another strategy may act on any tick and sees them all.
    """
    p = params or P.BacktestParams()
    return fold_ticks(prepared(features, p.align_bias), p.keys, lambda: Book(p, strategy), SCHEMA, blocks(p) if strategy is decide else None, strategy is not decide)
