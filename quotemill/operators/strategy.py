"""The two-stage decision as columns, and the ordered folds that need a relay: audit log and backtest.

All times are event times, so a run gives the same result at any wall clock.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import params as P
from ..functions.core import as_bool, as_float, slice_of, spread_gate

HOLD, T1_LONG, T1_SHORT, T2_LONG, T2_SHORT = "HOLD", "OPEN_T1_LONG", "OPEN_T1_SHORT", "OPEN_T2_LONG", "OPEN_T2_SHORT"
NUMBERS = (
    "bid", "ask", "bar_open", "bar_high", "bar_low", "bar_close", "atr_15_15m", "atr_20_1m", "fvg_high", "fvg_low", "fvg_age_bars", "sweep_wick", "sweep_body", "sweep_candle_low", "sweep_candle_high",
    "hh_15m", "ll_15m", "strong_low_15m", "strong_high_15m", "prev_day_high", "prev_day_low", "current_session_high", "current_session_low", "prev_session_high", "prev_session_low",
    "confirmed_1m_swing_low", "confirmed_1m_swing_high", "liq_tier", "r_dynamic",
)
FLAGS = ("bos_detected_15m", "bos_up_15m", "bos_down_15m", "choch_detected_15m", "choch_up_15m", "choch_down_15m", "fvg_filled", "liq_swept", "fvg_impulse_candle", "fvg_inside_4h_ob")
TEXTS = ("session", "fvg_side", "liq_side", "market_bias_4h")


def sweep_score() -> Column:
    """0 to 5: tier 1 gives 2, tier 2 gives 1; a wick over half the body, a major session and a CHoCH give 1 each."""
    tier = F.when(F.col("liq_tier") == 1, 2).when(F.col("liq_tier") == 2, 1).otherwise(0)
    wick = F.coalesce((F.col("sweep_body") > 0) & (F.col("sweep_wick") > F.col("sweep_body") * 0.5), F.lit(False)).cast("int")
    return F.least(F.lit(5), tier + wick + F.coalesce(F.col("session").isin("london", "newyork"), F.lit(False)).cast("int") + F.coalesce(F.col("choch_detected_15m"), F.lit(False)).cast("int"))


def gap_score() -> Column:
    """0 to 5: a gap wider than 15 gives 2; impulse, order block and an age over 3 bars give 1 each."""
    wide = F.when(F.col("fvg_high") - F.col("fvg_low") > P.GAP_WIDE, 2).otherwise(0)
    rest = [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("fvg_impulse_candle", "fvg_inside_4h_ob")]
    return F.least(F.lit(5), wide + rest[0] + rest[1] + F.coalesce((F.col("fvg_age_bars") > 3), F.lit(False)).cast("int"))


def _number(name: str, kind: T.DataType) -> Column:
    """as_float; a number is not parsed."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if isinstance(kind, T.NumericType) else as_float(name)


def _flag(name: str, kind: T.DataType) -> Column:
    """as_bool; a boolean is not parsed."""
    return F.coalesce(F.col(name), F.lit(False)) if isinstance(kind, T.BooleanType) else as_bool(name)


def context(features: DataFrame) -> DataFrame:
    """features with every column a decision reads: numbers without NaN, flags without null, what is absent as null.

    ``liq_tier`` is taken from ``sweep_tier`` where no column of that name exists.
    """
    have = set(features.columns)
    out = features
    if "liq_tier" not in have and "sweep_tier" in have:
        out = out.withColumn("liq_tier", F.col("sweep_tier"))
        have.add("liq_tier")
    kinds = {f.name: f.dataType for f in out.schema.fields}
    new = {c: _number(c, kinds[c]) if c in have else F.lit(None).cast("double") for c in NUMBERS}
    new |= {c: _flag(c, kinds[c]) if c in have else F.lit(False) for c in FLAGS}
    new |= {c: F.col(c) if c in have else F.lit(None).cast("string") for c in TEXTS}
    return out.withColumns(new)


def gap_gate() -> Column:
    """The first gate of the second stage that a tick's gap and sweep fail, or null; structure is judged by the relay."""
    size = F.col("fvg_high") - F.col("fvg_low")
    return (
        F.when(F.col("fvg_side").isNull() | F.col("fvg_filled") | F.col("fvg_high").isNull() | F.col("fvg_low").isNull(), "REASON_NO_FVG")
        .when(F.col("atr_20_1m").isNull() | (F.col("atr_20_1m") <= 0), "REASON_NO_ATR")
        .when(size < F.greatest(F.col("atr_20_1m") * P.GAP_ATR, F.lit(P.GAP_FLOOR)), "REASON_FVG_TOO_SMALL")
    )


def sweep_gate() -> Column:
    return F.when(~F.col("liq_swept"), "REASON_NO_LIQUIDITY").when(F.col("liq_tier").isNull(), "REASON_NO_LIQ_TIER")


def stateless(features: DataFrame, align_bias: bool = False) -> DataFrame:
    """The part of the decision that needs no relay, as columns: spread_gate, t1_action, t1_reason, gates, scores, t2_side.

    align_bias: a neutral bias holds and the first stage must go with the bias.
    """
    c = context(features)
    up, down = F.col("bos_up_15m") | F.col("choch_up_15m"), F.col("bos_down_15m") | F.col("choch_down_15m")
    bias = F.coalesce("market_bias_4h", F.lit("neutral"))
    if align_bias:
        up, down = up & (bias == "bullish"), down & (bias == "bearish")
    action = F.when(up, T1_LONG).when(down, T1_SHORT)
    reason = F.when(up, F.when(F.col("bos_up_15m"), "BOS").otherwise("CHoCH")).when(down, F.when(F.col("bos_down_15m"), "BOS").otherwise("CHoCH"))
    return c.withColumns(
        {
            "spread_gate": spread_gate(F.col("ask") - F.col("bid"), F.col("atr_15_15m")), "t1_action": action, "t1_reason": reason, "gap_gate": gap_gate(), "sweep_gate": sweep_gate(),
            "sweep_score": sweep_score(), "gap_score": gap_score(), "gap_mid": (F.col("fvg_high") + F.col("fvg_low")) / 2,
        }
    )


def required_score(direction: Column, bias: Column) -> Column:
    with_trend = F.coalesce(((direction == "bull") & (bias == "bullish")) | ((direction == "bear") & (bias == "bearish")), F.lit(False))
    return F.when(with_trend, P.SCORE_WITH).otherwise(P.SCORE_AGAINST)


def lot_multiplier(score: Column) -> Column:
    """Sizing by score that only the specification has: half the score, rounded down."""
    return F.floor(score / F.lit(10) * F.lit(5)).cast("int")


@dataclass
class Relay:
    """What the first stage hands to the second."""

    stopped: bool = False
    direction: str | None = None
    time_ms: int | None = None
    r: float | None = None
    taken_bar: object = None


def _none(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def decide(row: dict, now_ms: int, relay: Relay, t1: bool, t2: bool) -> tuple[str, str, int]:
    """(action, reason, total score) of one tick, given the relay and which trades are open."""
    if row["spread_gate"]:
        return HOLD, "REASON_SPREAD", 0
    if not t1 and not t2 and row["t1_action"]:
        return row["t1_action"], row["t1_reason"], 0
    if t1 or t2 or not relay.stopped:
        return HOLD, "hold", 0
    if row["gap_gate"]:
        return HOLD, row["gap_gate"], 0
    if relay.time_ms is not None and relay.r is not None and now_ms - relay.time_ms >= relay.r * 900_000:
        needs = {"bull": ("hh_15m", "strong_low_15m"), "bear": ("ll_15m", "strong_high_15m")}.get(relay.direction)
        if not needs or any(row[n] is None for n in needs):
            return HOLD, "REASON_STRUCTURE_BROKEN", 0
    if row["sweep_gate"]:
        return HOLD, row["sweep_gate"], 0
    score = int(row["sweep_score"] + row["gap_score"])
    agrees = (relay.direction, row["market_bias_4h"]) in (("bull", "bullish"), ("bear", "bearish"))
    if score < (P.SCORE_WITH if agrees else P.SCORE_AGAINST):
        return HOLD, "REASON_SCORE_TOO_LOW", score
    if (relay.direction == "bull" or row["liq_side"] == "low") and row["fvg_side"] == "bullish_fvg":
        return T2_LONG, "LIQ_SWEEP", score
    if (relay.direction == "bear" or row["liq_side"] == "high") and row["fvg_side"] == "bearish_fvg":
        return T2_SHORT, "LIQ_SWEEP", score
    return HOLD, "hold", score


#: (tick, its time in ms, relay, whether T1 and T2 are open) -> (action, reason, score)
Strategy = Callable[[dict, int, Relay, bool, bool], tuple[str, str, int]]

NEEDED = ["symbol", "source", "timestamp_utc", "seq", *NUMBERS, *FLAGS, *TEXTS, "spread_gate", "t1_action", "t1_reason", "gap_gate", "sweep_gate", "sweep_score", "gap_score", "gap_mid"]


def prepared(features: DataFrame, align_bias: bool = False) -> DataFrame:
    s = stateless(features, align_bias)
    if "seq" not in s.columns:
        s = s.withColumn("seq", F.lit(0).cast("long"))
    return s.select(*NEEDED)


def rows_of(g: pd.DataFrame):
    """Ticks of a key in order, as dicts without NaN, with their time in milliseconds and 15-minute bar."""
    g = g.sort_values(["timestamp_utc", "seq"], kind="stable")
    ms = g["timestamp_utc"].to_numpy("datetime64[ms]").astype("int64")
    for row, now in zip(g.to_dict("records"), ms.tolist()):
        yield {k: _none(v) for k, v in row.items()}, now, now // 900_000


AUDIT_SCHEMA = "symbol string, source string, timestamp_utc timestamp_ntz, decision string, reason string, score int, bid double, ask double, market_bias_4h string, session string"


class _Log:
    """One key's audit log."""

    def __init__(self, strategy: Strategy):
        self.strategy, self.relay, self.open_t1 = strategy, Relay(), False
        self.rows: list[dict] = []

    def tick(self, row: dict, now: int, bar: int) -> None:
        relay = self.relay
        if relay.taken_bar == bar:
            row |= {"t1_action": None, "t1_reason": None}
        action, reason, score = self.strategy(row, now, relay, self.open_t1, False)
        if action in (T1_LONG, T1_SHORT):
            self.open_t1, relay.taken_bar = True, bar
            relay.direction, relay.time_ms, relay.r = ("bull" if action == T1_LONG else "bear"), now, row["r_dynamic"]
        self.rows.append({c: row[c] for c in ("symbol", "source", "timestamp_utc", "bid", "ask", "market_bias_4h", "session")} | {"decision": action, "reason": reason, "score": score})

    def finish(self, row: dict) -> None:
        pass

    def drain(self) -> list[dict]:
        out, self.rows = self.rows, []
        return out


#: Ticks of a block that a fold may pass over as a whole.
BLOCK = 64


#: Ticks that travel to a fold as one row, and the time that one task packs.
CHUNK, SLICE = 1024, "15 minutes"


def _listed(a: pa.Array) -> list:
    """to_pylist, in bulk where a column holds numbers, booleans or texts."""
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        a = a.dictionary_encode()
        texts = [*a.dictionary.to_pylist(), None]
        return [texts[i] for i in pc.fill_null(a.indices, len(texts) - 1).to_numpy().tolist()] if a.null_count else [texts[i] for i in a.indices.to_numpy().tolist()]
    if not (pa.types.is_boolean(a.type) or pa.types.is_integer(a.type) or pa.types.is_floating(a.type)):
        return a.to_pylist()
    values = (pc.fill_null(a, pa.scalar(0, pa.int8()).cast(a.type)) if a.null_count else a).to_numpy(zero_copy_only=False).tolist()
    if a.null_count:
        for i in np.flatnonzero(a.is_null().to_numpy(zero_copy_only=False)).tolist():
            values[i] = None
    return values


class Columns(dict):
    """A batch's columns as lists; one is converted when it is first asked for."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __missing__(self, name: str) -> list:
        values = self[name] = _listed(self.batch.column(name))
        return values


class Tick(dict):
    """A row that reads a column when it is first asked for by name."""

    __slots__ = ("columns", "at")

    def __init__(self, columns: Columns, at: int):
        self.columns, self.at = columns, at

    def __missing__(self, name: str):
        value = self[name] = self.columns[name][self.at]
        return value


def _turns(b: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """Whether a row is the first of the batch or differs from the one before in any of the columns."""
    turn = np.ones(b.num_rows, bool)
    turn[1:] = False
    for c in cols:
        v = b.column(c).to_numpy(zero_copy_only=False)
        turn[1:] |= v[1:] != v[:-1]
    return turn


def _within(turn: np.ndarray) -> np.ndarray:
    """Each row's number since the last turn."""
    firsts = np.flatnonzero(turn)
    return np.arange(len(turn)) - np.repeat(firsts, np.diff(np.r_[firsts, len(turn)]))


def packed(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted ticks (with ``_slice``) as compressed chunks, none of which reaches over a key or slice, by their first tick."""
    for b in batches:
        if not b.num_rows:
            continue
        cuts = np.flatnonzero(_within(_turns(b, [*keys, "_slice"])) % CHUNK == 0)
        rows, inner = b.drop_columns(["_slice"]), []
        for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows.slice(start, stop - start))
            inner.append(sink.getvalue())
        first = b.select([*keys, "timestamp_utc", "seq"]).take(pa.array(cuts))
        sizes, packs = pa.array([x.size for x in inner], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in inner], pa.binary())
        yield pa.RecordBatch.from_arrays([*first.columns, sizes, packs], [*first.schema.names, "_size", "_pack"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for size, pack in zip(b.column("_size").to_pylist(), b.column("_pack")):
            yield from pa.ipc.open_stream(pa.decompress(pack.as_buffer(), size, "zstd"))


def fold_ticks(ticks: DataFrame, keys: tuple[str, ...], new: Callable[[], object], schema: str, watch: Callable[[pa.RecordBatch, np.ndarray], list] | None = None, whole: bool = True) -> DataFrame:
    """Each key's ticks, in order, through an object of its own with tick(row, ms, bar), finish(last row) and drain().

    Slices of a key are sorted and packed apart; a key's task sorts chunks, a row for up to ``CHUNK`` ticks, and streams
    them; what the object drains goes out after each.
    watch: gives for each block of a batch (from its first rows) what the object's ``passes`` judges it by; a block that
    passes is not turned into rows, as none of its ticks would do anything.  whole: rows are complete dicts; else they are
    ``Tick``, for an object that only asks for columns by name.
    """
    order = [*keys, "timestamp_utc", "seq"]
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for out in folded(unpacked(batches), keys, new, watch, whole):
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    sliced = slice_of(ticks, "timestamp_utc", SLICE, "_slice")
    chunk = T.StructType([*[ticks.schema[c] for c in order], T.StructField("_size", T.LongType()), T.StructField("_pack", T.BinaryType())])
    chunks = sliced.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", "timestamp_utc", "seq").mapInArrow(lambda batches: packed(batches, keys), chunk)
    return chunks.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def folded(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], new: Callable[[], object], watch: Callable[[pa.RecordBatch, np.ndarray], list] | None, whole: bool = True) -> Iterator[list[dict]]:
    """The fold over batches of sorted ticks: what the books drained after each."""
    now_key, book, last = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        out = []
        ms = pc.cast(b.column("timestamp_utc"), pa.timestamp("ms"), safe=False).cast(pa.int64()).to_numpy()
        turn = _turns(b, list(keys))
        cuts = np.flatnonzero(_within(turn) % BLOCK == 0)
        seen = watch(b, cuts) if watch else [None] * len(cuts)
        columns = Columns(b)
        for start, stop, block in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], seen):
            if turn[start]:
                key = tuple(b.column(k)[start].as_py() for k in keys)
                if book is None or key != now_key:
                    if book is not None:
                        book.finish(last.to_pylist()[0])
                        out += book.drain()
                    now_key, book = key, new()
            last = b.slice(stop - 1, 1)
            if block is not None and book.passes(block, stop - start):
                continue
            rows = b.slice(start, stop - start).to_pylist() if whole else [Tick(columns, i) for i in range(start, stop)]
            for at, row in zip(ms[start:stop].tolist(), rows):
                book.tick(row, at, at // 900_000)
        yield out + book.drain()
    if book is not None:
        book.finish(last.to_pylist()[0])
        yield book.drain()


def audit_log(features: DataFrame, align_bias: bool = False, strategy: Strategy = decide) -> DataFrame:
    """Decisions of the ticks that show a break, a gap or a sweep, in order, each 15-minute bar opening one first stage
    at most.  The first stage stays open, as nothing closes it here, so there is at most one per key."""
    p = prepared(features, align_bias).filter("bos_detected_15m OR choch_detected_15m OR fvg_side IS NOT NULL OR liq_swept")
    return fold_ticks(p, P.KEY, lambda: _Log(strategy), AUDIT_SCHEMA, whole=strategy is not decide)


def unaudited(features: DataFrame, decisions: DataFrame) -> DataFrame:
    """Qualifying ticks later than the key's last decision and without a decision of their own."""
    q = features.filter("bos_detected_15m OR choch_detected_15m OR fvg_side IS NOT NULL OR liq_swept")
    last = decisions.groupBy(*P.KEY).agg(F.max("timestamp_utc").alias("_resume"))
    fresh = q.join(last, list(P.KEY), "left").filter(F.col("_resume").isNull() | (F.col("timestamp_utc") > F.col("_resume"))).drop("_resume")
    return fresh.join(decisions.select(*P.KEY, "timestamp_utc").distinct(), [*P.KEY, "timestamp_utc"], "left_anti")


