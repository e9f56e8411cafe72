"""Micro-series with hand-computed results, plain-Python versions of the folds, and properties."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotemill import params as P
from quotemill.functions import core
from quotemill.operators import asof, backtest, candles, gaps, indicators, liquidity, metrics, ranges, scan, sessions, silver, strategy, structure, swings
from quotemill.plans import reports
from quotemill.plans.store import TickStore
from quotemill.sources import bi5, lake

T0 = dt.datetime(2024, 1, 1)


def bars_of(spark, rows, minutes=15, symbol="X"):
    """rows: (open, high, low, close)."""
    data = [(symbol, "mt5", T0 + dt.timedelta(minutes=minutes * i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, source string, bar_time timestamp_ntz, bar_open double, bar_high double, bar_low double, bar_close double")


def flat(spark, closes, minutes=15, half=0.5, symbol="X"):
    return bars_of(spark, [(c, c + half, c - half, c) for c in closes], minutes, symbol)


def test_flat_highs_are_no_fractal(spark):
    f = swings.fractals(flat(spark, [10] * 12), 5, 5)
    assert f.filter("is_swing_high OR is_swing_low").count() == 0


def test_fractal_needs_its_right_side(spark):
    closes = [10, 11, 12, 13, 14, 20, 14, 13]
    b = flat(spark, closes)
    assert swings.fractals(b, 5, 2).filter("is_swing_high").count() == 1
    assert swings.fractals(b, 5, 3).filter("is_swing_high").count() == 0
    adaptive = b.withColumn("r_dynamic", F.lit(2))
    assert swings.fractals(adaptive, 5, None).filter("is_swing_high").count() == 1
    assert swings.fractals(b.withColumn("r_dynamic", F.lit(5)), 5, None).filter("is_swing_high").count() == 0


def with_swings(b, highs=(), lows=()):
    at = lambda hs: [T0 + dt.timedelta(minutes=15 * i) for i in hs]
    return b.withColumn("is_swing_high", F.col("bar_time").isin(at(highs)) if highs else F.lit(False)).withColumn("is_swing_low", F.col("bar_time").isin(at(lows)) if lows else F.lit(False)).withColumn("r_dynamic", F.lit(3))


def rows(df, order="bar_time"):
    return df.orderBy(order).collect()


def test_breaks_repeat_while_closes_stay_beyond(spark):
    out = rows(structure.structure(with_swings(flat(spark, [10, 12, 10, 14, 15, 16]), highs=[1])))
    assert [r.bos_up_15m for r in out] == [False, False, False, True, True, True]
    assert out[3].smc_trend_15m == "bull" and out[3].r_dynamic_at_bos == 3


def test_one_bar_can_break_both_ways_and_ends_bear(spark):
    b = bars_of(spark, [(10, 11, 9, 10), (20, 20.5, 19.5, 20), (15, 21, 14, 15)])
    # The low at 19.5 lies above the high at 11, so a close of 15 is beyond both.
    out = rows(structure.structure(with_swings(b, highs=[0], lows=[1])))
    assert out[2].bos_up_15m and out[2].bos_down_15m and out[2].smc_trend_15m == "bear"


def test_change_of_character_turns_and_clears(spark):
    closes = [10, 12, 11, 9, 11, 13, 14, 15, 8, 8]
    out = rows(structure.structure(with_swings(flat(spark, closes), highs=[1], lows=[3]), "choch"))
    assert out[5].smc_trend_15m == "bull" and not out[5].bos_detected_15m
    assert out[6].bos_up_15m and out[6].strong_low_15m == 8.5
    assert out[8].choch_down_15m and out[8].smc_trend_15m == "bear"
    assert out[8].hh_15m is None and out[8].ll_15m is None and out[8].strong_high_15m == 12.5
    assert not out[9].bos_detected_15m
    with pytest.raises(ValueError):
        structure.structure(flat(spark, closes), "other")


def test_atr_seed_and_recursion(spark):
    b = bars_of(spark, [(10, 11, 9, 10), (10, 13, 10, 12), (12, 12, 11, 11), (11, 15, 11, 14)])
    a = [r.atr for r in rows(indicators.atr(b, 3, "atr"))]
    assert a[:2] == [0.0, 0.0] and a[2] == pytest.approx(2.0) and a[3] == pytest.approx((2 * 2 + 4) / 3)
    assert [r.atr for r in rows(indicators.atr(b, 3, "atr", "null"))][:2] == [None, None]
    assert {r.atr for r in rows(indicators.atr(b, 9, "atr"))} == {None}


def test_rsi_is_100_without_falls(spark):
    out = [r.rsi_14 for r in rows(indicators.rsi(flat(spark, range(20))))]
    assert out[-1] == 100.0 and out[5] is None


def test_r_dynamic_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1.2, 1.0), (None, 1.0), (0.0, 1.0), (9.0, 1.0), (0.1, 1.0)], "a double, m double")
    assert [r[0] for r in df.select(core.r_dynamic(F.col("a"), F.col("m"))).collect()] == [2, 5, 5, 2, 5]


def test_session_labels(spark):
    times = [(T0 + dt.timedelta(hours=22, minutes=30),), (T0 + dt.timedelta(hours=8, minutes=30),), (T0 + dt.timedelta(hours=13, minutes=30),)]
    df = spark.createDataFrame(times, "t timestamp_ntz")
    assert [r[0] for r in df.select(core.session_label("t")).collect()] == ["asian", "london", "newyork"]


def walk_sessions(ticks):
    """The older session tracker as a walk over (time, seq, mid), with the days' ranges."""
    name = lambda t: "ny" if t.hour >= 13 else "london" if t.hour >= 8 else "asian"
    days, out, now = {}, [], "asian"
    for t, _, mid in ticks:
        days.setdefault(t.date(), []).append(mid)
    day = prev = (None, None)
    high = low = None
    for t, _, mid in sorted(ticks):
        if high is None:
            high = low = mid
        elif name(t) != now:
            prev, now = (high, low), name(t)
            yesterday = days.get(t.date() - dt.timedelta(days=1))
            if t.hour == 0 and yesterday:
                day = (max(yesterday), min(yesterday))
            high = low = mid
            out.append((t, *day, mid, mid, *prev))
        else:
            high, low = max(high, mid), min(low, mid)
    return out


def test_older_session_tracker_walks_ticks(spark):
    at = lambda d, h, m, s=0: T0 + dt.timedelta(days=d, hours=h, minutes=m, seconds=s)
    hand = [(at(0, 9, 0, 1), 5.0), (at(0, 9, 0, 2), 7.0), (at(0, 9, 0, 3), 3.0), (at(0, 14, 0, 9), 6.0), (at(1, 0, 5), 8.0), (at(1, 0, 5, 30), 9.0), (at(2, 13, 0), 1.0), (at(3, 4, 0), 2.0), (at(5, 0, 0), 4.0), (at(5, 8, 0), 2.5)]
    r = random.Random(5)
    many = sorted((at(0, 0, 0) + dt.timedelta(seconds=r.randrange(12 * 86400)), float(r.randrange(100))) for _ in range(150))
    keyed = {"H": [(t, i, m) for i, (t, m) in enumerate(hand)], "A": [(t, i, m) for i, (t, m) in enumerate(many)], "T": [(at(0, 8, 0), 9 - i, float(i)) for i in range(4)]}
    ticks = spark.createDataFrame([(k, "mt5", *x) for k, v in keyed.items() for x in v], "symbol string, source string, timestamp_utc timestamp_ntz, seq long, mid double")
    got = rows(sessions.tick_session_levels(ticks, candles.ohlc(ticks, "4 hours")), "snapshot_time")
    for k, v in keyed.items():
        assert [tuple(x)[2:3] + tuple(x)[4:] for x in got if x.symbol == k] == walk_sessions(v)
    assert tuple(next(x for x in got if x.symbol == "H"))[2:] == (at(0, 9, 0, 2), True, None, None, 7.0, 7.0, 5.0, 5.0)


def test_same_session_after_a_gap_is_one_session(spark):
    m = spark.createDataFrame([("X", "mt5", T0 + dt.timedelta(hours=1), 5.0, 4.0), ("X", "mt5", T0 + dt.timedelta(days=1, hours=1), 8.0, 7.0), ("X", "mt5", T0 + dt.timedelta(days=1, hours=9), 9.0, 6.0)], "symbol string, source string, minute timestamp_ntz, high double, low double")
    out = rows(sessions.session_levels(m), "snapshot_time")
    assert [r.session_name for r in out] == ["asian", "london"]
    assert out[1].prev_day_high == 5.0 and out[1].prev_session_high is None and out[1].current_session_high == 9.0


def test_asof_takes_the_last_row_and_never_looks_ahead(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    left = spark.createDataFrame([("X", "a", at(h), h) for h in (0, 5, 30, 80)], "symbol string, source string, t timestamp_ntz, n int")
    right = spark.createDataFrame([("X", "a", at(5), 1, None), ("X", "a", at(5), 2, "x"), ("X", "a", at(29), 3, "y"), ("Y", "a", at(0), 9, "z")], "symbol string, source string, rt timestamp_ntz, v int, w string")
    out = {r.n: (r.v, r.w) for r in asof.asof_backward(left, right, "t", "rt", ["v", "w"], tie=["v"]).collect()}
    assert out == {0: (None, None), 5: (2, "x"), 30: (3, "y"), 80: (3, "y")}
    # A null inside the matched row stays null.
    nulled = spark.createDataFrame([("X", "a", at(1), 1, "p"), ("X", "a", at(4), 2, None)], right.schema)
    assert {r.n: r.w for r in asof.asof_backward(left, nulled, "t", "rt", ["v", "w"]).collect()}[5] is None
    assert asof.asof_backward(left.limit(0), right, "t", "rt", ["v"]).count() == 0


def gap_setup(spark, closes_after):
    """A trigger at bar 0, a bullish gap of 4 around bar 2, then the given closes."""
    base = [(100, 100.2, 99.8, 100), (100, 100.5, 99.5, 100), (100, 106, 100, 105), (106, 108, 104.5, 106)]
    b = bars_of(spark, base + [(c, c + 0.1, c - 0.1, c) for c in closes_after], 1).withColumn("atr_20_1m", F.lit(2.0))
    trig = spark.createDataFrame([("X", "mt5", T0, True, False, "bull")], "symbol string, source string, bar_time timestamp_ntz, bos_detected_15m boolean, choch_detected_15m boolean, smc_trend_15m string")
    return b, trig


def test_gap_is_filled_by_bar_21_but_not_22(spark):
    for n, filled in ((19, True), (20, False)):
        b, st = gap_setup(spark, [107] * (n - 1) + [99])  # the last close is on bar i + 2 + n - 1... counted from bar 2
        g = gaps.find_gaps(b, st).filter("bar_no = 3").collect()
        assert len(g) == 1 and g[0].fvg_side == "bullish_fvg" and (g[0].fvg_low, g[0].fvg_high) == (100.5, 104.5)
        assert g[0].fvg_filled == filled or n == 20


def test_active_gap_is_seen_while_open(spark):
    b, st = gap_setup(spark, [107, 107, 99, 107])
    g = gaps.find_gaps(b, st)
    seen = {r.bar_time.minute: r.fvg_age_bars for r in gaps.active_gaps(b, g, st).filter("fvg_high IS NOT NULL").collect()}
    assert seen == {3: 1, 4: 2, 5: 3}


def test_small_bodies_and_gaps_are_left_out(spark):
    b, st = gap_setup(spark, [107])
    assert gaps.find_gaps(b.withColumn("atr_20_1m", F.lit(10.0)), st).count() == 0  # body is exactly half an ATR
    assert gaps.find_gaps(b.withColumn("bar_low", F.col("bar_low") - F.when(F.col("bar_time") == T0 + dt.timedelta(minutes=3), 1.1).otherwise(0)), st).count() == 0


def test_lowest_tier_wins_a_sweep(spark):
    b = bars_of(spark, [(100, 103, 99, 100)], 1).withColumn("atr_20_1m", F.lit(1.0))
    lv = spark.createDataFrame([("X", "mt5", "high", 102.0, 1, T0, 0)], "symbol string, source string, direction string, price double, tier int, visible timestamp_ntz, ordinal int")
    sw = spark.createDataFrame([("X", "mt5", T0, "high", 101.0)], "symbol string, source string, bar_time timestamp_ntz, kind string, price double")
    none = spark.createDataFrame([], "symbol string, source string, direction string, price double, strength int")
    r = liquidity.sweeps(b, lv, sw, none).first()
    assert (r.liq_swept, r.liq_side, r.sweep_tier, r.sweep_wick, r.sweep_body) == (True, "high", 1, 3.0, 0.0)
    late = lv.withColumn("visible", F.col("visible") + F.expr("INTERVAL 1 HOUR"))
    assert liquidity.sweeps(b, late, sw, none).first().sweep_tier == 3


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_level_joins_equal_all_pairs_at_any_price(spark, scale):
    r = random.Random(5)
    closes = [scale * (1 + r.randrange(-60, 60) / 4000) for _ in range(80)]
    b = bars_of(spark, [(c, c * (1 + r.random() / 400), c * (1 - r.random() / 400), c * (1 + r.randrange(-2, 3) / 1000)) for c in closes])
    made = [("X", "mt5", r.choice(["high", "low"]), scale * (1 + r.randrange(-80, 80) / 4000), T0 + dt.timedelta(minutes=15 * r.randrange(60)), i) for i in range(40)]
    lv = spark.createDataFrame(made, "symbol string, source string, direction string, price double, formed_at timestamp_ntz, score int")
    bars = [x.asDict() for x in b.collect()]
    swept = {x.score: x.swept_at for x in liquidity.first_sweeps(lv, b).collect()}
    touched = {x.score: x.touches for x in liquidity.touches(lv, b).collect()}
    for _, _, side, p, formed, i in made:
        hit = lambda x: x["bar_high"] > p * 1.0005 and x["bar_close"] < p if side == "high" else x["bar_low"] < p * (1 - 0.0005) and x["bar_close"] > p  # noqa: B023, E731
        assert swept[i] == min((x["bar_time"] for x in bars if x["bar_time"] > formed and hit(x)), default=None)
        assert touched[i] == sum(x["bar_high"] >= p - p * 0.0005 and x["bar_low"] <= p + p * 0.0005 for x in bars)
    points = [(k, scale * v) for k, v in enumerate([0.1, 0.99, 1.0, 1.0, 1.0007, 1.013, 7.0])] + [(98, made[0][3]), (99, None)]
    best = {}
    for m in made:
        best[m[3]] = max(best.get(m[3], -1), m[5])
    frame = spark.createDataFrame([("X", "mt5", *x) for x in points] + [("Z", "mt5", 100, 1.0)], "symbol string, source string, score int, price double")
    found = {x[2]: tuple(x[4:]) for x in liquidity.nearest_levels(frame, lv).collect()}
    assert sorted(found) == [k for k, _ in points]
    for k, p in points[:-1]:
        near = sorted(best, key=lambda x: (abs(x - p), x))[:3]  # noqa: B023
        assert found[k] == (min((x for x in best if x > p), default=None), max((x for x in best if x < p), default=None), max(best[x] for x in near))
    assert found[99] == (None, None, None)


def test_inserts_leave_no_files_and_meet_old_and_new_days(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    left = lambda: {*shared.glob("insert-candles_4h*"), *shared.glob("new-candles_4h*")}
    store, b, before = TickStore(spark, f"{tmp_path}/store"), flat(spark, range(1, 9), minutes=720), left()
    early, late = b.filter(F.col("bar_time") < F.lit("2024-01-03").cast("timestamp_ntz")), b.filter(F.col("bar_time") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    assert (store.insert("candles_4h", early), store.insert("candles_4h", late), store.insert("candles_4h", b), store.insert("candles_4h", b.limit(0))) == (4, 4, 0, 0)
    assert store.read("candles_4h").count() == 8 and shared.is_dir() and left() == before


def test_candle_tables_keep_their_columns(spark, tmp_path):
    store, b = TickStore(spark, f"{tmp_path}/store"), bars_of(spark, [(1, 2, 0, 1)])
    store.replace_symbols("candles_1m", b)
    store.replace_symbols("candles_1m", b.drop("bar_open").withColumn("extra", F.lit(1)))
    (row,) = store.read("candles_1m").collect()
    assert "extra" not in row.asDict() and row.bar_open is None and row.bar_high == 2


def test_clusters_are_greedy_and_strongest_first():
    assert liquidity._cluster([1.0, 1.1, 5.0, 1.05, 5.1, 9.0], 0.2) == [(pytest.approx(1.05), 3), (pytest.approx(5.05), 2)]
    assert liquidity._cluster([1.0], 0.2) == []


def test_silver_rules(spark):
    vols = [(10.0, 9.0, 200.0), (10.0, 10.0, 200.0), (0.0, 0.0, 200.0), (float("nan"), 9.0, 200.0), (10.0, 10.0, 99.999), (10.0, 10.0, 100.0)]
    df = spark.createDataFrame([(T0, a, b, v, v, None) for a, b, v in [(9.0, 10.0, 200.0), *vols]], "timestamp_utc timestamp_ntz, ask double, bid double, ask_volume double, bid_volume double, symbol string")
    assert silver.quality_counters(df).first().asDict() == {"raw": 7, "invalid": 2, "inverted": 1, "below_notional": 1, "ok": 3, "zero_spread": 2}
    assert silver.unify_dukascopy(df).count() == 3
    with pytest.raises(ValueError):
        silver.unify_dukascopy(df.drop("ask"))
    mt5 = spark.createDataFrame([(" xauusd", 1.0, 1.0, 1.0, 1.0, 5), (" xauusd", 1.0, 1.1, 1.0, 1.0, 5), ("  ", 1.0, 1.1, 1.0, 1.0, 5)], "symbol string, bid double, ask double, last double, volume double, time_msc bigint")
    assert [r.symbol for r in silver.valid_mt5(mt5).collect()] == ["XAUUSD"]


def test_drawdown_and_sharpe(spark):
    t = spark.createDataFrame([("X", "a", i, i, p) for i, p in enumerate([10.0, -4.0, -3.0, 8.0])], "symbol string, source string, exit_time int, n int, pnl double")
    assert metrics.max_drawdown(t).first().max_drawdown == 7.0
    assert metrics.sharpe(t.limit(1)).first().sharpe == 0.0
    assert metrics.sharpe(t.withColumn("pnl", F.lit(1.0))).first().sharpe == 0.0


FEATURE = {c: None for c in strategy.NUMBERS} | {c: False for c in strategy.FLAGS} | {c: None for c in strategy.TEXTS}


def ticks_frame(spark, events):
    base = FEATURE | {"atr_15_15m": 10.0, "atr_20_1m": 2.0, "sweep_candle_low": 98.0, "sweep_candle_high": 102.0, "session": "london", "market_bias_4h": "bullish"}
    data = []
    for i, (bid, more) in enumerate(events):
        data.append({"symbol": "X", "source": "mt5", "timestamp_utc": T0 + dt.timedelta(minutes=16 * i), "seq": i, **base, "bid": bid, "ask": bid + 0.1, **more})
    schema = "symbol string, source string, timestamp_utc timestamp_ntz, seq bigint, " + ", ".join([f"{c} double" for c in strategy.NUMBERS] + [f"{c} boolean" for c in strategy.FLAGS] + [f"{c} string" for c in strategy.TEXTS])
    return spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in data], schema)


BOS = {"bos_detected_15m": True, "bos_up_15m": True}
GAP = {"fvg_side": "bullish_fvg", "fvg_high": 120.0, "fvg_low": 100.0, "liq_swept": True, "liq_side": "low", "liq_tier": 1.0, "sweep_wick": 2.0, "sweep_body": 1.0}


def trades(spark, events, **kw):
    out = backtest.backtest(ticks_frame(spark, events), P.BacktestParams(**kw)).orderBy("n").collect()
    return [r for r in out if r.kind == "trade"], out


def test_stop_loss_then_second_stage_takes_profit(spark):
    events = [(100.0, BOS), (97.0, {}), (112.0, GAP), (109.0, {"prev_day_high": 140.0}), (141.0, {})]
    t, _ = trades(spark, events, relay="full", timeout_ms=10**9)
    assert [(r.type, r.exit_reason) for r in t] == [("T1", "sl"), ("T2", "tp")]
    assert t[0].pnl < 0 < t[1].pnl and t[1].pair_id == t[0].pair_id
    assert t[1].entry_price == 110.0 and t[1].equity == pytest.approx(P.CAPITAL + t[0].pnl + t[1].pnl)


def test_breakeven_after_point_one(spark):
    t, _ = trades(spark, [(100.0, BOS), (104.0, {}), (100.05, {})])
    assert t[0].exit_reason == "sl" and t[0].point1_hit and not t[0].point2_hit and abs(t[0].pnl_pips) <= 1


def test_wide_spread_closes(spark):
    t, _ = trades(spark, [(100.0, BOS), (99.0, {"ask": 101.5})])
    assert t[0].exit_reason == "wide_spread"


def test_pending_order_expires_and_end_of_data_closes(spark):
    t, out = trades(spark, [(100.0, BOS), (97.0, {}), (112.0, GAP), (120.0, {}), (109.0, {})], relay="full")
    assert [(r.type, r.exit_reason) for r in t] == [("T1", "sl")]
    t, _ = trades(spark, [(100.0, BOS), (101.0, {})])
    assert t[0].exit_reason == "end_of_data"


def test_no_trade_without_a_sweep_zone_or_atr(spark):
    assert trades(spark, [(100.0, BOS | {"sweep_candle_low": None}), (101.0, {})])[0] == []
    assert trades(spark, [(100.0, BOS | {"atr_15_15m": None}), (101.0, {})])[0] == []


def test_bias_alignment_holds(spark):
    assert trades(spark, [(100.0, BOS | {"market_bias_4h": "neutral"}), (101.0, {})], align_bias=True)[0] == []


def test_keys_are_isolated(spark):
    a = ticks_frame(spark, [(100.0, BOS), (97.0, {})])
    both = a.unionByName(a.withColumn("symbol", F.lit("Y")).withColumn("bos_up_15m", F.lit(False)).withColumn("bos_detected_15m", F.lit(False)))
    out = backtest.backtest(both).filter("kind = 'trade'").collect()
    assert [r.symbol for r in out] == ["X"]


def test_report_renders(spark, tmp_path):
    _, out = trades(spark, [(100.0, BOS), (97.0, {})])
    df = backtest.backtest(ticks_frame(spark, [(100.0, BOS), (97.0, {})]))
    figures = reports.overview(df)
    assert figures["summary"]["n_trades"] == 1 and "| T1 | 1 |" in reports.markdown(figures) and "n_trades" in reports.text(figures)
    reports.write_csv(reports.trades_of(df), str(tmp_path / "csv"))


def test_binary_hours_decode(spark, tmp_path):
    frame = pd.DataFrame({"timestamp_utc": [pd.Timestamp(T0) + pd.Timedelta(milliseconds=i) for i in range(3)], "ask": [2000.5, 2001.0, 2002.25], "bid": [2000.0, 2000.5, 2002.0], "ask_volume": [1e6] * 3, "bid_volume": [2e6] * 3})
    blob = bi5.encode(frame, T0, "XAUUSD")
    folder = tmp_path / "XAUUSD/2024/00/01"
    folder.mkdir(parents=True)
    (folder / "00h_ticks.bi5").write_bytes(blob)
    (folder / "01h_ticks.bi5").write_bytes(b"")
    got = bi5.read(spark, str(tmp_path)).orderBy("timestamp_utc").collect()
    assert [(r.ask, r.bid, r.ask_volume) for r in got] == [(2000.5, 2000.0, 1e6), (2001.0, 2000.5, 1e6), (2002.25, 2002.0, 1e6)]
    import lzma

    cut = lzma.compress(lzma.decompress(blob) + b"1234567", format=lzma.FORMAT_ALONE)
    assert len(bi5.decode(cut, T0, "XAUUSD")) == 3
    assert bi5.decode(blob, T0, "EURUSD")["ask"][0] == pytest.approx(20.005)
    assert bi5.retry_delay(9) == 120 and bi5.retry_delay(1, False) == 10


def test_lake_compaction_and_pruned_scan(spark, tmp_path):
    t = spark.createDataFrame([(dt.datetime(2024, m, 1), 1.0 + k, 1.0, 1.0, 1.0, "X") for m in (1, 2) for k in (0, 0)], "timestamp_utc timestamp_ntz, ask double, bid double, ask_volume double, bid_volume double, symbol string")
    lake.write_ticks(t, str(tmp_path / "raw"))
    lake.compact(spark, str(tmp_path / "raw"), str(tmp_path / "done"))
    assert lake.scan(spark, str(tmp_path / "done")).count() == 2
    assert lake.scan(spark, str(tmp_path / "done"), (2024, 2), (2024, 2)).count() == 1
    with pytest.raises(ValueError):
        lake.scan_file(spark, str(tmp_path / "done")).select("ask")
        t.drop("bid").write.parquet(str(tmp_path / "bad"))
        lake.scan_file(spark, str(tmp_path / "bad"))


def test_store_inserts_once_replaces_symbols_and_grows_columns(spark, tmp_path):
    b = flat(spark, [1, 2, 3])
    with TickStore(spark, str(tmp_path / "s")) as store:
        assert store.insert("candles_15m", b) == 3 and store.insert("candles_15m", b) == 0
        store.insert("candles_15m", flat(spark, [1, 2], symbol="Y").withColumn("extra", F.lit(1)))
        store.replace_symbols("candles_15m", flat(spark, [9]))
        assert {r["symbol"]: r["count"] for r in store.read("candles_15m").groupBy("symbol").count().collect()} == {"X": 1, "Y": 2}
        assert store.tables() == ["candles_15m"] and "extra" in [r.column_name for r in store.describe("candles_15m").collect()]
        assert store.candle_at("candles_15m", "Y", T0 + dt.timedelta(minutes=20)).first().bar_close == 2.0
        assert store.between("candles_15m", "Y", T0, T0).count() == 1
    with pytest.raises(PermissionError):
        TickStore(spark, str(tmp_path / "s"), read_only=True).insert("candles_15m", flat(spark, [1, 2], symbol="Z"))


def test_running_counts_rise(spark):
    f = swings.fractals(flat(spark, [1, 5, 2, 6, 3, 7, 1, 8, 2, 9, 3, 1, 4, 2, 8, 1] * 3), 2, 2)
    out = swings.swing_counts(swings.swing_rows(f)).orderBy("bar_time", "kind").collect()
    assert all(a.n_highs <= b.n_highs and a.n_lows <= b.n_lows for a, b in zip(out, out[1:]))


def test_empty_tables(spark):
    b = flat(spark, [1]).limit(0)
    assert indicators.atr(b, 3, "atr").count() == 0 and structure.structure(with_swings(b)).count() == 0
    assert candles.ohlc(spark.createDataFrame([], "timestamp_utc timestamp_ntz, symbol string, source string, mid double, seq bigint"), "1 hour").count() == 0


def test_averages_over_slices_equal_a_run_over_the_whole(spark):
    r = np.random.default_rng(1)
    # One row in 20 hours: eight or nine of a key's rows make a slice, so seeds and warm-ups cross slices.
    frames = []
    for symbol, n in (("A", 120), ("B", 19), ("C", 20), ("D", 1)):
        at = np.datetime64("2024-01-01T03:00:00") + np.arange(n) * np.timedelta64(20, "h")
        u = r.normal(10, 3, n)
        u[5::17] = np.nan
        frames.append(pd.DataFrame({"symbol": symbol, "source": "s", "bar_time": at.astype("datetime64[us]"), "u": u}))
    whole = pd.concat(frames)
    df = spark.createDataFrame(whole.sample(frac=1, random_state=2), "symbol string, source string, bar_time timestamp_ntz, u double").withColumn("u", F.when(~F.isnan("u"), F.col("u")))
    wanted = [scan.Average("u", "seeded", 1 / 20, seed=20, shown=20, early=0.0), scan.Average("u", "plain", 2 / 21, shown=20), scan.Average("u", "short", 0.5, seed=3)]
    found = scan.averages(scan.sliced(df, "bar_time"), wanted)
    assert found.groupBy("symbol", "_slice").count().agg(F.max("count")).first()[0] <= 9
    got = {k: g.sort_values("bar_time") for k, g in found.toPandas().groupby("symbol")}
    for f in frames:
        out, u = got[f["symbol"].iloc[0]], f["u"].dropna().to_numpy()
        for a in wanted:
            want = np.full(len(u), np.nan)
            if len(u) >= a.seed:
                x = u[: a.seed].mean()
                for i in range(a.seed - 1, len(u)):
                    x = x if i < a.seed else (1 - a.weight) * x + a.weight * u[i]
                    want[i] = x
            want[: a.shown - 1] = a.early if a.early is not None and len(u) >= a.shown else np.nan
            have = out.loc[out["u"].notna(), a.name].to_numpy(float)
            np.testing.assert_allclose(have, want, rtol=1e-9)


def test_previous_values_cross_slices(spark):
    rows_ = [("A", "s", T0 + dt.timedelta(hours=31 * k), float(k)) for k in range(40)]
    df = spark.createDataFrame(rows_, "symbol string, source string, bar_time timestamp_ntz, u double")
    got = scan.previous(scan.sliced(df, "bar_time"), "u", "was").orderBy("bar_time").collect()
    assert [r.was for r in got] == [None, *[float(k) for k in range(39)]]


def test_drawdown_over_slices_equals_a_run_over_the_whole(spark):
    r = np.random.default_rng(4)
    pnl = r.normal(0, 50, 400)
    for sign in (1, -1, 0):
        p = np.abs(pnl) * sign if sign else pnl
        t = spark.createDataFrame([("X", "a", T0 + dt.timedelta(days=int(k) // 2), int(k), float(x)) for k, x in enumerate(p)], "symbol string, source string, exit_time timestamp_ntz, n int, pnl double")
        equity = np.r_[10_000, 10_000 + np.cumsum(p)]
        assert metrics.max_drawdown(t).first().max_drawdown == pytest.approx((np.maximum.accumulate(equity) - equity).max())


def test_many_facts_equal_one_join_after_the_other(spark):
    r = np.random.default_rng(5)
    at = lambda n: [T0 + dt.timedelta(hours=float(h)) for h in r.uniform(0, 120, n)]
    keys = lambda n: [("XY"[k], "s") for k in r.integers(0, 2, n)]
    left = spark.createDataFrame([(*k, t, i) for i, (k, t) in enumerate(zip(keys(300), at(300)))], "symbol string, source string, timestamp_utc timestamp_ntz, seq int")
    a = spark.createDataFrame([(*k, t, float(i), None if i % 3 else "t") for i, (k, t) in enumerate(zip(keys(40), at(40)))], "symbol string, source string, bar_time timestamp_ntz, x double, y string")
    b = a.withColumn("z", F.col("x") * 2).withColumn("bar_time", F.date_trunc("day", "bar_time").cast("timestamp_ntz")).select("symbol", "source", "bar_time", "z").filter("z < 40")
    facts = [asof.Fact(a, "bar_time", ["x", "y"]), asof.Fact(b, "bar_time", ["z"], tie=["z"]), asof.Fact(a.limit(0).withColumnsRenamed({"x": "v"}), "bar_time", ["v"])]
    got = asof.asof_many(left, "timestamp_utc", facts)
    want = left
    for f in facts:
        want = asof.asof_backward(want, f.rows, "timestamp_utc", f.at, f.cols, tie=f.tie)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_row") and got.filter("z IS NOT NULL").count() > 0


@pytest.mark.parametrize("scale", [100.0, 1e4])
def test_sweeps_by_minima_equal_all_pairs(spark, scale):
    r = random.Random(11)
    price = lambda: scale + round(r.random() * 20, 1)
    b = bars_of(spark, [(c := price(), c + r.randrange(4), c - r.randrange(4), c + r.choice([-1, 0, 1]) * 0.5) for _ in range(150)], 1).withColumn("atr_20_1m", F.when(F.minute("bar_time") % 3 > 0, F.lit(4.0)))
    kinds = lambda: r.choice(["high", "low"])
    ses = spark.createDataFrame([("X", "mt5", kinds(), price(), r.choice([1, 2]), T0 + dt.timedelta(minutes=r.randrange(150)), r.randrange(6)) for _ in range(12)], "symbol string, source string, direction string, price double, tier int, visible timestamp_ntz, ordinal int")
    sw = spark.createDataFrame([("X", "mt5", T0 + dt.timedelta(minutes=k), kinds(), price()) for k in range(9)], "symbol string, source string, bar_time timestamp_ntz, kind string, price double")
    eq = spark.createDataFrame([("X", "mt5", "high", price(), 2)], "symbol string, source string, direction string, price double, strength int")
    got = {x.bar_time: (x.sweep_tier, x.liq_side) for x in liquidity.sweeps(b, ses, sw, eq).collect()}
    counts, levels = {"high": 0, "low": 0}, []
    for x in sw.orderBy("bar_time").collect():
        counts[x.kind] += 1
        levels.append((3, dt.datetime.min, (x.kind == "low") * (1 << 40) + counts[x.kind], x.kind, x.price))
    levels += [(3, dt.datetime.min, (1 << 42) + (x.direction == "low"), x.direction, x.price) for x in eq.collect()]
    levels += [(x.tier, x.visible, x.ordinal, x.direction, x.price) for x in ses.collect()]
    for x in b.collect():
        tol = max((x.atr_20_1m or 4.0) * P.SWEEP_ATR, P.SWEEP_FLOOR)
        hit = lambda d, p: x.bar_high >= p - tol and x.bar_close < p if d == "high" else x.bar_low <= p + tol and x.bar_close > p  # noqa: B023, E731
        best = min((v for v in levels if v[1] <= x.bar_time and hit(v[3], v[4])), default=(None,) * 5)
        assert got[x.bar_time] == (best[0], best[3])
    assert len({v for v in got.values()}) > 4


def test_minima_of_stretches():
    r = np.random.default_rng(2)
    values = r.integers(0, 99, 500)
    a = r.integers(0, 499, 300)
    b = a + 1 + (r.random(300) * (500 - a - 1)).astype(int)
    assert ranges.Minima(values)(a, b).tolist() == [values[x:y].min() for x, y in zip(a, b)]


def test_counts_of_values_equal_comparisons(spark):
    r = random.Random(9)
    v = [(k, "s", r.choice([None, float(r.randrange(50)), r.random() * 50])) for k in "AAB" for _ in range(150)]
    p = [(k, "s", i, r.choice([None, -5.0, 99.0, float(r.randrange(50)), r.random() * 50])) for i in range(80) for k in "ABC"]
    values, points = spark.createDataFrame(v, "symbol string, source string, x double"), spark.createDataFrame(p, "symbol string, source string, i int, at double")
    for strict in (False, True):
        got = {(x.symbol, x.i): x.n for x in ranges.count_up_to(points, F.col("at"), values, "x", "n", strict).collect()}
        for k, _, i, at in p:
            want = 0 if at is None else sum(x is not None and (x < at if strict else x <= at) for s, _, x in v if s == k)
            assert got[k, i] == want


def test_first_sweeps_over_years_equal_all_pairs(spark):
    r = random.Random(21)
    data, c = [], 100.0
    for k in range(1500):  # a bar a day: more than one of the widest blocks
        c += r.gauss(0, 1.2)
        close = c + r.choice([-1, 0, 1]) * r.random() * 2
        data.append(("X", "mt5", T0 + dt.timedelta(days=k, hours=r.randrange(24)), c, max(c, close) + r.random() * 2, min(c, close) - r.random() * 2, close))
    b = spark.createDataFrame(data, "symbol string, source string, bar_time timestamp_ntz, bar_open double, bar_high double, bar_low double, bar_close double")
    made = [("X", "mt5", r.choice(["high", "low"]), r.choice(data)[6] + r.choice([0.0, 0.5, 30.0]), T0 + dt.timedelta(days=r.randrange(1500)), i) for i in range(120)] + [("Y", "mt5", "high", 1.0, T0, 999)]
    made += made[:3]
    lv = spark.createDataFrame(made, "symbol string, source string, direction string, price double, formed_at timestamp_ntz, score int")
    out = liquidity.first_sweeps(lv, b).collect()
    got = {x.score: x.swept_at for x in out}
    assert len(out) == len(made)
    for sym, _, side, p, formed, i in made:
        hit = lambda x: x[4] > p * 1.0005 and x[6] < p if side == "high" else x[5] < p * (1 - 0.0005) and x[6] > p  # noqa: B023, E731
        assert got[i] == min((x[2] for x in data if sym == "X" and x[2] > formed and hit(x)), default=None)
    assert sum(v is not None for v in got.values()) > 60


def test_counters_come_with_the_rows(spark, tmp_path):
    vols = [(9.0, 10.0, 200.0), (10.0, 9.0, 200.0), (10.0, 10.0, 200.0), (0.0, 0.0, 200.0), (float("nan"), 9.0, 200.0), (10.0, 10.0, 99.999), (10.0, 10.0, 100.0)]
    df = spark.createDataFrame([(T0, a, b, v, v, None) for a, b, v in vols], "timestamp_utc timestamp_ntz, ask double, bid double, ask_volume double, bid_volume double, symbol string")
    rows_, told = silver.unify_observed(df)
    rows_.write.parquet(str(tmp_path / "out"))
    assert told.get == silver.quality_counters(df).first().asDict() and spark.read.parquet(str(tmp_path / "out")).count() == told.get["ok"]


def test_unreadable_and_cut_hours_are_told(spark, tmp_path):
    import lzma

    hour = dt.datetime(2024, 1, 5, 10)
    folder = tmp_path / "XAUUSD" / "2024" / "00" / "05"
    folder.mkdir(parents=True)
    frame = pd.DataFrame({"timestamp_utc": [pd.Timestamp(hour) + pd.Timedelta(seconds=k) for k in range(3)], "ask": 2000.5, "bid": 2000.25, "ask_volume": 1e6, "bid_volume": 2e6})
    whole = bi5.encode(frame, hour, "XAUUSD")
    (folder / "10h_ticks.bi5").write_bytes(whole)
    (folder / "11h_ticks.bi5").write_bytes(b"no archive")
    (folder / "12h_ticks.bi5").write_bytes(lzma.compress(lzma.decompress(whole)[:-7], format=lzma.FORMAT_ALONE))
    (folder / "13h_ticks.bi5").write_bytes(b"")
    (tmp_path / "XAUUSD" / "odd.bi5").write_bytes(whole)
    got = bi5.read_checked(spark, str(tmp_path)).collect()
    faults = {r.file.rsplit("/", 1)[1]: r.fault.split(":")[0] for r in got if r.fault}
    assert faults == {"11h_ticks.bi5": "unreadable", "12h_ticks.bi5": "cut", "odd.bi5": "misnamed"}
    assert bi5.read(spark, str(tmp_path)).count() == sum(r.timestamp_utc is not None for r in got) == 5
    assert bi5.decode(whole, hour, "XAUUSD", fixed=True)["bid"].tolist() == pytest.approx([20.0025] * 3)


def test_blocks_that_are_passed_over_change_nothing(spark):
    from quotemill.operators.strategy import decide, folded, prepared
    from quotemill.plans import queries

    rare = queries.staged(spark, "/root/testdata/sf0.01")
    # Signals as rare as on real ticks: one in 150 can have a break, the others nothing to act on.
    keep = "seq % 150 = 0"
    for c in ("bos_up_15m", "bos_down_15m", "choch_up_15m", "choch_down_15m", "bos_detected_15m", "choch_detected_15m"):
        rare = rare.withColumn(c, F.expr(f"{keep} AND {c}"))
    rare = rare.withColumn("ask", F.expr("bid + 0.1"))
    for p in (P.BacktestParams(), P.BacktestParams(relay="full", align_bias=True)):
        t = prepared(rare, p.align_bias).toPandas().sort_values(["symbol", "source", "timestamp_utc", "seq"], kind="stable")
        t = pa.Table.from_pandas(t, preserve_index=False)
        books = []

        def new():
            books.append(backtest.Book(p, decide))  # noqa: B023
            return books[-1]

        runs = [[x for out in folded(iter(t.to_batches(1000)), p.keys, new, watch) for x in out] for watch in (None, backtest.blocks(p))]
        assert runs[0] == runs[1] and sum(x["kind"] == "trade" for x in runs[0]) > 5
        assert sum(b.seen for b in books) == t.num_rows and sum(b.opened for b in books) < t.num_rows
