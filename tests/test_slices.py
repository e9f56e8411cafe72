"""Busy keys: what one key's ticks are cut into, and that the cuts change nothing."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotemill import params as P
from quotemill.functions import core
from quotemill.operators import asof, backtest, strategy
from quotemill.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tasks_of(df) -> int:
    return len({r.p for r in df.withColumn("p", F.spark_partition_id()).collect()})


def test_a_busy_day_of_a_key_is_many_tasks_of_the_asof_join(uncoalesced):
    t = uncoalesced.range(2000).selectExpr("'X' AS symbol", "'a' AS source", "id AS seq", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id * 43) AS timestamp_utc")
    facts = t.filter("seq % 50 = 7").select("symbol", "source", F.col("timestamp_utc").alias("at"), F.col("seq").alias("fact"))
    out = asof.asof_many(t, "timestamp_utc", [asof.Fact(facts, "at", ["fact"])])
    assert tasks_of(out) > 1
    assert all(r.fact == (None if r.seq < 7 else (r.seq - 7) // 50 * 50 + 7) for r in out.collect())


def test_the_dense_path_of_a_key_is_many_tasks_and_its_running_sum(uncoalesced):
    d = queries.dense_ticks(uncoalesced, SF)
    assert tasks_of(d.filter("symbol = 'view'")) > 1
    start = dt.datetime(2024, 1, 1)
    raw = [r for r in queries.ticks(uncoalesced, SF).filter("symbol = 'view'").collect()]
    mean, total, want = sum(r.bid for r in raw) / len(raw), 0.0, {}
    for r in sorted(raw, key=lambda r: (start + (r.timestamp_utc - start) / 30, r.seq)):
        total += r.bid - mean
        want[r.seq] = 2000 + total / 35
    got = {r.seq: r.bid for r in d.filter("symbol = 'view'").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.00501 for k in want)


def test_packed_chunks_keep_rows_order_keys_and_slices(spark):
    p = strategy.prepared(queries.staged(spark, SF))
    t = core.slice_of(p, "timestamp_utc", strategy.SLICE, "_slice").orderBy("symbol", "source", "timestamp_utc", "seq").toArrow()
    chunks = list(strategy.packed(iter(t.to_batches(300)), P.KEY))
    parts = list(strategy.unpacked(iter(chunks)))
    assert pa.Table.from_batches(parts).to_pylist() == t.drop_columns(["_slice"]).to_pylist()
    assert sum(c.num_rows for c in chunks) == len(parts) < t.num_rows
    for part in parts:
        assert part.num_rows <= strategy.CHUNK
        assert len({(r["symbol"], r["source"], (r["timestamp_utc"] - dt.datetime(2024, 1, 1)) // dt.timedelta(minutes=15)) for r in part.to_pylist()}) == 1


def test_the_fold_by_chunks_and_lazy_rows_is_the_fold_over_all_rows(spark):
    p = P.BacktestParams()
    f = queries.staged(spark, SF)
    t = strategy.prepared(f).orderBy("symbol", "source", "timestamp_utc", "seq").toArrow().combine_chunks()
    runs = [[x for out in strategy.folded(iter(t.to_batches(100)), p.keys, lambda: backtest.Book(p), None, whole) for x in out] for whole in (True, False)]
    assert runs[0] == runs[1] and len(runs[0]) > 100
    got = backtest.backtest(f, p).orderBy("symbol", "n").collect()
    assert [tuple(r) for r in got] == [tuple(x.get(c) for c, _ in backtest.COLUMNS) for x in runs[0]]


def test_a_custom_strategy_gets_whole_rows(spark):
    seen = lambda row, now, relay, t1, t2: ("HOLD", str(row.get("bid") is not None and "ask" in row and len(row) == len(strategy.NEEDED)), 0)
    assert {r.reason for r in strategy.audit_log(queries.staged(spark, SF), strategy=seen).collect()} == {"True"}


def test_columns_as_lists(spark):
    for a in (pa.array([1.5, None, float("inf")]), pa.array([True, None, False]), pa.array([1, None, 2], pa.int32()), pa.array(["x", None, "x"]), pa.array(["x", "y"]), pa.array([], pa.string()), pa.array([None, None], pa.string()), pa.array([dt.datetime(2024, 1, 1), None])):
        assert strategy._listed(a) == a.to_pylist()


def test_typed_columns_of_a_decision_are_read_as_their_texts(spark):
    df = spark.sql("SELECT * FROM VALUES (1, double('NaN'), 2.5f, true, 1, 'yes', 'x'), (2, 3.0D, null, false, 0, 'no', '4.5'), (3, null, float('nan'), null, null, null, null) AS t(seq, bid, ask, bos_up_15m, fvg_filled, liq_swept, bar_high)")
    got = strategy.context(df).orderBy("seq").select("bid", "ask", "bos_up_15m", "fvg_filled", "liq_swept", "bar_high").collect()
    assert [tuple(r) for r in got] == [(None, 2.5, True, True, True, None), (3.0, None, False, False, False, 4.5), (None, None, False, False, False, None)]
