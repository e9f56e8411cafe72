"""Streams: the polled source across a restart, watermarked candles, late rows, decisions and idempotent landing."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quotemill import params as P
from quotemill.operators import candles as batch_candles
from quotemill.operators import online
from quotemill.plans import features
from quotemill.sources.live import QuoteSource
from quotemill.streaming import features as live_features
from quotemill.streaming import live

TICK = "timestamp_utc timestamp, symbol string, source string, mid double, seq bigint"


def polled(spark, limit):
    spark.dataSource.register(QuoteSource)
    return spark.readStream.format("quotes").option("rate", 20).option("limit", limit).load()


def test_polled_quotes_go_on_after_a_restart(spark, tmp_path):
    seen = []

    def keep(df, _):
        seen.extend(r.time_msc for r in df.select("time_msc").collect())

    for limit in (60, 140):  # the second run is a fresh reader on the same checkpoint
        q = polled(spark, limit).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        assert seen == [n * 1000 for n in range(limit)]


def rows(minutes):
    return [(dt.datetime(2024, 1, 5, 10, m, s), "X", "mt5", float(100 + (m * 7 + s) % 11), m * 60 + s) for m, s in minutes]


def stream_of(spark, path):
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(path))


def put(spark, path, data):
    spark.createDataFrame(data, TICK).coalesce(1).write.mode("append").parquet(str(path))


def test_candles_close_by_watermark_and_late_rows_are_left_out(spark, tmp_path):
    src, ck, out = tmp_path / "in", str(tmp_path / "ck"), str(tmp_path / "out")
    first, second, late, last = [(m, s) for m in range(4) for s in (1, 20, 50)], [(8, 5), (8, 30)], [(0, 40)], [(15, 0)]

    def run():
        q = live.candles(stream_of(spark, src), "1 minute").writeStream.format("parquet").option("checkpointLocation", ck).start(out)
        q.processAllAvailable()
        q.stop()

    put(spark, src, rows(first))
    put(spark, src, rows(second))
    run()
    put(spark, src, rows(late))  # ten minutes behind the watermark
    put(spark, src, rows(last))
    run()  # from the checkpoint: nothing twice
    got = sorted(tuple(r) for r in spark.read.parquet(out).withColumn("bar_time", F.col("bar_time").cast("string")).collect())
    t = spark.createDataFrame(rows(first + second), TICK)
    want = sorted(tuple(r) for r in batch_candles.ohlc(t, "1 minute").select("symbol", "source", F.col("bar_time").cast("string"), "bar_open", "bar_high", "bar_low", "bar_close").collect())
    assert got == want


def test_landing_adds_a_replayed_batch_once(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    put(spark, src, rows([(m, 1) for m in range(5)]))
    for ck in ("a", "b"):  # another checkpoint: every batch is replayed
        q = live.land(stream_of(spark, src).withColumn("bid", F.col("mid")).withColumn("ask", F.col("mid")), store, str(tmp_path / ck)).start()
        q.processAllAvailable()
        q.stop()
    assert live.TickStore(spark, store).read("unified_ticks").count() == 5


def test_decisions_carry_their_state_across_batches(spark, tmp_path):
    from pyspark.sql import Window

    from quotemill.functions.stage import stage
    from quotemill.operators import strategy
    from quotemill.plans import queries

    rows = queries.staged(spark, "/root/testdata/sf0.001").filter("symbol = 'click'")
    rows = stage(rows.withColumn("part", F.ntile(3).over(Window.orderBy("timestamp_utc", "seq"))), "staged")
    src, out = tmp_path / "in", str(tmp_path / "out")
    for k in (1, 2, 3):  # a file a batch, in order
        rows.filter(F.col("part") == k).coalesce(1).write.mode("append").parquet(str(src))
        q = live.decisions(spark.readStream.schema(rows.schema).parquet(str(src))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).start(out)
        q.processAllAvailable()
        q.stop()
    got = {str(r.timestamp_utc): (r.decision, r.reason) for r in spark.read.parquet(out).collect()}
    log = strategy.audit_log(rows).collect()
    assert len(got) == rows.count() and len(log) > 50
    assert all(got[str(r.timestamp_utc)] == (r.decision, r.reason) for r in log)


def walk(n, keys="AB", gap_s=30):
    """Ticks of a random walk with jumps, so that swings, breaks, sweeps and gaps occur."""
    r, out = np.random.default_rng(3), []
    for k, symbol in enumerate(keys):
        at = np.datetime64("2024-01-04T00:00:00") + np.cumsum(1 + r.exponential(gap_s, n)).astype("timedelta64[s]")
        mid = 2000 + np.cumsum(r.normal(0, 1.5, n) + np.where(r.random(n) < 0.01, r.normal(0, 14, n), 0))
        out.append(pd.DataFrame({"timestamp_utc": at.astype("datetime64[us]"), "symbol": symbol, "source": "s", "bid": mid - 0.1, "ask": mid + 0.1, "spread": 0.2, "mid": mid, "seq": np.arange(n) + k * n}))
    return pd.concat(out)


def same(a, b):
    none = pd.isna(a), pd.isna(b)
    return none[0] == none[1] if any(none) else abs(a - b) <= 1e-6 * max(1, abs(a)) if isinstance(a, float) else a == b


def assert_same_features(got, want, names):
    got, want = (f.sort_values("seq").reset_index(drop=True) for f in (got, want))
    assert got["seq"].tolist() == want["seq"].tolist()
    for c in names:
        wrong = [(i, a, b) for i, (a, b) in enumerate(zip(want[c].tolist(), got[c].tolist())) if not same(a, b)]
        assert not wrong, (c, wrong[:3])


def test_live_features_equal_the_causal_batch_across_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_features.PROVIDER)
    ticks = walk(3500)
    src, ck, out = tmp_path / "in", str(tmp_path / "ck"), str(tmp_path / "out")
    end = ticks["timestamp_utc"].max()
    last = ticks.groupby("symbol").head(1).assign(timestamp_utc=end + pd.Timedelta("2 days"), seq=[10**6, 10**6 + 1])
    cuts = [ticks["timestamp_utc"].quantile(q) for q in (0.3, 0.55, 0.8)]
    part = np.searchsorted(cuts, ticks["timestamp_utc"].to_numpy(), "left")
    # Some of the last half minute before a cut come with the next file, and every file is out of order.
    for k, cut in enumerate(cuts):
        late = ((cut - ticks["timestamp_utc"]) < pd.Timedelta("25s")) & (part == k) & (ticks["timestamp_utc"] < cut)
        part[late.to_numpy()] = k + 1
    files = [ticks[part == k].sample(frac=1, random_state=k) for k in range(4)] + [last]
    schema = spark.createDataFrame(ticks.head(1)).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = live_features.live_features(stream).writeStream.format("parquet").option("checkpointLocation", ck).start(out)
        q.processAllAvailable()
        rows = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
        q.stop()
        return rows

    held = []
    for some in (files[:2], files[2:]):
        for f in some:
            spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(src))
        held += run()
    got = spark.read.parquet(out).filter(f"seq < {10**6}").toPandas()
    batch = features.build_features(spark.createDataFrame(ticks), causal=True).ticks.toPandas()
    assert {"fvg_high", "hh_15m"} <= set(batch.columns) and batch["fvg_high"].notna().sum() > 50 and batch["liq_swept"].sum() > 100
    assert_same_features(got, batch, [*online.NAMES, "session"])
    assert held


def test_the_live_state_stays_bounded():
    sizes, rules = [], online.Online()
    ticks = walk(24_000, "A", 60)
    minute = ticks["timestamp_utc"].to_numpy().astype("datetime64[us]").astype(np.int64) // online.MINUTE
    for k, (m, mid) in enumerate(zip(minute.tolist(), ticks["mid"].tolist())):
        rules.tick_minute(m * online.MINUTE, mid, mid, mid, mid)
        if k in (12_000, 23_999):
            sizes.append({n: len(rows) for n, rows in rules.parts().items()})
    limits = {"open_bars": 3, "closed_bars": 7 + 11 + 11, "averages": 2, "atrs": P.MEDIAN_BARS, "sides": 2, "bias": 1, "gaps": P.GAP_AGE + 1, "ranges": 6, "levels": 6 * P.LEVEL_SNAPSHOTS + 2 * P.EQUAL_LOOKBACK}
    assert all(s[n] <= m for s in sizes for n, m in limits.items()) and sizes[0]["atrs"] == sizes[1]["atrs"] == P.MEDIAN_BARS
    again = online.Online.restore(rules.parts(), dict(rules.now))
    assert again.parts() == rules.parts() and again.now == rules.now


def test_the_live_loop_stores_ticks_features_and_decisions(spark, tmp_path):
    from quotemill.operators import strategy

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_features.PROVIDER)
    ticks = walk(1200, "A", 45)
    ms = ticks["timestamp_utc"].to_numpy().astype("datetime64[ms]").astype(np.int64)
    quotes = pd.DataFrame({"symbol": "a", "bid": ticks["bid"], "ask": ticks["ask"], "last": ticks["bid"], "volume": 1.0, "time_msc": ms})
    last = quotes.tail(1).assign(time_msc=quotes["time_msc"].max() + 86_400_000)
    src = tmp_path / "in"
    schema = spark.createDataFrame(quotes.head(1)).schema
    for f in (quotes.head(700), quotes.tail(500)), (last,):
        for part in f:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        queries = live.start(stream, str(tmp_path / "store"), str(tmp_path / "ck"))
        for q in queries:  # each hands over to the next
            q.processAllAvailable()
        for q in queries:
            q.stop()
    store = live.TickStore(spark, str(tmp_path / "store"))
    assert store.read("unified_ticks").count() == 1201
    got = store.read("tick_features").toPandas()
    unified = store.read("unified_ticks").withColumn("seq", F.unix_millis("timestamp_utc")).orderBy("timestamp_utc").limit(1200)
    batch = features.build_features(unified, causal=True).ticks
    assert_same_features(got, batch.toPandas(), online.NAMES)
    decided = {str(r.timestamp_utc): (r.decision, r.reason) for r in store.read("trade_decisions").collect()}
    log = strategy.audit_log(batch).collect()
    assert len(decided) == 1200 and log and all(decided[str(r.timestamp_utc)] == (r.decision, r.reason) for r in log)
