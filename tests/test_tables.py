"""Catalog tables, a database behind JDBC (Derby, which comes with Spark), and downloads from a server that fails."""

from __future__ import annotations

import datetime as dt
import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import indicators
from quotemill.plans.catalog import COLUMNS, Catalog, schema
from quotemill.plans.landing import TABLES, Database, clean, land
from quotemill.plans.store import TickStore
from quotemill.sources import bi5, download

T0 = dt.datetime(2024, 1, 5, 10)


def ticks(spark, n=6, start=0):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=k), "XAU" if k % 2 else "EUR", "mt5", float(k), k + 0.5) for k in range(start, start + n)], "timestamp_utc timestamp, symbol string, source string, bid double, ask double")


def test_tables_are_created_twice_and_widened(spark, tmp_path):
    db = Catalog(spark, f"t{uuid.uuid4().hex[:8]}", f"file://{tmp_path}/db")
    spark.sql(f"CREATE DATABASE {db.database}")
    # An older candle table with rows, from before the structure's columns.
    spark.sql(f"CREATE TABLE {db.name('candles_15m')} (bar_time TIMESTAMP, source STRING, bar_open DOUBLE, bar_high DOUBLE, bar_low DOUBLE, bar_close DOUBLE, symbol STRING) USING parquet PARTITIONED BY (symbol) LOCATION '{db.path}/candles_15m'")
    spark.sql(f"INSERT INTO {db.name('candles_15m')} VALUES (TIMESTAMP '2024-01-05 10:00:00', 'mt5', 1, 2, 0.5, 1.5, 'XAU')")
    added = db.create()
    assert "candles_15m.atr_15_15m" in added and "candles_15m.is_swing_low_15m" in added and all(a.startswith("candles_15m.") for a in added)
    assert db.create() == [] and db.tables() == sorted(COLUMNS)
    old = db.read("candles_15m").first()
    assert (old.bar_close, old.symbol, old.hh_15m) == (1.5, "XAU", None)
    for table in COLUMNS:
        have = {f.name: f.dataType for f in db.read(table).schema}
        assert have == {f.name: f.dataType for f in schema(table)}
    assert {r.col_name for r in db.describe("unified_ticks").collect()} >= {"timestamp_utc", "bid", "symbol"}
    spark.sql(f"DROP TABLE {db.name('candles_4h')}")
    spark.sql(f"CREATE TABLE {db.name('candles_4h')} (bar_time STRING, symbol STRING) USING parquet PARTITIONED BY (symbol)")
    with pytest.raises(ValueError, match="another type"):
        db.create()


def test_rows_are_conformed_and_required_values_checked(spark, tmp_path):
    db = Catalog(spark, f"t{uuid.uuid4().hex[:8]}", f"file://{tmp_path}/db")
    db.create()
    db.append("unified_ticks", ticks(spark).withColumn("another", F.lit(1)).withColumn("bid", F.col("bid").cast("float")))
    got = db.read("unified_ticks")
    assert got.count() == 6 and got.filter("symbol = 'XAU'").count() == 3 and got.filter("volume IS NULL").count() == 6
    with pytest.raises(Exception, match="unified_ticks.ask is null"):
        db.append("unified_ticks", ticks(spark, 3, 10).withColumn("ask", F.when(F.col("bid") < 11, F.col("ask"))))
    assert db.read("unified_ticks").count() == 6
    # The store writes the same folders.
    assert TickStore(spark, db.path).insert("unified_ticks", ticks(spark, 8).withColumns({"volume": F.lit(1.0), "volume_usd": F.lit(1.0)})) == 2
    db.refresh()
    assert db.read("unified_ticks").count() == 8
    plan = db.read("unified_ticks").filter("symbol = 'XAU' AND bid > 2").select("ask")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(bid), GreaterThan(bid,2.0)]" in plan
    with pytest.raises(ValueError):
        db.name("other")


@pytest.fixture
def database(spark, tmp_path):
    db = Database(spark, f"jdbc:derby:{tmp_path}/landing;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, partitions=3)
    assert db.create() == list(TABLES) and db.create() == []
    return db


def quotes(spark, start, n):
    return spark.createDataFrame([("XAU", 100 + (k * 7 % 11) / 4, 100.5 + (k * 7 % 11) / 4, 100.0, 1.0, 1_704_448_800_000 + k * 1000) for k in range(start, start + n)], "symbol string, bid double, ask double, last double, volume double, time_msc bigint")


def test_landing_rows_are_cleaned_once(spark, database):
    database.append(quotes(spark, 0, 60), "landing_ticks")
    rows = database.unprocessed(limit=None)
    assert rows.count() == 60 and rows.rdd.getNumPartitions() >= 1 and [r.time_msc for r in rows.select("time_msc").limit(3).collect()] == [1_704_448_800_000 + k * 1000 for k in range(3)]
    assert database.read("landing_ticks", by="time_msc").rdd.getNumPartitions() == 3
    assert clean(database, 40) == 40 and clean(database, 40) == 20 and clean(database, 40) == 0
    got = database.read("cleaned_ticks").toPandas().rename(columns=str.lower).sort_values("time_msc")
    assert len(got) == 60 and (got["spread"].round(9) == 0.5).all() and got["tick_time"].iloc[0] == pd.Timestamp("2024-01-05 10:00:00")
    # Each round averages over the rows it fetched, as given by a run over them.
    first = got["bid"].iloc[:40].reset_index(drop=True)
    ema = first.ewm(span=20, adjust=False, min_periods=20).mean()
    pd.testing.assert_series_equal(got["ema_20"].iloc[:40].reset_index(drop=True), ema, check_names=False)
    d = first.diff()
    up, down = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (d.where(d > 0, 0.0), -d.where(d < 0, 0.0)))
    pd.testing.assert_series_equal(got["rsi"].iloc[:40].reset_index(drop=True), 100 - 100 / (1 + up / down), check_names=False)
    # Rows given again add nothing; of equal keys one is added.
    again = database.read("cleaned_ticks").toDF(*[c.lower() for c in database.read("cleaned_ticks").columns]).drop("id", "cleaned_at")
    assert database.insert(again, "cleaned_ticks") == 0
    assert database.insert(again.withColumn("time_msc", F.lit(5).cast("long")), "cleaned_ticks") == 1
    assert database.insert(again.limit(0), "cleaned_ticks") == 0
    assert indicators.ema is not None


def test_decisions_are_added_once_by_their_time(spark, database):
    rows = spark.createDataFrame([("XAU", "HOLD", "NONE", 0, T0 + dt.timedelta(milliseconds=k // 2 * 5)) for k in range(8)], "symbol string, decision string, reason string, score int, tick_time timestamp")
    assert database.insert(rows, "trade_decisions") == 4 and database.insert(rows, "trade_decisions") == 0


def test_a_stream_of_quotes_lands_once_though_batches_repeat(spark, database, tmp_path):
    for k in range(3):
        quotes(spark, 10 * k, 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for ck in ("a", "b"):  # a new checkpoint gives every batch again
        stream = spark.readStream.schema(quotes(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = land(stream, database, str(tmp_path / ck)).start()
        q.processAllAvailable()
        q.stop()
    assert database.read("landing_ticks").count() == 30


def hour_of(root: Path, hour: dt.datetime, n: int, script: str = "", raw: bytes | None = None):
    file = root / download.file_of("XAUUSD", hour)
    file.parent.mkdir(parents=True, exist_ok=True)
    frame = pd.DataFrame({"timestamp_utc": [pd.Timestamp(hour) + pd.Timedelta(seconds=k) for k in range(n)], "ask": 2000.5, "bid": 2000.25, "ask_volume": 1e6, "bid_volume": 2e6})
    file.write_bytes(bi5.encode(frame, hour, "XAUUSD") if raw is None else raw)
    if script:
        Path(f"{file}.script").write_text(script)
    return file


def test_hours_are_fetched_with_retries_and_resumed(spark, tmp_path):
    root, out = tmp_path / "vendor", f"file://{tmp_path}/bronze"
    day = dt.datetime(2024, 1, 31)  # a Wednesday; the next day is another month
    hour_of(root, day, 5)
    hour_of(root, day.replace(hour=1), 7, "503 down 429")
    hour_of(root, day.replace(hour=2), 3, "503 " * 9)  # given up
    hour_of(root, day.replace(hour=3), 0, raw=b"no archive")
    hour_of(root, day.replace(hour=4), 0, raw=b"")
    hour_of(root, day + dt.timedelta(days=1), 4, "500")
    ask = {"transport": "tests.flaky_transport:get", "sleep": "tests.flaky_transport:sleep", "slots": 3, "retries": 4}
    told = download.download(spark, f"file://{root}", "XAUUSD", "2024-01-31", "2024-02-01", out, **ask)
    assert told == {"ticks_saved": 16, "files_written": 3, "hours_skipped": 45, "hours_resumed": 0}
    hours = {(r.hour.day, r.hour.hour): (r.status, r.attempts) for r in spark.read.parquet(f"{out}/hours").collect()}
    assert len(hours) == 47 and (31, 2) not in hours
    assert hours[31, 1] == ("landed", 4) and hours[31, 3][0] == "unreadable" and hours[31, 4][0] == "empty" and hours[31, 5] == ("missing", 1) and hours[1, 0] == ("landed", 2)
    # Only the hour that was given up is asked for again; after eight more failures it comes.
    told = download.download(spark, f"file://{root}", "XAUUSD", "2024-01-31", "2024-02-01", out, **ask | {"retries": 8})
    assert told == {"ticks_saved": 3, "files_written": 1, "hours_skipped": 0, "hours_resumed": 47}
    assert (root / download.file_of("XAUUSD", day)).with_name("00h_ticks.bi5.tries").stat().st_size == 1
    got = spark.read.parquet(f"{out}/ticks")
    assert got.count() == 19 and {(r.year, r.month) for r in got.select("year", "month").distinct().collect()} == {(2024, 1), (2024, 2)}


def test_hours_skip_weekends_and_wait_longer_each_time():
    reader = download._Hours({"symbol": "XAUUSD", "start": "2024-01-05T22:00:00", "end": "2024-01-08T02:00:00", "slots": "2", "skip": download.file_of("XAUUSD", dt.datetime(2024, 1, 8))})
    parts = [p.hours for p in reader.partitions()]
    assert sorted(h for p in parts for h in p) == [dt.datetime(2024, 1, 5, 22), dt.datetime(2024, 1, 5, 23), dt.datetime(2024, 1, 8, 1)] and len(parts) == 2
    waits, answers = [], iter([503, 502, 429, 0, 500, 200])

    def transport(url):
        code = next(answers)
        if not code:
            raise OSError
        return code, b"x"

    assert download.fetch("u", transport, waits.append, 8, 1.5) == ("fetched", 6, b"x")
    backoff = [w for w in waits if w != 1.5]
    limits = [(5, 10), (10, 20), (20, 40), (17, 21), (21, 25)]
    assert waits.count(1.5) == 6 and all(a <= w <= b for w, (a, b) in zip(backoff, limits)) and len(backoff) == 5
    assert download.fetch("u", lambda u: (404, b""), waits.append, 8, 0) == ("missing", 1, None)
