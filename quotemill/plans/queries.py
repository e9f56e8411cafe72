"""The registered queries of the tick operators over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import core
from ..functions.stage import place, stage
from ..operators import asof, backtest, candles, gaps, indicators, liquidity, metrics, sessions, silver, strategy, structure, swings
from ..sources import bi5, events, lake
from . import catalog, features, oracles, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RAW = """raw AS (
  SELECT ts AS timestamp_utc, event_type AS symbol, 'dukascopy' AS source, value AS bid,
         value + CASE WHEN event_id % 97 = 0 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) * (event_id % 4) END AS ask,
         CAST(1 + user_id % 50 AS DOUBLE) AS volume, event_id AS seq FROM events)"""
TICKS = RAW + """,
ticks AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM raw WHERE bid > 0 AND ask > 0 AND ask >= bid)"""


def bars_sql(name: str, width: str, volume: bool = False) -> str:
    more = ", sum(volume) AS bar_volume" if volume else ""
    return f"""{name} AS (
  SELECT symbol, source, time_bucket(INTERVAL '{width}', timestamp_utc) AS bar_time, arg_min(mid, (timestamp_utc, seq)) AS bar_open,
         max(mid) AS bar_high, min(mid) AS bar_low, arg_max(mid, (timestamp_utc, seq)) AS bar_close{more} FROM ticks GROUP BY 1, 2, 3)"""


KW = "PARTITION BY symbol, source ORDER BY bar_time"


def wilder_sql(source: str, n: int, name: str) -> str:
    """ATR in closed form: powers of (1 - 1/n) weigh the true ranges since the seed."""
    return f"""{name} AS (
  WITH t AS (SELECT *, row_number() OVER ({KW}) - 1 AS i, count(*) OVER (PARTITION BY symbol, source) AS cnt,
                    lag(bar_close) OVER ({KW}) AS pc FROM {source}),
  r AS (SELECT *, greatest(bar_high - bar_low, coalesce(abs(bar_high - pc), 0), coalesce(abs(bar_low - pc), 0)) AS tr FROM t),
  s AS (SELECT *, avg(CASE WHEN i < {n} THEN tr END) OVER (PARTITION BY symbol, source) AS seed FROM r),
  x AS (SELECT *, sum(CASE WHEN i >= {n} THEN tr / {n} * pow(1 - 1.0::DOUBLE / {n}, -(i - {n} + 1)) ELSE 0 END) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS acc FROM s)
  SELECT symbol, source, bar_time, bar_open, bar_high, bar_low, bar_close, i,
         CASE WHEN cnt < {n} THEN NULL WHEN i < {n} - 1 THEN 0.0 ELSE pow(1 - 1.0::DOUBLE / {n}, i - {n} + 1) * (seed + acc) END AS atr FROM x)"""


def fractal_sql(name: str, source: str, left: int, right: int) -> str:
    before, after = f"({KW} ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING)", f"({KW} ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING)"
    return f"""{name} AS (
  SELECT *, coalesce(bar_high > max(bar_high) OVER {before} AND bar_high > max(bar_high) OVER {after}
              AND lag(bar_high, {left}) OVER ({KW}) IS NOT NULL AND lead(bar_high, {right}) OVER ({KW}) IS NOT NULL, false) AS is_swing_high,
            coalesce(bar_low < min(bar_low) OVER {before} AND bar_low < min(bar_low) OVER {after}
              AND lag(bar_low, {left}) OVER ({KW}) IS NOT NULL AND lead(bar_low, {right}) OVER ({KW}) IS NOT NULL, false) AS is_swing_low
  FROM {source})"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


ticks, raw = events.ticks, events.raw_ticks
B15 = f"WITH {TICKS}, {bars_sql('b', '15 minutes')}"
B1 = f"WITH {TICKS}, {bars_sql('b', '1 minute')}"
B4 = f"WITH {TICKS}, {bars_sql('b', '4 hours')}"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- bars

for _name, _width, _volume in (("ohlc_1m", "1 minute", False), ("ohlc_15m", "15 minutes", False), ("ohlc_4h", "4 hours", False), ("ohlcv_5m", "5 minutes", True), ("ohlcv_1h", "1 hour", True), ("ohlcv_1d", "1 day", True)):
    query(_name, f"WITH {TICKS}, {bars_sql('b', _width, _volume)} SELECT * FROM b")(lambda s, d, w=_width, v=_volume: candles.ohlc(ticks(s, d), w, v))


@query("minute_ranges", f"WITH {TICKS} SELECT symbol, source, time_bucket(INTERVAL '1 minute', timestamp_utc) AS minute, max(mid) AS high, min(mid) AS low FROM ticks GROUP BY 1, 2, 3")
def _(s, d):
    return candles.minute_ranges(ticks(s, d))


@query("daily_ranges", f"{B4} SELECT symbol, source, CAST(CAST(bar_time AS DATE) AS TIMESTAMP) AS day, max(bar_high) AS day_high, min(bar_low) AS day_low FROM b GROUP BY 1, 2, 3")
def _(s, d):
    return candles.daily_ranges(candles.ohlc(ticks(s, d), "4 hours")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("bar_volume_join", f"WITH {TICKS}, {bars_sql('b', '1 hour')}, v AS (SELECT symbol, source, time_bucket(INTERVAL '1 hour', timestamp_utc) AS bar_time, sum(volume) AS bar_volume FROM ticks GROUP BY 1, 2, 3) SELECT b.*, bar_volume FROM b LEFT JOIN v USING (symbol, source, bar_time)")
def _(s, d):
    t = ticks(s, d)
    return candles.ohlc(t, "1 hour").join(candles.volume_of(t, "1 hour"), [*P.KEY, "bar_time"], "left")


# ---------------------------------------------------------------- silver

MT5 = "m AS (SELECT ' ' || lower(symbol) || ' ' AS symbol, bid, ask, bid AS last, volume, seq * 1000 AS time_msc FROM raw)"
DUKA = "k AS (SELECT timestamp_utc, symbol, bid, ask, CASE WHEN seq % 53 = 0 THEN NULL ELSE volume END AS ask_volume, volume / 2 AS bid_volume FROM raw)"


def mt5(s, d):
    return raw(s, d).select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol"), "bid", "ask", F.col("bid").alias("last"), "volume", (F.col("seq") * 1000).alias("time_msc"))


def dukascopy(s, d):
    return raw(s, d).select("timestamp_utc", "symbol", "bid", "ask", F.when(F.col("seq") % 53 != 0, F.col("volume")).alias("ask_volume"), (F.col("volume") / 2).alias("bid_volume"))


@query("valid_mt5", f"WITH {RAW}, {MT5} SELECT upper(trim(symbol)) AS symbol, bid, ask, last, volume, time_msc FROM m WHERE bid > 0 AND ask > 0 AND ask > bid AND time_msc > 0 AND length(trim(symbol)) > 0")
def _(s, d):
    return silver.valid_mt5(mt5(s, d))


@query("valid_dukascopy", f"WITH {RAW}, {DUKA} SELECT timestamp_utc, symbol, round(bid, 5) AS bid, round(ask, 5) AS ask, ask_volume, bid_volume FROM k WHERE bid > 0 AND ask > 0 AND ask >= bid AND ask_volume >= 0 AND bid_volume >= 0")
def _(s, d):
    return silver.valid_dukascopy(dukascopy(s, d))


@query("valid_unified", f"WITH {RAW} SELECT timestamp_utc, symbol, source, bid, ask, volume, seq, round((bid + ask) / 2, 5) AS mid, round(ask - bid, 5) AS spread FROM (SELECT * REPLACE (round(bid, 5) AS bid, round(ask, 5) AS ask) FROM raw WHERE bid > 0 AND ask > 0 AND ask >= bid)")
def _(s, d):
    return silver.with_mid_spread(silver.valid_unified(raw(s, d)))


@query("unify_mt5", f"WITH {RAW}, {MT5} SELECT epoch_ms(time_msc) AS timestamp_utc, upper(trim(symbol)) AS symbol, bid, ask, volume, volume * 100000 AS volume_usd, 'mt5' AS source, round((bid + ask) / 2, 5) AS mid, round(ask - bid, 5) AS spread FROM m WHERE bid > 0 AND ask > bid AND time_msc > 0 AND volume * 100000 >= 1000")
def _(s, d):
    return silver.unify_mt5(mt5(s, d)).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp_ntz"))


JUDGED = """j AS (SELECT *, (ask_volume + bid_volume) / 2 AS volume, (ask_volume + bid_volume) / 2 * (bid + ask) / 2 AS volume_usd,
  CASE WHEN bid IS NULL OR ask IS NULL OR ask_volume IS NULL OR bid_volume IS NULL THEN 'invalid' WHEN bid <= 0 OR ask <= 0 THEN 'invalid'
       WHEN ask < bid THEN 'inverted' WHEN (ask_volume + bid_volume) / 2 * (bid + ask) / 2 < 1000 THEN 'below_notional' ELSE 'ok' END AS rule FROM k)"""


@query("unify_dukascopy", f"WITH {RAW}, {DUKA}, {JUDGED}, g AS (SELECT timestamp_utc, upper(symbol) AS symbol, round(bid, 5) AS bid, round(ask, 5) AS ask, volume, volume_usd, 'dukascopy' AS source FROM j WHERE rule = 'ok') SELECT *, round((bid + ask) / 2, 5) AS mid, round(ask - bid, 5) AS spread FROM g")
def _(s, d):
    return silver.unify_dukascopy(dukascopy(s, d))


@query("quality_counters", f"WITH {RAW}, {DUKA}, {JUDGED} SELECT count(*) AS raw, count(*) FILTER (rule = 'invalid') AS invalid, count(*) FILTER (rule = 'inverted') AS inverted, count(*) FILTER (rule = 'below_notional') AS below_notional, count(*) FILTER (rule = 'ok') AS ok, count(*) FILTER (ask = bid AND rule = 'ok') AS zero_spread FROM j")
def _(s, d):
    return silver.quality_counters(dukascopy(s, d))


@query("dedup_first", f"WITH {RAW} SELECT time_bucket(INTERVAL '1 minute', timestamp_utc) AS minute, symbol, arg_min(bid, seq) AS bid, min(seq) AS seq FROM raw GROUP BY 1, 2")
def _(s, d):
    t = core.floor_to(raw(s, d), "timestamp_utc", "1 minute", "minute").select("minute", "symbol", "bid", "seq")
    return silver.dedup_first(t, ["minute", "symbol"], ["seq"])


@query("insert_or_ignore", f"WITH {RAW}, m AS (SELECT time_bucket(INTERVAL '1 hour', timestamp_utc) AS hour, symbol, bid, seq FROM raw), a AS (SELECT DISTINCT hour, symbol FROM m WHERE seq % 7 = 0) SELECT hour, symbol, arg_min(bid, seq) AS bid, min(seq) AS seq FROM m ANTI JOIN a USING (hour, symbol) WHERE seq % 7 <> 0 GROUP BY 1, 2")
def _(s, d):
    t = core.floor_to(raw(s, d), "timestamp_utc", "1 hour", "hour").select("hour", "symbol", "bid", "seq")
    return silver.insert_or_ignore(t.filter("seq % 7 = 0"), t.filter("seq % 7 <> 0"), ["hour", "symbol"], ["seq"])


@query("concat_ticks", f"WITH {RAW} SELECT symbol, count(*) AS n FROM (SELECT symbol FROM raw WHERE seq % 2 = 0 UNION ALL SELECT symbol FROM raw WHERE seq % 2 = 1 UNION ALL SELECT symbol FROM raw WHERE seq % 3 = 0) GROUP BY 1")
def _(s, d):
    t = raw(s, d)
    return t.filter("seq % 2 = 0").unionByName(t.filter("seq % 2 = 1")).unionByName(t.filter("seq % 3 = 0")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("days_range", f"WITH {RAW} SELECT * FROM raw WHERE timestamp_utc >= TIMESTAMP '2024-01-05' AND timestamp_utc < TIMESTAMP '2024-01-08'")
def _(s, d):
    import datetime as dt

    return silver.in_days(raw(s, d), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 7))


@query("safe_casts", """SELECT event_id, TRY_CAST(x AS DOUBLE) AS as_float, CAST(trunc(TRY_CAST(x AS DOUBLE)) AS BIGINT) AS as_int,
  coalesce(CASE WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL THEN TRY_CAST(x AS DOUBLE) <> 0 ELSE lower(trim(x)) IN ('true', 'yes') END, false) AS as_bool
  FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN 'yes' WHEN 2 THEN 'True' WHEN 3 THEN '0' WHEN 4 THEN CAST(value AS VARCHAR) ELSE NULL END AS x FROM events)""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 6
    e = e.withColumn("x", F.when(k == 0, "1").when(k == 1, "yes").when(k == 2, "True").when(k == 3, "0").when(k == 4, F.col("value").cast("string")))
    return e.select("event_id", core.as_float("x").alias("as_float"), core.as_int("x").alias("as_int"), core.as_bool("x").alias("as_bool"))


HOURS = "SELECT h AS hour FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT date_trunc('day', max(ts)) + INTERVAL 23 HOUR FROM events), INTERVAL 1 HOUR)) AS h) WHERE isodow(h) < 6"


def event_hours(s, d):
    """The trading hours of the days that the events cover."""
    ends = raw(s, d).agg(F.to_date(F.min("timestamp_utc")).cast("string"), F.date_add(F.to_date(F.max("timestamp_utc")), 1).cast("string")).first()
    return bi5.trading_hours(s, *ends)


@query("trading_hours", HOURS)
def _(s, d):
    return event_hours(s, d)


@query("hour_files", f"SELECT hour, printf('XAUUSD/%04d/%02d/%02d/%02dh_ticks.bi5', year(hour), month(hour) - 1, day(hour), hour(hour)) AS file FROM ({HOURS})")
def _(s, d):
    return event_hours(s, d).withColumn("file", bi5.hour_name(F.lit("XAUUSD"), F.col("hour")))


# ---------------------------------------------------------------- store reads

@query("range_query", f"WITH {TICKS} SELECT * FROM ticks WHERE symbol = 'click' AND timestamp_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def _(s, d):
    return ticks(s, d).filter((F.col("symbol") == "click") & F.col("timestamp_utc").between(F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr("TIMESTAMP_NTZ '2024-01-12'"))).orderBy("timestamp_utc", "seq")


@query("symbol_ticks", f"WITH {TICKS} SELECT * FROM ticks WHERE symbol = 'purchase'")
def _(s, d):
    return ticks(s, d).filter("symbol = 'purchase'").orderBy("timestamp_utc", "seq")


@query("chart_candles", f"{B15} SELECT bar_time, bar_open, bar_high, bar_low, bar_close FROM b WHERE symbol = 'view'")
def _(s, d):
    return candles.ohlc(ticks(s, d).filter("symbol = 'view'"), "15 minutes").select("bar_time", "bar_open", "bar_high", "bar_low", "bar_close").orderBy("bar_time")


@query("latest_candle", f"{B4} SELECT symbol, source, max(bar_time) AS bar_time, arg_max(bar_close, bar_time) AS bar_close FROM b WHERE bar_time <= TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def _(s, d):
    b = candles.ohlc(ticks(s, d), "4 hours").filter(F.col("bar_time") <= F.expr("TIMESTAMP_NTZ '2024-01-20'"))
    return b.groupBy(*P.KEY).agg(F.max("bar_time").alias("bar_time"), F.max_by("bar_close", "bar_time").alias("bar_close"))


@query("unprocessed", f"WITH {RAW} SELECT seq, symbol, bid FROM raw a WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.seq = a.seq AND b.seq % 3 = 0) ORDER BY seq LIMIT 500")
def _(s, d):
    t = raw(s, d).select("seq", "symbol", "bid")
    return store.unprocessed(t, t.filter("seq % 3 = 0"), "seq", 500)


@query("resume_anti_join", f"WITH {TICKS}, done AS (SELECT symbol, timestamp_utc FROM ticks WHERE seq % 5 = 0 AND timestamp_utc < TIMESTAMP '2024-01-15'), top AS (SELECT symbol, max(timestamp_utc) AS m FROM done GROUP BY 1) SELECT t.* FROM ticks t LEFT JOIN top USING (symbol) WHERE (m IS NULL OR t.timestamp_utc > m) AND NOT EXISTS (SELECT 1 FROM done x WHERE x.symbol = t.symbol AND x.timestamp_utc = t.timestamp_utc) AND t.spread > 0.1")
def _(s, d):
    t = ticks(s, d)
    done = t.filter((F.col("seq") % 5 == 0) & (F.col("timestamp_utc") < F.expr("TIMESTAMP_NTZ '2024-01-15'")))
    top = done.groupBy("symbol").agg(F.max("timestamp_utc").alias("m"))
    fresh = t.join(top, "symbol", "left").filter(F.col("m").isNull() | (F.col("timestamp_utc") > F.col("m"))).drop("m").filter("spread > 0.1")
    return fresh.join(done.select("symbol", "timestamp_utc").distinct(), ["symbol", "timestamp_utc"], "left_anti").select(*t.columns)


@query("resume_point", f"WITH {RAW} SELECT symbol, max(timestamp_utc) AS resume FROM raw GROUP BY 1")
def _(s, d):
    return raw(s, d).groupBy("symbol").agg(F.max("timestamp_utc").alias("resume"))


@query("row_count", "SELECT count(*) AS n FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").agg(F.count(F.lit(1)).alias("n"))


@query("top_levels", f"WITH {TICKS} SELECT round(mid, 0) AS level, count(*) AS touches FROM ticks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(s, d):
    return ticks(s, d).groupBy(F.round("mid", 0).alias("level")).agg(F.count(F.lit(1)).alias("touches")).orderBy(F.desc("touches"), "level").limit(20)


@query("filtered_counts", f"WITH {TICKS} SELECT count(*) AS n, count(*) FILTER (spread = 0) AS zero_spread, count(*) FILTER (mid > (SELECT avg(mid) FROM ticks)) AS above_mean FROM ticks")
def _(s, d):
    t = ticks(s, d)
    mean = t.agg(F.avg("mid").alias("_mean"))
    return t.crossJoin(F.broadcast(mean)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("spread") == 0).alias("zero_spread"), F.count_if(F.col("mid") > F.col("_mean")).alias("above_mean"))


SESSION = "CASE WHEN hour({0}) >= 13 AND hour({0}) < 22 THEN 'newyork' WHEN hour({0}) >= 8 AND hour({0}) < 17 THEN 'london' ELSE 'asian' END"


@query("session_label", f"WITH {TICKS} SELECT seq, {SESSION.format('timestamp_utc')} AS session FROM ticks")
def _(s, d):
    return ticks(s, d).select("seq", core.session_label("timestamp_utc").alias("session"))


@query("session_counts", f"WITH {TICKS} SELECT {SESSION.format('timestamp_utc')} AS session, count(*) AS n FROM ticks WHERE spread > 0 GROUP BY 1")
def _(s, d):
    return ticks(s, d).filter("spread > 0").groupBy(core.session_label("timestamp_utc").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("value_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("bar_key", f"WITH {TICKS} SELECT seq, time_bucket(INTERVAL '15 minutes', timestamp_utc) AS bar FROM ticks")
def _(s, d):
    return core.floor_to(ticks(s, d), "timestamp_utc", "15 minutes", "bar").select("seq", "bar")


# ---------------------------------------------------------------- indicators

def b15(s, d):
    return candles.ohlc(ticks(s, d), "15 minutes")


def b15_atr(s, d):
    return indicators.atr(b15(s, d), P.ATR_15M, "atr_15_15m")


ATR15 = f"{B15}, {wilder_sql('b', P.ATR_15M, 'a')}"


@query("atr_15m", f"{ATR15} SELECT symbol, source, bar_time, round(atr, 6) AS atr_15_15m FROM a")
def _(s, d):
    return rounded(b15_atr(s, d).select(*P.KEY, "bar_time", "atr_15_15m"), "atr_15_15m")


@query("atr_5m", f"WITH {TICKS}, {bars_sql('b', '5 minutes')}, {wilder_sql('b', P.ATR_5M, 'a')} SELECT symbol, source, bar_time, round(atr, 6) AS atr_14 FROM a")
def _(s, d):
    return rounded(indicators.atr(candles.ohlc(ticks(s, d), "5 minutes"), P.ATR_5M, "atr_14").select(*P.KEY, "bar_time", "atr_14"), "atr_14")


@query("atr_1m", f"{B1}, {wilder_sql('b', P.ATR_1M, 'a')} SELECT symbol, source, bar_time, round(atr, 6) AS atr_20_1m FROM a")
def _(s, d):
    return rounded(indicators.atr(candles.ohlc(ticks(s, d), "1 minute"), P.ATR_1M, "atr_20_1m").select(*P.KEY, "bar_time", "atr_20_1m"), "atr_20_1m")


RSI_SQL = f"""{B15}, t AS (SELECT *, row_number() OVER ({KW}) - 1 AS i, count(*) OVER (PARTITION BY symbol, source) AS cnt, bar_close - lag(bar_close) OVER ({KW}) AS dx FROM b),
 x AS (SELECT *, pow(13.0::DOUBLE / 14, i) * sum(CASE WHEN i > 0 AND dx > 0 THEN dx / 14 * pow(13.0::DOUBLE / 14, -i) ELSE 0 END) OVER w AS up,
   pow(13.0::DOUBLE / 14, i) * sum(CASE WHEN i > 0 AND dx < 0 THEN -dx / 14 * pow(13.0::DOUBLE / 14, -i) ELSE 0 END) OVER w AS down FROM t WINDOW w AS ({KW} ROWS UNBOUNDED PRECEDING))
 SELECT symbol, source, bar_time, round(CASE WHEN cnt < 14 OR i < 13 THEN NULL WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi_14 FROM x"""


@query("rsi_15m", RSI_SQL)
def _(s, d):
    return rounded(indicators.rsi(b15(s, d)).select(*P.KEY, "bar_time", "rsi_14"), "rsi_14")


@query("ema_15m", f"""{B15}, t AS (SELECT *, row_number() OVER ({KW}) - 1 AS i FROM b),
 x AS (SELECT *, pow(19.0::DOUBLE / 21, i) * sum(CASE WHEN i = 0 THEN bar_close ELSE bar_close * 2 / 21 * pow(19.0::DOUBLE / 21, -i) END) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS e FROM t)
 SELECT symbol, source, bar_time, round(CASE WHEN i >= 19 THEN e END, 6) AS ema_20 FROM x""")
def _(s, d):
    return rounded(indicators.ema(b15(s, d), price="bar_close").select(*P.KEY, "bar_time", "ema_20"), "ema_20")


@query("median_atr", f"{ATR15} SELECT symbol, source, round(median(atr), 6) AS median_atr FROM a GROUP BY 1, 2")
def _(s, d):
    return rounded(indicators.medians(b15_atr(s, d), "atr_15_15m"), "median_atr")


R_SQL = "CASE WHEN a.atr IS NULL OR a.atr <= 0 THEN 5 ELSE CAST(greatest(2, least(5, round_even(3.0 * m / a.atr, 0))) AS INTEGER) END"
RDYN = f"{ATR15}, md AS (SELECT symbol, source, median(atr) AS m FROM a GROUP BY 1, 2), r AS (SELECT a.*, {R_SQL} AS r_dynamic FROM a JOIN md USING (symbol, source))"


def b15_r(s, d):
    return indicators.with_r_dynamic(b15_atr(s, d))


@query("r_dynamic", f"{RDYN} SELECT symbol, source, bar_time, r_dynamic FROM r")
def _(s, d):
    return b15_r(s, d).select(*P.KEY, "bar_time", "r_dynamic")


# ---------------------------------------------------------------- swings, bias, structure

ADAPTIVE = f"{RDYN}, " + ", ".join(fractal_sql(f"f{r}", "r", 5, r) for r in (2, 3, 4, 5)) + ", f AS (" + " UNION ALL ".join(f"SELECT * FROM f{r} WHERE r_dynamic = {r}" for r in (2, 3, 4, 5)) + ")"


def f15(s, d):
    return swings.fractals(b15_r(s, d), P.FRACTAL_LEFT, None)


@query("fractal_15m", f"{ADAPTIVE} SELECT symbol, source, bar_time, is_swing_high, is_swing_low FROM f")
def _(s, d):
    return f15(s, d).select(*P.KEY, "bar_time", "is_swing_high", "is_swing_low")


@query("fractal_4h", f"{B4}, {fractal_sql('f', 'b', 5, 5)} SELECT symbol, source, bar_time, is_swing_high, is_swing_low FROM f")
def _(s, d):
    return swings.fractals(candles.ohlc(ticks(s, d), "4 hours"), 5, 5).select(*P.KEY, "bar_time", "is_swing_high", "is_swing_low")


@query("fractal_1m", f"{B1}, {fractal_sql('f', 'b', 3, 3)}, g AS (SELECT *, lag(CASE WHEN is_swing_high THEN bar_high END, 3) OVER ({KW}) AS h, lag(CASE WHEN is_swing_low THEN bar_low END, 3) OVER ({KW}) AS l FROM f) SELECT symbol, source, bar_time, last_value(h IGNORE NULLS) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS confirmed_1m_swing_high, last_value(l IGNORE NULLS) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS confirmed_1m_swing_low FROM g")
def _(s, d):
    return swings.last_confirmed(candles.ohlc(ticks(s, d), "1 minute")).select(*P.KEY, "bar_time", "confirmed_1m_swing_high", "confirmed_1m_swing_low")


@query("fractal_v3", f"WITH {TICKS}, {bars_sql('b0', '1 hour')}, {wilder_sql('b0', 14, 'a')}, b AS (SELECT symbol, source, bar_time, round(bar_high, 5) AS bar_high, round(bar_low, 5) AS bar_low, coalesce(atr, avg(atr) OVER (PARTITION BY symbol, source), (bar_high - bar_low) * 0.005) AS size FROM a), {fractal_sql('f', 'b', 5, 5)} SELECT symbol, source, bar_time, is_swing_high AND bar_high - bar_low >= size * 0.5 AS is_swing_high, is_swing_low AND bar_high - bar_low >= size * 0.5 AS is_swing_low FROM f")
def _(s, d):
    b = indicators.atr(candles.ohlc(ticks(s, d), "1 hour"), 14, "atr_14")
    return swings.fractals_v3(b).select(*P.KEY, "bar_time", "is_swing_high", "is_swing_low")


SWINGS = f"{ADAPTIVE}, sw AS (SELECT symbol, source, bar_time, 'high' AS kind, bar_high AS price FROM f WHERE is_swing_high UNION ALL SELECT symbol, source, bar_time, 'low', bar_low FROM f WHERE is_swing_low)"


def swing_table(s, d):
    return swings.swing_rows(f15(s, d))


@query("swing_rows", f"{SWINGS} SELECT * FROM sw")
def _(s, d):
    return swing_table(s, d)


@query("swing_counts", f"{SWINGS} SELECT *, count(*) FILTER (kind = 'high') OVER (PARTITION BY symbol, source ORDER BY bar_time, kind ROWS UNBOUNDED PRECEDING) AS n_highs, count(*) FILTER (kind = 'low') OVER (PARTITION BY symbol, source ORDER BY bar_time, kind ROWS UNBOUNDED PRECEDING) AS n_lows FROM sw")
def _(s, d):
    return swings.swing_counts(swing_table(s, d))


@query("last_swings", f"{SWINGS} SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY symbol, source, kind ORDER BY bar_time DESC) <= 80")
def _(s, d):
    return swings.last_n(swing_table(s, d), P.EQUAL_LOOKBACK)


BIAS = f"""WITH {TICKS}, {bars_sql('b', '1 hour')}, {fractal_sql('f', 'b', 5, 5)},
 g AS (SELECT *, CASE WHEN is_swing_high THEN bar_high END AS hp, CASE WHEN is_swing_low THEN bar_low END AS lp FROM f),
 h AS (SELECT *, max(hp) OVER p AS top, min(lp) OVER p AS bottom FROM g WINDOW p AS ({KW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 k AS (SELECT *, is_swing_high AND (top IS NULL OR hp > top) AS hh, is_swing_high AND NOT (top IS NULL OR hp > top) AS lh, is_swing_low AND (bottom IS NULL OR lp < bottom) AS ll, is_swing_low AND NOT (bottom IS NULL OR lp < bottom) AS hl FROM h),
 m AS (SELECT *, coalesce(bool_or(hl) OVER p, false) AS had_hl, coalesce(bool_or(ll) OVER p, false) AS had_ll, bool_or(hh) OVER c AS had_hh, bool_or(lh) OVER c AS had_lh FROM k
       WINDOW p AS ({KW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS ({KW} ROWS UNBOUNDED PRECEDING)),
 n AS (SELECT *, coalesce(CASE WHEN ll AND had_lh THEN 'bearish' WHEN hl AND had_hh THEN 'bullish' END, CASE WHEN hh AND had_hl THEN 'bullish' WHEN lh AND had_ll THEN 'bearish' END) AS ev FROM m),
 o AS (SELECT *, last_value(ev IGNORE NULLS) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS st FROM n)
 SELECT symbol, source, bar_time, coalesce(lag(st, 5) OVER ({KW}), 'neutral') AS market_bias_4h FROM o"""


@query("bias_fractal", BIAS)
def _(s, d):
    return swings.bias_4h(candles.ohlc(ticks(s, d), "1 hour")).select(*P.KEY, "bar_time", "market_bias_4h")


@query("trend_blocks", f"WITH z AS ({BIAS}), c AS (SELECT *, CASE WHEN market_bias_4h IS DISTINCT FROM lag(market_bias_4h) OVER ({KW}) THEN 1 ELSE 0 END AS ch FROM z), g AS (SELECT *, sum(ch) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS blk FROM c) SELECT symbol, source, any_value(market_bias_4h) AS value, min(bar_time) AS start, max(bar_time) AS \"end\", count(*) AS bars FROM g GROUP BY symbol, source, blk")
def _(s, d):
    return indicators.trend_blocks(swings.bias_4h(candles.ohlc(ticks(s, d), "1 hour")), "market_bias_4h")


@query("latest_bias", f"WITH z AS ({BIAS}) SELECT symbol, source, arg_max(market_bias_4h, bar_time) AS latest_bias FROM z GROUP BY 1, 2")
def _(s, d):
    return structure.latest_bias(swings.bias_4h(candles.ohlc(ticks(s, d), "1 hour")))


@query("forward_fill", f"{ADAPTIVE} SELECT symbol, source, bar_time, last_value(CASE WHEN is_swing_high THEN bar_high END IGNORE NULLS) OVER ({KW} ROWS UNBOUNDED PRECEDING) AS last_high FROM f")
def _(s, d):
    f = f15(s, d).select(*P.KEY, "bar_time", F.when(F.col("is_swing_high"), F.col("bar_high")).alias("last_high"))
    return indicators.fill_forward(f, ["last_high"])


def structured(s, d, mode="bos"):
    return structure.structure(f15(s, d), mode)


def _structure_columns(df: DataFrame) -> DataFrame:
    return df.select(*P.KEY, "bar_time", *[f.name for f in structure.ADDED])


def turned_sql(mode: str, ticks: str = TICKS) -> str:
    """15-minute bars with ATR, R, swings and structure, as CTEs from ticks to sd."""
    return f"WITH RECURSIVE {ADAPTIVE.replace(TICKS, ticks).removeprefix('WITH ')}, {oracles.ordered_sql('f')}, {oracles.structure_sql(mode)}, {oracles.structured_sql(mode)}"


BOS, CHOCH = turned_sql("bos"), turned_sql("choch")


@query("structure_bos", f"{BOS} SELECT {oracles.STRUCTURE} FROM sd")
def _(s, d):
    return _structure_columns(structured(s, d))


@query("structure_choch", f"{CHOCH} SELECT {oracles.STRUCTURE} FROM sd")
def _(s, d):
    return _structure_columns(structured(s, d, "choch"))


@query("breaks_v3", f"WITH RECURSIVE {TICKS}, {bars_sql('b', '15 minutes')}, {oracles.breaks_v3_sql('b')} SELECT nb.symbol, nb.source, nb.bar_time, dir AS structure_direction, bos AS bos_detected, choch AS choch_detected FROM nb JOIN sb ON nb.symbol = sb.symbol AND nb.source = sb.source AND nb.n = sb.n")
def _(s, d):
    return structure.breaks_v3(b15(s, d)).select(*P.KEY, "bar_time", "structure_direction", "bos_detected", "choch_detected")


@query("structure_equi_join", f"{BOS} SELECT symbol, source, bar_time, bar_open, bar_high, bar_low, bar_close, smc_trend_15m, hh_15m, ll_15m FROM sd")
def _(s, d):
    st = _structure_columns(structured(s, d)).select(*P.KEY, "bar_time", "smc_trend_15m", "hh_15m", "ll_15m")
    return b15(s, d).join(st, [*P.KEY, "bar_time"], "left")


# ---------------------------------------------------------------- sessions

def _sessions_sql(back: int) -> str:
    return f"""WITH {TICKS}, m AS (SELECT symbol, source, time_bucket(INTERVAL '1 minute', timestamp_utc) AS minute, max(mid) AS high, min(mid) AS low FROM ticks GROUP BY 1, 2, 3),
 a AS (SELECT *, CASE WHEN hour(minute) >= 13 THEN 'newyork' WHEN hour(minute) >= 8 THEN 'london' ELSE 'asian' END AS session_name FROM m),
 b AS (SELECT *, CASE WHEN dayofyear(minute) IS DISTINCT FROM lag(dayofyear(minute)) OVER w THEN 1 ELSE 0 END AS nd, CASE WHEN session_name IS DISTINCT FROM lag(session_name) OVER w THEN 1 ELSE 0 END AS ns FROM a WINDOW w AS (PARTITION BY symbol, source ORDER BY minute)),
 c AS (SELECT *, sum(nd) OVER w AS d, sum(ns) OVER w AS s FROM b WINDOW w AS (PARTITION BY symbol, source ORDER BY minute ROWS UNBOUNDED PRECEDING)),
 dd AS (SELECT symbol, source, d + 1 AS d, max(high) AS prev_day_high, min(low) AS prev_day_low FROM c GROUP BY 1, 2, 3), ss AS (SELECT symbol, source, s + {back} AS s, max(high) AS prev_session_high, min(low) AS prev_session_low FROM c GROUP BY 1, 2, 3)
 SELECT symbol, source, minute AS snapshot_time, true AS session_boundary, session_name, prev_day_high, prev_day_low, high AS current_session_high, low AS current_session_low, prev_session_high, prev_session_low
 FROM c LEFT JOIN dd USING (symbol, source, d) LEFT JOIN ss USING (symbol, source, s) WHERE ns = 1"""


@query("session_levels", _sessions_sql(2))
def _(s, d):
    return sessions.session_levels(candles.minute_ranges(ticks(s, d)))


@query("session_levels_v3", _sessions_sql(1))
def _(s, d):
    return sessions.session_levels(candles.minute_ranges(ticks(s, d)), 1)


TICK_SESSIONS = f"""WITH {TICKS}, {bars_sql('b', '4 hours')},
 dd AS (SELECT symbol, source, CAST(bar_time AS DATE) AS day, max(bar_high) AS dh, min(bar_low) AS dl FROM b GROUP BY 1, 2, 3),
 o AS (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY timestamp_utc, seq) AS i FROM ticks),
 n AS (SELECT *, CASE WHEN i = 1 THEN 'asian' WHEN hour(timestamp_utc) >= 13 THEN 'ny' WHEN hour(timestamp_utc) >= 8 THEN 'london' ELSE 'asian' END AS name FROM o),
 c AS (SELECT *, CASE WHEN i > 1 AND name <> lag(name) OVER (PARTITION BY symbol, source ORDER BY i) THEN 1 ELSE 0 END AS turn FROM n),
 r AS (SELECT *, sum(turn) OVER (PARTITION BY symbol, source ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM c),
 e AS (SELECT symbol, source, s + 1 AS s, max(mid) AS prev_session_high, min(mid) AS prev_session_low FROM r GROUP BY 1, 2, 3),
 x AS (SELECT r.*, prev_session_high, prev_session_low, dh, dl FROM r LEFT JOIN e ON r.symbol = e.symbol AND r.source = e.source AND r.s = e.s
       LEFT JOIN dd ON r.symbol = dd.symbol AND r.source = dd.source AND hour(timestamp_utc) = 0 AND dd.day = CAST(timestamp_utc AS DATE) - 1 WHERE turn = 1)
 SELECT symbol, source, timestamp_utc AS snapshot_time, true AS session_boundary, last_value(dh IGNORE NULLS) OVER p AS prev_day_high, last_value(dl IGNORE NULLS) OVER p AS prev_day_low,
        mid AS current_session_high, mid AS current_session_low, prev_session_high, prev_session_low
 FROM x WINDOW p AS (PARTITION BY symbol, source ORDER BY s ROWS UNBOUNDED PRECEDING)"""


@query("session_levels_ticks", TICK_SESSIONS)
def _(s, d):
    t = ticks(s, d)
    return sessions.tick_session_levels(t, candles.ohlc(t, "4 hours"))


# ---------------------------------------------------------------- as-of joins

@query("asof_candles", f"WITH {TICKS}, {bars_sql('b', '1 minute')} SELECT t.seq, b.bar_open, b.bar_high, b.bar_low, b.bar_close FROM ticks t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.source = b.source AND t.timestamp_utc >= b.bar_time")
def _(s, d):
    t = ticks(s, d)
    cols = ["bar_open", "bar_high", "bar_low", "bar_close"]
    return asof.bar_join(t, candles.ohlc(t, "1 minute"), "1 minute", cols).select("seq", *cols)


@query("asof_sessions", f"WITH z AS ({_sessions_sql(2)}), {TICKS} SELECT t.seq, z.session_name, z.prev_day_high, z.prev_session_low FROM ticks t ASOF LEFT JOIN z ON t.symbol = z.symbol AND t.source = z.source AND t.timestamp_utc >= z.snapshot_time")
def _(s, d):
    t = ticks(s, d)
    cols = ["session_name", "prev_day_high", "prev_session_low"]
    return asof.asof_backward(t, sessions.session_levels(candles.minute_ranges(t)), "timestamp_utc", "snapshot_time", cols).select("seq", *cols)


@query("asof_filtered", f"{ATR15} SELECT t.seq, round(x.atr, 6) AS atr_15_15m FROM ticks t ASOF LEFT JOIN (SELECT * FROM a WHERE atr > 0) x ON t.symbol = x.symbol AND t.source = x.source AND t.timestamp_utc >= x.bar_time")
def _(s, d):
    t = ticks(s, d)
    usable = b15_atr(s, d).filter("atr_15_15m IS NOT NULL AND atr_15_15m > 0")
    return rounded(asof.asof_backward(t, usable, "timestamp_utc", "bar_time", ["atr_15_15m"]).select("seq", "atr_15_15m"), "atr_15_15m")


@query("asof_swing_counts", f"{SWINGS}, c AS (SELECT symbol, source, bar_time, count(*) FILTER (kind = 'high') OVER w AS n_highs, count(*) FILTER (kind = 'low') OVER w AS n_lows FROM sw WINDOW w AS (PARTITION BY symbol, source ORDER BY bar_time, kind ROWS UNBOUNDED PRECEDING)), e AS (SELECT symbol, source, bar_time, max(n_highs) AS n_highs, max(n_lows) AS n_lows FROM c GROUP BY 1, 2, 3) SELECT t.seq, e.n_highs, e.n_lows FROM ticks t ASOF LEFT JOIN e ON t.symbol = e.symbol AND t.source = e.source AND t.timestamp_utc >= e.bar_time")
def _(s, d):
    c = swings.swing_counts(swing_table(s, d))
    return asof.asof_backward(ticks(s, d), c, "timestamp_utc", "bar_time", ["n_highs", "n_lows"], tie=["n_highs", "n_lows"]).select("seq", "n_highs", "n_lows")


@query("asof_bias", f"WITH z AS ({BIAS}), {TICKS} SELECT t.seq, z.market_bias_4h FROM ticks t ASOF LEFT JOIN z ON t.symbol = z.symbol AND t.source = z.source AND t.timestamp_utc >= z.bar_time")
def _(s, d):
    t = ticks(s, d)
    return asof.asof_backward(t, swings.bias_4h(candles.ohlc(t, "1 hour")), "timestamp_utc", "bar_time", ["market_bias_4h"]).select("seq", "market_bias_4h")


@query("asof_zones", f"{BOS} SELECT t.seq, z.zone_low, z.zone_high FROM ticks t ASOF LEFT JOIN (SELECT * FROM sd WHERE zone_low IS NOT NULL OR zone_high IS NOT NULL) z ON t.symbol = z.symbol AND t.source = z.source AND t.timestamp_utc >= z.bar_time")
def _(s, d):
    return asof.asof_backward(ticks(s, d), structure.zones(structured(s, d)), "timestamp_utc", "bar_time", ["zone_low", "zone_high"]).select("seq", "zone_low", "zone_high")


@query("asof_trend_1m", f"{BOS}, {bars_sql('m1', '1 minute')} SELECT m1.symbol, m1.source, m1.bar_time, z.smc_trend_15m FROM m1 ASOF LEFT JOIN (SELECT * FROM sd WHERE smc_trend_15m IS NOT NULL) z ON m1.symbol = z.symbol AND m1.source = z.source AND m1.bar_time >= z.bar_time")
def _(s, d):
    t = structured(s, d).filter("smc_trend_15m IS NOT NULL").select(*P.KEY, F.col("bar_time").alias("at"), "smc_trend_15m")
    return asof.asof_backward(candles.ohlc(ticks(s, d), "1 minute").select(*P.KEY, "bar_time"), t, "bar_time", "at", ["smc_trend_15m"])


@query("prior_trigger", f"{BOS}, {bars_sql('m1', '1 minute')} SELECT m1.symbol, m1.source, m1.bar_time, z.bar_time AS trigger_time FROM m1 ASOF LEFT JOIN (SELECT * FROM sd WHERE bos_detected_15m) z ON m1.symbol = z.symbol AND m1.source = z.source AND m1.bar_time >= z.bar_time")
def _(s, d):
    return asof.asof_backward(candles.ohlc(ticks(s, d), "1 minute").select(*P.KEY, "bar_time"), structure.triggers(structured(s, d)), "bar_time", "trigger_time", ["trigger_time"])


# ---------------------------------------------------------------- gaps and liquidity

def b1(s, d):
    return features.bars_1m(ticks(s, d))


def dense_ticks(s, d):
    """A price path made of the events: each value's distance from its key's mean, summed up, is the price's way, and time
    runs thirty times as fast, so that minutes have bodies, breaks, gaps and sweeps."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    t = ticks(s, d).withColumn("timestamp_utc", (start + (F.col("timestamp_utc") - start) / 30).cast("timestamp_ntz"))
    mean = t.groupBy(*P.KEY).agg(F.avg("bid").alias("mean"))
    t = core.known(t, F.broadcast(mean), P.KEY).withColumn("step", F.col("bid") - F.col("mean")).drop("mean")
    # The sum runs within slices of a key; a slice starts with a row of what the key's earlier slices come to.
    t = core.slice_of(t, "timestamp_utc", "15 minutes", "slice")
    row = F.struct(*[c for c in t.columns if c not in ("slice", "step")]).alias("row")
    t = t.select(*P.KEY, "slice", "step", row)
    sums = t.groupBy(*P.KEY, "slice").agg(F.sum("step").alias("sum"))
    before = F.sum("sum").over(W.partitionBy(*P.KEY).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    both = t.unionByName(sums.select(*P.KEY, "slice", before.alias("step"), F.lit(None).cast(t.schema["row"].dataType).alias("row")))
    order = W.partitionBy(*P.KEY, "slice").orderBy(F.col("row").isNotNull(), "row.timestamp_utc", "row.seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = both.withColumn("path", F.sum("step").over(order)).filter("row IS NOT NULL").select("row.*", "path")
    return t.withColumn("bid", F.lit(2000.0) + F.round(F.col("path") / 35, 2)).drop("path").withColumn("ask", F.col("bid") + F.col("spread")).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


DENSE_TICKS = f"""{TICKS.replace("ticks AS (", "thin AS (")}, dense0 AS (SELECT TIMESTAMP '2024-01-01' + to_microseconds(CAST(round((epoch_us(timestamp_utc) - epoch_us(TIMESTAMP '2024-01-01')) / 30.0::DOUBLE) AS BIGINT)) AS timestamp_utc, symbol, source, volume, seq, spread, bid - avg(bid) OVER (PARTITION BY symbol, source) AS step FROM thin),
dense1 AS (SELECT * EXCLUDE (step), 2000.0::DOUBLE + round(sum(step) OVER (PARTITION BY symbol, source ORDER BY timestamp_utc, seq ROWS UNBOUNDED PRECEDING) / 35, 2) AS bid FROM dense0),
ticks AS MATERIALIZED (SELECT *, bid + spread AS ask, (bid + (bid + spread)) / 2 AS mid FROM dense1)"""


def minutes_and_quarters(s, d):
    """1-minute bars with their ATR and 15-minute structure of the dense ticks."""
    t = stage(dense_ticks(s, d), "dense")
    return t, stage(indicators.atr(candles.ohlc(t, "1 minute"), P.ATR_1M, "atr_20_1m"), "bars"), stage(features.bars_15m(t), "structure")


GAPS = f"{turned_sql('bos', DENSE_TICKS)}, {bars_sql('m0', '1 minute')}, {wilder_sql('m0', P.ATR_1M, 'm1')}, {oracles.gaps_sql('m1')}"
ACTIVE = f"{GAPS}, {oracles.active_gaps_sql()}"


@query("gaps", f"{GAPS} SELECT * FROM fg")
def _(s, d):
    return gaps.find_gaps(*minutes_and_quarters(s, d)[1:])


def with_active_gaps(s, d):
    t, bars, st = minutes_and_quarters(s, d)
    return t, gaps.active_gaps(bars, stage(gaps.find_gaps(bars, st), "gaps"), st)


@query("active_gaps", f"{ACTIVE} SELECT * FROM ag")
def _(s, d):
    return with_active_gaps(s, d)[1]


V3_GAPS = f"""WITH {TICKS}, {bars_sql('b', '5 minutes')}, x AS (SELECT *, lag(bar_high) OVER w AS h0, lag(bar_low) OVER w AS l0, lead(bar_high) OVER w AS h2, lead(bar_low) OVER w AS l2,
  min(bar_low) OVER ({KW} ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS mn, max(bar_high) OVER ({KW} ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS mx FROM b WINDOW w AS ({KW})),
 g AS (SELECT symbol, source, bar_time AS formed_at, round(CASE WHEN l2 > h0 THEN l2 ELSE l0 END, 5) AS fvg_high, round(CASE WHEN l2 > h0 THEN h0 ELSE h2 END, 5) AS fvg_low, CASE WHEN l2 > h0 THEN 'bullish' ELSE 'bearish' END AS side, mn, mx FROM x WHERE l2 > h0 OR h2 < l0)"""


@query("gaps_v3", f"{V3_GAPS} SELECT symbol, source, formed_at, fvg_high, fvg_low, side, coalesce(CASE WHEN side = 'bullish' THEN mn <= fvg_low ELSE mx >= fvg_high END, false) AS filled FROM g")
def _(s, d):
    return gaps.gaps_v3(candles.ohlc(ticks(s, d), "5 minutes"))


@query("distinct_gap_bounds", f"{V3_GAPS} SELECT DISTINCT fvg_high, fvg_low FROM g")
def _(s, d):
    return gaps.gaps_v3(candles.ohlc(ticks(s, d), "5 minutes")).select("fvg_high", "fvg_low").dropDuplicates()


@query("gap_ticks", f"{ACTIVE} SELECT t.seq, ag.fvg_high, ag.fvg_low, ag.fvg_side, ag.fvg_age_bars FROM ticks t JOIN ag ON t.symbol = ag.symbol AND t.source = ag.source AND time_bucket(INTERVAL '1 minute', t.timestamp_utc) = ag.bar_time WHERE ag.fvg_high IS NOT NULL")
def _(s, d):
    t, active = with_active_gaps(s, d)
    return asof.bar_join(t, active, "1 minute", ["fvg_high", "fvg_low", "fvg_side", "fvg_age_bars"]).filter("fvg_high IS NOT NULL").select("seq", "fvg_high", "fvg_low", "fvg_side", "fvg_age_bars")


def quarter_levels(s, d):
    return sessions.levels_of(sessions.session_levels(candles.minute_ranges(ticks(s, d))))


@query("level_dedup", f"WITH z AS ({_sessions_sql(2)}), l AS (SELECT symbol, source, snapshot_time AS visible, unnest([{{'p': prev_day_high, 'd': 'high', 't': 1, 'o': 0}}, {{'p': prev_day_low, 'd': 'low', 't': 1, 'o': 1}}, {{'p': current_session_high, 'd': 'high', 't': 2, 'o': 2}}, {{'p': current_session_low, 'd': 'low', 't': 2, 'o': 3}}, {{'p': prev_session_high, 'd': 'high', 't': 2, 'o': 4}}, {{'p': prev_session_low, 'd': 'low', 't': 2, 'o': 5}}]) AS l FROM z) SELECT symbol, source, l.d AS direction, l.p AS price, l.t AS tier, visible, l.o AS ordinal FROM l WHERE l.p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, source, l.d, round_even(l.p * 100, 0) ORDER BY visible, l.o) = 1")
def _(s, d):
    return quarter_levels(s, d)


SWUNG = f"{SWINGS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {bars_sql('m0', '1 minute')}, {wilder_sql('m0', P.ATR_1M, 'm1')}, {oracles.equal_levels_sql('sw', 'm1')}"


@query("equal_levels", f"{SWUNG} SELECT symbol, source, direction, round(price, 9) AS price, strength FROM eq")
def _(s, d):
    return liquidity.equal_levels(swing_table(s, d), b1(s, d)).withColumn("price", F.round("price", 9))


@query("sweeps", f"{SWUNG}, ses AS ({_sessions_sql(2)}), {oracles.sweeps_sql('m1', 'ses', 'sw')} SELECT symbol, source, bar_time, liq_swept, liq_side, sweep_tier, sweep_candle_low, sweep_candle_high, sweep_wick, sweep_body FROM sv")
def _(s, d):
    bars, turned = stage(b1(s, d), "bars"), stage(swing_table(s, d), "swings")
    out = liquidity.sweeps(bars, quarter_levels(s, d), turned, liquidity.equal_levels(turned, bars))
    return out.select(*P.KEY, "bar_time", "liq_swept", "liq_side", "sweep_tier", "sweep_candle_low", "sweep_candle_high", "sweep_wick", "sweep_body")


@query("theta_sweeps", f"WITH z AS ({_sessions_sql(2)}), {TICKS}, {bars_sql('b', '15 minutes')}, lv AS (SELECT symbol, source, snapshot_time AS visible, current_session_high AS price FROM z), hit AS (SELECT b.symbol, b.source, b.bar_time, min(lv.visible) AS first_level, count(*) AS levels FROM b JOIN lv ON b.symbol = lv.symbol AND b.source = lv.source AND lv.visible <= b.bar_time AND b.bar_high >= lv.price - 2.0 AND b.bar_close < lv.price GROUP BY 1, 2, 3) SELECT * FROM hit")
def _(s, d):
    lv = sessions.session_levels(candles.minute_ranges(ticks(s, d))).select(*P.KEY, F.col("snapshot_time").alias("visible"), F.col("current_session_high").alias("price"))
    b, lv = liquidity.by_cells(b15(s, d), F.col("bar_low"), F.col("bar_high") + 2.0, lv)
    met = b.join(lv, [*P.KEY, "_cell"]).filter((F.col("visible") <= F.col("bar_time")) & liquidity.swept(F.lit("high"), F.col("price"), F.lit(2.0)))
    return met.groupBy(*P.KEY, "bar_time").agg(F.min("visible").alias("first_level"), F.count(F.lit(1)).alias("levels"))


V3_LEVELS = f"WITH {TICKS}, {bars_sql('b', '4 hours')}, {fractal_sql('f', 'b', 5, 5)}, lv AS (SELECT symbol, source, 'high' AS direction, bar_high AS price, bar_time AS formed_at FROM f WHERE is_swing_high UNION ALL SELECT symbol, source, 'low', bar_low, bar_time FROM f WHERE is_swing_low)"


def v3_levels(s, d):
    f = swings.swing_rows(swings.fractals(candles.ohlc(ticks(s, d), "4 hours"), 5, 5))
    return f.select(*P.KEY, F.col("kind").alias("direction"), "price", F.col("bar_time").alias("formed_at"))


@query("first_sweeps", f"{V3_LEVELS}, m AS (SELECT lv.*, min(b.bar_time) AS swept_at FROM lv LEFT JOIN b ON b.symbol = lv.symbol AND b.source = lv.source AND b.bar_time > formed_at AND CASE WHEN direction = 'high' THEN bar_high > price * (1 + CAST(0.0005 AS DOUBLE)) AND bar_close < price ELSE bar_low < price * (1 - CAST(0.0005 AS DOUBLE)) AND bar_close > price END GROUP BY ALL) SELECT * FROM m")
def _(s, d):
    return liquidity.first_sweeps(v3_levels(s, d), candles.ohlc(ticks(s, d), "4 hours"))


@query("level_touches", f"{V3_LEVELS} SELECT lv.*, count(b.bar_time) AS touches FROM lv LEFT JOIN b ON b.symbol = lv.symbol AND b.source = lv.source AND bar_high >= price - price * CAST(0.0005 AS DOUBLE) AND bar_low <= price + price * CAST(0.0005 AS DOUBLE) GROUP BY ALL")
def _(s, d):
    return liquidity.touches(v3_levels(s, d), candles.ohlc(ticks(s, d), "4 hours"))


@query("round_levels", f"{B4}, e AS (SELECT symbol, source, min(bar_low) AS lo, max(bar_high) AS hi FROM b GROUP BY 1, 2) SELECT symbol, source, g * CAST(50 AS DOUBLE) AS price FROM e, LATERAL (SELECT unnest(generate_series(CAST(ceil(lo / 50) AS BIGINT), CAST(floor(hi / 50) AS BIGINT))) AS g)")
def _(s, d):
    return liquidity.round_number_levels(candles.ohlc(ticks(s, d), "4 hours"))


def timeframe_levels(s, d):
    t = ticks(s, d)
    parts = [swings.swing_rows(swings.fractals(candles.ohlc(t, w), 5, 5)).select(*P.KEY, F.lit(n).alias("timeframe"), "price", F.col("bar_time").alias("formed_at"), F.col("kind").alias("direction")) for n, w in (("1h", "1 hour"), ("4h", "4 hours"))]
    return parts[0].unionByName(parts[1])


TF_SQL = f"WITH {TICKS}, {bars_sql('b1', '1 hour')}, {bars_sql('b4', '4 hours')}, {fractal_sql('f1', 'b1', 5, 5)}, {fractal_sql('f4', 'b4', 5, 5)}, lv AS (" + " UNION ALL ".join(f"SELECT symbol, source, '{n}' AS timeframe, {c} AS price, bar_time AS formed_at, '{k}' AS direction FROM {f} WHERE is_swing_{k}" for n, f in (("1h", "f1"), ("4h", "f4")) for k, c in (("high", "bar_high"), ("low", "bar_low"))) + ")"
CONF_SQL = f"{TF_SQL}, cf AS (SELECT lv.*, count(DISTINCT o.timeframe) AS timeframes FROM lv JOIN lv o ON lv.symbol = o.symbol AND lv.source = o.source AND abs(o.price - lv.price) <= lv.price * CAST(0.002 AS DOUBLE) GROUP BY ALL)"


@query("confluence", f"{CONF_SQL} SELECT * FROM cf")
def _(s, d):
    return liquidity.confluence(timeframe_levels(s, d))


@query("confluence_score", f"{CONF_SQL} SELECT symbol, source, timeframe, price, formed_at, direction, CAST(timeframes - 1 + 1 + 0 + CASE timeframe WHEN '4h' THEN 2 WHEN '1h' THEN 1 ELSE 0 END + CASE WHEN hour(formed_at) >= 7 AND hour(formed_at) < 9 THEN 2 ELSE 0 END AS INTEGER) AS score FROM cf")
def _(s, d):
    c = liquidity.confluence(timeframe_levels(s, d))
    score = liquidity.confluence_score(F.col("timeframes"), F.col("timeframe"), F.lit(False), F.lit(True), F.lit(1), F.hour("formed_at"))
    return c.select(*P.KEY, "timeframe", "price", "formed_at", "direction", score.alias("score"))


NEAR_SQL = f"{CONF_SQL}, l2 AS (SELECT symbol, source, price AS level, max(timeframes) AS score FROM cf GROUP BY 1, 2, 3), p AS (SELECT symbol, source, bar_time, bar_close AS price FROM b4), j AS (SELECT p.*, level, score, row_number() OVER (PARTITION BY p.symbol, p.source, p.bar_time ORDER BY abs(level - p.price), level) AS rk FROM p JOIN l2 USING (symbol, source))"


@query("nearest_levels", f"{NEAR_SQL} SELECT symbol, source, bar_time, price, min(CASE WHEN level > price THEN level END) AS nearest_above, max(CASE WHEN level < price THEN level END) AS nearest_below, max(CASE WHEN rk <= 3 THEN score END) AS best_score FROM j GROUP BY 1, 2, 3, 4")
def _(s, d):
    points = candles.ohlc(ticks(s, d), "4 hours").select(*P.KEY, "bar_time", F.col("bar_close").alias("price"))
    return liquidity.nearest_levels(points, liquidity.confluence(timeframe_levels(s, d)).withColumn("score", F.col("timeframes")))


# ---------------------------------------------------------------- strategy, backtest, metrics

@query("spread_gate", f"{ATR15} SELECT t.seq, coalesce(x.atr > 0 AND t.spread > x.atr * CAST(0.25 AS DOUBLE), false) AS spread_gate, t.spread >= CAST(20 * CAST(0.1 AS DOUBLE) AS DOUBLE) AS wide FROM ticks t JOIN a x ON t.symbol = x.symbol AND t.source = x.source AND time_bucket(INTERVAL '15 minutes', t.timestamp_utc) = x.bar_time")
def _(s, d):
    t = asof.bar_join(ticks(s, d), b15_atr(s, d), "15 minutes", ["atr_15_15m"])
    return t.select("seq", core.spread_gate(F.col("spread"), F.col("atr_15_15m")).alias("spread_gate"), core.wide_spread(F.col("spread")).alias("wide"))


def built(s, d, mode="bos"):
    return features.build_features(ticks(s, d), mode)


def dense(s, d, mode="bos"):
    """Features of the dense ticks."""
    return features.build_features(stage(dense_ticks(s, d), "dense"), mode)


def features_sql(ticks: str) -> str:
    """All CTEs from ticks to ft, the enriched ticks."""
    facts = f"""sw AS (SELECT symbol, source, bar_time, 'high' AS kind, bar_high AS price FROM sd WHERE is_swing_high UNION ALL SELECT symbol, source, bar_time, 'low', bar_low FROM sd WHERE is_swing_low),
 cnt AS (SELECT b.symbol, b.source, b.bar_time, count(*) FILTER (a.kind = 'high') AS n_highs, count(*) FILTER (a.kind = 'low') AS n_lows FROM (SELECT DISTINCT symbol, source, bar_time FROM sw) b JOIN sw a ON a.symbol = b.symbol AND a.source = b.source AND a.bar_time <= b.bar_time GROUP BY 1, 2, 3),
 ses AS ({_sessions_sql(2).replace(TICKS + ', ', '')}), bias AS ({BIAS.replace(TICKS + ', ', '').replace("INTERVAL '1 hour'", "INTERVAL '4 hours'")}),
 cf0 AS (SELECT *, row_number() OVER ({KW}) AS i FROM m1), {fractal_sql('cf1', 'cf0', 3, 3)},
 cf AS (SELECT a.symbol, a.source, a.bar_time, (SELECT arg_max(h.bar_high, h.i) FROM cf1 h WHERE h.symbol = a.symbol AND h.source = a.source AND h.is_swing_high AND h.i + 3 <= a.i) AS confirmed_1m_swing_high,
   (SELECT arg_max(l.bar_low, l.i) FROM cf1 l WHERE l.symbol = a.symbol AND l.source = a.source AND l.is_swing_low AND l.i + 3 <= a.i) AS confirmed_1m_swing_low FROM cf1 a)"""
    bars = f"{bars_sql('m0', '1 minute')}, {wilder_sql('m0', P.ATR_1M, 'ma')}, {oracles.rsi_sql('ma', 'm1')}"
    return f"{turned_sql('bos', ticks)}, {bars}, {facts}, {oracles.equal_levels_sql('sw', 'm1')}, {oracles.sweeps_sql('m1', 'ses', 'sw')}, {oracles.gaps_sql('m1')}, {oracles.active_gaps_sql()}, {oracles.features_sql(SESSION.format('t.timestamp_utc'))}"


FULL, DENSE_FULL = features_sql(TICKS), features_sql(DENSE_TICKS)


@query("build_features", f"{FULL} SELECT * REPLACE (round(atr_20_1m, 6) AS atr_20_1m, round(rsi_14, 6) AS rsi_14, round(atr_15_15m, 6) AS atr_15_15m) FROM ft")
def _(s, d):
    return rounded(built(s, d).ticks, "atr_20_1m", "rsi_14", "atr_15_15m")


@query("decisions_stateless", f"{DENSE_FULL}, {oracles.stateless_sql()} SELECT seq, spread_gate, t1_action, t1_reason, gap_gate, sweep_gate, sweep_score, gap_score FROM dz")
def _(s, d):
    return strategy.stateless(dense(s, d).ticks).select("seq", "spread_gate", "t1_action", "t1_reason", "gap_gate", "sweep_gate", "sweep_score", "gap_score")


@query("audit_log", f"{DENSE_FULL}, {oracles.stateless_sql()}, {oracles.audit_sql()} SELECT symbol, source, timestamp_utc, decision, reason, score, bid, ask, market_bias_4h, session FROM au WHERE k > 0")
def _(s, d):
    return strategy.audit_log(dense(s, d).ticks)


# Ticks of the dense path with all that a decision reads, made of the row number so that every gate, both stages, targets,
# trails and cancelled orders occur; the same expressions in both dialects.
STAGED = {
    "ask": "CASE WHEN seq % 211 = 0 THEN ask + 3 ELSE ask END", "atr_15_15m": "CAST(CASE WHEN seq % 41 = 0 THEN 0.1 WHEN seq % 43 = 0 THEN 0 ELSE 6.0 END AS DOUBLE)", "atr_20_1m": "CAST(CASE WHEN seq % 37 <> 0 THEN 2.0 END AS DOUBLE)",
    "bos_up_15m": "seq % 19 = 0", "bos_down_15m": "seq % 23 = 0", "choch_up_15m": "seq % 29 = 3", "choch_down_15m": "seq % 31 = 7", "bos_detected_15m": "seq % 19 = 0 OR seq % 23 = 0", "choch_detected_15m": "seq % 29 = 3 OR seq % 31 = 7",
    "sweep_candle_low": "CASE WHEN seq % 17 <> 0 THEN bid - 1 - seq % 5 END", "sweep_candle_high": "CASE WHEN seq % 17 <> 0 THEN bid + 1 + seq % 5 END", "bar_open": "bid", "bar_close": "bid", "bar_high": "bid + CAST(seq % 3 AS DOUBLE)", "bar_low": "bid - CAST(seq % 3 AS DOUBLE)",
    "fvg_side": "CASE seq % 5 WHEN 0 THEN 'bullish_fvg' WHEN 1 THEN 'bearish_fvg' WHEN 2 THEN 'bullish_fvg' WHEN 3 THEN 'bearish_fvg' END", "fvg_low": "bid - CAST(2 + seq % 9 AS DOUBLE)", "fvg_high": "bid - CAST(2 + seq % 9 AS DOUBLE) + CAST(2 + 4 * (seq % 6) AS DOUBLE)",
    "fvg_filled": "seq % 13 = 0", "fvg_age_bars": "CAST(seq % 7 AS INT)", "liq_swept": "seq % 6 <> 0", "liq_side": "CASE WHEN seq % 4 < 2 THEN 'high' ELSE 'low' END", "sweep_tier": "CAST(CASE WHEN seq % 11 <> 0 THEN 1 + seq % 2 END AS INT)",
    "sweep_wick": "CAST(seq % 4 AS DOUBLE)", "sweep_body": "CAST(seq % 3 AS DOUBLE)", "market_bias_4h": "CASE WHEN seq % 900 < 400 THEN 'bullish' WHEN seq % 900 < 800 THEN 'bearish' WHEN seq % 900 < 850 THEN 'neutral' END",
    "hh_15m": "CASE WHEN seq % 8 <> 0 THEN bid + 9 END", "ll_15m": "CASE WHEN seq % 8 <> 1 THEN bid - 9 END", "strong_low_15m": "CASE WHEN seq % 9 <> 0 THEN bid - 20 END", "strong_high_15m": "bid + 20", "r_dynamic": "CAST(seq % 3 AS INT)",
    "prev_day_high": "bid + 15", "prev_day_low": "bid - 25", "current_session_high": "CASE WHEN seq % 3 = 0 THEN bid + 40 END", "current_session_low": "bid - 40", "prev_session_high": "bid + 60", "prev_session_low": "CASE WHEN seq % 3 = 1 THEN bid - 8 END",
    "confirmed_1m_swing_low": "CASE WHEN seq % 10 <> 0 THEN bid - 2 END", "confirmed_1m_swing_high": "CASE WHEN seq % 10 <> 0 THEN bid + 2 END",
}


def staged(s, d):
    t = dense_ticks(s, d).select("symbol", "source", "timestamp_utc", "seq", "bid", "ask")
    return t.selectExpr("symbol", "source", "timestamp_utc", "seq", "bid", *[f"{e} AS {c}" for c, e in STAGED.items()]).withColumn("session", core.session_label("timestamp_utc"))


def backtest_sql(relay: str, align_bias: bool) -> str:
    made = ", ".join(f"{e} AS {c}" for c, e in STAGED.items())
    return f"WITH RECURSIVE {DENSE_TICKS}, ft AS (SELECT symbol, source, timestamp_utc, seq, bid, {made}, {SESSION.format('timestamp_utc')} AS session FROM ticks), {oracles.stateless_sql(align_bias=align_bias)}, {oracles.backtest_sql(relay=relay)}"


MONEY = {"entry_price": 6, "exit_price": 6, "pnl": 6, "pnl_pips": 6, "hold_minutes": 9, "sl_pips": 6, "mae_pips": 6, "mfe_pips": 6, "equity": 6}
ROUNDED = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in MONEY.items())  # no negative zeros


def money(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in MONEY.items()})


STAGED_BOS, STAGED_FULL = backtest_sql("compat", False), backtest_sql("full", True)


@query("backtest", f"{STAGED_BOS} SELECT * REPLACE ({ROUNDED}) FROM bt_out")
def _(s, d):
    return money(backtest.backtest(staged(s, d)))


@query("backtest_choch_full", f"{STAGED_FULL} SELECT * REPLACE ({ROUNDED}) FROM bt_out")
def _(s, d):
    return money(backtest.backtest(staged(s, d), P.BacktestParams(relay="full", align_bias=True)))


@query("backtest_features")
def _(s, d):
    return backtest.backtest(dense(s, d).ticks)


# Metrics are held against SQL on trade-like rows of orders: profit is the price's distance from 250 000.
TRADES = """trades AS (SELECT o_orderkey AS n, CAST(o_custkey % 7 AS VARCHAR) AS symbol, 'mt5' AS source, o_orderdate AS exit_time, round(o_totalprice - 250000, 2) AS pnl,
  CASE o_custkey % 4 WHEN 0 THEN 'asian' WHEN 1 THEN 'london' ELSE 'newyork' END AS session, CASE WHEN o_custkey % 2 = 0 THEN 'bull' ELSE 'bear' END AS trend, 'T1' AS type,
  CAST(o_custkey % 13 AS DOUBLE) AS mae_pips, CAST(o_custkey % 17 AS DOUBLE) AS mfe_pips FROM orders)"""


def trades(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("n"), (k % 7).cast("string").alias("symbol"), F.lit("mt5").alias("source"), F.col("o_orderdate").alias("exit_time"), F.round(F.col("o_totalprice") - 250000, 2).alias("pnl"),
        F.when(k % 4 == 0, "asian").when(k % 4 == 1, "london").otherwise("newyork").alias("session"), F.when(k % 2 == 0, "bull").otherwise("bear").alias("trend"), F.lit("T1").alias("type"),
        (k % 13).cast("double").alias("mae_pips"), (k % 17).cast("double").alias("mfe_pips"),
    )


@query("trade_summary", f"WITH {TRADES} SELECT symbol, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (NOT pnl > 0) AS n_losses, round(sum(pnl), 4) AS gross_pnl, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0), 6) AS profit_factor, round(avg(pnl) FILTER (pnl > 0), 4) AS avg_win, round(avg(pnl) FILTER (pnl <= 0), 4) AS avg_loss, round(avg(mae_pips), 6) AS avg_mae, round(avg(mfe_pips), 6) AS avg_mfe FROM trades GROUP BY 1")
def _(s, d):
    m = metrics.summary(trades(s, d), ("symbol",))
    return m.withColumns({c: F.round(c, 4) for c in ("gross_pnl", "avg_win", "avg_loss")} | {c: F.round(c, 6) for c in ("win_rate", "profit_factor", "avg_mae", "avg_mfe")})


@query("session_stats", f"WITH {TRADES}, dom AS (SELECT unnest(['asian', 'london', 'newyork', 'off']) AS session) SELECT dom.session, count(n) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, round(coalesce(sum(pnl), 0), 4) AS pnl FROM dom LEFT JOIN trades USING (session) GROUP BY 1")
def _(s, d):
    return metrics.by_domain(trades(s, d), "session", ("asian", "london", "newyork", "off")).withColumn("pnl", F.round("pnl", 4))


CURVE = f"WITH {TRADES}, c AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY symbol, source ORDER BY exit_time, n ROWS UNBOUNDED PRECEDING) AS equity FROM trades)"


@query("equity_curve", f"{CURVE} SELECT n, symbol, round(equity, 4) AS equity FROM c")
def _(s, d):
    return metrics.equity_curve(trades(s, d)).select("n", "symbol", F.round("equity", 4).alias("equity"))


@query("max_drawdown", f"{CURVE}, m AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol, source ORDER BY exit_time, n ROWS UNBOUNDED PRECEDING)) AS top FROM c) SELECT symbol, source, round(max(top - equity), 4) AS max_drawdown FROM m GROUP BY 1, 2")
def _(s, d):
    return metrics.max_drawdown(trades(s, d)).withColumn("max_drawdown", F.round("max_drawdown", 4))


@query("sharpe", f"WITH {TRADES} SELECT symbol, source, round(CASE WHEN count(*) >= 2 AND stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END, 6) AS sharpe FROM trades GROUP BY 1, 2")
def _(s, d):
    return rounded(metrics.sharpe(trades(s, d)), "sharpe")


@query("unrealised", f"WITH {TICKS} SELECT seq, round(CASE WHEN seq % 3 = 0 THEN 0 ELSE (CASE WHEN seq % 3 = 1 THEN 1 ELSE -1 END) * (mid - 250) * 0.05 * 10 / CAST(0.1 AS DOUBLE) END, 6) AS unrealised FROM ticks")
def _(s, d):
    side = F.when(F.col("seq") % 3 == 0, 0).when(F.col("seq") % 3 == 1, 1).otherwise(-1)
    p = ticks(s, d).select("seq", side.alias("side"), F.lit(250.0).alias("entry_price"), F.lit(0.05).alias("lot"), "mid")
    return metrics.unrealised(p).select("seq", F.round("unrealised", 6).alias("unrealised"))


@query("gate_funnel", f"{STAGED_BOS} SELECT exit_reason AS reason, count(*) AS n FROM bt_out WHERE kind = 'reason' GROUP BY 1")
def _(s, d):
    return metrics.funnel(backtest.backtest(staged(s, d)))


@query("detections", f"{DENSE_FULL} SELECT count(*) FILTER (bos_detected_15m) AS bos, count(*) FILTER (choch_detected_15m) AS choch, count(*) FILTER (is_swing_high_15m) AS swing_highs, count(*) FILTER (is_swing_low_15m) AS swing_lows, count(DISTINCT fvg_timestamp) AS gaps FROM ft")
def _(s, d):
    return metrics.detections(dense(s, d).ticks)


@query("lot_multiplier", "SELECT event_id, CAST(floor((event_id % 11) / 10.0 * 5) AS INTEGER) AS multiplier FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", strategy.lot_multiplier(F.col("event_id") % 11).alias("multiplier"))


# ---------------------------------------------------------------- storage: what is written is read again

VENDOR = """v AS (SELECT date_trunc('millisecond', timestamp_utc) AS tick, CASE WHEN symbol IN ('click', 'view') THEN 'XAUUSD' ELSE 'EURUSD' END AS metal, symbol, seq, bid, ask, volume FROM raw WHERE bid > 0 AND ask > 0),
 w AS (SELECT *, CASE metal WHEN 'XAUUSD' THEN 1000.0::DOUBLE ELSE 100000.0::DOUBLE END AS scale FROM v)"""


def vendor_files(s, d):
    """The events as the vendor's hour files: two symbols, whose prices have different divisors."""
    metal = F.when(F.col("symbol").isin("click", "view"), "XAUUSD").otherwise("EURUSD")
    t = raw(s, d).filter("bid > 0 AND ask > 0").select(F.date_trunc("millisecond", "timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"), metal.alias("symbol"), "ask", "bid", F.col("volume").alias("ask_volume"), (F.col("volume") * 2).alias("bid_volume"))
    return bi5.encoded(t)


@query("decoded_hours", f"WITH {RAW}, {VENDOR} SELECT tick AS timestamp_utc, metal AS symbol, round_even(ask * scale, 0) / scale AS ask, round_even(bid * scale, 0) / scale AS bid, volume AS ask_volume, volume * 2 AS bid_volume FROM w")
def _(s, d):
    t = bi5.decoded(vendor_files(s, d))
    return t.select(F.col("timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"), "symbol", "ask", "bid", *[F.round(c, 1).alias(c) for c in ("ask_volume", "bid_volume")])


@query("decoded_hours_fixed", f"WITH {RAW}, {VENDOR} SELECT tick AS timestamp_utc, metal AS symbol, round_even(ask * scale, 0) / 100000.0::DOUBLE AS ask, round_even(bid * scale, 0) / 100000.0::DOUBLE AS bid, round(volume / 1000000, 9) AS ask_volume FROM w")
def _(s, d):
    t = bi5.decoded(vendor_files(s, d), fixed=True)
    return t.select(F.col("timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"), "symbol", "ask", "bid", F.round("ask_volume", 9).alias("ask_volume"))


@query("lake_months", f"WITH {RAW} SELECT timestamp_utc, symbol, bid, ask, seq, year(timestamp_utc) AS year, month(timestamp_utc) AS month FROM raw WHERE timestamp_utc >= TIMESTAMP '2024-01-01' AND timestamp_utc < TIMESTAMP '2024-02-01'")
def _(s, d):
    path = place(s, "lake")
    lake.write_ticks(raw(s, d).select("timestamp_utc", "symbol", "bid", "ask", "seq"), path)
    return lake.scan(s, path, (2024, 1), (2024, 1))


@query("lake_compacted", f"WITH {RAW} SELECT timestamp_utc, symbol, min(bid) AS bid FROM raw GROUP BY 1, 2 HAVING count(DISTINCT bid) = 1")
def _(s, d):
    path, target = place(s, "lake"), place(s, "lake-compacted")
    # Every tick twice, in two files; times at which a symbol has two prices are left out, as which of them stays is up to the files.
    t = raw(s, d).select("timestamp_utc", "symbol", "bid", "ask", "seq")
    alone = t.groupBy("timestamp_utc", "symbol").agg(F.count_distinct("bid").alias("n")).filter("n = 1").drop("n")
    for _ in range(2):
        lake.write_ticks(t.join(alone, ["timestamp_utc", "symbol"], "left_semi"), path)
    lake.compact(s, path, target)
    return s.read.parquet(target).select("timestamp_utc", "symbol", "bid")


@query("store_ticks", f"WITH {RAW} SELECT timestamp_utc, symbol, source, arg_min(bid, seq) AS bid, min(seq) AS seq FROM raw WHERE symbol IN ('click', 'view') GROUP BY 1, 2, 3")
def _(s, d):
    kept = store.TickStore(s, place(s, "store"))
    t = raw(s, d).filter("symbol IN ('click', 'view')").select("timestamp_utc", "symbol", "source", "bid", "seq")
    # The second insert overlaps with the first; the later rows of a key lose.
    first = t.withColumn("_n", F.row_number().over(W.partitionBy("timestamp_utc", "symbol", "source").orderBy("seq"))).filter("_n = 1 OR seq % 2 = 0").drop("_n")
    kept.insert("unified_ticks", first, order=["seq"])
    kept.insert("unified_ticks", t, order=["seq"])
    return kept.read("unified_ticks").select("timestamp_utc", "symbol", "source", "bid", "seq")


@query("store_candles", f"WITH {TICKS}, {bars_sql('b', '15 minutes')} SELECT symbol, source, bar_time, bar_open, CASE WHEN symbol = 'view' THEN bar_close + 1 ELSE bar_close END AS bar_close FROM b")
def _(s, d):
    kept = store.TickStore(s, place(s, "store"))
    b = stage(b15(s, d).select(*P.KEY, "bar_time", "bar_open", "bar_close"), "bars")
    kept.replace_symbols("candles_15m", b)
    # One symbol again, with a column that the table doesn't have: its rows are replaced, the others' and the columns stay.
    kept.replace_symbols("candles_15m", b.filter("symbol = 'view'").withColumn("bar_close", F.col("bar_close") + 1).withColumn("extra", F.lit(1)))
    return kept.read("candles_15m").select(*P.KEY, *[c for c in kept.read("candles_15m").columns if c not in P.KEY])


@query("store_features", f"WITH {TICKS} SELECT timestamp_utc, symbol, source, seq, mid, CASE WHEN symbol = 'click' THEN spread END AS spread FROM ticks")
def _(s, d):
    kept = store.TickStore(s, place(s, "store"))
    t = ticks(s, d).select("timestamp_utc", "symbol", "source", "seq", "mid", "spread")
    kept.replace_symbols("tick_features", t.withColumn("mid", F.lit(0.0)).drop("spread"))
    kept.replace_symbols("tick_features", t.filter("symbol <> 'click'").drop("spread"))
    # A new column widens the table; rows that were written before it have nulls.
    kept.replace_symbols("tick_features", t.filter("symbol = 'click'"))
    return kept.read("tick_features").select("timestamp_utc", "symbol", "source", "seq", "mid", "spread")


@query("store_decisions", f"WITH {RAW}, k AS (SELECT timestamp_utc, symbol, min(seq) AS seq FROM raw GROUP BY 1, 2) SELECT timestamp_utc, symbol, CASE WHEN seq % 3 = 0 THEN 'OPEN_T1_LONG' WHEN seq % 3 = 1 THEN 'OPEN_T1_SHORT' END AS decision, seq FROM k WHERE symbol = 'view' AND seq % 3 < 2")
def _(s, d):
    kept = store.TickStore(s, place(s, "store"))
    made = F.when(F.col("seq") % 3 == 0, "OPEN_T1_LONG").when(F.col("seq") % 3 == 1, "OPEN_T1_SHORT").otherwise("HOLD")
    t = raw(s, d).groupBy("timestamp_utc", "symbol").agg(F.min("seq").alias("seq")).withColumn("decision", made)
    for _ in range(2):  # a decision that is given again stays once
        kept.insert("trade_decisions", t, order=["seq"])
    return kept.decisions("view", held=False).select("timestamp_utc", "symbol", "decision", "seq")


@query("catalog_ticks", f"WITH {RAW} SELECT timestamp_utc, symbol, bid, ask, volume, source FROM raw WHERE symbol = 'view' AND bid > 50")
def _(s, d):
    # A database of its own, so that runs don't meet.
    db = catalog.Catalog(s, f"quotemill_{uuid.uuid4().hex[:12]}", place(s, "catalog"))
    db.create()
    db.append("unified_ticks", raw(s, d))
    return db.read("unified_ticks").filter("symbol = 'view' AND bid > 50").select(F.col("timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"), "symbol", "bid", "ask", "volume", "source")
