"""The store's tables in the session's catalog: typed, partitioned by symbol, created once and widened, never narrowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import KEYS, TickStore, conform

# The columns of the tables, by what they tell; a column is in a table once.
_GAP = "fvg_high DOUBLE, fvg_low DOUBLE, fvg_side STRING, fvg_timestamp TIMESTAMP, fvg_filled BOOLEAN, fvg_age_bars INT"
_ATR = "atr_20_1m DOUBLE, atr_15_15m DOUBLE"
_SESSION = "prev_day_high DOUBLE, prev_day_low DOUBLE, current_session_high DOUBLE, current_session_low DOUBLE, prev_session_high DOUBLE, prev_session_low DOUBLE, session_boundary BOOLEAN"
_COUNTS = "n_confirmed_swing_highs_15m INT, n_confirmed_swing_lows_15m INT"
_NODES = "smc_trend_15m STRING, hh_15m DOUBLE, ll_15m DOUBLE, strong_low_15m DOUBLE, strong_high_15m DOUBLE, bos_detected_15m BOOLEAN, choch_detected_15m BOOLEAN, bos_up_15m BOOLEAN, bos_down_15m BOOLEAN, choch_up_15m BOOLEAN, choch_down_15m BOOLEAN, is_swing_high_15m BOOLEAN, is_swing_low_15m BOOLEAN"
_SWEEP = "sweep_candle_low DOUBLE, sweep_candle_high DOUBLE, sweep_wick DOUBLE, sweep_body DOUBLE"
_BAR = "bar_open DOUBLE, bar_high DOUBLE, bar_low DOUBLE, bar_close DOUBLE"
_CANDLE = "bar_time TIMESTAMP, source STRING, bar_open DOUBLE, bar_high DOUBLE, bar_low DOUBLE, bar_close DOUBLE"
COLUMNS = {
    "unified_ticks": "timestamp_utc TIMESTAMP, bid DOUBLE, ask DOUBLE, volume DOUBLE, volume_usd DOUBLE, source STRING",
    "tick_features": f"timestamp_utc TIMESTAMP, bid DOUBLE, ask DOUBLE, mid DOUBLE, volume DOUBLE, volume_usd DOUBLE, source STRING, {_BAR}, rsi_14 DOUBLE, atr_14 DOUBLE, liq_level DOUBLE, liq_type STRING, liq_side STRING, liq_tf STRING, liq_score DOUBLE, liq_confirmed BOOLEAN, liq_swept BOOLEAN, dist_to_nearest_high DOUBLE, dist_to_nearest_low DOUBLE, session STRING, structure_direction STRING, bos_detected BOOLEAN, choch_detected BOOLEAN, {_GAP}, price_position STRING, {_ATR}, {_SESSION}, {_COUNTS}, {_NODES}, market_bias_4h STRING, {_SWEEP}",
    "trade_decisions": f"timestamp_utc TIMESTAMP, decision STRING, reason STRING, score INT, mid DOUBLE, bid DOUBLE, ask DOUBLE, session STRING, {_GAP}, {_ATR}, {_SESSION}, {_COUNTS}, {_NODES}, market_bias_4h STRING, liq_swept BOOLEAN, liq_side STRING, {_SWEEP}",
    "candles_1m": f"{_CANDLE}, atr_20_1m DOUBLE",
    "candles_15m": f"{_CANDLE}, atr_15_15m DOUBLE, {_NODES}",
    "candles_4h": f"{_CANDLE}, market_bias_4h STRING",
    "landing_ticks": "bid DOUBLE, ask DOUBLE, last DOUBLE, volume DOUBLE, time_msc BIGINT, ingested_at TIMESTAMP",
    "cleaned_ticks": "bid DOUBLE, ask DOUBLE, spread DOUBLE, rsi DOUBLE, ema_20 DOUBLE, tick_time TIMESTAMP, time_msc BIGINT, cleaned_at TIMESTAMP",
}
#: Columns that hold a value in every row, besides a table's key.
REQUIRED = {"unified_ticks": ["bid", "ask"], "trade_decisions": ["decision"], "cleaned_ticks": ["time_msc"]} | {f"candles_{w}": ["bar_open", "bar_high", "bar_low", "bar_close"] for w in ("1m", "15m", "4h")}


def schema(table: str) -> T.StructType:
    """The table's columns, the symbol it is partitioned by last."""
    return T.StructType.fromDDL(f"{COLUMNS[table]}, symbol STRING")


def required(table: str) -> list[str]:
    return [*KEYS.get(table, []), *REQUIRED.get(table, [])]


class Catalog:
    """The tables of one database.  path: a shared folder to keep them below, the warehouse's otherwise; a TickStore on
    that path and this catalog are the same tables."""

    def __init__(self, spark: SparkSession, database: str, path: str | None = None):
        self.spark, self.database, self.path = spark, database, path and path.rstrip("/")

    def name(self, table: str) -> str:
        if table not in COLUMNS:
            raise ValueError(f"unknown table {table}")
        return f"`{self.database}`.`{table}`"

    def create(self) -> list[str]:
        """Creates what is missing, adds columns that older tables lack; returns the columns added as table.column."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
        for table in COLUMNS:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema(table))
            place = f" LOCATION '{self.path}/{table}'" if self.path else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet PARTITIONED BY (symbol){place}")
        return self.migrate()

    def migrate(self) -> list[str]:
        added = []
        for table in COLUMNS:
            have = {f.name.lower(): f for f in self.spark.table(self.name(table)).schema}
            wrong = [f.name for f in schema(table) if f.name in have and have[f.name].dataType != f.dataType]
            if wrong:
                raise ValueError(f"{table}: columns of another type: {wrong}; types are never changed in place")
            new = [f for f in schema(table) if f.name.lower() not in have]
            if new:
                self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
                added += [f"{table}.{f.name}" for f in new]
        return added

    def tables(self) -> list[str]:
        return sorted(r.tableName for r in self.spark.sql(f"SHOW TABLES IN `{self.database}`").collect())

    def describe(self, table: str) -> DataFrame:
        return self.spark.sql(f"DESCRIBE TABLE {self.name(table)}")

    def refresh(self) -> None:
        """Takes notice of partitions that a TickStore on the same path has written."""
        written = set(TickStore(self.spark, self.path).tables()) if self.path else set()
        for table in sorted(written & set(COLUMNS)):
            self.spark.sql(f"ALTER TABLE {self.name(table)} RECOVER PARTITIONS")
            self.spark.catalog.refreshTable(self.name(table))

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows in the table's columns and types: what it doesn't have is left out, what the rows lack is null.

        A null in a required column fails the write, before anything of it shows.
        """
        whole = conform(rows, self.spark.table(self.name(table)).schema)
        for c in required(table):
            whole = whole.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{table}.{c} is null")).cast(whole.schema[c].dataType)).otherwise(F.col(c)))
        whole.write.insertInto(self.name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))
