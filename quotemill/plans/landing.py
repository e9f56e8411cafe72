"""Landing and cleaned ticks in a database behind JDBC: tables, partitioned reads, and writes that add a key once."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stage import held_stage
from ..operators import indicators, silver

#: Types, and a name that one of them reserves, by dialect; the tables' columns.
TYPES = {
    "postgresql": {"id": "BIGSERIAL PRIMARY KEY", "number": "DOUBLE PRECISION", "time": "TIMESTAMPTZ", "now": "TIMESTAMPTZ DEFAULT NOW()", "last": "last"},
    "derby": {"id": "BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY", "number": "DOUBLE PRECISION", "time": "TIMESTAMP", "now": "TIMESTAMP DEFAULT CURRENT_TIMESTAMP", "last": '"LAST"'},
}
TABLES = {
    "landing_ticks": "id {id}, symbol VARCHAR(20), bid {number}, ask {number}, {last} {number}, volume {number}, time_msc BIGINT, ingested_at {now}",
    "cleaned_ticks": "id {id}, symbol VARCHAR(20), bid {number}, ask {number}, spread {number}, rsi {number}, ema_20 {number}, tick_time {time}, cleaned_at {now}, time_msc BIGINT NOT NULL, CONSTRAINT unique_time_msc UNIQUE (time_msc)",
    "trade_decisions": "id {id}, symbol VARCHAR(20), decision VARCHAR(20), reason VARCHAR(255), score INTEGER, bid {number}, ask {number}, rsi {number}, ema_20 {number}, spread {number}, tick_time {time} NOT NULL, decided_at {now}, smc_trend_15m VARCHAR(10), bos_detected_15m BOOLEAN, choch_detected_15m BOOLEAN, market_bias_4h VARCHAR(10), liq_swept BOOLEAN, liq_side VARCHAR(10), CONSTRAINT unique_trade_tick_time UNIQUE (tick_time)",
}
KEYS = {"cleaned_ticks": "time_msc", "trade_decisions": "tick_time"}


@dataclass
class Database:
    """A database that Spark reads and writes over JDBC; its driver's jar is on the cluster's class path."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    #: Rows that a read is parted by, and that a fetch holds at once.
    partitions: int = 8
    fetch: int = 10_000

    @property
    def dialect(self) -> str:
        return self.url.split(":")[1]

    @contextlib.contextmanager
    def _connection(self) -> Iterator:
        jvm = self.spark._jvm
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"])
        info = jvm.java.util.Properties()
        for k, v in self.properties.items():
            info.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, info)
        try:
            yield connection
        finally:
            connection.close()

    def create(self) -> list[str]:
        """Creates the tables that are missing; returns their names."""
        made = []
        with self._connection() as c:
            rows = c.getMetaData().getTables(None, None, "%", None)
            have = set()
            while rows.next():
                have.add(rows.getString("TABLE_NAME").lower())
            for table, columns in TABLES.items():
                if table not in have:
                    c.createStatement().execute(f"CREATE TABLE {table} ({columns.format(**TYPES[self.dialect])})")
                    made.append(table)
        return made

    def read(self, table: str, by: str | None = None) -> DataFrame:
        """A table or subquery; by: a whole-number column to part the read by, between its least and greatest value."""
        ask = {"url": self.url, "fetchsize": str(self.fetch), **self.properties}
        parted = {}
        if by:
            ends = self.spark.read.format("jdbc").options(query=f"SELECT MIN({by}) AS lo, MAX({by}) AS hi FROM {table}", **ask).load().first()
            if ends[0] is not None and ends[1] > ends[0]:
                parted = {"partitionColumn": by, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(self.partitions)}
        return self.spark.read.format("jdbc").options(dbtable=table, **parted, **ask).load()

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.format("jdbc").options(url=self.url, dbtable=table, batchsize=str(self.fetch), **self.properties).mode("append").save()

    def insert(self, rows: DataFrame, table: str) -> int:
        """Adds rows whose key is new, of equal keys one; returns how many.  Adding the same rows again adds nothing, so a
        batch whose write broke off is simply given again.  Of the table only keys in the rows' range are read; one writer."""
        key = KEYS[table]
        with held_stage(rows, f"insert-{table}") as given:
            ends = given.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
            if ends[0] is None:
                return 0
            literal = (lambda x: f"TIMESTAMP('{x}')" if self.dialect == "derby" else f"TIMESTAMP '{x}'") if key == "tick_time" else str
            seen = self.read(f"(SELECT {key} FROM {table} WHERE {key} BETWEEN {literal(ends[0])} AND {literal(ends[1])}) seen").withColumnRenamed(key.upper(), key)
            order = [c for c in given.columns if c != key] or [key]
            with held_stage(silver.insert_or_ignore(seen, given.filter(F.col(key).isNotNull()), [key], order), f"new-{table}") as new:
                n = new.count()
                if n:
                    self.append(new, table)
                return n

    def unprocessed(self, limit: int | None = 100) -> DataFrame:
        """Landing rows that are not cleaned yet, by time_msc; the database leaves the others out, the read is parted."""
        open_rows = "(SELECT l.* FROM landing_ticks l WHERE NOT EXISTS (SELECT 1 FROM cleaned_ticks c WHERE c.time_msc = l.time_msc)) l"
        rows = self.read(open_rows, by="time_msc")
        rows = rows.toDF(*[c.lower() for c in rows.columns]).orderBy("time_msc", "id")
        return rows.limit(limit) if limit else rows


def cleaned(rows: DataFrame) -> DataFrame:
    """Landing rows as cleaned_ticks: spread, RSI and EMA of the bid over the rows of a symbol, and the tick's time."""
    t = rows.filter("time_msc IS NOT NULL").withColumn("source", F.lit("landing")).withColumn("tick_time", F.timestamp_millis("time_msc"))
    # Rows of one time keep an order of their own.
    t = t.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy("time_msc", "id")))
    t = indicators.ema(t, price="bid", name="ema_20", order="_n")
    t = indicators.rsi(t, name="rsi", price="bid", order="_n")
    return t.select("symbol", "bid", "ask", (F.col("ask") - F.col("bid")).alias("spread"), "rsi", "ema_20", "tick_time", "time_msc")


def clean(db: Database, limit: int | None = 100) -> int:
    """One round of the cleaner: the open landing rows, cleaned and added."""
    return db.insert(cleaned(db.unprocessed(limit)), "cleaned_ticks")


def land(quotes: DataFrame, db: Database, checkpoint: str):
    """A stream of quotes (symbol, bid, ask, last, volume, time_msc) into landing_ticks.  A batch that is given again after a
    break adds only what its earlier try did not: rows are told by (symbol, time_msc)."""

    def batch(df: DataFrame, _: int) -> None:
        with held_stage(df.select("symbol", "bid", "ask", "last", "volume", "time_msc"), "landing") as given:
            ends = given.agg(F.min("time_msc"), F.max("time_msc")).first()
            if ends[0] is None:
                return
            seen = db.read(f"(SELECT symbol, time_msc FROM landing_ticks WHERE time_msc BETWEEN {ends[0]} AND {ends[1]}) seen")
            seen = seen.toDF(*[c.lower() for c in seen.columns])
            db.append(given.join(seen.distinct(), ["symbol", "time_msc"], "left_anti"), "landing_ticks")

    return quotes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
