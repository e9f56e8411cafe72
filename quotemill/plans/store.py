"""The feature store: partitioned Parquet tables below one path, with additive schemas and key-safe writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stage import held_stage
from ..operators.silver import insert_or_ignore

#: Keys by which rows of a table are one.
KEYS = {
    "unified_ticks": ["timestamp_utc", "symbol", "source"], "tick_features": ["timestamp_utc", "symbol", "source"], "trade_decisions": ["timestamp_utc", "symbol"],
    "candles_1m": ["bar_time", "symbol", "source"], "candles_15m": ["bar_time", "symbol", "source"], "candles_4h": ["bar_time", "symbol", "source"],
}


class TickStore:
    """Tables are folders partitioned by symbol.  Replacing a symbol rewrites its partitions only; reads prune by symbol."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    def __enter__(self) -> TickStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open between calls."""

    def _where(self, table: str) -> str:
        if table not in KEYS:
            raise ValueError(f"unknown table {table}")
        return f"{self.path}/{table}"

    def _folder(self, table: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._where(table))
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        """Whether the table has files; a folder alone is none."""
        hadoop, files = self._folder(table)
        return files.exists(hadoop) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(hadoop))

    def prepare(self, table: str) -> str:
        """Makes the table's folder, so that a stream can wait for its files; returns its path."""
        hadoop, files = self._folder(table)
        files.mkdirs(hadoop)
        return self._where(table)

    def tables(self) -> list[str]:
        return [t for t in KEYS if self.exists(t)]

    def read(self, table: str) -> DataFrame:
        """All columns that any file of the table has; columns that older files lack are null."""
        return self.spark.read.option("mergeSchema", "true").parquet(self._where(table))

    def describe(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.read(table).schema], "column_name string, column_type string")

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        # A symbol's days are spread over tasks; a file holds its days in order, so reads of a time range skip row groups.
        order = [k for k in KEYS[table] if k != "symbol"]
        (df.repartition("symbol", F.to_date(order[0])).sortWithinPartitions("symbol", *order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(self._where(table)))

    def insert(self, table: str, rows: DataFrame, order: list[str] | None = None) -> int:
        """Adds rows whose key is new; returns how many were added.  Of equal keys among the rows the first stays.

        Of the table only the keys between the rows' first and last time are read.
        """
        keys = KEYS[table]
        order = order or [c for c in rows.columns if c not in keys][:1] or keys
        with held_stage(rows, f"insert-{table}") as given:
            seen = given.limit(0).select(*keys)
            if self.exists(table):
                ends = given.agg(F.min(keys[0]).cast("string").alias("a"), F.max(keys[0]).cast("string").alias("b")).first()
                time, kind = F.col(keys[0]), given.schema[keys[0]].dataType
                seen = self.read(table).filter(time.between(F.lit(ends.a).cast(kind), F.lit(ends.b).cast(kind)) | time.isNull()).select(*keys)
            with held_stage(insert_or_ignore(seen, given, keys, order), f"new-{table}") as new:
                n = new.count()
                if n:
                    self._write(new, table, "append")
                return n

    def replace_symbols(self, table: str, rows: DataFrame) -> None:
        """Puts rows in place of all rows of their symbols; other symbols stay.

        A candle table keeps the columns that it has: others of the rows are left out, missing ones are null.  Other
        tables grow by the rows' new columns.
        """
        if table.startswith("candles_") and self.exists(table):
            rows = conform(rows, self.read(table).schema)
        self._write(rows, table, "overwrite")

    def between(self, table: str, symbol: str, start, end) -> DataFrame:
        """Rows of a symbol from start to end, both included, in time order."""
        ts = KEYS[table][0]
        return self.read(table).filter((F.col("symbol") == symbol) & F.col(ts).between(F.lit(start), F.lit(end))).orderBy(ts)

    def candle_at(self, table: str, symbol: str, at) -> DataFrame:
        """The latest candle of a symbol at or before a time."""
        return self.read(table).filter((F.col("symbol") == symbol) & (F.col("bar_time") <= F.lit(at))).orderBy(F.col("bar_time").desc()).limit(1)

    def decisions(self, symbol: str, held: bool = True) -> DataFrame:
        d = self.read("trade_decisions").filter(F.col("symbol") == symbol)
        return (d if held else d.filter("decision <> 'HOLD'")).orderBy("timestamp_utc")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones null, others left out, types cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def unprocessed(landing: DataFrame, cleaned: DataFrame, key: str = "time_msc", limit: int | None = None) -> DataFrame:
    """Landing rows whose key isn't among the cleaned ones, in key order."""
    out = landing.join(cleaned.select(key).distinct(), key, "left_anti").select(*landing.columns).orderBy(key)
    return out.limit(limit) if limit else out
