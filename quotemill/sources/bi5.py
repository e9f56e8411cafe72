"""Vendor hour files: names, trading hours, landing plan, decoder and encoder of the binary format."""

from __future__ import annotations

import datetime as dt
import lzma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P

#: Fixed format: big-endian milliseconds in the hour, ask and bid as integers, ask and bid volume; 20 bytes.
ROW = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
TICKS = "timestamp_utc timestamp, ask double, bid double, ask_volume double, bid_volume double, symbol string"


def hour_name(symbol: Column, hour: Column) -> Column:
    """The file of an hour, relative to the vendor's root; its months count from 0."""
    return F.format_string("%s/%04d/%02d/%02d/%02dh_ticks.bi5", symbol, F.year(hour), F.month(hour) - 1, F.day(hour), F.hour(hour))


def trading_hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every hour from start to before end, Saturdays and Sundays left out."""
    hours = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour")
    return hours.filter(F.weekday("hour") < 5)


def landing_plan(hours: DataFrame, symbol: str, landed: DataFrame) -> DataFrame:
    """The hours whose file is not landed yet (landed: column file), with its name."""
    named = hours.withColumn("file", hour_name(F.lit(symbol), F.col("hour")))
    return named.join(landed.select("file").distinct(), "file", "left_anti")


def retry_delay(attempt: int, throttled: bool = True, base: float = 5.0, cap: float = 120.0) -> float:
    """Seconds before another try: doubling for throttling answers, linear for network errors; jitter is the caller's."""
    return min(2**attempt * base, cap) if throttled else base * (attempt + 1)


def divisor(symbol: str) -> float:
    return P.METAL_DIVISOR if symbol.upper() in P.METALS else P.FX_DIVISOR


def unpacked(data: bytes) -> bytes:
    return lzma.decompress(data) if data else b""


def fault_of(data: bytes) -> str | None:
    """Why an hour's data is not what it should be, or null; an empty file is an hour without ticks."""
    try:
        return "cut" if len(unpacked(data)) % ROW.itemsize else None
    except lzma.LZMAError as e:
        return f"unreadable: {e}"


def decode(data: bytes, hour: dt.datetime, symbol: str, fixed: bool = False) -> pd.DataFrame:
    """Ticks of one compressed hour; a cut last row is ignored, unreadable data gives none.

    fixed: the older rule, which divides every symbol by 100 000 and leaves volumes as they are.
    """
    try:
        raw = unpacked(data)
    except lzma.LZMAError:
        raw = b""
    rows = np.frombuffer(raw[: len(raw) // ROW.itemsize * ROW.itemsize], ROW)
    by, scale = (P.FX_DIVISOR, 1.0) if fixed else (divisor(symbol), P.VOLUME_SCALE)
    out = pd.DataFrame({"timestamp_utc": pd.Timestamp(hour) + pd.to_timedelta(rows["ms"].astype("int64"), unit="ms")})
    for c in ("ask", "bid"):
        out[c] = rows[c].astype("float64") / by
    for c in ("ask_volume", "bid_volume"):
        out[c] = rows[c].astype("float64") * scale
    return out.assign(symbol=symbol)


def encode(ticks: pd.DataFrame, hour: dt.datetime, symbol: str) -> bytes:
    """The inverse of decode, for fixtures."""
    rows = np.zeros(len(ticks), ROW)
    rows["ms"] = ((ticks["timestamp_utc"] - pd.Timestamp(hour)) // pd.Timedelta("1ms")).astype("int64")
    for c in ("ask", "bid"):
        rows[c] = np.round(ticks[c] * divisor(symbol)).astype("int64")
    for c in ("ask_volume", "bid_volume"):
        rows[c] = ticks[c] / P.VOLUME_SCALE
    return lzma.compress(rows.tobytes(), format=lzma.FORMAT_ALONE)


def encoded(ticks: DataFrame) -> DataFrame:
    """(symbol, hour, file, content): the hour files of ticks (timestamp_utc, symbol, ask, bid, ask_volume, bid_volume)."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        symbol, hour = key
        return pd.DataFrame({"symbol": [symbol], "hour": [hour], "content": [encode(g.sort_values("timestamp_utc", kind="stable"), hour, symbol)]})

    at = F.window("timestamp_utc", "1 hour")["start"].cast("timestamp_ntz")
    hours = ticks.withColumn("hour", at).groupBy("symbol", "hour").applyInPandas(run, "symbol string, hour timestamp_ntz, content binary")
    return hours.withColumn("file", hour_name(F.col("symbol"), F.col("hour")))


def decoded(hours: DataFrame, fixed: bool = False) -> DataFrame:
    """The ticks of hour files (symbol, hour, file, content), with their file."""

    def run(batches):
        for b in batches:
            for symbol, hour, file, content in zip(b["symbol"], b["hour"], b["file"], b["content"]):
                yield decode(bytes(content), hour.to_pydatetime(), symbol, fixed).assign(file=file)

    return hours.select("symbol", "hour", "file", "content").mapInPandas(run, f"{TICKS}, file string")


def read(spark: SparkSession, path: str, fixed: bool = False) -> DataFrame:
    """Ticks of all hour files below path; symbol and hour come from each file's name.  One pass, no shuffle."""
    return read_checked(spark, path, fixed).filter("fault IS NULL OR fault = 'cut'").filter("timestamp_utc IS NOT NULL").drop("file", "fault")


def read_checked(spark: SparkSession, path: str, fixed: bool = False) -> DataFrame:
    """Ticks of all hour files below path with their file, and a row without a tick for each file that has a ``fault``:
    unreadable, cut (its whole rows are there too), or misnamed.  Written once, ticks and rejects part without a second read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bi5").load(path).select("path", "content")
    names = [c.split()[0] for c in TICKS.split(", ")]

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    symbol, year, month, day, hour = name.rsplit("/", 5)[1:]
                    at = dt.datetime(int(year), int(month) + 1, int(day), int(hour[:2]))
                except ValueError:
                    fault = "misnamed"
                else:
                    fault = fault_of(content)
                    yield decode(content, at, symbol, fixed).assign(file=name, fault=None)
                if fault:
                    yield pd.DataFrame({c: [None] for c in names} | {"file": [name], "fault": [fault]}).astype({"timestamp_utc": "datetime64[us]"})

    return files.mapInPandas(run, f"{TICKS}, file string, fault string")
