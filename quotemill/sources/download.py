"""The vendor's hour files as a Spark data source: hours are fetched in tasks, each with its own outcome, and landed by month.

``spark.read.format("hour_files")`` gives a row for each trading hour: file, hour, status, attempts, content.  A partition is
one slot of requests; it asks for its hours one after the other with a least gap, so that the number of partitions and the
gap bound the rate.  Answers of 404 mean an hour without ticks; 429, 502 and 503 are tried again after doubling delays,
network errors and other answers after growing ones, both with jitter; after the last try the hour is given up.
"""

from __future__ import annotations

import datetime as dt
import importlib
import random
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.stage import held_stage
from . import bi5, lake

SCHEMA = "symbol string, hour timestamp_ntz, file string, status string, attempts int, content binary"
THROTTLED = (429, 502, 503)
SLOTS, GAP_S, RETRIES, TIMEOUT_S = 2, 1.5, 8, 60


def get(url: str) -> tuple[int, bytes]:
    """The default transport: HTTP status and body; OSError for network errors."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=TIMEOUT_S) as answer:  # noqa: S310
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def named(place: str) -> Callable:
    """The function at ``module:name``, found where the code runs."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def fetch(url: str, transport: Callable[[str], tuple[int, bytes]], sleep: Callable[[float], None], retries: int, gap: float) -> tuple[str, int, bytes | None]:
    """(status, attempts, body): fetched, missing, empty or failed."""
    for attempt in range(retries):
        sleep(gap)
        try:
            code, body = transport(url)
        except OSError:
            code, body = 0, b""
        if code == 404:
            return "missing", attempt + 1, None
        if code == 200:
            return ("fetched", attempt + 1, body) if body else ("empty", attempt + 1, None)
        if attempt + 1 < retries:
            if code in THROTTLED:
                base = bi5.retry_delay(attempt)
                sleep(base + random.uniform(0, base))
            else:
                sleep(bi5.retry_delay(attempt, throttled=False, base=4.0) + random.uniform(1, 5))
    return "failed", retries, None


class Slot(InputPartition):
    def __init__(self, hours: list[dt.datetime]):
        self.hours = hours


class HourFiles(DataSource):
    """Options: root, symbol, start, end (before it), skip (file names that are landed, parted by commas), slots, gap, retries,
    transport and sleep (``module:name``)."""

    @classmethod
    def name(cls) -> str:
        return "hour_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Hours(dict(self.options))


class _Hours(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        start, end = (dt.datetime.fromisoformat(self.o[k]) for k in ("start", "end"))
        skip = set(self.o.get("skip", "").split(","))
        every = [start + dt.timedelta(hours=k) for k in range(max(0, int((end - start) / dt.timedelta(hours=1))))]
        hours = [h for h in every if h.weekday() < 5 and file_of(self.o["symbol"], h) not in skip]
        slots = max(1, min(int(self.o.get("slots", SLOTS)), len(hours)))
        return [Slot(hours[k::slots]) for k in range(slots)]

    def read(self, partition: Slot) -> Iterator[tuple]:
        transport, sleep = named(self.o.get("transport", f"{__name__}:get")), named(self.o.get("sleep", "time:sleep"))
        for hour in partition.hours:
            file = file_of(self.o["symbol"], hour)
            status, attempts, body = fetch(f"{self.o['root'].rstrip('/')}/{file}", transport, sleep, int(self.o.get("retries", RETRIES)), float(self.o.get("gap", GAP_S)))
            yield self.o["symbol"], hour, file, status, attempts, body


def file_of(symbol: str, hour: dt.datetime) -> str:
    """bi5.hour_name of one hour."""
    return f"{symbol}/{hour.year:04d}/{hour.month - 1:02d}/{hour.day:02d}/{hour.hour:02d}h_ticks.bi5"


def months(start: dt.datetime, end: dt.datetime) -> Iterator[tuple[dt.datetime, dt.datetime]]:
    while start < end:
        after = (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        yield start, min(after, end)
        start = after


def download(spark: SparkSession, root: str, symbol: str, start: str, end: str, path: str, **options: str | int | float) -> dict[str, int]:
    """Lands the trading hours of the days start to end, both included, below path and tells what became of them.

    Hours that ``<path>/hours`` lists as landed are not asked for again; failed ones are, at the next call.  A month's ticks
    are written before its hours are listed, and a month that broke off between the two is written anew, so ticks may be
    there twice until ``lake.compact`` keeps each once.  ``hours_skipped``: missing, empty, unreadable or given up.
    """
    spark.dataSource.register(HourFiles)
    told: Counter = Counter(ticks_saved=0, files_written=0, hours_skipped=0, hours_resumed=0)
    first, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end) + dt.timedelta(days=1)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hours")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for a, b in months(first, last):
        landed = []
        if files.exists(place):  # a month has some 550 hours
            landed = [r.file for r in spark.read.parquet(f"{path}/hours").filter((F.col("symbol") == symbol) & F.col("hour").between(F.lit(a), F.lit(b - dt.timedelta(hours=1)))).select("file").distinct().collect()]
        told["hours_resumed"] += len(landed)
        reader = spark.read.format("hour_files").options(root=root, symbol=symbol, start=a.isoformat(), end=b.isoformat(), skip=",".join(landed), **{k: str(v) for k, v in options.items()})
        with held_stage(reader.load(), "hours") as hours, held_stage(bi5.decoded(hours.filter("status = 'fetched'")), "ticks") as ticks:
            by = {r.file: r.n for r in ticks.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
            if by:
                lake.write_ticks(ticks.drop("file"), f"{path}/ticks")
            got = hours.join(ticks.select("file").distinct().withColumn("full", F.lit(True)), "file", "left")
            status = F.when(F.col("full"), "landed").when(F.col("status") == "fetched", "unreadable").otherwise(F.col("status"))
            outcome = got.select("symbol", "hour", "file", status.alias("status"), "attempts")
            outcome.filter("status <> 'failed'").write.mode("append").parquet(f"{path}/hours")
            told["ticks_saved"] += sum(by.values())
            told["files_written"] += len(by)
            told["hours_skipped"] += outcome.filter("status <> 'landed'").count()
    return dict(told)
