"""A streaming source of quotes through Spark's Python data source API, for terminals that can only be polled."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "symbol string, bid double, ask double, last double, volume double, time_msc bigint"


class QuoteSource(DataSource):
    """``spark.readStream.format("quotes")``: a deterministic feed of ``rate`` quotes a batch from ``start_msc`` on, which
    stands in for a terminal; a subclass overrides ``quote``."""

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self)

    def quote(self, n: int) -> tuple:
        o = self.options
        bid = float(o.get("bid", "100")) + (n * 7919 % 101) / 100
        return o.get("symbol", "XAUUSD"), bid, bid + 0.16, bid, 1.0, int(o.get("start_msc", "0")) + n * 1000


class _Reader(SimpleDataSourceStreamReader):
    """A poll reads on from the offset that the engine holds, so a restart from a checkpoint goes on where it stopped."""

    def __init__(self, source: QuoteSource):
        self.source, self.rate, self.limit = source, int(source.options.get("rate", "50")), int(source.options.get("limit", "1000000000"))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"n": max(start["n"], min(self.limit, start["n"] + self.rate))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.source.quote(n) for n in range(start["n"], end["n"])])
