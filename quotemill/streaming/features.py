"""Features of a stream of ticks, kept up bar by bar in typed state: no history is read again.

Each key's ticks wait until the watermark has passed them, so they are taken in event order however they arrive; rows later
than that are Spark's to drop.  An event-time timer at the first waiting tick wakes the key when no new rows come.  What
a tick sees equals ``build_features(ticks, causal=True)``, across restarts too, as all that the rules know is in the state
(``operators.online``): bars being made, the last few closed ones, averages, structure, bias, open gaps, session ranges, the
last swings and snapshots.  Its size doesn't grow with time, but for the ticks within the watermark's delay.

Spark keeps such state in RocksDB: set spark.sql.streaming.stateStore.providerClass to RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.core import session_label
from ..operators.online import KEPT, MINUTE, NAMES, SEEN, STATE, Online, columns

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "at bigint, seq bigint, bid double, ask double, mid double, spread double"
#: The values seen last, as state: times as microseconds.
NOW = f"{SEEN}, {KEPT}".replace("fvg_timestamp timestamp", "fvg_timestamp bigint")
RESULT = f"symbol string, source string, timestamp_utc timestamp, seq bigint, bid double, ask double, mid double, spread double, {SEEN}"


class Live(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.parts = {name: handle.getListState(name, schema) for name, schema in STATE.items()}
        self.now = handle.getValueState("now", NOW)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for g in rows:
            at = g["timestamp_utc"].to_numpy("datetime64[us]").astype(np.int64)
            new += zip(at.tolist(), *(g[c].tolist() for c in columns(WAITING)[1:]))
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        ticks = sorted([*(tuple(r) for r in self.waiting.get()), *new])
        ready = [t for t in ticks if t[0] <= watermark_ms * 1000]
        later = ticks[len(ready) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if ready:
            yield self._seen(key, ready)

    def _seen(self, key: tuple, ticks: list[tuple]) -> pd.DataFrame:
        last = self.now.get() if self.now.exists() else None
        online = Online.restore({n: [tuple(r) for r in s.get()] for n, s in self.parts.items()}, None if last is None else dict(zip(columns(NOW), last)))
        own = pd.DataFrame(ticks, columns=columns(WAITING))
        minute = own["at"].to_numpy() // MINUTE
        cuts = [0, *(np.flatnonzero(np.diff(minute)) + 1).tolist(), len(own)]
        mid, seen = own["mid"].to_numpy(), []
        for a, b in zip(cuts, cuts[1:]):
            part = mid[a:b]
            now = online.tick_minute(int(minute[a]) * MINUTE, float(part[0]), float(part.max()), float(part.min()), float(part[-1]))
            seen += [tuple(now[c] for c in NAMES)] * (b - a)
        for name, rows in online.parts().items():
            if rows:
                self.parts[name].put(rows)
            else:
                self.parts[name].clear()
        self.now.update(tuple(online.now[c] for c in columns(NOW)))
        facts = pd.DataFrame(seen, columns=NAMES, dtype=object)
        facts["fvg_timestamp"] = pd.to_datetime(facts["fvg_timestamp"].astype("Int64"), unit="us")
        own.insert(0, "timestamp_utc", own.pop("at").to_numpy().astype("datetime64[us]"))
        own.insert(0, "source", key[1])
        own.insert(0, "symbol", key[0])
        return pd.concat([own, facts], axis=1)[columns(RESULT)]


def live_features(ticks: DataFrame, delay: str = "1 minute") -> DataFrame:
    """ticks (a stream: timestamp_utc timestamp, symbol, source, bid, ask, mid, spread, seq) with the features each sees."""
    rows = ticks.select("symbol", "source", "timestamp_utc", *columns(WAITING)[1:]).withWatermark("timestamp_utc", delay)
    seen = rows.groupBy("symbol", "source").transformWithStateInPandas(Live(), RESULT, "Append", "EventTime")
    return seen.withColumn("session", session_label(F.col("timestamp_utc")))
