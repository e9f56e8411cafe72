"""Structured Streaming forms: candles with a watermark, stateful decisions, and idempotent landing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators import silver
from ..operators.strategy import T1_LONG, T1_SHORT, Relay, decide, prepared, rows_of
from ..plans.store import TickStore
from .features import live_features


def candles(ticks: DataFrame, width: str, delay: str = "1 minute") -> DataFrame:
    """Bars of a stream of ticks, appended once the watermark (``delay`` behind the latest tick) has passed their end."""
    at = F.struct("timestamp_utc", "seq")
    bars = ticks.withWatermark("timestamp_utc", delay).groupBy("symbol", "source", F.window("timestamp_utc", width).alias("w")).agg(F.min_by("mid", at).alias("bar_open"), F.max("mid").alias("bar_high"), F.min("mid").alias("bar_low"), F.max_by("mid", at).alias("bar_close"))
    return bars.select("symbol", "source", F.col("w.start").alias("bar_time"), "bar_open", "bar_high", "bar_low", "bar_close")


DECISIONS = "symbol string, source string, timestamp_utc timestamp_ntz, decision string, reason string, score int"
STATE = "taken_bar bigint, opened boolean, direction string, time_ms bigint, r double"


def decisions(features: DataFrame) -> DataFrame:
    """The audit log of a stream of enriched ticks; each key's relay is state, ticks go in event order within a batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken, opened, direction, time_ms, r = state.get if state.exists else (None, False, None, None, None)
        relay = Relay(False, direction, time_ms, r, taken)
        out = []
        for row, now, bar in rows_of(pd.concat(list(frames))):
            if relay.taken_bar == bar:
                row |= {"t1_action": None, "t1_reason": None}
            action, reason, score = decide(row, now, relay, opened, False)
            if action in (T1_LONG, T1_SHORT):
                opened, relay.taken_bar = True, bar
                relay.direction, relay.time_ms, relay.r = ("bull" if action == T1_LONG else "bear"), now, row["r_dynamic"]
            out.append((*key, row["timestamp_utc"], action, reason, score))
        state.update((relay.taken_bar, opened, relay.direction, relay.time_ms, relay.r))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    return prepared(features).groupBy("symbol", "source").applyInPandasWithState(run, DECISIONS, STATE, "append", "NoTimeout")


def land(ticks: DataFrame, store_path: str, checkpoint: str, table: str = "unified_ticks"):
    """Starts a query that adds each batch's new keys to the store; a replayed batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        TickStore(df.sparkSession, store_path).insert(table, df)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def start(quotes: DataFrame, store_path: str, checkpoint: str, delay: str = "1 minute", every: str | None = None) -> list[StreamingQuery]:
    """The live loop: quotes of a terminal (symbol, bid, ask, last, volume, time_msc) into ticks, features and decisions.

    Three queries, each with its own checkpoint, hand over through the store: ticks are landed and, in state, enriched
    (``streaming.features``); decisions follow the features' files.  All writes are by key, so batches may be given again.
    every: a trigger interval ('15 seconds'); a source's batch size (as ``rate`` of the polled quotes) makes it a number of
    ticks.
    """
    spark = quotes.sparkSession
    unified = silver.unify_mt5(quotes).withColumn("seq", F.unix_millis("timestamp_utc"))
    store = TickStore(spark, store_path)

    def keep(table: str, order: str):
        def batch(df: DataFrame, _: int) -> None:
            store.insert(table, df, order=[order])

        return batch

    def started(df: DataFrame, name: str, batch) -> StreamingQuery:
        writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{name}").queryName(name)
        return (writer.trigger(processingTime=every) if every else writer).start()

    enriched = live_features(unified, delay)
    columns = T.StructType([f for f in enriched.schema if f.name != "symbol"] + [enriched.schema["symbol"]])
    features = spark.readStream.schema(columns).parquet(store.prepare("tick_features"))
    return [started(unified, "ticks", keep("unified_ticks", "bid")), started(enriched, "features", keep("tick_features", "seq")), started(decisions(features), "decisions", keep("trade_decisions", "decision"))]
