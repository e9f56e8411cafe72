"""Where intermediate tables go, and how texts reach Python in bounded pieces."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a single machine (tests) uses a local temporary folder; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quotemill-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task, one thing at a time: asking for another lets the last one go."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def released(run: Callable) -> Callable:
    """run, as a task that keeps nothing afterwards: workers live on, so free memory goes back to the system."""

    def whole(batches):
        _held.clear()
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes at most (one long text may exceed it)."""
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + 50_000, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def utf8_buffer(column: pa.Array):
    """(bytes, offsets) of a string column without copying its data; null counts as empty."""
    import numpy as np

    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]
