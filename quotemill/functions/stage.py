"""Written cuts in a plan: what several later steps read is computed once, and survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all machines share (unset: a local folder on a single machine, an error on a cluster)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quotemill-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to a place of its own and read back."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._quotemill_path = path
    return staged


@contextlib.contextmanager
def held_stage(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """stage(df, name) for the length of a block; its files go after it, so repeated writes (micro-batches) leave none."""
    staged = stage(df, name)
    try:
        yield staged
    finally:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(staged._quotemill_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
