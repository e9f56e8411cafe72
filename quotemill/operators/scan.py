"""Linear recurrences as an associative scan: a key's rows are cut into slices of time that are worked on apart.

An exponential average x' = (1 - w) x + w u over a slice of rows is an affine map of the x before the slice, and maps of
slices that follow each other compose to one.  So each slice is reduced to its map, a key's slices (a row each) are
composed in order, and every slice starts from the x that its key's earlier slices lead to.  No task holds more than a
slice, whatever a key's history.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.core import floor_to

SLICE = "7 days"


@dataclass(frozen=True)
class Average:
    """An exponential average of column ``of`` with weight ``weight`` for the new value, that starts as the mean of the first
    ``seed`` values.  It shows from the ``shown``-th value on; before, it is ``early`` if the key has so many values, else
    null.  Null values leave it as it is."""

    of: str
    name: str
    weight: float
    seed: int = 1
    shown: int = 1
    early: float | None = None


def sliced(df: DataFrame, order: str, width: str = SLICE) -> DataFrame:
    """df with ``_slice``: the window of its time, or of a thousand of a number."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.NumericType):
        return df.withColumn("_slice", F.floor(F.col(order) / 1000).cast("long"))
    if isinstance(kind, T.DateType):
        return floor_to(df.withColumn("_time", F.col(order).cast("timestamp_ntz")), "_time", width, "_slice").drop("_time")
    return floor_to(df, order, width, "_slice")


def previous(df: DataFrame, col: str, name: str, keys=P.KEY, order: str = "bar_time") -> DataFrame:
    """df (with ``_slice``) with the value of the row before, which may be in an earlier slice."""
    keys = list(keys)
    ends = df.groupBy(*keys, "_slice").agg(F.max_by(col, order).alias("_end"))
    carry = ends.select(*keys, "_slice", F.lag("_end").over(W.partitionBy(*keys).orderBy("_slice")).alias("_before"))
    within = W.partitionBy(*keys, "_slice").orderBy(order)
    first = F.row_number().over(within) == 1
    return df.join(carry, [*keys, "_slice"]).withColumn(name, F.when(first, F.col("_before")).otherwise(F.lag(col).over(within))).drop("_before")


def _weights(n: int, w: float) -> np.ndarray:
    return w * (1 - w) ** np.arange(n - 1, -1, -1.0)


def _reduced(u: np.ndarray, a: Average) -> tuple[int, list[float], list[float]]:
    """Number of values, sums of the first 0, 1, … seed values, and what a slice that starts from 0 after so many ends at."""
    k = min(a.seed, len(u)) + 1
    heads = np.r_[0.0, np.cumsum(u[: k - 1])]
    part = _weights(len(u), a.weight) * u
    return len(u), heads.tolist(), (part.sum() - np.r_[0.0, np.cumsum(part[: k - 1])]).tolist()


def _composed(slices: list[tuple[int, list[float], list[float]]], a: Average) -> list[tuple[int, float, float | None]]:
    """What each slice starts from: number of values, their sum while they are fewer than the seed, and the average."""
    starts, n, total, x = [], 0, 0.0, None
    for m, heads, ends in slices:
        starts.append((n, total, x))
        if x is not None:
            x = (1 - a.weight) ** m * x + ends[0]
        elif n + m < a.seed:
            total += heads[m]
        else:
            k = a.seed - n
            x = (1 - a.weight) ** (m - k) * (total + heads[k]) / a.seed + ends[k]
        n += m
    return starts


def _run(x: float, u: np.ndarray, w: float) -> np.ndarray:
    return pd.Series(np.r_[x, u]).ewm(alpha=w, adjust=False).mean().to_numpy()[1:]


def _applied(values: np.ndarray, start: tuple[int, float, float | None], every: int, a: Average) -> np.ndarray:
    n, total, x = start
    valid = ~np.isnan(values)
    u = values[valid]
    if x is not None:
        out = _run(x, u, a.weight)
    elif n + len(u) < a.seed:
        out = np.full(len(u), np.nan)
    else:
        k = a.seed - n
        first = (total + u[:k].sum()) / a.seed
        out = np.r_[np.full(k - 1, np.nan), first, _run(first, u[k:], a.weight)]
    hidden = n + 1 + np.arange(len(u)) < a.shown
    early = a.early if a.early is not None and every >= a.shown else np.nan
    out[hidden] = early
    whole = np.full(len(values), np.nan)
    whole[valid] = out
    before = early if n < a.shown - 1 or x is None else x
    return pd.Series(np.r_[before, whole]).ffill().to_numpy()[1:]


def averages(df: DataFrame, wanted: list[Average], keys=P.KEY, order: str = "bar_time") -> DataFrame:
    """df (with ``_slice``) with the averages added; a row per slice is composed for each key."""
    keys, names = list(keys), [a.name for a in wanted]
    df = df.select(*[c for c in df.columns if c not in names])
    parts = [T.StructField(f"_{k}{i}", t) for i in range(len(wanted)) for k, t in (("n", T.LongType()), ("heads", T.ArrayType(T.DoubleType())), ("ends", T.ArrayType(T.DoubleType())))]
    key_fields = [df.schema[c] for c in (*keys, "_slice")]

    def reduce(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        row = [x for a in wanted for x in _reduced(g[a.of].dropna().to_numpy(float), a)]
        return pd.DataFrame([[*key, *row]], columns=[f.name for f in (*key_fields, *parts)])

    starts = [T.StructField(f"_{k}{i}", t) for i in range(len(wanted)) for k, t in (("n", T.LongType()), ("total", T.DoubleType()), ("x", T.DoubleType()))] + [T.StructField(f"_all{i}", T.LongType()) for i in range(len(wanted))]

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_slice").reset_index(drop=True)
        out = g[[f.name for f in key_fields]].copy()
        for i, a in enumerate(wanted):
            found = _composed(list(zip(g[f"_n{i}"], g[f"_heads{i}"], g[f"_ends{i}"])), a)
            for k, c in enumerate(("n", "total", "x")):
                out[f"_{c}{i}"] = [f[k] for f in found]
        for i in range(len(wanted)):
            out[f"_all{i}"] = int(g[f"_n{i}"].sum())
        return out[[f.name for f in (*key_fields, *starts)]]

    def apply(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        s = start.iloc[0]
        made = {}
        for i, a in enumerate(wanted):
            x = s[f"_x{i}"]
            made[a.name] = _applied(rows[a.of].to_numpy(float), (int(s[f"_n{i}"]), float(s[f"_total{i}"]), None if pd.isna(x) else float(x)), int(s[f"_all{i}"]), a)
        return rows.assign(**made)

    reduced = df.groupBy(*keys, "_slice").applyInPandas(reduce, T.StructType([*key_fields, *parts]))
    composed = reduced.groupBy(*keys).applyInPandas(compose, T.StructType([*key_fields, *starts]))
    out = df.groupBy(*keys, "_slice").cogroup(composed.groupBy(*keys, "_slice")).applyInPandas(apply, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
