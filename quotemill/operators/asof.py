"""As-of joins by union and window, split by time so that no key is a single task."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.core import floor_to


def asof_backward(left: DataFrame, right: DataFrame, on: str, right_on: str, cols: list[str], keys=P.KEY, tie: list[str] | None = None, slice_width: str = "1 day") -> DataFrame:
    """left with cols of the last right row at or before ``on``, null before the first; ties go to the largest ``tie``.

    Both sides are cut into time slices.  A slice starts from the last right row of earlier slices, found by an
    aggregate with one row for each key and slice and a window over those rows alone.  Within a slice right rows, then
    left rows of equal time are ordered together, and the matched row is carried as one struct, nulls inside it kept.
    """
    keys = list(keys)
    tie = tie or []
    value = F.struct(*[F.col(c).alias(c) for c in cols])
    r = floor_to(right.filter(F.col(right_on).isNotNull()), right_on, slice_width, "_slice").select(*keys, "_slice", F.col(right_on).alias("_t"), F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"), value.alias("_v"))
    l = floor_to(left, on, slice_width, "_slice").withColumn("_row", F.struct(*left.columns))
    ends = r.groupBy(*keys, "_slice").agg(F.max_by("_v", F.struct("_t", "_tie")).alias("_end"))
    slices = l.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "full")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = slices.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).filter("_carry IS NOT NULL")
    row_type = l.schema["_row"].dataType
    nothing = F.lit(None).cast(row_type)
    tie_type = r.schema["_tie"].dataType
    both = (
        carry.select(*keys, "_slice", F.col("_slice").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.col("_carry").alias("_v"), nothing.alias("_row"))
        .unionByName(r.select(*keys, "_slice", "_t", F.lit(1).alias("_side"), "_tie", "_v", nothing.alias("_row")))
        .unionByName(l.select(*keys, "_slice", F.col(on).alias("_t"), F.lit(2).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), "_row"))
    )
    w = W.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).filter("_row IS NOT NULL")
    return out.select("_row.*", *[F.col(f"_m.{c}").alias(c) for c in cols])


@dataclass
class Fact:
    """Rows to look back at: those of ``rows`` by the time ``at`` give ``cols``; of equal times the largest ``tie`` counts."""

    rows: DataFrame
    at: str
    cols: list[str]
    tie: list[str] = field(default_factory=list)


def asof_many(left: DataFrame, on: str, facts: list[Fact], keys=P.KEY, slice_width: str = "15 minutes") -> DataFrame:
    """left with the columns of each fact's last row at or before ``on``, as asof_backward of one fact after the other would
    give, but with one exchange of left's rows (and one of its distinct slices).

    All facts and left go into one union, each fact a column of its own; within a slice one sort serves them all, and
    each fact's last row is carried by itself.  A slice starts from each fact's last row of earlier slices, and is a bar's
    width, so that days with very many rows of a key are many tasks.
    """
    keys = list(keys)
    kinds = {}
    rows = []
    for i, f in enumerate(facts):
        r = f.rows.filter(F.col(f.at).isNotNull()).select(*keys, F.col(f.at).alias("_t"), F.struct(*f.cols).alias(f"_f{i}"), F.struct(*f.tie).alias("_tie") if f.tie else F.lit(0).alias("_tie"))
        r = r.groupBy(*keys, "_t").agg(F.max_by(f"_f{i}", "_tie").alias(f"_f{i}")) if f.tie else r.drop("_tie")
        kinds[f"_f{i}"] = r.schema[f"_f{i}"].dataType
        rows.append(r)

    def aligned(df: DataFrame) -> DataFrame:
        return df.select(*keys, "_slice", "_t", "_side", *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.col("_row") if "_row" in df.columns else F.lit(None).cast(row_type).alias("_row"))

    whole = floor_to(left.select(*keys, F.col(on).alias("_t"), F.struct(*left.columns).alias("_row")), "_t", slice_width, "_slice").withColumn("_side", F.lit(2))
    row_type = whole.schema["_row"].dataType
    seen = aligned(floor_to(rows[0], "_t", slice_width, "_slice").withColumn("_side", F.lit(1)))
    for r in rows[1:]:
        seen = seen.unionByName(aligned(floor_to(r, "_t", slice_width, "_slice").withColumn("_side", F.lit(1))))
    ends = seen.groupBy(*keys, "_slice").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("_t", c))).alias(c) for c in kinds])
    slices = floor_to(left.select(*keys, F.col(on).alias("_t")), "_t", slice_width, "_slice").select(*keys, "_slice").distinct()
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = slices.join(ends, [*keys, "_slice"], "full").select(*keys, "_slice", F.col("_slice").alias("_t"), F.lit(0).alias("_side"), *[F.last(c, ignorenulls=True).over(before)[c].alias(c) for c in kinds])
    both = aligned(carry).unionByName(seen).unionByName(aligned(whole))
    w = W.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.select("_row", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in kinds]).filter("_row IS NOT NULL")
    return out.select("_row.*", *[F.col(f"_f{i}.{c}").alias(c) for i, f in enumerate(facts) for c in f.cols])


def bar_join(ticks: DataFrame, bars: DataFrame, width: str, cols: list[str], keys=P.KEY) -> DataFrame:
    """Each tick with its own bar's columns: an equi-join, as the bar of a tick always exists."""
    t = floor_to(ticks, "timestamp_utc", width, "_bar")
    b = bars.select(*keys, F.col("bar_time").alias("_bar"), *cols)
    return t.join(b, [*keys, "_bar"], "left").select(*ticks.columns, *cols)
