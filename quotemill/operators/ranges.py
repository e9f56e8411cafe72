"""Questions about ranges of values, answered by sorted arrays in place of comparisons with every value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.stage import stage


class Minima:
    """The least of any stretch of an array, from a table of the least of 1, 2, 4, … values in a row: two looks each."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values)]
        while (1 << len(self.rows)) <= len(values):
            last, k = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-k], last[k:]))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Over [start, stop); none of them empty."""
        out = np.empty(len(start), self.rows[0].dtype)
        level = np.frexp((stop - start).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[start[at]], row[stop[at] - (1 << int(k))])
        return out


def count_up_to(points: DataFrame, at: Column, values: DataFrame, value: str, name: str, strict: bool = False, keys=P.KEY) -> DataFrame:
    """points with the number of their key's values at most ``at`` (below it, if strict); null points get 0.

    Values and points meet in price cells of about a hundred values on average: counts of cells are summed up over a row
    per cell, and within a cell one sort serves all points.  No point is compared with a value one by one.
    """
    keys = list(keys)
    v = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    ends = v.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("_n"))
    width = F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / F.greatest(F.ceil(F.col("_n") / 100), F.lit(1))).otherwise(1.0)
    ends = ends.select(*keys, "_low", width.alias("_width"), F.ceil(F.col("_n") / 100).alias("_cells"))
    # Clamped, so that points beyond all values share the outer cells.
    cell = F.floor(F.least(F.greatest((F.col("_x") - F.col("_low")) / F.col("_width"), F.lit(-1.0)), F.col("_cells") + F.lit(1.0))).cast("long")
    p = points.select(*keys, F.struct(*points.columns).alias("_row"), at.cast("double").alias("_x")).join(ends, keys, "left")
    row_type = p.schema["_row"].dataType
    v = v.join(ends, keys)
    counts = v.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_k"))
    cells = counts.select(*keys, "_cell").union(p.select(*keys, cell.alias("_cell"))).distinct()
    before = F.sum("_k").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    base = cells.join(counts, [*keys, "_cell"], "left").select(*keys, "_cell", F.coalesce(before, F.lit(0)).alias("_base"))
    first, second = (1, 0) if strict else (0, 1)  # of equal values and points, which is sorted first
    both = v.select(*keys, cell.alias("_cell"), "_x", F.lit(first).alias("_side"), F.lit(1).alias("_one"), F.lit(None).cast(row_type).alias("_row")).unionByName(p.select(*keys, cell.alias("_cell"), "_x", F.lit(second).alias("_side"), F.lit(0).alias("_one"), "_row"))
    within = F.sum("_one").over(W.partitionBy(*keys, "_cell").orderBy("_x", "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = both.withColumn("_within", within).filter("_row IS NOT NULL").join(base, [*keys, "_cell"], "left")
    return found.select("_row.*", F.when(F.col("_x").isNull(), 0).otherwise(F.coalesce("_base", F.lit(0)) + F.coalesce("_within", F.lit(0))).cast("long").alias(name))


#: Days of a block, from the widest to a day; each but the first is a part of the one before.
TIERS = (512, 64, 8, 1)


def day_number(at: str) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 86_400_000_000).cast("long")


def first_hit(points: DataFrame, after: str, bars: DataFrame, possible: Column, hit: Column, name: str, extremes: dict[str, Column], keys=P.KEY) -> DataFrame:
    """points with the time of their key's first bar later than ``after`` for which ``hit`` holds, or null.

    extremes: aggregates of a block of bars; possible: whether a block with such extremes can hold a hit, which must be true
    of every block around a bar that is one.  Blocks are a tree: a point goes down only below blocks that can hold a hit, to
    days.  Of its days it looks first at one, then, if that holds none, at the next two, four and so on, so that it meets
    the bars of few more days than lie before its hit.
    """
    keys = list(keys)
    base = stage(points.filter(F.col(after).isNotNull()).distinct().withColumn("_id", F.xxhash64(*points.columns)), "points")
    days = stage(bars.withColumn("_d1", day_number("bar_time")).groupBy(*keys, "_d1").agg(*[a.alias(c) for c, a in extremes.items()]), "days")
    fold = {c: (F.max if c.startswith("max") else F.min) for c in extremes}
    found = base.withColumn("_from", day_number(after))
    for wider, tier in zip((None, *TIERS), TIERS):
        blocks = days.withColumn(f"_d{tier}", F.floor(F.col("_d1") / tier).cast("long"))
        if wider:
            blocks = blocks.withColumn(f"_d{wider}", F.floor(F.col("_d1") / wider).cast("long"))
        group = [*keys, *([f"_d{wider}"] if wider else []), f"_d{tier}"]
        blocks = blocks.groupBy(*group).agg(*[f(c).alias(c) for c, f in fold.items()])
        met = found.join(blocks, [*keys, *([f"_d{wider}"] if wider else [])]).filter((F.col(f"_d{tier}") >= F.floor(F.col("_from") / tier)) & possible)
        found = met.drop(*fold, *([f"_d{wider}"] if wider else []))
    place = F.row_number().over(W.partitionBy("_id", *points.columns).orderBy("_d1"))
    left = stage(found.select(*points.columns, "_id", "_d1", place.alias("_place")), "days-to-look-at")
    b = bars.withColumn("_d1", day_number("bar_time"))
    hits, step = None, 1
    while True:
        some = left.filter(F.col("_place") < 2 * step).join(b, [*keys, "_d1"]).filter((F.col("bar_time") > F.col(after)) & hit)
        new = stage(some.groupBy("_id", *points.columns).agg(F.min("bar_time").alias(name)), "hits")
        hits = new if hits is None else hits.unionByName(new)
        rest = left.filter(F.col("_place") >= 2 * step)
        left = rest.join(new.select("_id", *points.columns), ["_id", *points.columns], "left_anti")
        step *= 2
        if left.isEmpty():
            break
        left = stage(left, "days-to-look-at")
    return points.join(hits.drop("_id"), points.columns, "left")
