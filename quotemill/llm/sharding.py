"""Sharding by a Feistel permutation with cycle walking over global row numbers.  DataFrame functions only.

Law ``rows``: shard counts differ by one at most.  Rows are numbered 0 to N-1 in the order (doc_id, crc32, size),
nulls first; rows equal in all three are interchangeable.  A keyed Feistel network permutes the domain
a*b >= N (a = ceil(sqrt N), b = ceil(N/a)), and positions >= N walk on along their cycle until they fall below N,
which makes it a permutation of 0 to N-1.  Position p lands in shard p mod n, slot p div n, so both can be
computed for any row number without looking at other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import written

ROUNDS = 6
LAW = "rows"
#: Row numbers of monotonically_increasing_id hold the partition above this bit.
PARTITION_BIT = 33


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """rows with a gapless global row number in ``order``; moves each row once and keeps no window over all rows.

    The sorted rows are written with their place in their own partition; the partitions' counts (one row for each,
    so bounded by the number of tasks and not by the data) become offsets that are broadcast.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", PARTITION_BIT)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    spark, offset, table = rows.sparkSession, 0, []
    for part_id, n in counts:
        table.append((int(part_id), offset))
        offset += int(n)
    offsets = spark.createDataFrame(table, "_part bigint, _offset bigint")
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND((1 << PARTITION_BIT) - 1))
    return out.select(*rows.columns, name)


def _mix(value: Column, key: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value.cast("long"), F.lit(key).cast("long")), F.lit(modulus).cast("long"))


def _feistel(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """One pass over Z_a x Z_b as a fold whose step uses each half once."""
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        odd = F.pmod(k, F.lit(2)) == 1
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k), F.lit(a).cast("long")), F.lit(a).cast("long"))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k), F.lit(b).cast("long")), F.lit(b).cast("long"))
        return F.struct(F.when(odd, left).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(right).alias("r"))

    rounds = F.array(*[F.lit(k).cast("long") for k in keys])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row number x among n.

    A walk visits distinct positions >= n before it comes back, so as many steps as there are such positions
    (fewer than sqrt n) always suffice, and only about one row in sqrt n walks at all.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = [(seed * 1_000_003 + 7919 * i) * 2 + (i + 1) % 2 for i in range(ROUNDS)]
    once = _feistel(x, a, b, keys)
    spare = a * b - n
    if not spare:
        return once
    first = F.when(once < n, F.array(once)).otherwise(F.array(once, F.lit(None).cast("long")))
    walk = F.aggregate(
        F.when(F.size(first) == 1, F.sequence(F.lit(0), F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(spare))),
        F.element_at(first, 1),
        lambda at, _: F.when(at < n, at).otherwise(_feistel(at, a, b, keys)),
    )
    return walk


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and row_number of every row.

    Null text: size 8, crc32 of nothing (0).  An empty table gives no rows.  Only ids, sizes and checksums move.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    table = numbered(rows, ["doc_id", "text_crc32", "size"])
    n = table.count()
    place = table.withColumn("_at", permuted(F.col("row_number"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.pmod("_at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_at") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "row_number",
    )
