"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(rows: DataFrame, text: Column, label: Column, per_label: int, max_chars: int) -> list[tuple[str, str]]:
    """At most about ``per_label`` distinct texts of each label, cut to ``max_chars``, as (label, text).

    Chosen by the text's hash, so the choice is the same for every partitioning and copies count once.  The bound on
    what reaches the driver is 2 * per_label texts of a label.  Rows without a label or text are left out.
    """
    base = rows.select(label.cast("string").alias("label"), text.alias("text")).filter("label IS NOT NULL AND text IS NOT NULL AND text <> ''")
    base = base.withColumn("h", F.xxhash64("text"))
    counts = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(None).cast("double")
    for k in sorted(counts):
        limit = F.when(F.col("label") == k, F.lit(min(1.0, per_label / max(1, counts[k])))).otherwise(limit)
    unit = F.pmod(F.col("h"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = base.filter(unit <= limit).groupBy("label", "h").agg(F.min(F.substring("text", 1, max_chars)).alias("text"))
    got = chosen.orderBy("h", "label").limit(2 * per_label * len(counts)).collect()
    return [(r["label"], r["text"]) for r in got]


def sample_by_table(docs: DataFrame, marks: DataFrame, per_label: int, max_chars: int) -> list[tuple[str, str]]:
    """As labelled_sample, for labels in a table of their own: marks has doc_id and label.

    The documents are chosen among the marks, by the hash of doc_id, so at most 2 * per_label ids of a label are
    broadcast and the texts are read where they are, without a shuffle.  Equal texts of a label count once.
    """
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("label").cast("string").alias("_label")).filter("_doc IS NOT NULL AND _label IS NOT NULL")
    counts = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(None).cast("double")
    for k in sorted(counts):
        share = F.when(F.col("_label") == k, F.lit(min(1.0, per_label / counts[k]))).otherwise(share)
    unit = F.pmod(F.xxhash64("_doc"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = marks.filter(unit <= share).distinct().limit(2 * per_label * len(counts))
    joined = docs.select("doc_id", F.substring("text", 1, max_chars).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    rows = joined.filter("text IS NOT NULL AND text <> ''").select("_label", "text", F.xxhash64("text").alias("h")).limit(4 * per_label * len(counts)).collect()
    return sorted({(r["_label"], r["text"]): r["h"] for r in rows}, key=lambda x: (hash_of(x[1]), x))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
