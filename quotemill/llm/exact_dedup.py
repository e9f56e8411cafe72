"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct normalised text, bucketed and sorted by digest.  New data is
pre-aggregated by digest, compared with the index by a sort-merge anti-join that does not move the index
(its buckets are the join's partitions), and what is new is appended as further sorted bucket files, marked with the
batch that brought it in.  A batch that is given again under its name, after a failure or by mistake, adds nothing and
gets the answer that it got (or would have got) the first time.  One writer at a time appends to an index.

Normalised: every character of ``[\\x20\\x09-\\x0D]`` deleted.  Null text counts as empty, and empty texts equal
each other.  Of equal texts in one batch the row with the most code points of its original text stays, then the
smallest doc_id (null doc_ids last), then the smallest hash of the text; a text the index already holds keeps the row
that brought it in.  Repeated rows (same doc_id and text) count as copies; exact_dedup marks all of them kept, as they
cannot be told apart, keep_distinct returns one.  An empty table gives no rows.  Other columns are ignored, whatever
their names; keep_distinct returns them unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import scratch, written

SPACES = " \t\n\x0b\x0c\r"
#: Rows that a bucket of an index is planned for, and its fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 32
#: A group is hot above this many rows and above this share of the batch, so no batch has more than 1 / HOT_SHARE hot groups.
HOT_ROWS, HOT_SHARE = 10_000, 0.001


def digest_column(text: str | F.Column) -> F.Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.translate(F.coalesce(col, F.lit("")), SPACES, ""), 256))


def _marked(docs: DataFrame) -> list[F.Column]:
    """What tells a row apart: code points, digest and a hash of the original text."""
    return [F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), digest_column("text").alias("digest"), F.xxhash64("text").alias("own")]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, digest, own) of every row; other columns of docs are ignored."""
    return docs.select("doc_id", *_marked(docs))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest.  max() of (n_points, ~doc_id, ~own) combines before the shuffle, so no group meets in one task."""
    rank = F.struct("n_points", F.bitwise_not("doc_id").alias("neg"), F.bitwise_not("own").alias("own"))
    g = rows.groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return g.select("digest", F.bitwise_not("best.neg").alias("keep_id"), F.col("best.n_points").alias("keep_points"), F.bitwise_not("best.own").alias("keep_own"), "group_size")


class DigestIndex:
    """A bucketed, sorted digest table at ``path``; opens what is there or starts empty with ``buckets`` buckets."""

    SCHEMA = "digest binary, keep_id bigint, keep_points bigint, keep_own bigint, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_").replace(".", "_")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Takes the table's name out of the catalogue; its files stay at ``path``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def unseen(self, new_groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks."""
        return new_groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """The rows go to the index's own buckets: one shuffle, one sorted file per bucket."""
        (
            fresh.select("digest", "keep_id", "keep_points", "keep_own", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def _judged(self, docs: DataFrame, batch: str | None) -> DataFrame:
        """Every row with its group's answer.

        Rows of hot groups stay where they are and meet a broadcast of at most 1 / HOT_SHARE = 1000 rows, whatever the
        batch; the others are joined by sort-merge, where no group is more than HOT_SHARE of the batch or HOT_ROWS.
        """
        batch = batch or uuid.uuid4().hex
        rows = written(digests(docs), "digests")
        found = written(groups(rows), "digest-groups")
        self.append(written(self.unseen(found), "digests-new"), batch)
        total = found.agg(F.sum("group_size")).first()[0] or 0
        hot = found.select("digest", "group_size").filter(F.col("group_size") > max(HOT_ROWS, int(total * HOT_SHARE)))
        # The index's rows of hot digests are found by the broadcast too, so the index isn't moved for them.
        answers = written(self.rows().join(F.broadcast(hot), "digest"), "digests-hot")
        sizes = found.select("digest", "group_size").join(self.rows().hint("merge"), "digest")
        judged = rows.join(F.broadcast(answers), "digest").unionByName(
            rows.join(F.broadcast(answers.select("digest")), "digest", "left_anti").join(sizes.hint("merge"), "digest")
        )
        same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("own") == F.col("keep_own"))
        return judged.withColumn("kept", (F.col("batch") == batch) & same)

    def dedup(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.  Appends what is new as ``batch``.

        group_size counts the batch's rows.  The digests are written first, so a retry or a lost executor reads the
        same rows; the answer comes from the index alone, so it is the same however often the batch is given by name.
        """
        return self._judged(docs, batch).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _fresh_index(docs: DataFrame, buckets: int | None) -> DigestIndex:
    spark = docs.sparkSession
    return DigestIndex(spark, scratch(spark, "index"), buckets or max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS)))


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs against an empty index in the shared folder, whose table leaves the catalogue again."""
    index = _fresh_index(docs, buckets)
    out = written(index.dedup(docs), "exact-dedup")
    index.forget()
    return out


def keep_distinct(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps; of identical rows one.

    Joined on the digest and a hash of what else tells a row apart, which spreads a large group of copies over all
    partitions; the texts move once.
    """
    names = docs.columns
    row = lambda: F.xxhash64("doc_id", "n_points", "own", F.col("doc_id").isNull()).alias("_row")
    index = _fresh_index(docs, buckets)
    kept = written(index._judged(docs, None).filter("kept").select(F.col("digest").alias("_digest"), row()).distinct(), "kept")
    index.forget()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole"), "doc_id", *_marked(docs)).select("_whole", F.col("digest").alias("_digest"), row())
    found = whole.join(kept.hint("merge"), ["_digest", "_row"], "left_semi").dropDuplicates(["_digest", "_row"])
    return found.select("_whole.*")
