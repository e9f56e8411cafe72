"""A Merkle manifest of a table of documents: a digest of each row, of each language and of all, and each row's proof.

A node's place in its group's tree follows from its rank among the group's rows.  Ranks come from a radix trie over the
sort key and not from a global sort: histograms of ever longer key prefixes (two hexadecimal digits a step, only where
a prefix still holds more than ``BUCKET`` rows) are summed up among siblings, at most a few hundred rows at a time, and
only rows of one small bucket are ever put in order.  The digits of the rank in base ``FANOUT`` are the trie of the
tree itself: rows that share all but the last three digits are one block, which is reduced from its longest prefixes
to one digest; blocks are the rows of the next round.  So three levels take one exchange, a group is as many tasks as
it has blocks, and the paths upwards are joined to blocks before these are laid out as rows again.

Of a row's digest: doc_id, source, lang, n_chars and text.  Rows go by doc_id, null first; rows that share a doc_id go
by their digest, and whole copies follow each other (which is which doesn't show).  A null language is a group of its
own.  Empty tables give empty results.  Columns besides these five are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import written

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: A bucket of more rows is parted by two more digits of its key.
BUCKET = 4096
#: So many rows of heavy prefixes may be broadcast (about 60 bytes each); beyond, they are joined by a merge.
SPREAD = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path's step: the run's digests left and right of one's own.
STEPS = "array<struct<l: string, r: string>>"


def part(value: Column) -> Column:
    """A value as it goes into a row's digest: its length in bytes, a colon and itself, or ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[part(F.col(c)) for c in FIELDS[:-1]], part(text)), 256)


def _shared(a: Column, b: Column) -> Column:
    """How many characters two strings begin with alike."""
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))


def ranks(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows (g, key, …, not null) with ``rank``, from 0 in each g by key, and ``n``, the number of rows of g.

    Keys are strings in byte order, of one length or each once in its g.  rows is read once for each step of the trie, so
    it should be a written table.  Rows of equal keys follow each other in no stated order; as no digit parts them, more
    than ``bucket`` of them are one task.
    """
    depths, done, heavy, deepest = [3], [], None, rows.agg(F.max(F.length("key"))).first()[0] or 0
    placed = rows.withColumn("bucket", F.substring("key", 1, depths[0]))
    while True:
        some = placed if heavy is None else placed.filter("_open")
        counts = written(some.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")), "histogram")
        too_many = F.col("n") > bucket if depths[-1] < deepest else F.lit(False)
        done.append(counts.filter(~too_many).select("g", "bucket", "n"))
        heavy = counts.filter(too_many)
        size, shared = heavy.agg(F.count(F.lit(1)), F.min(_shared(F.col("low"), F.col("high")))).first()
        if not size:
            break
        # Two more digits, after those that all of a heavy prefix's keys have in common.
        depths.append(min(deepest, shared + 2))
        heavy = heavy.select(F.col("g").alias("_g"), F.col("bucket").alias("_b"))
        heavy = F.broadcast(heavy) if size <= SPREAD else heavy.hint("merge")
        placed = placed.drop("_open").join(heavy, (F.col("g") == F.col("_g")) & (F.col("bucket") == F.col("_b")), "left")
        placed = placed.withColumn("_open", F.col("_b").isNotNull()).withColumn("bucket", F.when(F.col("_open"), F.substring("key", 1, depths[-1])).otherwise(F.col("bucket"))).drop("_g", "_b")
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.union(more)
    # What comes before a bucket: at each depth its smaller siblings, which have one parent and so are few.
    base = buckets.withColumn("_base", F.lit(0).cast("long"))
    for above, depth in zip([0, *depths], depths):
        prefix, parent = F.substring("bucket", 1, depth), F.substring("_p", 1, above)
        level = buckets.filter(F.length("bucket") > above).groupBy("g", prefix.alias("_p")).agg(F.sum("n").alias("_n"))
        smaller = F.sum("_n").over(W.partitionBy("g", parent).orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
        level = level.select(F.col("g").alias("_g"), "_p", smaller.alias("_before"))
        base = base.join(level, (F.col("g") == F.col("_g")) & (prefix == F.col("_p")), "left")
        base = base.withColumn("_base", F.col("_base") + F.coalesce("_before", F.lit(0))).drop("_g", "_p", "_before")
    sizes = buckets.groupBy("g").agg(F.sum("n").alias("_size"))
    base = written(base.join(sizes, "g").select(F.col("g").alias("_g"), F.col("bucket").alias("_b"), "_base", "_size"), "bases")
    whole = placed.drop("_open").join(base.hint("merge"), (F.col("g") == F.col("_g")) & (F.col("bucket") == F.col("_b")))
    inside = F.row_number().over(W.partitionBy("g", "bucket").orderBy("key"))
    return whole.select(*rows.columns, (F.col("_base") + inside - 1).alias("rank"), F.col("_size").alias("n"))


def _parents(level: Column) -> Column:
    """The digests of the runs of FANOUT digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / F.lit(FANOUT)).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), ""), 256))


def climb(nodes: DataFrame, most: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes (g, idx, n, digest, …) with ``steps`` from each node up to the last digest, and the columns of ``above``.

    most: the largest n.  above: takes the groups' last digests (g, digest), gives (g, steps, …).
    """
    carried = [c for c in nodes.columns if c not in ("g", "n")]
    blocks = nodes.groupBy("g", F.shiftright("idx", 3 * LEVELS).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", *[c for c in carried if c != "idx"]))).alias("members"))
    blocks = blocks.withColumn("level0", F.col("members.digest"))
    for k in range(LEVELS):
        level = F.col(f"level{k}")
        # A group that is one block ends at its only digest; elsewhere even a run of one is hashed.
        ended = (F.col("n") <= BLOCK) & (F.size(level) == 1)
        blocks = blocks.withColumn(f"level{k + 1}", F.when(ended, level).otherwise(_parents(level)))
    blocks = written(blocks, "blocks")
    last = F.element_at(f"level{LEVELS}", 1).alias("digest")
    if most > BLOCK:
        up = climb(blocks.select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), last), math.ceil(most / BLOCK), above)
        up = up.withColumnRenamed("idx", "block").drop("digest")
        joined = blocks.join(up.withColumnRenamed("steps", "higher"), ["g", "block"])
    else:
        joined = blocks.join(above(blocks.select("g", last)).withColumnRenamed("steps", "higher"), "g")
    known = [c for c in joined.columns if c not in ("g", "block", "n", "members", "higher", *[f"level{k}" for k in range(LEVELS + 1)])]
    each = joined.select("*", F.posexplode("members").alias("at", "m"))
    steps = []
    for k in range(LEVELS):
        level, own = F.col(f"level{k}"), F.shiftright("at", 3 * k)
        first = F.shiftright("at", 3 * k + 3) * FANOUT
        step = F.struct(F.array_join(F.slice(level, first + 1, own - first), "").alias("l"), F.array_join(F.slice(level, own + 2, first + FANOUT - 1 - own), "").alias("r"))
        steps.append(F.when((F.col("n") > BLOCK) | (F.size(level) > 1), F.array(step)).otherwise(F.array().cast(STEPS)))
    return each.select("g", *[F.col(f"m.{c}").alias(c) for c in carried], F.concat(*steps, "higher").alias("steps"), *known)


def folded(steps: Column, digest: Column) -> Column:
    """The last digest that a row's own and its steps lead to."""
    return F.aggregate(steps, digest, lambda now, s: F.sha2(F.concat(s["l"], now, s["r"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, steps and claimed_leaf of every row of docs.

    claimed: the text that a holder of the row shows in place of ``text`` (by default the same); claimed_leaf is the
    digest that it gives.  Steps of two rows are proofs against the same root.
    """
    shown = leaf_of(claimed) if claimed is not None else F.col("leaf")
    whole = docs.select(*FIELDS).withColumn("leaf", leaf_of(F.col("text"))).withColumn("claimed_leaf", shown)
    g = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))
    # Written once, so that the number that parts whole copies stays the same in every later step.
    leaves = written(whole.select("doc_id", g.alias("g"), "leaf", "claimed_leaf", F.lpad(F.lower(F.hex(F.floor(F.rand(3) * (1 << 32)).cast("long"))), 8, "0").alias("_copy")), "leaves")
    ends = leaves.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (format((x or 0) + (1 << 63), "016x") for x in ends)
    common = next((k for k in range(16) if low[k] != high[k]), 16) // 2 * 2
    digits = F.lpad(F.lower(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    key = F.coalesce(F.concat(F.lit("1"), F.substring(digits, common + 1, 16)), F.lit("0" * (17 - common)))
    ranked = ranks(leaves.withColumn("key", F.concat(key, "leaf", "_copy")))
    ranked = ranked.select("g", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "claimed_leaf")
    most = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1

    def over_groups(roots: DataFrame) -> DataFrame:
        groups = written(roots.select(F.lit("").alias("g"), F.concat(F.hex("g"), F.lit("!")).alias("key"), F.col("g").alias("group"), "digest"), "subroots")
        top = climb(ranks(groups).select("g", F.col("rank").alias("idx"), "n", "digest", "group"), groups.count() or 1, lambda r: r.select("g", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root")))
        return top.select(F.col("group").alias("g"), "steps", F.col("digest").alias("subroot"), "root")

    return climb(ranked, most, over_groups).withColumnRenamed("digest", "leaf")


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest's digests for every row of docs, and whether each row, where 3 divides its doc_id's crc32 after its
    text's A-Z were lower-cased, still leads to the root; rows with a null doc_id are not tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(docs, F.when(hit, F.translate("text", ASCII_UPPER, ASCII_LOWER)).otherwise(F.col("text")))
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("steps"), F.col("claimed_leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
