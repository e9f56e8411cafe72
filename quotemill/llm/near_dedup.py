"""Near-duplicate groups by BagMinHash signatures, banding and verified multiset overlap.

Texts are multisets of five-word shingles (lower case; a text of one to four words is one shingle).  Two texts are linked if their weighted Jaccard similarity is 0.8 or more, and a class is a connected
component of links, named by its smallest doc_id.

Signatures: each shingle with weight w owns Poisson processes over the weight ranges [0,1), [1,2), [2,4), [4,8) ...
below w; points come in rising order, each at a random register and weight, and points at weights of w or more
don't count (BagMinHash with weights discretised to integers and dyadic ranges as the hierarchy).  A register holds
the first point to reach it, so two registers agree with probability sum(min)/sum(max).

Candidates: texts with equal multisets are one.  In each band's bucket every text is compared with two pivots, the
smallest doc_id and the text with the most bucket mates; each text's best estimate is verified, and the verified
links contract the buckets.  A bucket that still holds several components is anchored at the largest of them, and all
buckets of an anchor are settled together: the few texts outside the anchor's component (outsiders) meet its members
and each other, each text being sent once and not once a band; their overlaps are counted exactly.  Members of the anchor never meet each other, so a large group costs its
size times the number of its outsiders, and a task writes fewer links than it has rows.  An anchor with many buckets
is parted by buckets, and a part that still has more than UNIT_ROWS rows or UNIT_BYTES of shingles by blocks of
outsiders and of all rows, so no candidate of a bucket is left out, however large the bucket.

Words: runs of letters, marks and digits; in scripts without spaces each character.  A text without words is a class
of its own.  Null text counts as empty.  Rows with null doc_id get class_id null and are kept.  Rows that share a
doc_id count as one document, linked through any of its texts; repeated rows are all returned.  Classes are named by
their smallest doc_id, so ties cannot arise.  An empty table gives no rows.  Columns of docs but doc_id and text are
ignored (keep_one returns them unchanged).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textvec import U, hashes, mix, words
from .workspace import checkpointed, pieces, released, utf8_buffer, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Estimates below this are six standard deviations under the threshold.
LEAST_ESTIMATE = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Rows, and bytes of shingles, of one block of outsiders or of all texts of an anchor.
UNIT_ROWS, UNIT_BYTES = 1024, 8 << 20
#: Tasks among which the rows of a large anchor are dealt in joins.
SALTS = 32
#: Bytes of text that a worker sketches or compares at once.
PIECE = 2 << 20
OWNER_BITS = 16  # a batch has fewer texts than this allows; shingles keep 48 bits
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and each one's document, for lower-case UTF-8 texts that lie one after another."""
    starts, ends, doc = words(data, offsets)
    w = hashes(data, starts, ends)
    if len(w) >= SHINGLE:
        whole = doc[: len(doc) - SHINGLE + 1] == doc[SHINGLE - 1 :]
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), U)
        for j in range(SHINGLE):
            h += w[at + j] * _ODD[j]
        h, owner = mix(h), doc[at]
    else:
        h, owner = np.zeros(0, U), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        s = count[short].astype(U)
        for j in range(SHINGLE - 1):
            has = count[short] > j
            s[has] = mix(s[has] * _ODD[4] + w[first[has] + j] * _ODD[j])
        h, owner = np.concatenate([h, s]), np.concatenate([owner, short])
    return h, owner


def _counted(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight) of distinct shingles of each document, by document; hashes lose their lowest bits."""
    assert n < 1 << OWNER_BITS
    packed, weight = np.unique((owner.astype(U) << U(64 - OWNER_BITS)) | (h >> U(OWNER_BITS)), return_counts=True)
    return (packed >> U(64 - OWNER_BITS)).astype(np.int64), packed & U((1 << 64 - OWNER_BITS) - 1), weight


def signatures(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of REGISTERS 32-bit values for each of n documents, from distinct shingles' hashes with weights."""
    doc, item, weight = _counted(h, owner, n)
    best = np.full(n * REGISTERS, (1 << 64) - 1, U)
    doc, item, weight, low, width, seed = _ranges(doc, item, weight)
    x = np.zeros(len(doc))
    top = np.full(n, np.inf)
    t = 0
    while len(doc):
        t += 1
        s = mix(seed + U((t * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((s >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * REGISTERS)
        alive = x <= top[doc]
        if not alive.all():
            doc, weight, low, width, seed, x, s = (a[alive] for a in (doc, weight, low, width, seed, x, s))
        s2 = mix(s)
        counts = low + ((s2 >> U(40)).astype(np.int64) * width >> 24) < weight
        register = ((s2 & U(0xFFFFFF)) * U(REGISTERS)) >> U(24)
        key = (x.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (mix(s2) >> U(32))
        at = doc * REGISTERS + register.astype(np.int64)
        np.minimum.at(best, at[counts], key[counts])
        live = np.unique(doc)
        worst = best.reshape(n, REGISTERS)[live].max(1)
        full = worst != U((1 << 64) - 1)
        top[live[full]] = (worst[full] >> U(32)).astype(np.uint32).view(np.float32).astype(np.float64)
    return (best.reshape(n, REGISTERS) & U(0xFFFFFFFF)).astype(np.uint32)


def _ranges(doc, item, weight):
    """One entry for each shingle and dyadic weight range that begins below its weight."""
    parts = []
    low, width, j = 0, 1, 0
    own = np.arange(len(doc))
    while len(own):
        parts.append((own, np.full(len(own), low), np.full(len(own), width), mix(item[own] * U(0xD6E8FEB86659FD93) + U(j))))
        low, width, j = low + width, max(1, low + width), j + 1
        own = own[weight[own] > low]
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z.astype(U), z, z, z, z.astype(U)
    own, low, width, seed = (np.concatenate([p[k] for p in parts]) for k in range(4))
    return doc[own], item[own], weight[own], low, width, seed


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8_buffer(pc.utf8_lower(pc.fill_null(column, "")))


def contents(h: np.ndarray, owner: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits that tell the shingle multisets of n texts apart; None for a text without words."""
    count = np.bincount(owner, minlength=n)
    order = np.lexsort((h, owner))
    hh, first = h[order], np.cumsum(count) - count
    has = count > 0
    place = np.arange(len(hh)).astype(U) - np.repeat(first, count).astype(U)
    both = np.zeros((n, 2), U)
    if has.any():
        both[has, 0] = np.add.reduceat(mix(hh + place * _ODD[0]), first[has])
        both[has, 1] = np.add.reduceat(mix(hh * _ODD[1] + place), first[has])
    return [both[i].tobytes() if has[i] else None for i in range(n)]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, content, signature) of each row; content tells equal shingle multisets, null without words."""

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            h, owner = shingles(*_lower(b.column("text")))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(contents(h, owner, n), pa.binary()), pa.array([s.tobytes() for s in signatures(h, owner, n)], pa.binary())],
                names=["doc_id", "content", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, content binary, signature binary")


def estimates(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with est, the share of equal registers, where it may reach the threshold."""
    sig = texts.select(F.col("doc").alias("_id"), F.col("signature").alias("_sig"))
    joined = pairs.join(sig.select(F.col("_id").alias("a"), F.col("_sig").alias("sa")), "a").join(sig.select(F.col("_id").alias("b"), F.col("_sig").alias("sb")), "b")

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            est = (x == y).mean(1)
            ok = pa.array(est >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(est).filter(ok)], names=["a", "b", "est"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, est double")


def shared_shingles(left: np.ndarray, rights: list[np.ndarray]) -> np.ndarray:
    """How many keys each of ``rights`` shares with ``left``; all are sorted, without repeats and not empty."""
    every = np.concatenate(rights)
    at = np.searchsorted(left, every)
    hit = left[np.minimum(at, len(left) - 1)] == every
    sizes = np.array([len(r) for r in rights])
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)


def linked(left: np.ndarray, rights: list[np.ndarray]) -> np.ndarray:
    """Whether the weighted Jaccard similarity of left with each of rights reaches THRESHOLD."""
    both = shared_shingles(left, rights)
    sizes = len(left) + np.array([len(r) for r in rights])
    return both >= THRESHOLD * (sizes - both)


def _occurrences(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys of sorted shingles that count repeats: the n-th occurrence of a shingle in a text has a key of its own."""
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    return mix(h + run.astype(U) * _ODD[2])


def multiset_keys(h: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """The shingles of each of n texts as sorted keys, one for each occurrence."""
    order = np.lexsort((h, owner))
    k, o = _occurrences(h[order], owner[order]), owner[order]
    cut = np.searchsorted(o, np.arange(n + 1))
    return [np.sort(k[x:y]) for x, y in zip(cut, cut[1:])]


def carried(docs: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """(doc, signature, shingles, size) of the texts that share a bucket; the corpus's texts move once for it."""
    wanted = buckets.select(F.col("doc").alias("_want")).distinct()
    text = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("_want"), "left_semi")

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            data, offsets = _lower(b.column("text"))
            h, owner = shingles(data, offsets)
            content = contents(h, owner, b.num_rows)
            keys = multiset_keys(h, owner, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(content, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([len(k) for k in keys], pa.int32())],
                names=["doc", "content", "shingles", "size"],
            )

    keyed = text.mapInArrow(released(run), "doc bigint, content binary, shingles binary, size int").dropDuplicates(["doc", "content"])
    own = reps.select(F.col("doc_id").alias("doc"), "content", "signature").join(wanted.hint("merge"), F.col("doc") == F.col("_want"), "left_semi")
    return own.join(keyed.hint("merge"), ["doc", "content"]).select("doc", "signature", "shingles", "size")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (as of carried) whose overlap reaches THRESHOLD."""
    keys = texts.select(F.col("doc").alias("_doc"), "shingles")
    joined = pairs.select("a", "b").join(keys.hint("merge"), F.col("a") == F.col("_doc")).select("a", "b", F.col("shingles").alias("sa"))
    joined = joined.join(keys.hint("merge"), F.col("b") == F.col("_doc")).select("a", "b", "sa", F.col("shingles").alias("sb"))

    def run(batches):
        for b in batches:
            left, right = (b.column(c) for c in ("sa", "sb"))
            ok = pa.array([bool(linked(np.frombuffer(x.as_buffer(), U), [np.frombuffer(y.as_buffer(), U)])[0]) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return joined.mapInArrow(released(run), "a bigint, b bigint")


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, doc) of every band of every text, where several texts share the bucket.  Both uses of the bands read one exchange."""
    width = 4 * ROWS
    bands = reps.select(F.col("doc_id").alias("doc"), F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(BANDS)])).alias("key"))
    bands = bands.select("key", "doc").repartition("key")
    several = bands.groupBy("key").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).filter("d0 < d1").select("key")
    return bands.join(several.hint("merge"), "key", "left_semi")


def _stars(buckets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of each text with its buckets' two pivots."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("smallest"))
    sized = buckets.join(sizes.hint("merge"), "key")
    mates = sized.groupBy("doc").agg(F.sum("n").alias("mates"))
    top = buckets.join(mates.hint("merge"), "doc").groupBy("key").agg(F.max(F.struct("mates", (-F.col("doc")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("top"))
    pivots = sizes.join(top.hint("merge"), "key").select("key", F.explode(F.array_distinct(F.array("smallest", "top"))).alias("b"))
    return buckets.join(pivots.hint("merge"), "key").select(F.col("doc").alias("a"), "b").filter("a <> b").distinct()


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows with few's columns where few has their keys; a key's rows go to SALTS tasks, by ``spread``."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(2)), F.lit(SALTS)).cast("int"))
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(few.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def _units(buckets: DataFrame, named: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of mixed buckets, by unit (anchor, part, i, k): block i of the outsiders (left) and block k of all (right)."""
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    own = buckets.join(named.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    own = checkpointed(own.join(sizes.hint("merge"), "component", "left").select("key", "doc", "component", F.coalesce("members", F.lit(1)).alias("members")), "members")
    anchors = own.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.struct("members", (-F.col("component")).alias("neg"))).alias("m"))
    anchors = anchors.filter("c0 < c1").select("key", (-F.col("m.neg")).alias("anchor"))
    rows = checkpointed(own.join(anchors.hint("merge"), "key").select("key", "doc", "component", "anchor"), "mixed")
    parts = rows.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / (8 * UNIT_ROWS)).cast("int").alias("parts")).filter("parts > 1")
    rows = _salted(rows, parts, ["anchor"], "key")
    rows = rows.select("anchor", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "doc", "component").distinct()
    held = rows.join(texts.select("doc", "shingles", "size").hint("merge"), "doc").withColumn("outside", F.col("component") != F.col("anchor"))
    held = checkpointed(held, "held")
    blocks = lambda n, size: F.greatest(F.ceil(n / UNIT_ROWS), F.ceil(8 * size / UNIT_BYTES), F.lit(1)).cast("int")
    out = F.col("outside").cast("int")
    counts = held.groupBy("anchor", "part").agg(blocks(F.count(F.lit(1)), F.sum("size")).alias("gk"), blocks(F.sum(out), F.sum(out * F.col("size"))).alias("gi"))
    at = _salted(held, counts.filter("gk > 1 OR gi > 1"), ["anchor", "part"], "doc").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("gk", "gi")})
    at = at.withColumn("own_i", F.pmod(F.xxhash64("doc"), F.col("gi")).cast("int")).withColumn("own_k", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("gk")).cast("int"))
    place = lambda i, k, left, right: F.struct(i.alias("i"), k.alias("k"), left.alias("left"), right.alias("right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("gk") - 1), lambda k: place(F.col("own_i"), k, F.lit(True), k == F.col("own_k")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("gi") - 1), lambda i: place(i, F.col("own_k"), F.lit(False), F.lit(True)))
    places = F.when(F.col("outside"), F.concat(as_left, F.filter(as_right, lambda s: s["i"] != F.col("own_i")))).otherwise(as_right)
    return at.withColumn("at", F.explode(places)).select("anchor", "part", "at.i", "at.k", "at.left", "at.right", "doc", "component", "shingles")


def _settle_unit(anchor: int, doc: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links between components of a unit, so many that all that is alike is connected; keys are the rows' shingles one
    after another.  Each left row's overlaps with all right rows at once are counted by an index of the right rows' keys."""
    links, parent = [], {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    start = np.cumsum(sizes) - sizes
    code = np.unique(keys, return_inverse=True)[1].astype(np.int32)
    number = np.full(len(doc), -1, np.int32)  # of right rows
    rows = np.flatnonzero(right)
    number[rows] = np.arange(len(rows))
    owner = np.repeat(number, sizes)
    at = np.flatnonzero(owner >= 0)
    at = at[np.argsort(code[at], kind="stable")]
    owner = owner[at]
    first = np.searchsorted(code[at], np.arange(int(code.max(initial=-1)) + 2))
    inside, doc_r, size_r, comp_r = component[rows] == anchor, doc[rows], sizes[rows], component[rows]
    for x in np.flatnonzero(left):
        own = code[start[x] : start[x] + sizes[x]]
        lo = first[own]
        n = first[own + 1] - lo
        places = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = np.bincount(owner[places], minlength=len(rows))
        # Of two outsiders the one with the smaller doc_id is the left one.
        alike = (both >= THRESHOLD * (sizes[x] + size_r - both)) & (comp_r != component[x]) & (inside | (doc_r > doc[x]))
        for k in np.flatnonzero(alike):
            u, v = root(int(component[x])), root(int(comp_r[k]))
            if u != v:
                parent[u] = v
                links.append((int(doc[x]), int(doc_r[k])))
    return links


def _settled(units: DataFrame) -> DataFrame:
    """Links (a, b) across the components of mixed buckets; each unit writes fewer than it has rows."""

    def run(batches):
        held, now = [], None

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            doc, component = (table.column(c).to_numpy() for c in ("doc", "component"))
            left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
            blobs = table.column("shingles").to_pylist()
            sizes = np.array([len(x) // 8 for x in blobs])
            links = _settle_unit(now[0], doc, component, left, right, np.frombuffer(b"".join(blobs), U), sizes)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["a", "b"])

        for b in batches:
            names = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("anchor", "part", "i", "k")], 1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for p, q in zip(cuts, cuts[1:]):
                if q > p:
                    if now is not None and tuple(names[p].tolist()) != now:
                        yield close()
                        held = []
                    now = tuple(names[p].tolist())
                    held.append(b.slice(p, q - p))
        if held:
            yield close()

    order = ["anchor", "part", "i", "k"]
    return units.repartition(*order).sortWithinPartitions(*order).mapInArrow(released(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept (the class's smallest doc_id stays) of every row of docs."""
    docs = docs.select("doc_id", "text")
    made = written(sketches(docs), "sketches")
    usable = made.filter("content IS NOT NULL AND doc_id IS NOT NULL")
    reps = written(usable.groupBy("content").agg(F.min(F.struct("doc_id", "signature")).alias("r")).select("content", "r.doc_id", "r.signature"), "representatives")
    buckets = checkpointed(_buckets(reps), "buckets")
    texts = written(carried(docs, reps, buckets), "carried")
    stars = estimates(_stars(buckets), texts)
    best = stars.groupBy("a").agg(F.max(F.struct("est", (-F.col("b")).alias("neg"))).alias("m")).select("a", (-F.col("m.neg")).alias("b"))
    named = checkpointed(components(verify(best, texts)), "components")
    links = named.toDF("a", "b").union(_settled(_units(buckets, named, texts)))
    named = checkpointed(components(links), "components")
    classes = reps.select("content", "doc_id").join(named.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("content", F.coalesce("component", "doc_id").alias("class"))
    out = made.select("doc_id", "content").join(classes.hint("merge"), "content", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, of which near_duplicates keeps the document."""
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
