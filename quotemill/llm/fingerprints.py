"""Document fingerprints from closed syncmers.

A k-mer of UTF-8 bytes is a closed syncmer if the smallest of its s-mers (by hash) is its first or its last.  The
choice looks at nothing but the k-mer itself, so an edit disturbs only the anchors it touches.  A fingerprint holds
every anchor each time it occurs, in order of place: a word of 32 bits with 28 bits of hash and the gap to the anchor
before, which is K - S at most.  The words are deflated where that is shorter (texts that repeat themselves) and
written in base 64, so a fingerprint grows with the text and says where each anchor is.

``likeness`` counts occurrences that two texts share in matching places over all occurrences of both.  28 bits are
enough for that: an anchor of a text meets one of n others by chance with probability n / 2^28, and has to agree in
place besides.

Texts under SHORT bytes have all their SHORT_K-mers as anchors besides (the top bit of a hash tells them), which count
only between two such texts; texts of fewer than SHORT_K bytes have one anchor, their own hash.  Null counts as empty; two empty texts are alike (1),
an empty and a non-empty one are not (0).  Equal texts have equal fingerprints (within one build of zlib).  Of rows
that share a doc_id, null included, each has its own result; they follow each other by text.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import U, eights, mix
from .workspace import pieces, texts_of

K, S = 20, 8
#: Any 2K - S - 1 = 31 bytes hold a syncmer, which three quarters of a text of SHORT bytes are well above.
SHORT, SHORT_K = 128, 5
SHORT_BIT = U(1 << 28)
#: In place of a gap: a SHORT_K-mer's word, whose place is its number among them.  Any K - S k-mers in a row hold a
#: syncmer (if the smallest s-mer under them is one of the first K - S, the k-mer that starts there, else the one that ends there).
SHORT_GAP = 15
#: Comparisons sort by (hash, place) in one integer; places and their displacements take this many bits.
PLACE_BITS = 34
#: Displacements this close are one diagonal; a short insertion moves the rest by less.
SLACK = 64


def syncmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of texts that lie one after another; none crosses a text's end."""
    n = len(data)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = eights(data)
    inner = mix(at[: n - S + 1])
    w = K - S + 1
    m = n - K + 1
    # Sliding minimum of w = 13 values by doubling: windows of 8, then two that overlap.
    low = np.minimum(inner[:-1], inner[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    low = np.minimum(low[:m], low[w - 8 : w - 8 + m])
    hit = (inner[:m] == low) | (inner[w - 1 : w - 1 + m] == low)
    # k-mers that begin in the last K-1 bytes of a text would cross into the next.
    for i in range(1, K):
        cut = offsets[1:] - i
        cut = cut[(cut >= 0) & (cut < m)]
        hit[cut] = False
    pos = np.flatnonzero(hit)
    tail = at[pos + 16] & U((1 << 8 * (K - 16)) - 1)
    h = mix(at[pos] * U(0x9E3779B97F4A7C15) ^ mix(at[pos + 8] * U(0xC2B2AE3D27D4EB4F) ^ mix(tail + U(1))))
    return pos, h & (SHORT_BIT - U(1))


def short_anchors(raw: bytes) -> np.ndarray:
    """The hashes of all SHORT_K-mers of a short text by place, or its own hash if it has none."""
    if len(raw) < SHORT_K:
        return np.array([int.from_bytes(hashlib.sha256(raw).digest()[:4], "little") >> 4][: len(raw)], U) | SHORT_BIT
    at = eights(np.frombuffer(raw, np.uint8))[: len(raw) - SHORT_K + 1]
    return mix(at & U((1 << 8 * SHORT_K) - 1)) & (SHORT_BIT - U(1)) | SHORT_BIT


def sketch_many(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its anchors' hashes and places, in order of place, SHORT_K-mers last."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    pos, h = syncmers(data, offsets)
    cut = np.searchsorted(pos, offsets)
    out = []
    for i, r in enumerate(raw):
        h_i, place = h[cut[i] : cut[i + 1]], pos[cut[i] : cut[i + 1]] - offsets[i]
        if len(r) < SHORT:
            more = short_anchors(r)
            h_i, place = np.concatenate([h_i, more]), np.concatenate([place, np.arange(len(more))])
        out.append((h_i, place))
    return out


def pack(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """A byte (1 if the rest is deflated), then a word for each anchor."""
    h, p = sketch
    gaps = np.where(h < SHORT_BIT, np.diff(p, prepend=-1), SHORT_GAP).astype(U)
    raw = ((h & (SHORT_BIT - U(1))) << U(4) | gaps).astype("<u4").tobytes()
    small = zlib.compress(raw, 1)
    return base64.b64encode(b"\1" + small if len(small) < len(raw) else b"\0" + raw).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    word = np.frombuffer(zlib.decompress(raw[1:]) if raw[0] else raw[1:], "<u4").astype(U)
    h, gap = word >> U(4), (word & U(15)).astype(np.int64)
    short = gap == SHORT_GAP
    return np.where(short, h | SHORT_BIT, h), np.concatenate([np.cumsum(gap[~short]) - 1, np.arange(short.sum())])


def _ranked(ra: np.ndarray, rb: np.ndarray, kinds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index, index) of each kind's first with its first, second with second, ...; and the same from the last."""
    edge = np.arange(kinds + 1)
    sa, sb = np.searchsorted(ra, edge), np.searchsorted(rb, edge)
    at = np.arange(len(ra))
    before, after, others = at - sa[ra], sa[ra + 1] - 1 - at, sb[ra + 1] - sb[ra]
    i, z = np.flatnonzero(before < others), np.flatnonzero(after < others)
    return [(i, sb[ra[i]] + before[i]), (z, sb[ra[z] + 1] - 1 - after[z])]


def _crowd(shifts: np.ndarray) -> tuple[int, int]:
    """How many displacements lie within SLACK of the one that has most about it, and the commonest of those."""
    votes = np.sort(shifts)
    low, high = np.searchsorted(votes, votes - SLACK, "left"), np.searchsorted(votes, votes + SLACK, "right")
    best = (high - low).argmax()
    values, counts = np.unique(votes[low[best] : high[best]], return_counts=True)
    return int(high[best] - low[best]), int(values[counts.argmax()])


def _nearest(want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """For each wanted key the index of the nearest of the sorted keys, the smaller of two, -1 beyond SLACK."""
    right = np.searchsorted(have, want, "left")
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(have) - 1)
    near = np.where(np.abs(have[left] - want) <= np.abs(have[right] - want), left, right)
    return np.where(np.abs(have[near] - want) <= SLACK, near, -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Occurrences of anchors that both texts have in matching places, over all of both: 0 to 1, 1 for equal texts.

    The main displacement is the one most pairs of occurrences vote for, where an anchor's first occurrence is paired
    with its first in the other text and so on, or its last with its last, whichever agree better.  On it, two
    occurrences of an anchor match if each is the other's nearest and they are off by SLACK at most.  The rest are
    paired from the first on and match if their displacement is within SLACK of that of the pair before or after them.
    So an anchor that a text repeats counts as often as both texts have it.
    """
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return 1.0 if len(ha) == len(hb) else 0.0
    if (ha[-1] < SHORT_BIT) != (hb[-1] < SHORT_BIT):
        (ha, pa_), (hb, pb) = ((h[h < SHORT_BIT], p[h < SHORT_BIT]) for h, p in ((ha, pa_), (hb, pb)))
    common = np.intersect1d(ha, hb)
    if not len(common):
        return 0.0

    def grouped(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = np.minimum(np.searchsorted(common, h), len(common) - 1)
        both = common[kind] == h
        kind, p = kind[both], p[both]
        order = np.argsort(kind, kind="stable")
        return kind[order], p[order]

    (ra, xa), (rb, xb) = grouped(ha, pa_), grouped(hb, pb)
    _, main = max((_crowd(xb[j] - xa[i]) for i, j in _ranked(ra, rb, len(common))), key=lambda c: c[0])
    base = int(xa.max()) + 1
    here, there = (ra << PLACE_BITS) + (xa + main + base), (rb << PLACE_BITS) + (xb + base)
    to, back = _nearest(here, there), _nearest(there, here)
    on = (to >= 0) & (back[to] == np.arange(len(ra)))
    taken = np.zeros(len(rb), bool)
    taken[to[on]] = True
    count = int(on.sum())
    if not on.all() and not taken.all():
        rest, others = np.flatnonzero(~on), np.flatnonzero(~taken)
        i, j = _ranked(ra[rest], rb[others], len(common))[0]
        i, j = np.concatenate([np.flatnonzero(on), rest[i]]), np.concatenate([to[on], others[j]])
        order = np.lexsort((ra[i], xa[i]))
        i, j = i[order], j[order]
        step = np.abs(np.diff(xb[j] - xa[i])) <= SLACK
        beside = np.zeros(len(i), bool)
        beside[1:] |= step
        beside[:-1] |= step
        count = int((on[i] | beside).sum())
    return count / (len(ha) + len(hb) - count)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many of the following document's first code points."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with column ``fingerprint`` appended, replacing one of that name; one pass, no shuffle."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != "fingerprint"])
    names = [*docs.columns, "fingerprint"]

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pack(s) for s in sketch_many(texts_of(b))], pa.string())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


PER_BLOCK, MAX_BLOCKS, SAMPLED_PER_BLOCK = 2000, 20_000, 100


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block, head) in partitions sorted by (block, head, doc_id, text), nulls first.

    Blocks are ranges of doc_id between splitters from a sample (SAMPLED_PER_BLOCK ids for each of at most MAX_BLOCKS
    blocks, which bounds what the driver gets).  The rows with a block's first id come once more at the end of the
    block before, with head true; those of the first block at the end of the last.  So every row's successor in the
    whole order is in its own block, and the text moves once.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n // PER_BLOCK)))
    wanted = blocks * SAMPLED_PER_BLOCK
    some = ids if n <= wanted else ids.sample(False, wanted / n, seed=1)
    seen = np.sort(np.array([r[0] for r in some.limit(2 * wanted).collect() if r[0] is not None], np.int64))
    cuts = np.unique(seen[(np.arange(1, blocks) * len(seen)) // blocks]) if len(seen) else seen

    def place(known: np.ndarray, null: np.ndarray) -> np.ndarray:
        return np.where(null, 0, np.searchsorted(cuts, known, "right"))

    def arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return pc.fill_null(col, 0).to_numpy(zero_copy_only=False), pc.is_null(col).to_numpy(zero_copy_only=False)

    def firsts(batches):
        for b in batches:
            if b.num_rows:
                known, null = arrays(b.column("doc_id"))
                at = place(known, null)
                low = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, at[~null], known[~null])
                has = np.zeros(len(cuts) + 1, bool)
                has[at[null]] = True
                used = np.unique(at)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(low[used]), pa.array(has[used])], names=["block", "low", "nulls"])

    heads = {r["block"]: (r["nulls"], r["low"]) for r in ids.mapInArrow(firsts, "block int, low bigint, nulls boolean").groupBy("block").agg(F.min("low").alias("low"), F.max("nulls").alias("nulls")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def route(batches):
        for b in pieces(batches):
            known, null = arrays(b.column("doc_id"))
            at = place(known, null)
            first = np.array([null[i] if heads[k][0] else (not null[i] and known[i] == heads[k][1]) for i, k in enumerate(at.tolist())], bool)
            again = np.flatnonzero(first)
            rows = pa.array(np.concatenate([np.arange(len(at)), again]))
            target = np.concatenate([at, [before[int(k)] for k in at[again]]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), b.column("text").take(rows), pa.array(target), pa.array(np.arange(len(target)) >= len(at))], names=["doc_id", "text", "block", "head"]
            )

    routed = docs.select("doc_id", F.col("text")).mapInArrow(route, "doc_id bigint, text string, block int, head boolean")
    return routed.repartition(max(1, len(order)), "block").sortWithinPartitions("block", "head", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how like it is to that and to the next document.

    The next document is the next in ascending (doc_id, text), nulls first; after the last comes the first.
    """

    def run(batches):
        held = None  # the last row so far: block, head, doc_id, text, its sketch
        for b in pieces(batches):
            block, head = b.column("block").to_pylist(), b.column("head").to_pylist()
            ids, texts = b.column("doc_id").to_pylist(), texts_of(b)
            sketches = sketch_many(texts)
            rows = list(zip(block, head, ids, texts, sketches))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(r, s) for r, s in zip(rows, rows[1:]) if not r[1] and r[0] == s[0]]
            changed = [edited(r[3], s[3]) for r, s in pairs]
            after = sketch_many(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r, _ in pairs], pa.int64()), pa.array([len(r[3]) for r, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in changed], pa.string()),
                    pa.array([pack(r[4]) for r, _ in pairs], pa.string()), pa.array([pack(e) for e in after], pa.string()),
                    pa.array([likeness(r[4], e) for (r, _), e in zip(pairs, after)], pa.float64()), pa.array([likeness(r[4], s[4]) for r, s in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(docs).mapInArrow(run, RESULT)
