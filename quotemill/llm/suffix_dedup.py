"""Removal of byte strings of 50 that also start in a document with a smaller doc_id, by a sparse suffix array.

Only some suffixes are sorted: those at anchors, chosen so that equal 50-byte strings have equal anchors at equal
places (the string's 16-byte substring of smallest hash).  Each window of 50 bytes belongs to one anchor, so two
windows are equal exactly if their anchors' suffixes and the bytes before them agree far enough.

1. Every map task lists its anchors' k-mer hashes; a shuffle by hash tells which k-mers are in two documents or more.
   K-mers that many documents of a task share are known to repeat at once and are sent only once for the task.
2. By chunk of documents, the repeated anchors become records (the bytes of all windows of the anchor); equal records
   of a chunk are one, with the chunk's smallest doc_id.
3. Sampled splitters range-partition the records by the leading tokens of their suffix.  Each bucket sorts suffixes,
   and the reversed bytes before the anchors, by multikey quicksort on 8-byte tokens, and common-prefix lengths of
   neighbours give the classes of windows that are equal.  Equal windows have equal leading tokens, so no class is
   cut by a bucket's boundary; a k-mer's records are bounded by the number of chunks and of its distinct contexts.
4. A class's smallest doc_id decides for each record which windows go; the spans return to their chunks.

Strings are compared within documents, on the input.  Null text is empty.  A row with null doc_id neither removes
nor loses bytes.  Rows that share a doc_id don't remove each other's bytes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U, eights, hashes, mix
from .workspace import pieces, utf8_buffer

LENGTH, K = 50, 16
WINDOW = LENGTH - K + 1
POSITION_BITS = 26
#: Documents in a chunk, documents whose anchors share a bucket of step 1, and records in a bucket of step 3, on average.
CHUNK_DOCS, HASH_DOCS, RANGE_DOCS = 1000, 6_000, 6_000
#: A k-mer in so many documents of one task is known to repeat and isn't sent for each.
LOCAL = 32
SAMPLE, AVERAGE = 20_000, 400  # leads, and anchors of an average document


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, k-mer hash, position, first window, end of windows) of each anchor; places count from data's start."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if n < LENGTH or not (lengths >= LENGTH).any():
        return empty, empty.astype(U), empty, empty, empty
    at = eights(data)
    m = n - K + 1
    h = mix(at[:m] * U(0x9E3779B97F4A7C15) ^ mix(at[8 : m + 8] + U(0xA0761D6478BD642F)))
    bits = max(POSITION_BITS, int(n).bit_length())
    low = (h & ~U((1 << bits) - 1)) | np.arange(m, dtype=U)
    # Sliding minimum of WINDOW = 35 by doubling to 32, then two windows of 32 that overlap.
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    s = n - LENGTH + 1
    low = np.minimum(low[:s], low[WINDOW - 32 : WINDOW - 32 + s])
    place = (low & U((1 << bits) - 1)).astype(np.int64)
    valid = np.ones(s, bool)
    for e in offsets[1:-1][lengths[:-1] > 0]:
        valid[max(0, e - LENGTH + 1) : e] = False
    first = np.empty(s, bool)
    first[0] = True
    first[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], s)
    ok = valid[starts]
    starts, ends = starts[ok], ends[ok]
    pos = place[starts]
    return np.searchsorted(offsets, starts, "right") - 1, h[pos], pos, starts, ends


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, count in kinds:
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return out


HASHED = "bucket int, rids binary, n bigint, entries binary"
PLACED = "chunk int, n bigint, places binary"


def _first_step(buckets: int):
    """Rows (bucket, rids, entries) of a task: hash, row and position of its anchors, or with bucket >= buckets the
    row and position of those already known to repeat."""

    def flush(rids, parts):
        rid = np.array(rids, np.int64)
        h, row, pos = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(h, kind="stable")
        hs, rows = h[order], row[order]
        cut = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        size = np.diff(np.r_[cut, len(hs)])
        docs = np.add.reduceat(np.r_[True, (rows[1:] != rows[:-1]) | (hs[1:] != hs[:-1])].astype(np.int64), cut)
        many = np.repeat(docs >= LOCAL, size)
        hot = np.zeros(len(h), bool)
        hot[order[many]] = True
        told = np.zeros(len(h), bool)
        told[order[cut[docs >= LOCAL]]] = True
        shift = U(64 - buckets.bit_length() + 1)
        home = (mix(h) >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)  # chosen hashes are small ones
        out = []

        def row_of(bucket, which, flag):
            used, local = np.unique(row[which], return_inverse=True)
            kept = rid[used]
            five = (h[which] & U((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            out.append((bucket, kept.astype("<i8").tobytes(), len(which), _squeeze(np.ascontiguousarray(five), flag.astype(np.uint8), local.astype("<u2"), pos[which].astype("<u4"))))

        send = np.flatnonzero(~hot | told)
        send = send[np.argsort(home[send], kind="stable")]
        for part in np.split(send, np.flatnonzero(np.diff(home[send])) + 1):
            if len(part):
                row_of(int(home[part[0]]), part, told[part])
        known = np.flatnonzero(hot)
        if len(known):
            row_of(buckets + int(rid[0] % buckets), known, np.ones(len(known)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())], names=["bucket", "rids", "n", "entries"])

    def run(batches):
        rids, parts, total = [], [], 0
        for b in pieces(batches, limit=1 << 20):
            b = b.filter(pc.is_valid(b.column("doc_id")))
            if not b.num_rows:
                continue
            data, offsets = utf8_buffer(b.column("text"))
            doc, h, pos, _, _ = anchors(data, offsets)
            if len(rids) + b.num_rows > 60_000 or total > 250_000:
                if total:
                    yield flush(rids, parts)
                rids, parts, total = [], [], 0
            parts.append((h, doc + len(rids), pos - offsets[doc]))
            rids += b.column("rid").to_pylist()
            total += len(h)
        if total:
            yield flush(rids, parts)

    return run


def _by_chunk(rid: np.ndarray, pos: np.ndarray, chunks: int) -> list[tuple[int, int, bytes]]:
    chunk = rid % chunks
    order = np.lexsort((pos, rid, chunk))
    rid, pos, chunk = rid[order], pos[order], chunk[order]
    cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(rid) else []
    out = []
    for a, b in zip(cut, [*cut[1:], len(rid)]):
        used, local = np.unique(rid[a:b], return_inverse=True)
        out.append((int(chunk[a]), b - a, np.array([len(used)], "<u4").tobytes() + _squeeze(used.astype("<i8"), local.astype("<u2"), pos[a:b].astype("<u4"))))
    return out


def _repeated(buckets: int, chunks: int):
    """The (rid, position) of the anchors of a bucket whose k-mer is in two documents, by chunk."""

    def run(table: pa.Table) -> pa.Table:
        hs, docs, flags, poss, tasks = [], [], [], [], []
        known = table.column("bucket")[0].as_py() >= buckets
        for i, (rids, n, blob) in enumerate(zip(*(table.column(c).to_pylist() for c in ("rids", "n", "entries")))):
            five, flag, row, pos = _expand(blob, ("u1", 5 * n), ("u1", n), ("<u2", n), ("<u4", n))
            h = np.zeros((n, 8), np.uint8)
            h[:, :5] = five.reshape(n, 5)
            hs.append(h.view("<u8").ravel())
            docs.append(np.frombuffer(rids, "<i8")[row])
            flags.append(flag)
            poss.append(pos)
        h, doc, flag, pos = (np.concatenate(x) for x in (hs, docs, flags, poss))
        if known:
            out = _by_chunk(doc, pos.astype(np.int64), chunks)
        else:
            order = np.argsort(h, kind="stable")
            hh, dd, ff = h[order], doc[order], flag[order]
            cut = np.flatnonzero(np.r_[True, hh[1:] != hh[:-1]])
            several = (np.minimum.reduceat(dd, cut) != np.maximum.reduceat(dd, cut)) | (np.maximum.reduceat(ff, cut) > 0)
            hit = order[np.repeat(several, np.diff(np.r_[cut, len(hh)])) & (ff == 0)]
            out = _by_chunk(doc[hit], pos[hit].astype(np.int64), chunks)
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int32()), "n": pa.array([o[1] for o in out], pa.int64()), "places": pa.array([o[2] for o in out], pa.binary())})

    return run


def _chunk_docs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rids, doc_ids, their validity, bytes, offsets) of a chunk, in the order of rid."""
    table = table.combine_chunks().sort_by("rid")
    column = table.column("text")
    data, offsets = utf8_buffer(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
    ids = table.column("doc_id")
    return table.column("rid").to_numpy(), pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(), data, offsets


RECORDS = "bucket int, chunk int, docs binary, n bigint, n_refs bigint, shape binary, slices binary, refs binary"  # docs: those that refs use


def _records(splitters: np.ndarray):
    """The repeated anchors of a chunk as records, by range of their suffixes' leading tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            chunk = left.column("chunk")[0].as_py()
            rid, ids, fine, data, offsets = _chunk_docs(left)
            wanted = []
            for n, blob in zip(right.column("n").to_pylist(), right.column("places").to_pylist()):
                used = int(np.frombuffer(blob, "<u4", 1)[0])
                r, local, pos = _expand(blob[4:], ("<i8", used), ("<u2", n), ("<u4", n))
                wanted.append(np.stack([r[local], pos.astype(np.int64)], 1))
            wanted = np.concatenate(wanted)
            lo, hi = np.searchsorted(rid, wanted[:, 0]), np.searchsorted(rid, wanted[:, 0], "right")
            copies = hi - lo  # identical rows have the same rid
            row = np.repeat(lo, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            target = np.unique(offsets[row] + np.repeat(wanted[:, 1], copies))
            doc, _, pos, start, end = anchors(data, offsets)
            ok = np.isin(pos, target, assume_unique=False) & fine[doc]
            doc, pos, start, end = doc[ok], pos[ok], start[ok], end[ok]
            if len(doc):
                stop = end + LENGTH - 1
                same = mix(hashes(data, start, stop) ^ U(0x165667B19E3779F9)) + (pos - start).astype(U)
                _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
                smallest = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(smallest, inverse, ids[doc])
                lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, K)[pos[first]]).view(f"S{K}").ravel()
                bucket = np.searchsorted(splitters, lead, "right")
                rank = np.empty(len(first), np.int64)
                order = np.argsort(bucket, kind="stable")
                rank[order] = np.arange(len(order))
                by_record = np.argsort(rank[inverse], kind="stable")
                ref_count = np.bincount(rank[inverse], minlength=len(first))
                ref_end = np.cumsum(ref_count)
                cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
                for a, b in zip(cut, [*cut[1:], len(order)]):
                    f = first[order[a:b]]
                    refs = by_record[ref_end[a] - ref_count[a] : ref_end[b - 1]]
                    slices = np.concatenate([data[x:y] for x, y in zip(start[f], stop[f])])
                    used, own = np.unique(doc[refs], return_inverse=True)
                    rows.append(
                        (
                            int(bucket[order[a]]), chunk, np.array([len(used)], "<u4").tobytes() + _squeeze(used.astype("<u4"), ids[used].astype("<i8")), b - a, len(refs),
                            _squeeze((pos[f] - start[f]).astype(np.uint8), (end[f] - start[f]).astype(np.uint8), smallest[order[a:b]].astype("<i8"), ref_count[a:b].astype("<u4")),
                            zstandard.ZstdCompressor(level=3).compress(slices.tobytes()), _squeeze(own.astype("<u4"), (start[refs] - offsets[doc[refs]]).astype("<u4")),
                        )
                    )
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names=[c.split()[0] for c in RECORDS.split(", ")])

    return run


def multikey_sort(tokens: np.ndarray) -> np.ndarray:
    """The order of rows of tokens (most significant first): rows that agree so far are sorted by the next token."""
    n, width = tokens.shape
    order = np.argsort(tokens[:, 0], kind="stable")
    group = np.zeros(n, np.int64)
    if n:
        group[1:] = np.cumsum(tokens[order[1:], 0] != tokens[order[:-1], 0])
    for k in range(1, width):
        tied = np.zeros(n, bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows, g = order[at], group[at]
        inner = np.lexsort((tokens[rows, k], g))
        order[at] = rows[inner]
        split = np.zeros(n, bool)
        new = order[at]
        split[at[1:]] = (group[at[1:]] == group[at[:-1]]) & (tokens[new[1:], k] != tokens[new[:-1], k])
        group = group + np.cumsum(split)
    return order


def _prefix_classes(table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before) of rows of bytes, padded to whole 8-byte tokens."""
    order = multikey_sort(table.view(">u8").astype(U))
    common = np.zeros(len(table), np.uint8)
    if len(table) > 1:
        for a in range(1, len(table), 200_000):
            b = min(a + 200_000, len(table))
            differ = table[order[a:b], :width] != table[order[a - 1 : b - 1], :width]
            some = differ.any(1)
            common[a:b] = np.where(some, differ.argmax(1), width)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """For each row the number of the group that shares its first ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    new = common < length
    if len(new):
        new[0] = False
    out[order] = np.cumsum(new)
    return out


def _gone(table: pa.Table) -> pa.Table:
    """The spans to remove, by chunk, that a bucket's records show."""
    heads = []
    for chunk, docs, n, n_refs, shape, slices, refs in zip(*(table.column(c).to_pylist() for c in ("chunk", "docs", "n", "n_refs", "shape", "slices", "refs"))):
        lead, count, smallest, ref_count = _expand(shape, ("u1", n), ("u1", n), ("<i8", n), ("<u4", n))
        own, start = _expand(refs, ("<u4", n_refs), ("<u4", n_refs))
        n_docs = int(np.frombuffer(docs, "<u4", 1)[0])
        used, ids = _expand(docs[4:], ("<u4", n_docs), ("<i8", n_docs))
        heads.append((chunk, lead.astype(np.int64), count.astype(np.int64), smallest, ref_count, zstandard.ZstdDecompressor().decompress(slices), used[own], start, ids[own]))
    lead, count, smallest = (np.concatenate([h[k] for h in heads]) for k in (1, 2, 3))
    data = np.frombuffer(b"".join(h[5] for h in heads), np.uint8)
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    total = len(lead)
    padded = np.concatenate([np.zeros(WINDOW + 8, np.uint8), data, np.zeros(64, np.uint8)])
    base = begin + lead + WINDOW + 8
    view = np.lib.stride_tricks.sliding_window_view(padded, 56)
    right = np.ascontiguousarray(view[base])
    reach = size - lead
    right[np.arange(56)[None, :] >= np.minimum(reach, LENGTH)[:, None]] = 0
    r_order, r_common = _prefix_classes(right, LENGTH)
    del right
    left = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 40)[base - 40][:, ::-1])
    left[np.arange(40)[None, :] >= lead[:, None]] = 0
    l_order, l_common = _prefix_classes(left, WINDOW - 1)
    del left, padded, data, view
    # first[i, w]: the rank of the smallest doc_id among the windows equal to window w of record i.
    ranked, smallest = np.unique(smallest, return_inverse=True)
    smallest = smallest.astype(np.int32)
    first = np.full((total, WINDOW), len(ranked), np.int32)
    for back in range(WINDOW):
        w = lead - back
        at = np.flatnonzero((w >= 0) & (w < count))
        if not len(at):
            continue
        key = _classes(l_order, l_common, back)[at] * (total + 1) + _classes(r_order, r_common, LENGTH - back)[at]
        o = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(key[o]) != 0])
        low = np.minimum.reduceat(smallest[at[o]], cut)
        first[at[o], w[at[o]]] = np.repeat(low, np.diff(np.r_[cut, len(o)]))
    out, at = [], 0
    for chunk, _, cnt, _, ref_count, _, row, start, ids in heads:
        record = at + np.repeat(np.arange(len(cnt)), ref_count)
        at += len(cnt)
        spans = []
        for a in range(0, len(record), 200_000):
            rec, rw, st = record[a : a + 200_000], row[a : a + 200_000].astype(np.int64), start[a : a + 200_000].astype(np.int64)
            hit = first[rec] < np.searchsorted(ranked, ids[a : a + 200_000])[:, None]
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, x = np.nonzero(edge == 1)
            _, y = np.nonzero(edge == -1)
            spans.append(np.stack([rw[i], st[i] + x, st[i] + y + LENGTH - 1], 1))
        s = _merged(np.concatenate(spans)) if spans else np.zeros((0, 3), np.int64)
        if len(s):
            out.append((chunk, len(s), _squeeze(s[:, 0].astype("<u4"), s[:, 1].astype("<u4"), (s[:, 2] - s[:, 1]).astype("<u4"))))
    return pa.table({"chunk": pa.array([o[0] for o in out], pa.int32()), "n": pa.array([o[1] for o in out], pa.int64()), "places": pa.array([o[2] for o in out], pa.binary())})


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (document, start, end) with those that overlap or touch joined, sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    wide = int(spans[:, 2].max()) + 2
    start, end = spans[:, 0] * wide + spans[:, 1], spans[:, 0] * wide + spans[:, 2]
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    cut = np.flatnonzero(new)
    last = np.r_[cut[1:], len(spans)] - 1
    return np.stack([spans[cut, 0], spans[cut, 1], reach[last] - spans[cut, 0] * wide], 1)


DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _results(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c or "text" in c else pa.int64()) for c in (DIGESTS + (", kept_text binary" if with_text else "")).split(", ")})
        _, ids, fine, data, offsets = _chunk_docs(left)
        spans = [np.zeros((0, 3), np.int64)]
        for n, blob in zip(right.column("n").to_pylist(), right.column("places").to_pylist()):
            row, start, size = (x.astype(np.int64) for x in _expand(blob, ("<u4", n), ("<u4", n), ("<u4", n)))
            spans.append(np.stack([row, start, start + size], 1))
        spans = _merged(np.concatenate(spans))
        cut = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1))
        sha, removed, kept = [], np.zeros(len(ids), np.int64), []
        for i in range(len(ids)):
            own = spans[cut[i] : cut[i + 1]]
            body = data[offsets[i] : offsets[i + 1]]
            if len(own):
                mask = np.ones(len(body), bool)
                for _, a, b in own:
                    mask[a:b] = False
                removed[i] = len(body) - mask.sum()
                body = body[mask]
            raw = body.tobytes()
            sha.append(hashlib.sha256(raw).hexdigest())
            if with_text:
                kept.append(raw)
        columns = {"doc_id": pa.array(ids, pa.int64(), mask=~fine), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(cut).astype(np.int64)), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    return run


def _splitters(docs: DataFrame, n: int, buckets: int) -> np.ndarray:
    """buckets - 1 cuts among the leading tokens of a sample's anchors: 40 documents for each bucket, and of their anchors a
    share by hash such that about SAMPLE come from documents of average length, however many documents there are."""
    if buckets < 2:
        return np.zeros(0, f"S{K}")
    wanted = min(n, 40 * buckets)
    least = U((2**64 - 1) * SAMPLE // max(SAMPLE, AVERAGE * wanted))

    def leads(batches):
        for b in pieces(batches, limit=1 << 20):
            data, offsets = utf8_buffer(b.column("text"))
            _, h, pos, _, _ = anchors(data, offsets)
            pos = pos[mix(h) <= least]
            yield pa.RecordBatch.from_arrays([pa.array([data[p : p + K].tobytes() for p in pos], pa.binary())], names=["lead"])

    some = docs.select("text").sample(False, min(1.0, wanted / max(n, 1)), seed=3).mapInArrow(leads, "lead binary").collect()
    found = np.sort(np.array([bytes(r[0]) for r in some], f"S{K}"))
    return np.unique(found[(np.arange(1, buckets) * len(found)) // buckets]) if len(found) else found


def _power(x: int) -> int:
    return 1 << max(0, (x - 1).bit_length())


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs; with_text adds the remaining bytes."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    chunks, buckets, ranges = max(1, -(-n // CHUNK_DOCS)), _power(max(16, -(-n // HASH_DOCS))), max(1, min(16, -(-n // 50)), -(-n // RANGE_DOCS))
    splitters = _splitters(docs, n, ranges)
    rows = docs.withColumn("rid", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    chunked = rows.withColumn("chunk", F.pmod("rid", F.lit(chunks)).cast("int"))
    hashed = rows.mapInArrow(_first_step(buckets), HASHED)
    places = hashed.groupBy("bucket").applyInArrow(_repeated(buckets, chunks), PLACED)
    records = chunked.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(_records(splitters), RECORDS)
    gone = records.groupBy("bucket").applyInArrow(_gone, PLACED)
    return chunked.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_results(with_text), DIGESTS + (", kept_text binary" if with_text else ""))
