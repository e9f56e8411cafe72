"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokens of ``public_tokenizers.PATTERN`` are found by arrays: each code point gets a symbol (its class, with the
look-ahead an apostrophe or a white-space run needs); each symbol is a function from scanner state to scanner state;
these functions form a small monoid, so their products are computed by an associative scan (rows of 64 at once, then
the rows' totals); a pre-token starts where state and classes say so.  The slices go through a cache of merged
pieces, and the places of pieces and ids are kept, so that decoding can address any id's bytes.

Null text is empty and gives no ids.  A text of any length is encoded whole; merging a piece of n bytes takes
O(n log n).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textvec import categories, code_points
from .workspace import held, pieces, texts_of, trim

# ---------------------------------------------------------------- pre-tokenisation

LETTER, NUMBER, OTHER, SPACE, BLANK = 0, 1, 2, 3, 4  # BLANK: white space that is not U+0020
TAIL_ONE, TAIL_TWO = 5, 6  # an apostrophe before one or two letters that make it a contraction
#: States: after something a contraction may follow; after U+0020 or a run of others; one, two letters of a contraction to come; a contraction just ended.
FREE, HELD, ONE, TWO, ENDED = range(5)
_STEP = {
    LETTER: (FREE, FREE, ENDED, ONE, FREE),
    NUMBER: (FREE, FREE, FREE, FREE, FREE),
    OTHER: (HELD, HELD, HELD, HELD, HELD),
    SPACE: (HELD, HELD, HELD, HELD, HELD),
    BLANK: (FREE, FREE, FREE, FREE, FREE),
    TAIL_ONE: (ONE, HELD, HELD, HELD, ONE),
    TAIL_TWO: (TWO, HELD, HELD, HELD, TWO),
}
RESET = 7  # at a text's first character: any state before it is FREE


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(element of each symbol, products, state reached from FREE by each element, identity), by closure."""
    identity = tuple(range(5))
    found = {identity: 0}
    order = [identity]
    generators = [_STEP[s] for s in range(7)] + [(FREE,) * 5]
    for f in order:
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(order)
                order.append(h)
    product = np.array([[found[tuple(g[s] for s in f)] for g in order] for f in order], np.uint8)
    return np.array([found[g] for g in generators], np.uint8), product, np.array([f[FREE] for f in order], np.uint8), found[identity]


def _scan(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive products of monoid elements, left to right."""
    _, product, _, identity = _monoid()
    flat = product.ravel()
    size = len(product)
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    table = np.full(rows * width, identity, np.uint8)
    table[:n] = elements
    table = np.ascontiguousarray(table.reshape(rows, width).T)
    for j in range(1, width):
        table[j] = flat[table[j - 1].astype(np.intp) * size + table[j]]
    carry = np.empty(rows, np.uint8)
    carry[0] = identity
    carry[1:] = _scan(table[-1])[:-1]
    return np.ascontiguousarray(flat[carry.astype(np.intp)[None, :] * size + table].T).ravel()[:n]


@functools.cache
def _classes() -> np.ndarray:
    kind = np.array([OTHER, LETTER, NUMBER, BLANK], np.uint8)[categories()]
    kind[0x20] = SPACE
    return kind


def piece_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points of texts that lie one after another."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cps]
    symbol = kind.copy()
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    last = first[1:]
    first = first[:n]
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        text_end = offsets[np.searchsorted(offsets, at, "right")]
        one = np.where(at + 1 < text_end, cps[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < text_end, cps[np.minimum(at + 2, n - 1)], 0)
        # The contractions of the pattern are 's 't 'm 'd and 're 've 'll.
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = TAIL_ONE
        symbol[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = TAIL_TWO
    generator, product, _, _ = _monoid()
    elements = generator[symbol]
    starts_at = np.flatnonzero(first)
    elements[starts_at] = product[generator[RESET], elements[starts_at]]
    reached = _scan(elements)
    state = np.empty(n, np.uint8)  # before each character
    state[0] = FREE
    state[1:] = _monoid()[2][reached[:-1]]
    state[starts_at] = FREE

    previous = np.empty(n, np.uint8)
    previous[0] = BLANK
    previous[1:] = kind[:-1]
    white = kind >= SPACE
    white_before = previous >= SPACE
    # A word, number or run of others goes on through its own class; U+0020 before it belongs to it; a contraction's letters belong to its apostrophe.
    start = np.where(white, ~white_before, (kind != previous) & (previous != SPACE))
    start |= (state == ENDED) & ~white
    inside = (state == ONE) | (state == TWO)
    start &= ~inside
    # The last of several white spaces stands apart unless the text ends with it.
    final = np.zeros(n, bool)
    final[:-1] = white[:-1] & ~white[1:]
    final &= ~last
    start |= final
    start |= first
    return np.flatnonzero(start)


# ---------------------------------------------------------------- merging

BIG = 1 << 60
#: Bytes of text that are in work at once.
PIECE = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: adjacent parts join in the order of rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get(piece[i : end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:stop])
            if r is not None:
                heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PieceCache(dict):
    """piece -> its number; numbers address arrays of ids.  Emptied when it holds ``limit`` pieces.

    ``encode_new`` gets the list of pieces not met before and returns the ids of each.
    """

    def __init__(self, encode_new, limit: int = 250_000):
        self.encode_new, self.limit = encode_new, limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def settle(self) -> None:
        """Encodes what came new and appends it to the arrays."""
        if self.new:
            parts = self.encode_new(self.new)
            count = np.array([len(p) for p in parts], np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(parts), np.uint32, int(count.sum()))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.flat = np.concatenate([self.flat, flat])
            self.count = np.concatenate([self.count, count])
            self.new = []


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices of ranges [begin, begin+count), one after another."""
    total = int(count.sum())
    out_at = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(begin - out_at, count)


def encode_texts(texts: list[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, each text's offset among the ids, piece starts in code points, each piece's offset among the ids)."""
    cps, offsets = code_points(texts)
    starts = piece_starts(cps, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), starts, np.zeros(1, np.int64)
    joined = "".join(texts)
    if len(cache) > cache.limit:
        cache.reset()
    cuts = starts.tolist()
    cuts.append(len(joined))
    at = np.fromiter(map(cache.__getitem__, [joined[a:b] for a, b in zip(cuts, cuts[1:])]), np.int64, len(starts))
    cache.settle()
    count = cache.count[at]
    ids = cache.flat[ragged(cache.begin[at], count)]
    piece_at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(count, out=piece_at[1:])
    return ids, piece_at[np.searchsorted(starts, offsets)], starts, piece_at


class Decoder:
    """Ids to bytes by one gather."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {i: b for b, i in ranks.items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(b) for b in table], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.begin[ids], self.length[ids])].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the decoded text, and its length at the end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[ids], out=out[1:])
        return out


def _codec(path: str) -> tuple[PieceCache, Decoder]:
    def make():
        ranks = load_ranks(path)
        return PieceCache(lambda new: [merge(p.encode("utf-8", "surrogatepass"), ranks) for p in new]), Decoder(ranks)

    return held(f"codec {path}", make)


def vocabulary(path: str | None) -> str:
    """The rank file's place: as given, else the multilingual vocabulary of the installed package, found where the code runs."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with column ``ids`` (array of int) appended, replacing one of that name; one pass, no shuffle."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != "ids"])
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    names = schema.names

    def run(batches):
        cache, _ = _codec(vocabulary(path))
        for b in pieces(batches, limit=PIECE):
            ids, at, _, _ = encode_texts(texts_of(b), cache)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with column ``decoded`` (binary) appended."""
    encoded = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    names = schema.names

    def run(batches):
        _, decoder = _codec(vocabulary(path))
        for b in batches:
            out = [decoder.decode(np.asarray(v, np.int64)) for v in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=names)

    return encoded.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, both digested in one pass.

    A row for each row of docs, repeated rows and null doc_ids too; null text is empty; other columns are ignored.
    """

    def run(batches):
        cache, decoder = _codec(vocabulary(path))
        for b in pieces(batches, limit=PIECE):
            ids, at, _, _ = encode_texts(texts_of(b), cache)
            raw = ids.astype("<u4")
            back = decoder.decode(ids.astype(np.int64))
            ends = decoder.offsets(ids.astype(np.int64))[at]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(at)), pa.array([sha(raw[i:j].tobytes()) for i, j in zip(at, at[1:])], pa.string()), pa.array([sha(back[i:j]) for i, j in zip(ends, ends[1:])], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


