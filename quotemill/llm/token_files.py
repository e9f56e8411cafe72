"""Token ids in files, in ascending doc_id order, written and read by Spark.

A file is a Parquet container of chunks; a chunk is consecutive documents of one part (range of doc_id) with their
ids as one payload of ``token_codec`` (independent, checksummed blocks).  ``before`` counts the part's ids before the
chunk, so a document's place among all ids needs one number for each part besides its own chunk.

Texts are encoded by the tokenizers library; pieces met before are looked up (a piece's ids don't depend on what
stands around it), new ones go to the library.  With ``added`` the tokenizer's special tokens are matched in texts, as
the library does by default, without it they are text like any other; a text with a token to match goes to the
library whole.  Null text is empty: its only id is the end id.  Rows with equal doc_id are ordered by text, nulls
first.  An empty table gives no chunks.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_codec
from .byte_bpe import PieceCache, piece_starts, ragged
from .textvec import code_points
from .workspace import held, pieces, scratch, texts_of, trim

END_ID = 0
#: A part of as many ids has no smaller last chunk, and a chunk twice as many at most (a longer document is a chunk of its
#: own): the coder takes a step for all blocks of a chunk at once, so ids of small chunks cost several times as much.
CHUNK_IDS = 4 << 20
CHUNK_SCHEMA = "part int, chunk int, before bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"


#: Pieces met before that a worker keeps at most, besides those of the texts at hand.
KNOWN_PIECES = 1_000_000


def _byte_chars() -> np.ndarray:
    """The printable character's code point that stands for each byte in a byte-level vocabulary; 0 for 0xFF, which no text holds."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = np.arange(256, dtype="<u4")
    others = np.setdiff1d(chars, own)
    chars[others] = 256 + np.arange(len(others))
    chars[0xFF] = 0
    return chars


def _cache(path: str | None, added: bool) -> tuple[PieceCache, list[str]]:
    """The pieces met before, and the tokens that no piece may be looked up around."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        tokenizer.encode_special_tokens = not added
        matched = [t.content for t in tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split, model, chars = tokenizer.pre_tokenizer, tokenizer.model, _byte_chars()
        # A piece is one word to the library's model, where nothing but the split into words comes before it.
        plain = tokenizer.normalizer is None and isinstance(split, ByteLevel) and not split.add_prefix_space

        def words(new):
            text = chars[np.frombuffer(b"\xff".join(new), np.uint8)].tobytes().decode("utf-32-le")
            return [[t.id for t in model.tokenize(w)] for w in text.split("\0")]

        cache = PieceCache(words if plain else lambda new: whole([p.decode() for p in new]), KNOWN_PIECES)
        cache.encode_whole = whole
        return cache, matched

    return held(f"tokenizer {path} {added}", make)


def _look_up(texts: list[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """encode() without tokens to match: each distinct piece of the texts, as bytes, is looked up once."""
    cps, offsets = code_points(texts)
    starts = piece_starts(cps, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    data = "".join(texts).encode()
    cuts = np.append(starts, len(cps))
    if len(data) > len(cps):
        width = np.ones(len(cps), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += cps >= least
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        cuts = at[cuts]
    wide = len(data) >= 1 << 31
    found = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)]).dictionary_encode()
    kept = found.dictionary.cast(pa.large_binary())
    ends, held_by = np.frombuffer(kept.buffers()[1], np.int64, len(kept) + 1).tolist(), kept.buffers()[2].to_pybytes()
    distinct = [held_by[a:b] for a, b in zip(ends, ends[1:])]
    numbers = np.fromiter(map(cache.__getitem__, distinct), np.int64, len(distinct))
    cache.settle()
    index = found.indices.to_numpy()
    begin, count = cache.begin[numbers], cache.count[numbers]
    if len(cache) > cache.limit:
        flat = cache.flat[ragged(begin, count)]
        begin = np.cumsum(count) - count
        cache.reset()
        cache.update(zip(distinct, range(len(distinct))))
        cache.flat, cache.begin, cache.count = flat, begin, count
    n = count[index]
    piece_at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(n, out=piece_at[1:])
    return cache.flat[ragged(begin[index], n)], piece_at[np.searchsorted(starts, offsets)]


def encode(texts: list[str], cache: PieceCache, matched: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, each text's offset among the ids)."""
    whole = [i for i, t in enumerate(texts) if any(m in t for m in matched)]
    if not whole:
        return _look_up(texts, cache)
    looked_up = list(texts)
    for i in whole:
        looked_up[i] = ""
    ids, at = _look_up(looked_up, cache)
    parts = [ids[a:b] for a, b in zip(at, at[1:])]
    for i, found in zip(whole, cache.encode_whole([texts[i] for i in whole])):
        parts[i] = np.array(found, np.uint32)
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def with_end(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ids with END_ID after each text's."""
    return np.insert(ids, at[1:], END_ID)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, chunk_ids: int = CHUNK_IDS, added: bool = False) -> None:
    """Encodes docs (doc_id, text) to files below path; the text moves once, into ranges of doc_id."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]

    def run(batches):
        (cache, matched), part = _cache(tokenizer, added), TaskContext.get().partitionId()
        before = chunk = n_held = 0
        rows = []  # (doc_ids, counts, ids) of consecutive documents

        def close(k):
            nonlocal before, chunk, n_held, rows
            doc_ids, counts, ids = (np.concatenate(x) if j else pa.concat_arrays(x) for j, x in enumerate(zip(*rows[:k])))
            rows = rows[k:]
            trim()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([token_codec.encode(ids)], pa.binary()),
                ],
                names=["part", "chunk", "before", "doc_ids", "counts", "payload"],
            )
            before, chunk, n_held = before + len(ids), chunk + 1, n_held - len(ids)
            return out

        for b in pieces(batches):
            ids, at = encode(texts_of(b), cache, matched)
            all_ids, n = with_end(ids, at), np.diff(at) + 1
            while rows and n_held + len(all_ids) > 2 * chunk_ids:
                yield close(max(1, int(np.searchsorted(np.cumsum([len(r[2]) for r in rows]), chunk_ids, "right"))))
            rows.append((b.column("doc_id").cast(pa.int64()), n, all_ids))
            n_held += len(all_ids)
        if rows:
            yield close(len(rows))

    docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(run, CHUNK_SCHEMA).write.parquet(path)


def _offsets(chunks: DataFrame) -> DataFrame:
    """Each part's first place among all ids: a row for each part, so bounded by the writer's number of tasks."""
    spark = chunks.sparkSession
    n_ids = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    total, rows = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.sum(n_ids).alias("n")).collect()):
        rows.append((part, total))
        total += n
    return spark.createDataFrame(rows, "part int, part_start bigint")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every document in the files."""
    return _read(spark, path, "doc_id bigint, start bigint, ids array<int>", lambda ids: pa.array(ids.astype(np.int32)))


def _read(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    placed = chunks.join(F.broadcast(_offsets(chunks)), "part").select((F.col("part_start") + F.col("before")).alias("first"), "doc_ids", "counts", "payload")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ids = token_codec.decode(row["payload"])
                n = np.array(row["counts"], np.int64)
                ends = np.cumsum(n)
                if len(names) == 3:
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - n), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), value(ids))], names=names)
                else:
                    raw = ids.astype("<u4")
                    crc = [zlib.crc32(raw[e - c : e].tobytes()) for c, e in zip(n, ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=names)

    return placed.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str | None = None, added: bool = False) -> DataFrame:
    """doc_id, start, n_tokens (with the end id) and ids_crc32 as read back from files written for docs."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer, added=added)
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", None)
