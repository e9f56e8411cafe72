"""Maximal runs of repeated words, by the runs theorem, and texts without the repeats.

A run is a longest stretch in which words q apart are identical, q being its smallest period.  Every run of at least
two periods holds a Lyndon word of length q, in one of two alphabets (words in some order, and in its reverse), that is
the longest Lyndon word from its first place; these end before the next smaller suffix.  So: the ranks of all suffixes in
both orders, the next smaller value of each, and from each such word the stretch's ends by common prefixes of suffixes
(and of those of the mirrored text), which are minima of the array of common prefixes of neighbours, looked up in a
sparse table.  All arrays cover a piece of several texts at once; suffixes end with their text.

Only runs of at least four periods are looked for.  Such a run holds two of its Lyndon words in a row, so a place where
the next one doesn't have the same length, or another word stands at its start, needs no common prefixes.

Words are ``[^\\x20\\x09-\\x0D]+``.  A text is treated whole, in one task; its arrays take about 300 bytes a word.  Null and
empty texts have no words and no runs.  Rows are independent: repeated rows repeat their results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .workspace import pieces, texts_of

LEAST, PERIODS = 6, 4
#: Places next to each other that are looked at one by one before a next smaller value is searched by halving.
NEAR = 8


def _packed_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by several columns of small non-negative integers; packed into one number where they fit."""
    bits = [max(1, int(k.max()).bit_length()) for k in keys]
    place = max(1, (len(keys[0]) - 1).bit_length())
    if sum(bits) + place > 63:
        return np.lexsort(keys[::-1])
    packed = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits):
        packed = packed << b | k
    packed = packed << place | np.arange(len(packed))
    packed.sort()
    return packed & ((1 << place) - 1)


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray, ends: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """The rank (from 1) of each suffix of a text among all, by text and then by symbols; a suffix's end is smallest.

    doc and ends: each place's text and where it ends.  levels takes the ranks by the first 1, 2, 4, … symbols.
    """
    n = len(symbols)
    order = _packed_order([doc, symbols])
    rank = np.empty(n, np.int64)

    def settle(order: np.ndarray, base: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        """Gives ranks to places in order, equal ones alike, from their base; returns those that are not alone."""
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(order)])
        rank[order] = np.repeat(base[first], size)
        return order[np.repeat(size > 1, size)]

    left = settle(order, np.arange(1, n + 1), doc[order], symbols[order])
    h = 1
    if levels is not None:
        levels.append(rank.copy())
    while len(left):
        after = left + h
        second = np.where(after < ends[left], rank[np.minimum(after, n - 1)], 0)
        o = _packed_order([rank[left], second])
        left, second = left[o], second[o]
        old = rank[left]
        # Places of one old rank stand together, from that rank on.
        start = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        within = np.arange(len(left)) - np.repeat(start, np.diff(np.r_[start, len(left)]))
        left = settle(left, old + within, old, second)
        h *= 2
        if levels is not None:
            levels.append(rank.copy())
    return rank


class Minima:
    """Minima of any stretches of an array, by a table of the minima of 1, 2, 4, … values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (1 << len(self.rows)) <= len(values):
            last, k = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-k], last[k:]))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Over [start, stop), which is not empty."""
        out = np.empty(len(start), self.rows[0].dtype)
        level = np.frexp((stop - start).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[start[at]], row[stop[at] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first later place of a smaller value in each place's text, or the text's end."""
    n = len(values)
    found = ends.copy()
    left = np.arange(n)
    for d in range(1, NEAR + 1):
        left = left[left + d < ends[left]]
        hit = values[left + d] < values[left]
        found[left[hit]] = left[hit] + d
        left = left[~hit]
    at = left + NEAR + 1
    open_ = at < ends[left]
    left, at = left[open_], at[open_]
    if not len(left):
        return found
    # Powers of two upwards while no smaller value is among the next 2^k, then downwards into the stretch that has one.
    lows = Minima(values).rows
    level = np.zeros(len(left), np.int64)
    rising = np.arange(len(left))
    for k, row in enumerate(lows):
        fits = at[rising] + (1 << k) <= ends[left[rising]]
        rising = rising[fits]
        free = row[at[rising]] > values[left[rising]]
        rising = rising[free]
        at[rising] += 1 << k
        level[rising] = k + 1
    for k in range(len(lows) - 1, -1, -1):
        fits = np.flatnonzero((level >= k) & (at + (1 << k) <= ends[left]))
        free = fits[lows[k][at[fits]] > values[left[fits]]]
        at[free] += 1 << k
    found[left] = np.minimum(at, ends[left])
    return found


class Extensions:
    """Lengths of common prefixes of suffixes of the same text."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        levels: list[np.ndarray] = []
        self.ends, self.rank = ends, suffix_ranks(symbols, doc, ends, levels) - 1
        order = np.empty(len(symbols), np.int64)
        order[self.rank] = np.arange(len(symbols))
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        same = doc[a] == doc[b]
        for k in range(len(levels) - 1, -1, -1):
            fits = np.flatnonzero(same & (a < ends[a - common]) & (b < ends[b - common]))
            alike = fits[levels[k][a[fits]] == levels[k][b[fits]]]
            for x in (a, b, common):
                x[alike] += 1 << k
        self.least = Minima(common)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i < j of one text, j at most its end."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(j < self.ends[i])
        x, y = self.rank[i[inside]], self.rank[j[inside]]
        out[inside] = self.least(np.minimum(x, y), np.maximum(x, y))
        return out


def find_runs(symbols: np.ndarray, sizes: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """(text, start, length, period) of the runs of texts that follow each other, by text, start and period.

    symbols: numbers from 0, equal for equal words.  A run has max(least, periods * period) words at least; periods is
    three or more.
    """
    none = np.zeros((0, 4), np.int64)
    if not len(symbols):
        return none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    firsts, seconds = [], []
    for alphabet in (symbols, symbols.max() - symbols):
        nsv = next_smaller(suffix_ranks(alphabet, doc, ends), ends)
        i = np.flatnonzero(nsv < ends)
        p = nsv[i] - i
        keep = (nsv[nsv[i]] - nsv[i] == p) & (symbols[i] == symbols[nsv[i]])
        firsts.append(i[keep])
        seconds.append(p[keep])
    i, p = np.concatenate(firsts), np.concatenate(seconds)
    if not len(i):
        return none
    # The texts that have such places, by themselves, forwards and mirrored.
    some = np.unique(doc[i])
    chosen = np.zeros(len(sizes), bool)
    chosen[some] = True
    part = np.flatnonzero(chosen[doc])
    new = np.cumsum(chosen[doc]) - 1
    i = new[i]
    n, own, sub = len(part), doc[part], symbols[part]
    counts = sizes[some]
    sub_ends = np.repeat(np.cumsum(counts), counts)
    sub_starts = sub_ends - np.repeat(counts, counts)
    ahead = Extensions(sub, own, sub_ends)
    right = ahead(i, i + p)
    del ahead
    behind = Extensions(sub[::-1].copy(), own[::-1].max() - own[::-1], (n - sub_starts)[::-1].copy())
    # Before i and i + p the mirrored text goes on at n - i and n - i - p.
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > sub_starts[i])
    left[inner] = behind(n - i[inner] - p[inner], n - i[inner])
    start, length = i - left, left + p + right
    ok = length >= np.maximum(least, periods * p)
    found = np.stack([own[start[ok]], (start - sub_starts[i])[ok], length[ok], p[ok]], 1)
    return np.unique(found, axis=0)[:, [0, 1, 2, 3]] if len(found) else none


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that a document is read as, for one in ten by its doc_id's crc32: from word a on the first p
    words repeat.  None: as it is; a null doc_id too."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def words_of(text: str) -> list[bytes]:
    """The words between spaces, tabs, line feeds and other returns: what bytes.split parts by."""
    return text.encode("utf-8", "surrogatepass").split()


def collapsed(texts: list[list[bytes]], periods: int = PERIODS) -> tuple[list[list[tuple[int, int, int]]], list[list[bytes]]]:
    """Each text's runs as (start, length, period), and its words without those after a run's first period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = list(chain.from_iterable(texts))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not flat:
        return runs, texts
    symbols = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    found = find_runs(symbols, sizes, LEAST, periods)
    kept = list(texts)
    for cut in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else []:
        k = int(cut[0, 0])
        runs[k] = sorted((int(s), int(m), int(p)) for _, s, m, p in cut)
        gone = np.zeros(len(texts[k]) + 1, np.int64)
        np.add.at(gone, cut[:, 1] + cut[:, 3], 1)
        np.add.at(gone, cut[:, 1] + cut[:, 2], -1)
        kept[k] = [texts[k][j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
    return runs, kept


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_runs", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")],
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
])


def collapse_runs(docs: DataFrame, reread: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text, of every row.

    reread: gives from doc_id and number of words the places of the words that the text is read as (None: as it is).
    Ties of the exponent go to the smallest start, then period.  One pass, no shuffle; other columns are ignored.
    """

    def run(batches):
        for b in pieces(batches, limit=2 << 20):
            ids, texts = b.column("doc_id").to_pylist(), [words_of(t) for t in texts_of(b)]
            for k, doc_id in enumerate(ids):
                at = reread(doc_id, len(texts[k])) if reread else None
                if at is not None:
                    texts[k] = [texts[k][j] for j in at]
            runs, kept = collapsed(texts)
            rows = []
            for doc_id, own, words in zip(ids, runs, kept):
                best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                told = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(own, key=lambda r: (r[0], r[2])))
                rows.append((doc_id, len(own), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.string()] * 2)], names=RESULT.names)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
