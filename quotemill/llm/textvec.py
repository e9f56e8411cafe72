"""Vectorised text primitives on numpy arrays: UTF-8 words, byte windows, code points and character classes."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit (Stafford's variant of a finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit value that starts at each byte; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point: 1 part of a word (letter, mark, number), 2 a word of its own (scripts without spaces), 0 neither."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c))[0] in "LMN":
            out[c] = 1
    # Thai, Lao, Myanmar, Khmer, kana, Bopomofo and ideographs.
    for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
        out[a : b + 1][out[a : b + 1] == 1] = 2
    return out


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, bytes and kind of each non-ASCII character."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int32)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0xFF >> (size + 1))
    last = len(data) - 1
    for k in range(1, 4):
        more = size > k
        point[more] = (point[more] << 6) | (data[np.minimum(at[more] + k, last)] & 0x3F)
    return at, size, _kinds()[np.minimum(point, 0x10FFFF)]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 texts, and each word's document.

    A word is a maximal run of letters, marks and digits; in scripts that don't part words by spaces each character is one.
    """
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = _ALNUM[data]
    before = np.empty_like(inside)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    at, size, kind = _wide(data)
    for k in range(4):
        neither = at[(kind == 0) & (size > k)] + k
        inside[neither[neither < len(data)]] = False
    alone = kind == 2
    if alone.any():
        cuts = np.concatenate([cuts, at[alone], (at + size)[alone]])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = before  # reused
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of data."""
    at = eights(data)
    n = ends - starts
    h = mix((at[starts] & _MASK[np.minimum(n, 8)]) ^ (n.astype(U) * U(0x9E3779B97F4A7C15)))
    left, k = np.flatnonzero(n > 8), 8
    while len(left):
        part = at[starts[left] + k] & _MASK[np.minimum(n[left] - k, 8)]
        h[left] = mix(h[left] * U(0x9E3779B97F4A7C15) ^ part)
        k += 8
        left = left[n[left] > k]
    return h


@functools.cache
def categories() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 1
        elif k == "N":
            out[c] = 2
    # The code points with the White_Space property.
    for a, b in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = 3
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and each text's offset."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each [offsets[i], offsets[i+1]), zero for empty ranges."""
    total = np.zeros(len(offsets) - 1, np.float64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        total[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.float64)
    return total
