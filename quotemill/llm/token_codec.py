"""A context-mixing range coder for token ids, run over many blocks at once.

A chunk's header holds what its blocks start from: the chunk's distinct ids with their order-0 frequencies, and for each
its commonest follower with the chance of it (order 1), and the first probabilities and weights.  Every block is reset to that state and has its own coder,
checksum and order-2 table, so blocks are independent of each other; ``encode`` and ``decode`` step through all blocks of
a chunk together, one id of each block a step, as numpy operations over the blocks.

Each id is coded as: is it what the block's order-2 table predicts (if the context was met); if not, is it the order-1
prediction (if there is another); if not, its place among the order-0 frequencies.  The two yes/no chances are mixed in
the logistic domain from what the three orders say of the candidate (order 2: hits of its slot; order 1: how likely the
follower is, and whether both predict the same id; order 0: how common the candidate is) with probabilities and weights
that learn in each block, STRIDE steps at a time, from where some blocks of the chunk had come to after LEARN_FROM steps.
Between two such times each combination of contexts has one chance, so a step looks chances up and mixes none.  All arithmetic
is on integers, so any machine decodes what another wrote.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
SLOTS = 2048  # of the order-2 table, in each block
MAGIC = b"QMTOKEN3"
HEAD = 32  # bytes before the primer
SLICE = 1 << 20  # ids of a chunk that are widened at once
LEAST_PAIR = 3  # times that a follower must occur in the chunk to be predicted
ZERO, TOP, THIRTY_TWO = np.uint64(0), np.uint64(1 << 32), np.uint64(32)
FLAG_BITS, ID_BITS = np.uint64(16), np.uint64(20)
FLAGS, LAST_PLACE = np.uint64(1 << 16), np.uint64((1 << 20) - 1)
RATE, LEARN = 6, 17
STRIDE = 128  # steps that a block's probabilities and weights learn from at once


class Corrupt(ValueError):
    """A block or header that doesn't have the checksum that it was written with."""


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch: 12-bit probability to a logit scaled by 256; squash: back, for logits -2047 to 2047."""
    x = np.arange(-2047, 2048)
    squash = np.clip(np.round(4096 / (1 + np.exp(-x / 256.0))), 1, 4095).astype(np.int32)
    stretch = np.clip(np.searchsorted(squash, np.arange(4096)) - 2047, -2047, 2047).astype(np.int32)
    return stretch, squash


STRETCH, SQUASH = _tables()
#: Contexts: of order 2 (twice the trust, up to 3, and whether order 1 agrees), of order 1 (firmness) and of order 0.
MET, FIRM, COMMON = 8, 4, 4
NEVER = -16384  # a logit below any other
#: Chances of yes, of 65536, by mixed logit; other ids keep 32 of it at least and both predictions 1, so no part of a range is nothing.
CHANCE_TWO = np.clip(SQUASH << 4, 32, 65024).astype(np.uint16)
CHANCE_ONE = np.clip(SQUASH << 4, 128, 61440).astype(np.uint16)
SHARE_OF = (1 << 16) // (np.arange(STRIDE + 1, dtype=np.int32) + (1 << RATE) - 1)
#: What a slot gains by the trust in it (twice), when its guess is wrong (first 8) or right.
TRUST = np.array([(t >> 1) * 2 - 2 * t for t in range(4) for _ in range(2)] + [2 * (t < 3) for t in range(4) for _ in range(2)], np.int32)


def _start() -> np.ndarray:
    even, firm = np.full(32, 1 << 15), SQUASH[(2 * np.arange(FIRM) + 1) * 2048 // FIRM - 1].repeat(2) << 4
    weights = np.full(3, 26000 >> 3)
    return np.concatenate([even[:MET], firm, even[:COMMON], weights] * 2)


#: The probabilities and weights (halved three times) of both chances, where there are too few blocks to learn them from.
START = _start()
LEAST_BLOCKS, LEARN_FROM = 32, 512


class _Primer:
    """What all blocks of a chunk start from; ids are handled as their places among the chunk's distinct ids."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, follow: np.ndarray, firm: np.ndarray, start: np.ndarray | None = None):
        self.symbols, self.counts, self.follow, self.firm = symbols, counts, follow, firm
        self.start = START if start is None else start
        total = 1 << int(ID_BITS)
        share = np.maximum(counts.astype(np.int64) * (total - len(counts)) // max(int(counts.sum()), 1), 1)
        share[np.argmax(share)] += total - share.sum()
        self.cum = np.concatenate([[0], np.cumsum(share)])
        self.share = share
        #: How common an id is, on a scale of 0 to 31: half powers of two.
        self.common = np.minimum(np.searchsorted(np.int64(1) << np.arange(1, 20), share, "right") + (share > total >> 6), 31)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Primer, np.ndarray]:
        """(the primer of ids, the ids' places)."""
        slices = [slice(a, a + SLICE) for a in range(0, len(ids), SLICE)]
        counts = sum(np.bincount(ids[part], minlength=1 << 16) for part in slices)
        symbols = np.flatnonzero(counts)
        place = np.zeros(1 << 16, np.uint32)
        place[symbols] = np.arange(len(symbols))
        x, size = np.empty(len(ids), np.uint32), len(symbols)
        for part in slices:
            x[part] = place.take(ids[part])
        pairs = x[:-1] * np.uint32(size)  # below 2 ** 32 with what follows
        pairs += x[1:]
        pairs.sort()
        more = max(len(pairs) - LEAST_PAIR + 1, 0)
        pairs, times = np.unique(pairs[:more][pairs[:more] == pairs[len(pairs) - more :]], return_counts=True)
        pairs, times = pairs.astype(np.int64), times + LEAST_PAIR - 1
        order = np.lexsort((times, pairs // size))
        pairs, times = pairs[order], times[order]
        left = pairs // size
        best = np.flatnonzero(np.diff(left, append=-1))
        follow, firm = np.zeros(size, np.int64), np.zeros(size, np.int64)
        follow[left[best]] = pairs[best] % size
        chance = times[best] * 4095 // (counts[symbols[left[best]]] + 1)
        firm[left[best]] = np.maximum((STRETCH[chance] + 2048) >> 7, 1)
        return cls(symbols, counts[symbols], follow, firm), x

    def learn(self, x: np.ndarray) -> None:
        """Lets all blocks start from what some of them, rows of places x, learn."""
        if len(x) >= LEAST_BLOCKS:
            m = _encode_blocks(x[: -1 : len(x) // LEAST_BLOCKS, :LEARN_FROM], self, LEARN_FROM)[1]
            self.start = np.concatenate([m.two.state(), m.one.state()])

    def pack(self) -> bytes:
        wide = (np.diff(self.symbols, prepend=0).astype("<u2"), self.counts.astype("<u4"), self.follow.astype("<u2"), self.firm.astype("u1"))
        return zlib.compress(np.array([len(self.symbols)], "<u4").tobytes() + self.start.astype("<u2").tobytes() + b"".join(np.frombuffer(a.tobytes(), "u1").reshape(len(a), -1).T.tobytes() for a in wide))

    @classmethod
    def unpack(cls, packed: bytes) -> _Primer:
        raw = np.frombuffer(zlib.decompress(packed), "u1")
        size, at, parts = int(raw[:4].view("<u4")[0]), 4 + 2 * len(START), []
        for kind in ("<u2", "<u4", "<u2", "u1"):
            width = np.dtype(kind).itemsize
            parts.append(np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(kind).ravel().astype(np.int64))
            at += size * width
        return cls(np.cumsum(parts[0]), *parts[1:], raw[4 : 4 + 2 * len(START)].view("<u2"))


class _Chance:
    """Mixed yes/no chances of all lanes: three adaptive probabilities, chosen by small contexts, and weights of each block.

    ``p`` are the probabilities: by order 2 (trust, and whether order 1 agrees), by order 1 (firmness, and agreement) and by
    order 0; ``chance`` is what they say together, a row for each combination of contexts and a column for each lane.  All
    learn after STRIDE steps from what these steps told.  A ``never`` is an order-2 context in which the answer is no."""

    def __init__(self, lanes: int, start: np.ndarray, never: np.ndarray, most: int):
        """start: the probabilities of the three orders, then the weights halved three times."""
        self.lanes, self.never, self.most = lanes, never, most
        self.p = [np.repeat(s.astype(np.int32)[:, None], lanes, 1) for s in np.split(start[:-3], np.cumsum([MET, 2 * FIRM]))]
        self.w = [np.full(lanes, s, np.int32) for s in start[-3:].astype(np.int32) << 3]
        self._settle()

    def _settle(self) -> None:
        self.s = [STRETCH.take(p >> 4) for p in self.p]
        said = [np.clip(s * w >> 16, -4095, 4095).astype(np.int16) for s, w in zip(self.s, self.w)]
        two = said[0] + np.int16(2047)
        two[self.never] = NEVER
        mixed = (two.reshape(MET // 2, 1, 2, self.lanes) + said[1].reshape(FIRM, 2, self.lanes))[:, :, :, None] + said[2]
        np.maximum(mixed, 0, out=mixed)
        np.minimum(mixed, 4094, out=mixed)
        self.chance = self.most.take(mixed).ravel()

    def learn(self, at: np.ndarray, told: np.ndarray) -> None:
        """at, told: where in ``chance`` each step asked, and 4096, or 4097 if the answer was yes, or 0 if it wasn't asked."""
        shape = (MET // 2, FIRM, 2, COMMON, self.lanes)
        sums = np.bincount(at.ravel(), told.ravel(), self.chance.size).astype(np.int32)
        n, hits = sums >> 12, sums & 0xFFF
        errors = (hits << 12) - n * (self.chance >> 4)
        # A number for all three: errors are at least -4096 each.
        both = ((sums.astype(np.int64) << 32) + errors).reshape(shape)
        by_firm = both.sum(0)
        for k, of in enumerate((both.sum(3).sum(1).reshape(MET, self.lanes), by_firm.sum(2).reshape(2 * FIRM, self.lanes), by_firm.sum((0, 1)))):
            if k == 0:
                of[self.never] = 0
            asked = (of + (1 << 31) >> 32).astype(np.int32)
            error = of.astype(np.int32)
            n, hits = asked >> 12, asked & 0xFFF
            turn = np.einsum("cl,cl->l", error, self.s[k], dtype=np.int64) >> LEARN - 4
            self.w[k] = np.clip(self.w[k] + turn, -(1 << 18), 1 << 18).astype(np.int32)
            off = hits * 65535 - n * self.p[k] >> 5
            off *= SHARE_OF.take(n)
            off >>= 11
            self.p[k] += off
        self._settle()

    def state(self) -> np.ndarray:
        """A start from what the lanes have learned."""
        return np.concatenate([*(p.mean(1) for p in self.p), [np.clip(w.mean(), 0, 1 << 18) / 8 for w in self.w]]).astype(np.uint16)


class _Model:
    """``guess`` holds, for each slot of each block, the predicted place times 8, and twice the trust in it."""

    def __init__(self, lanes: int, primer: _Primer):
        self.primer, self.lanes, self.size = primer, lanes, len(primer.symbols)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.base = self.lane * SLOTS
        self.guess = np.full(lanes * SLOTS, self.size << 3, np.int32)
        half = len(START) // 2
        self.two = _Chance(lanes, primer.start[:half], np.arange(2), CHANCE_TWO)
        self.one = _Chance(lanes, primer.start[half:], np.arange(3, MET, 2), CHANCE_ONE)
        self.last = np.zeros(lanes, np.int64)
        self.mark = np.zeros(lanes, np.int64)
        common = np.append(np.minimum(primer.common * COMMON >> 5, COMMON - 1), 0)
        firm = primer.firm * FIRM >> 5
        #: For each id: what follows it (no place, if not known), how firmly, and how common that is.
        none = self.size + 1 << 8
        self.after = np.append(np.where(primer.firm > 0, primer.follow << 8 | firm * 2 * COMMON | common[primer.follow], none), none).astype(np.int32)
        self.common = common.astype(np.int32)
        self.seen = 0
        self.places = np.zeros((2, STRIDE, lanes), np.int64)
        self.told = np.zeros((2, STRIDE, lanes))

    def step(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order-2 prediction, order-1 prediction, their chances of 65536); predictions that aren't there are no place."""
        at = self.last * 40503
        at += self.mark
        at >>= 7
        at &= SLOTS - 1
        at += self.base
        self.at, self.now, after = at, self.guess.take(at), self.after.take(self.last)
        g2, g1 = self.now >> 3, after >> 8
        self.trust = self.now & 7
        # Rows go by trust, firmness, agreement, how common.
        where = self.trust * np.int32(FIRM * COMMON)
        where += after & 255
        where += (g1 == g2) * np.int32(COMMON)
        two, one = self.places[:, self.seen]
        np.multiply(where, self.lanes, out=one)
        one += self.lane
        where &= -COMMON
        where += self.common.take(g2)
        np.multiply(where, self.lanes, out=two)
        two += self.lane
        p2, p1 = self.two.chance.take(two).astype(np.uint64), self.one.chance.take(one).astype(np.uint64)
        p1 *= FLAGS - p2
        p1 >>= FLAG_BITS
        return g2, g1, p2, p1

    def learn(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """x: the ids' places as 64-bit integers."""
        state = hit2 * np.int32(8)
        state |= self.trust
        new = self.now + TRUST.take(state)
        np.copyto(new, x << 3 | 2, where=state < 4, casting="same_kind")
        self.guess[self.at] = new
        self.mark = self.last * 2654435761
        self.last = x
        two, one = self.told[:, self.seen]
        np.add(hit2, 4096.0, out=two)
        np.add(hit1, 4096.0, out=one)
        one *= ~hit2
        self.seen += 1
        if self.seen == STRIDE:
            self.seen = 0
            self.two.learn(self.places[0], self.told[0])
            self.one.learn(self.places[1], self.told[1])


class _Writer:
    """Range coder with carries: the range is at least 2 ** 32 before each id, so an id settles one word at most."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.width = steps + 4
        self.out = np.zeros(lanes * self.width, np.uint32)
        self.first = np.arange(lanes) * self.width
        self.n = self.first.copy()  # where each lane's next word goes

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrows the lanes' intervals to size from start on, both in units of the range."""
        low = self.low + start
        carry = np.flatnonzero(low < self.low)
        if len(carry):
            to = self.n[carry] - 1
            while len(to):
                self.out[to] += np.uint32(1)
                to = to[self.out[to] == 0] - 1
        settle = np.flatnonzero(size < TOP)
        lo, to = low[settle], self.n[settle]
        self.out[to] = lo >> THIRTY_TWO
        self.n[settle] = to + 1
        low[settle] = lo << THIRTY_TWO
        size[settle] <<= THIRTY_TWO
        self.low, self.range = low, size

    def words(self, lane: int) -> np.ndarray:
        """The lane's words, if it ended here."""
        low = int(self.low[lane])
        return np.append(self.out[self.first[lane] : self.n[lane]], np.array([low >> 32, low & 0xFFFFFFFF], np.uint32))


class _Reader:
    """The writer's counterpart; ``off`` is how far the code lies in its interval."""

    def __init__(self, words: list[np.ndarray]):
        self.width = max(map(len, words)) + 4
        self.words = np.zeros(len(words) * self.width, np.uint32)
        for k, w in enumerate(words):
            self.words[k * self.width : k * self.width + len(w)] = w
        self.n = np.arange(len(words)) * self.width
        self.end = self.n + self.width - 1
        self.range = np.full(len(words), (1 << 64) - 1, np.uint64)
        self.off = (self.words[self.n].astype(np.uint64) << THIRTY_TWO) | self.words[self.n + 1]
        self.n += 2

    def narrow(self, off: np.ndarray, size: np.ndarray) -> None:
        settle = np.flatnonzero(size < TOP)
        at = self.n[settle]
        off[settle] = (off[settle] << THIRTY_TWO) | self.words[np.minimum(at, self.end[settle])]
        self.n[settle] = at + 1
        size[settle] <<= THIRTY_TWO
        self.off, self.range = off, size


def _encode_blocks(x: np.ndarray, primer: _Primer, tail: int) -> tuple[list[np.ndarray], _Model]:
    """(the words of each block, the model at its end); x: a row of places for each block, of which the last has tail."""
    lanes, steps = x.shape
    last = np.zeros(0, np.uint32)
    m, w = _Model(lanes, primer), _Writer(lanes, steps)
    cum, share = primer.cum.astype(np.uint64), primer.share.astype(np.uint64)
    for t, now in enumerate(np.ascontiguousarray(x.T), 1):
        g2, g1, p2, p1 = m.step()
        now = now.astype(np.int32)
        hit2 = now == g2
        hit1 = (now == g1) & ~hit2
        unit = w.range >> FLAG_BITS
        end2 = unit * p2
        size1 = unit * p1
        part = (FLAGS - p2 - p1) * unit
        part >>= ID_BITS
        start = np.where(hit2, ZERO, np.where(hit1, end2, end2 + size1 + part * cum.take(now)))
        size = np.where(hit2, end2, np.where(hit1, size1, part * share.take(now)))
        w.narrow(start, size)
        if t == tail:
            last = w.words(lanes - 1)
        m.learn(now.astype(np.int64), hit2, hit1)
    return [*(w.words(k) for k in range(lanes - 1)), last], m


def _decode_blocks(words: list[np.ndarray], steps: int, primer: _Primer) -> np.ndarray:
    lanes = len(words)
    m, r = _Model(lanes, primer), _Reader(words)
    cum, share = primer.cum.astype(np.uint64), primer.share.astype(np.uint64)
    by_place = np.repeat(np.arange(len(share), dtype=np.uint16), primer.share)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        g2, g1, p2, p1 = m.step()
        unit, off = r.range >> FLAG_BITS, r.off
        end2 = unit * p2
        size1 = unit * p1
        part = (FLAGS - p2 - p1) * unit
        part >>= ID_BITS
        off1 = off - end2
        hit2 = off < end2
        hit1 = (off1 < size1) & ~hit2
        off0 = off1 - size1
        found = by_place.take(off0 // part, mode="clip").astype(np.int64)
        off0 -= part * cum.take(found)
        now = np.where(hit2, g2, np.where(hit1, g1, found))
        off = np.where(hit2, off, np.where(hit1, off1, off0))
        size = np.where(hit2, end2, np.where(hit1, size1, part * share.take(found)))
        r.narrow(off, size)
        np.minimum(now, m.size, out=now)  # a damaged chunk may ask for what no table predicts
        m.learn(now, hit2, hit1)
        out[t] = now
    return out.T


def _head(n: int, blocks: int, steps: int, packed: bytes) -> bytes:
    head = MAGIC + np.array([n], "<u8").tobytes() + np.array([blocks, steps, len(packed)], "<u4").tobytes()
    return head + np.array([zlib.crc32(packed, zlib.crc32(head))], "<u4").tobytes() + packed


def encode(ids: np.ndarray) -> bytes:
    """ids (below 65536) as one chunk: magic, number of ids, of blocks, of ids in a block, the primer's size, the crc32
    of all this and the primer; the primer; for each block its words and its ids' crc32; then the words."""
    n = len(ids)
    steps = min(BLOCK, max(n, 1))
    blocks = -(-n // steps) if n else 0
    if not blocks:
        return _head(n, 0, steps, b"")
    if ids.max() > 0xFFFF:
        raise ValueError("ids must be below 65536")
    primer, x = _Primer.of(ids)
    table = np.zeros(blocks * steps, np.uint16)
    table[:n] = x
    del x
    table = table.reshape(blocks, steps)
    primer.learn(table)
    packed = primer.pack()
    words = _encode_blocks(table, primer, n - (blocks - 1) * steps)[0]
    sums = [zlib.crc32(ids[k * steps : (k + 1) * steps].astype("<u4").tobytes()) for k in range(blocks)]
    return _head(n, blocks, steps, packed) + np.array([len(w) for w in words], "<u4").tobytes() + np.array(sums, "<u4").tobytes() + np.concatenate(words).astype("<u4").tobytes()


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; Corrupt if a block's or the header's checksum doesn't hold."""
    if chunk[:8] != MAGIC or len(chunk) < HEAD:
        raise Corrupt("not a chunk of token ids")
    n = int(np.frombuffer(chunk, "<u8", 1, 8)[0])
    blocks, steps, size, check = (int(v) for v in np.frombuffer(chunk, "<u4", 4, 16))
    packed, at = chunk[HEAD : HEAD + size], HEAD + size
    if zlib.crc32(packed, zlib.crc32(chunk[: HEAD - 4])) != check:
        raise Corrupt("header")
    if not blocks:
        return np.zeros(0, np.uint32)
    if len(chunk) < at + 8 * blocks or (len(chunk) - at) % 4:
        raise Corrupt("cut short")
    primer = _Primer.unpack(packed)
    sizes = np.frombuffer(chunk, "<u4", blocks, at)
    sums = np.frombuffer(chunk, "<u4", blocks, at + 4 * blocks)
    words = np.frombuffer(chunk, "<u4", offset=at + 8 * blocks)
    if len(words) != sizes.sum():
        raise Corrupt("cut short")
    cuts = np.cumsum(sizes.astype(np.int64))
    found = _decode_blocks([words[b - s : b] for s, b in zip(sizes.astype(np.int64), cuts)], steps, primer)
    ids = np.append(primer.symbols, 0).astype(np.uint32)[found.reshape(-1)[:n]]
    for k in range(blocks):
        if zlib.crc32(ids[k * steps : (k + 1) * steps].astype("<u4").tobytes()) != sums[k]:
            raise Corrupt(f"block {k}")
    return ids
