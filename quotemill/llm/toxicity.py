"""Toxicity from subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (3 to 6 bytes, with marks at both ends) and of itself,
all hashed into one table; a linear softmax gives its class, and a text is as toxic as its most toxic word.  An
unseen misspelling shares most n-grams with the word it comes from.  Vectors and softmax are trained together: first
on words, each with the share of toxic texts among the texts that have it, then on texts through their most toxic
word.  The score is calibrated on texts kept out of training so that 0.7 is the best split of the two labels.

Null, empty or wordless texts score 0.  Without rows of both labels every text scores 0.  Columns of the input named
like the results are replaced.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import sample_by_table
from .textvec import U, eights, hashes, mix, words
from .workspace import pieces, utf8_buffer

BUCKETS, DIM = 1 << 17, 8
SHORTEST, LONGEST = 3, 6
CUT = 0.7
#: The bound of the training sample: texts of a label, characters of a text, distinct words.
PER_LABEL, MAX_CHARS, MAX_WORDS = 3000, 6000, 150_000
WORD_STEPS, WORD_BATCH, TEXT_STEPS = 80, 20_000, 80


@dataclasses.dataclass
class Model:
    pull: np.ndarray  # each bucket's vector along the difference of the two classes' weights
    offset: float
    split: float
    slope: float

    def scores(self, logits: np.ndarray) -> np.ndarray:
        x = np.clip(self.slope * (logits - self.split) + np.log(CUT / (1 - CUT)), -40, 40)
        return np.where(np.isfinite(logits) & np.isfinite(self.split), 1 / (1 + np.exp(-x)), 0.0)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of the n-grams of ``<word>`` and of the whole, for each word."""
    n = ends - starts
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + 2, out=at[1:])
    buf = np.full(at[-1], ord(">"), np.uint8)
    buf[at[:-1]] = ord("<")
    inner = np.arange(int(n.sum())) + np.repeat(at[:-1] + 1 - (np.cumsum(n) - n), n)
    buf[inner] = data[np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)]
    view = eights(buf)
    owner = np.repeat(np.arange(len(n)), n + 2)
    left = np.repeat(at[1:], n + 2) - np.arange(len(buf))
    found, whose = [mix(hashes(buf, at[:-1], at[1:]))], [np.arange(len(n))]
    for k in range(SHORTEST, LONGEST + 1):
        pos = np.flatnonzero(left >= k)
        found.append(mix((view[pos] & U((1 << 8 * k) - 1)) ^ U(k << 56)))
        whose.append(owner[pos])
    h, w = np.concatenate(found), np.concatenate(whose)
    o = np.argsort(w, kind="stable")
    count = np.bincount(w, minlength=len(n))
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=off[1:])
    return (h[o] % U(BUCKETS)).astype(np.int32), off


def _unique_words(data, offsets):
    starts, ends, doc = words(data, offsets)
    _, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], inverse, doc


def _means(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, off[:-1], axis=0) / np.diff(off).reshape(-1, *[1] * (values.ndim - 1))


class _Trainer:
    def __init__(self, grams: np.ndarray, off: np.ndarray, rng: np.random.Generator):
        self.grams, self.off = grams, off
        self.vectors = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
        self.softmax = (rng.standard_normal((DIM, 2)) / DIM).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.g_vectors = np.full(BUCKETS, 1e-6, np.float32)
        self.g_softmax = np.full((DIM, 2), 1e-6, np.float32)
        self.g_bias = np.full(2, 1e-6, np.float32)

    def logits(self) -> np.ndarray:
        d = self.softmax[:, 1] - self.softmax[:, 0]
        return _means((self.vectors @ d)[self.grams], self.off) + (self.bias[1] - self.bias[0])

    def step(self, some: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One AdaGrad step of the cross-entropy of the given words on vectors, softmax and bias together."""
        count = np.diff(self.off)[some]
        at = np.repeat(self.off[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        g = self.grams[at]
        off = np.zeros(len(some) + 1, np.int64)
        np.cumsum(count, out=off[1:])
        v = _means(self.vectors[g], off)
        z = v @ self.softmax + self.bias
        p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
        err = ((p - target) * weight / weight.sum()).astype(np.float32)
        both = np.stack([-err, err], 1)
        grad_w, grad_b = v.T @ both, both.sum(0)
        pull = both @ self.softmax.T  # by word
        share = np.repeat(pull / count[:, None], count, axis=0)
        grad = np.stack([np.bincount(g, share[:, k], BUCKETS) for k in range(DIM)], 1).astype(np.float32)
        self.g_vectors += (grad**2).mean(1)
        self.vectors -= rate * grad / np.sqrt(self.g_vectors)[:, None]
        self.g_softmax += grad_w**2
        self.softmax -= rate * grad_w / np.sqrt(self.g_softmax)
        self.g_bias += grad_b**2
        self.bias -= rate * grad_b / np.sqrt(self.g_bias)


def _maxima(logits: np.ndarray, pair_word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest logit and the word it is of; cuts: where each text's words start among the pairs."""
    x = logits[pair_word]
    top = np.maximum.reduceat(x, cuts)
    lengths = np.diff(np.r_[cuts, len(x)])
    hit = np.flatnonzero(x == np.repeat(top, lengths))
    owner = np.searchsorted(cuts, hit, "right") - 1
    first = np.unique(owner, return_index=True)[1]
    return top, pair_word[hit[first]]


def fit(sample: list[tuple[str, str]]) -> Model:
    """A model from (label '0' or '1', text)."""
    y = np.array([k == "1" for k, _ in sample])
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.inf, 1.0)
    rng = np.random.default_rng(7)
    raw = [t.lower().encode("utf-8", "surrogatepass") for _, t in sample]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, inverse, doc = _unique_words(data, offsets)
    pairs = np.unique(doc * len(starts) + inverse)
    pair_doc, pair_word = pairs // len(starts), pairs % len(starts)
    # Kept out for calibration and choice of the model: every fifth text of a label that has ten.
    held = np.zeros(len(y), bool)
    for k in (False, True):
        own = np.flatnonzero(y == k)
        if len(own) >= 10:
            held[own[4::5]] = True
    used = ~held[pair_doc]
    with_toxic = np.bincount(pair_word[used & y[pair_doc]], minlength=len(starts))
    without = np.bincount(pair_word[used & ~y[pair_doc]], minlength=len(starts))
    seen = with_toxic + without
    keep = np.flatnonzero(seen > 0)
    keep = keep[np.argsort(-seen[keep], kind="stable")][:MAX_WORDS]
    number = np.full(len(starts), -1)
    number[keep] = np.arange(len(keep))
    grams, off = subwords(data, starts[keep], ends[keep])
    trainer = _Trainer(grams, off, rng)
    n1, n0 = max(1, (y & ~held).sum()), max(1, (~y & ~held).sum())
    toxic_rate, clean_rate = with_toxic[keep] / n1, without[keep] / n0 + 1 / min(n1, n0)
    target = toxic_rate / (toxic_rate + clean_rate)
    weight = np.log1p(seen[keep])
    for _ in range(WORD_STEPS):
        part = rng.choice(len(keep), min(len(keep), WORD_BATCH), replace=False)
        trainer.step(part, target[part], weight[part], 0.5)
    ok = used & (number[pair_word] >= 0)
    d, w = pair_doc[ok], number[pair_word[ok]]
    docs, cuts = np.unique(d, return_index=True)
    balance = np.where(y[docs], 0.5 / n1, 0.5 / n0)
    which = np.flatnonzero(held) if held.any() and y[held].any() and not y[held].all() else np.arange(len(y))
    h_data, h_offsets = _part(data, offsets, which)
    best = _calibrated(trainer, h_data, h_offsets, y[which])
    for i in range(1, TEXT_STEPS + 1):
        _, top = _maxima(trainer.logits(), w, cuts)
        trainer.step(top, y[docs].astype(np.float64), balance, 0.3)
        if i % 20 == 0:
            best = max(best, _calibrated(trainer, h_data, h_offsets, y[which]), key=lambda m: m[:2])
    return best[2]


def _part(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [data[offsets[k] : offsets[k + 1]] for k in which]
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=off[1:])
    return np.concatenate(parts), off


def _calibrated(trainer: _Trainer, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> tuple[float, float, Model]:
    """(balanced accuracy of the best split, how far apart the labels' medians are around it, the model).

    The split lies in the middle of the gap between the texts on its two sides.
    """
    difference = trainer.softmax[:, 1] - trainer.softmax[:, 0]
    model = Model((trainer.vectors @ difference).astype(np.float32), float(trainer.bias[1] - trainer.bias[0]), 0.0, 1.0)
    top = text_logits(model, data, offsets)
    fine = np.isfinite(top)
    top, label = top[fine], label[fine]
    if not label.any() or label.all():
        return 0.0, 0.0, model
    o = np.argsort(top, kind="stable")
    gain = np.concatenate([[0.0], np.cumsum(np.where(label[o], -1 / label.sum(), 1 / (~label).sum()))])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = best[len(best) // 2]
    lo, hi = top[o[max(k - 1, 0)]], top[o[min(k, len(o) - 1)]]
    model.split = float((lo + hi) / 2)
    spread = max(1e-3, np.median(top[label]) - model.split)
    model.slope = float(np.clip(4 / spread, 0.05, 50))
    return float(gain[k]), float(spread / (abs(np.median(top[~label]) - model.split) + spread)), model


def text_logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest logit among each text's words, minus infinity without words."""
    out = np.full(len(offsets) - 1, -np.inf)
    starts, ends, inverse, doc = _unique_words(data, offsets)
    if len(doc):
        grams, off = subwords(data, starts, ends)
        logits = (_means(model.pull[grams], off) + model.offset)[inverse]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.maximum.reduceat(logits, first)
    return out


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """Fits on a bounded sample of docs (doc_id, text) that labels (doc_id, toxic) covers; see PER_LABEL."""
    marks = labels.select("doc_id", F.when(F.col("toxic").isNotNull(), F.when(F.col("toxic") >= 1, "1").otherwise("0")).alias("label"))
    return fit(sample_by_table(docs, marks, per_label, max_chars))


RESULT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted (score >= 0.7) appended; one pass, no shuffle."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {f.name for f in RESULT}])
    names = [*docs.columns, *[f.name for f in RESULT]]

    def run(batches):
        for b in pieces(batches):
            data, offsets = utf8_buffer(pc.utf8_lower(pc.fill_null(b.column("text"), "")))
            s = model.scores(text_logits(model, data, offsets))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT]))
