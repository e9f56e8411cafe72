"""Quality from a support vector machine on naive Bayes features.

A text's features are indicators, whatever the number of times: its runs of three bytes, its words and its pairs of
neighbouring words, letter case and marks kept, hashed into one table.  Each indicator is scaled by the logarithm of the
ratio of its shares in the two classes, and a text's vector to length 1.  A linear model with hinge loss is fitted by dual
coordinate descent: one text's multiplier at a time is set to its best value between 0 and its class's bound.  The weights
are drawn towards their mean size (``BLEND``), so that what naive Bayes says holds where the margin says little.  Each text
of the sample is there a second time as a short stretch of itself, so that short texts are known too.  The score is a
logistic curve of the margin and of how many features there are, once each and in all (indicators alone don't see repeats),
fitted on texts kept out of the rest; classes count by their shares of the labels.  A text of over ``WINDOW`` bytes is as
many equal parts and has the mean of their logits, as the features of one that has no end would all be there.

A text scores by itself: repeated rows score alike.  Null, empty and very short texts have no features and get the score of
the constant alone.  A document with two labels is in both classes' samples.  Without rows of both labels every text scores
0.5.  Columns of the input named like the results are replaced.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import sample_by_table
from .textvec import U, eights, hashes, mix, words
from .workspace import pieces, utf8_buffer

BUCKETS = 1 << 18
CUT = 0.5
#: The bound of the training sample: texts of a label, characters of a text.
PER_LABEL, MAX_CHARS = 1500, 8000
WINDOW = 8192
SMOOTH, COST, BLEND = 1.0, 1.0, 0.25
#: Characters of the stretches, from the fewest to the most, their logarithms spread evenly.
STRETCH = (10, 1000)
EPOCHS, ENOUGH = 40, 0.01


def parts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the equal parts of each text that hold WINDOW bytes at most, and each part's text."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // WINDOW))
    owner = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.r_[offsets[:-1][owner] + size[owner] * k // count[owner], offsets[-1:]], owner


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of each text's distinct features, in no stated order."""
    three = (eights(data)[: len(data)] & U(0xFFFFFF)) * U(0x9E3779B97F4A7C15) >> U(46)
    starts, ends, doc = words(data, offsets)
    h = hashes(data, starts, ends)
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) ^ h[1:]) if len(h) else h
    word, pair = (h % U(BUCKETS)).astype(np.int32), (pair % U(BUCKETS)).astype(np.int32)
    three = three.astype(np.int32)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    latest, out = np.zeros(BUCKETS, np.int32), []
    size = np.zeros(len(offsets), np.int64)
    for k in range(len(offsets) - 1):
        a, b, p, q = offsets[k], offsets[k + 1], cut[k], cut[k + 1]
        every = np.concatenate([three[a : max(a, b - 2)], word[p:q], pair[p : max(p, q - 1)]])
        # Of equal ones the one that was noted last stays.
        at = np.arange(len(every), dtype=np.int32)
        latest[every] = at
        one = every[latest[every] == at]
        out.append(one)
        size[k + 1] = len(one)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.cumsum(size)


@dataclasses.dataclass
class Model:
    ratio: np.ndarray  # each bucket's log-count ratio
    weight: np.ndarray  # each bucket's weight, ratio included
    bias: float
    curve: np.ndarray  # of the columns of measures

    def measures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The margin, the logarithms of 1 + the numbers of distinct features and of bytes, and 1."""
        found, cut = features(data, offsets)
        out = np.full(len(offsets) - 1, self.bias)
        some = np.flatnonzero(np.diff(cut))
        if len(some):
            at = cut[:-1][some]
            length = np.sqrt(np.add.reduceat(self.ratio[found].astype(np.float64) ** 2, at))
            out[some] += np.add.reduceat(self.weight[found].astype(np.float64), at) / np.maximum(length, 1e-9)
        return np.stack([out, np.log1p(np.diff(cut)), np.log1p(np.diff(offsets)), np.ones(len(out))], 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        cuts, owner = parts(offsets)
        logit = np.bincount(owner, np.clip(self.measures(data, cuts) @ self.curve, -40, 40)) / np.bincount(owner)
        return 1 / (1 + np.exp(-logit))


def _descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bound: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights (the last for the constant 1) of the hinge-loss model of unit vectors x (places, values) and signs y."""
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(y))
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, v = x[i]
            slack = y[i] * (w[at] @ v + w[-1]) - 1
            wish = slack if 0 < alpha[i] < bound[i] else min(slack, 0.0) if alpha[i] <= 0 else max(slack, 0.0)
            worst = max(worst, abs(wish))
            if wish:
                was = alpha[i]
                alpha[i] = min(max(was - slack / 2, 0.0), bound[i])  # a vector's square is 1, and the constant's 1
                w[at] += (alpha[i] - was) * y[i] * v
                w[-1] += (alpha[i] - was) * y[i]
        if worst < ENOUGH:
            break
    return w


def _logistic(x: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """The score's curve: Newton steps on the likelihood, label 1 weighted by its share, targets short of 0 and 1."""
    n1, n0 = label.sum(), (~label).sum()
    target = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label, share / n1, (1 - share) / n0)
    curve, ridge = np.zeros(x.shape[1]), 1e-5 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -40, 40)))
        gradient = x.T @ (weight * (p - target)) + ridge @ curve
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        curve -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return curve


def _stretches(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Of each text a stretch from the start of a word on."""
    out = []
    for t in texts:
        size = int(np.exp(rng.uniform(*np.log(STRETCH))))
        at = int(rng.integers(0, max(1, len(t) - size)))
        at = t.find(" ", at) + 1 if at else 0
        out.append(t[at : at + size])
    return out


def fit(sample: list[tuple[str, str]], share: float | None = None) -> Model:
    """A model from (label '0' or '1', text); share: label 1's among all labels, unless the sample's."""
    y = np.array([k == "1" for k, _ in sample])
    zero = np.zeros(BUCKETS, np.float32)
    if not len(y) or y.all() or not y.any():
        return Model(zero, zero, 0.0, np.zeros(4))
    rng = np.random.default_rng(5)
    held = np.zeros(len(y), bool)
    for k in (False, True):
        own = np.flatnonzero(y == k)
        if len(own) >= 10:
            held[own[4::5]] = True
    texts = [t for _, t in sample]
    data, offsets = utf8_buffer(pa.array(texts + _stretches(texts, rng), pa.large_string()))
    cuts, owner = parts(offsets)
    y, held = np.r_[y, y][owner], np.r_[held, held][owner]
    found, cut = features(data, cuts)
    used = y[~held]
    each = [found[cut[i] : cut[i + 1]] for i in np.flatnonzero(~held)]
    counts = [np.full(BUCKETS, SMOOTH) for _ in range(2)]
    for own, f in zip(used, each):
        counts[int(own)][f] += 1
    ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    x = [(f, ratio[f].astype(np.float64) / max(np.sqrt(np.sum(ratio[f].astype(np.float64) ** 2)), 1e-9)) for f in each]
    bound = COST * len(used) / np.where(used, 2 * used.sum(), 2 * (~used).sum())
    w = _descend(x, np.where(used, 1.0, -1.0), bound, rng)
    mean = np.abs(w[:-1]).mean()
    model = Model(ratio, (((1 - BLEND) * mean + BLEND * w[:-1]) * ratio).astype(np.float32), float(BLEND * w[-1]), np.zeros(4))
    which = np.flatnonzero(held) if held.any() and y[held].any() and not y[held].all() else np.arange(len(y))
    model.curve = _logistic(model.measures(data, cuts)[which], y[which], y.mean() if share is None else share)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """Fits on a bounded sample of docs (doc_id, text) that labels (doc_id, quality) covers; see PER_LABEL."""
    marks = labels.select("doc_id", F.when(F.col("quality").isNotNull(), F.when(F.col("quality") >= 1, "1").otherwise("0")).alias("label"))
    share = marks.agg(F.avg(F.col("label").cast("int"))).first()[0]
    return fit(sample_by_table(docs, marks, per_label, max_chars), share)


RESULT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted (score >= 0.5) appended; one pass, no shuffle."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {f.name for f in RESULT}])
    names = [*docs.columns, *[f.name for f in RESULT]]

    def run(batches):
        for b in pieces(batches):
            s = model.scores(*utf8_buffer(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT]))
