"""Language identification by interpolated Kneser-Ney character models.

One model per language over 4-grams of lower-cased letters (code points; whatever is no letter is one mark), stored as sorted arrays of n-gram hashes with the
discounted probability of each n-gram and the back-off weight of each context.  A text gets the language of the
lowest cross-entropy per letter; it is rejected if that exceeds the threshold calibrated for the language and the
text's number of letters on texts kept out of the counts, or if it has no letter.

Null or letterless texts: ``und``, score 0, rejected.  Ties go to the first language in alphabetical order.  No
labelled text at all: every text is ``und`` and rejected.  Columns of the input named like the results are replaced.
"""

from __future__ import annotations

import dataclasses
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample
from .textvec import U, categories, code_points, mix, sums
from .workspace import held, pieces, texts_of

ORDER = 4
#: Bytes of text that a worker scores at once.
PIECE = 1 << 20
#: Bits of the number of n-grams that a worker remembers.
REMEMBERED = 19
#: Letters of a calibration slice; texts vary less the longer they are, so the threshold holds for longer ones too.
SLICE, MARGIN = 60, 0.12
#: Shorter texts are held against slices of the greatest of these lengths that they reach.
LENGTHS = (1, 2, 4, 8, 15, 30, SLICE)
#: The score is a posterior over this many letters at most, so that it doesn't saturate with length.
SCORE_LETTERS = 40


@dataclasses.dataclass
class Model:
    languages: list[str]
    alphabet: int  # distinct letters of the sample, and one for all others
    grams: list[tuple[np.ndarray, np.ndarray]]  # by language and order: sorted hashes, discounted probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by language and context length: sorted hashes, back-off weights
    reject: np.ndarray  # by language and length of LENGTHS
    uid: str = dataclasses.field(default_factory=lambda: uuid.uuid4().hex)

    def log_probabilities(self, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural log of P(letter | those before it), a column for each language; rows of the two tables of hashes
        hold, by order, the n-gram that ends at the letter and the one before it."""
        out = np.empty((len(grams), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            p = np.full(len(grams), 1.0 / self.alphabet)
            for m in range(ORDER):
                p = _find(*self.grams[k * ORDER + m], grams[:, m], 0.0) + _find(*self.contexts[k * ORDER + m], contexts[:, m], 1.0) * p
            out[:, k] = np.log(p)
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, 0 for what is no letter, and each text's offset."""
    cps, off = code_points([t.lower() for t in texts])
    return np.where(categories()[cps] == 1, cps, 0).astype(U), off


def windows(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row j holds the symbol j places before each; texts begin after zeros."""
    n = len(symbols)
    back = np.zeros((ORDER, n), U)
    for j in range(ORDER):
        back[j, j:] = symbols[: max(0, n - j)]
        # Of a text shorter than this the place is a later text's, as near to its start.
        early = (offsets[:-1, None] + np.arange(j)).ravel()
        back[j, early[early < n]] = 0
    return back


def ngrams(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes by order 1 to ORDER of the n-gram that ends at each symbol, and of its context; texts begin after zeros."""
    return _by_order(windows(symbols, offsets))


def _by_order(back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = back.shape[1]
    grams, contexts = np.empty((n, ORDER), U), np.empty((n, ORDER), U)
    for table, shift in ((grams, 0), (contexts, 1)):
        h = np.zeros(n, U)
        for m in range(ORDER):
            # The context of order m + 1 has m symbols.
            if m >= shift:
                h = mix(h * _FACTOR + back[m] + _FACTOR)
            table[:, m] = h
    return grams, contexts


_FACTOR = U(0x9E3779B97F4A7C15)


def _fit_language(grams: np.ndarray, contexts: np.ndarray) -> tuple[list, list]:
    """Discounted probabilities and back-off weights of each order; lower orders count distinct left neighbours."""
    out, weights = [None] * ORDER, [None] * ORDER
    _, first, counts = np.unique(grams[:, ORDER - 1], return_index=True, return_counts=True)
    for m in range(ORDER - 1, -1, -1):
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx, where = np.unique(contexts[first, m], return_inverse=True)
        total, kinds = np.bincount(where, counts), np.bincount(where)
        p = (counts - discount) / total[where]
        o = np.argsort(grams[first, m])
        out[m] = (grams[first, m][o], p[o])
        weights[m] = (ctx, discount * kinds / total)
        if m:
            # Of the distinct n-grams of this order, the first place of each shorter one and how many it ends.
            _, at, counts = np.unique(grams[first, m - 1], return_index=True, return_counts=True)
            first = first[at]
    return out, weights


def fit(sample: list[tuple[str, str]]) -> Model:
    """A model from (language, text); every fifth text of a language calibrates its threshold instead of counting."""
    languages = sorted({k for k, _ in sample})
    model = Model(languages, 1 + len(np.setdiff1d(symbols_of([t for _, t in sample])[0], [0])), [], [], np.zeros((len(languages), len(LENGTHS))))
    kept_out = []
    for lang in languages:
        texts = [t for k, t in sample if k == lang]
        kept_out.append(texts[::5] if len(texts) >= 10 else texts)
        sym, off = symbols_of([t for i, t in enumerate(texts) if i % 5] if len(texts) >= 10 else texts)
        g, c = _fit_language(*_by_order(windows(sym, off)[:, sym > 0]))
        model.grams += g
        model.contexts += c
    for k, texts in enumerate(kept_out):
        sym, off = symbols_of(texts)
        lp = model.log_probabilities(*_by_order(windows(sym, off)[:, sym > 0]))[:, k]
        for j, size in enumerate(LENGTHS):
            whole = len(lp) // size
            means = -lp[: whole * size].reshape(whole, size).mean(1) if whole else np.array([-lp.mean() if len(lp) else np.log(model.alphabet)])
            model.reject[k, j] = np.quantile(means, 0.999) * (1 + MARGIN)
    # No threshold lies below that of longer texts.
    model.reject = np.maximum.accumulate(model.reject[:, ::-1], axis=1)[:, ::-1]
    return model


class _Memo:
    """What a worker has looked up so far: a slot for each hash of a longest n-gram, the later one stays."""

    def __init__(self, languages: int):
        self.keys, self.lp = np.zeros(1 << REMEMBERED, U), np.zeros((1 << REMEMBERED, languages), np.float32)

    def rows(self, model: Model, back: np.ndarray) -> np.ndarray:
        """Log-probabilities of each letter by language; only n-grams that have no slot are hashed by order and searched."""
        key = back[0] * _FACTOR
        for m in range(1, ORDER):
            key = (key + back[m]) * _FACTOR
        key = mix(key) | U(1)
        slot = (key >> U(64 - REMEMBERED)).astype(np.int64)
        lp = self.lp[slot]
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            new, first, inverse = np.unique(key[missing], return_index=True, return_inverse=True)
            found = model.log_probabilities(*_by_order(back[:, missing[first]]))
            lp[missing] = found[inverse]
            slots, one = np.unique(slot[missing[first]], return_index=True)
            self.keys[slots], self.lp[slots] = new[one], found[one]
        return lp


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy per letter and rejection of each text."""
    n, width = len(texts), len(model.languages)
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    sym, off = symbols_of(texts)
    is_letter = sym > 0
    letters = sums(is_letter.astype(np.float32), off)
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(letters.astype(np.int64), out=ends[1:])
    memo = held(f"languages {model.uid}", lambda: _Memo(width))
    lp = memo.rows(model, windows(sym, off)[:, is_letter]) if is_letter.any() else np.zeros((0, width), np.float32)
    h = np.stack([-sums(lp[:, k], ends) for k in range(width)], 1) / np.maximum(letters, 1)[:, None]
    best = h.argmin(1)
    lowest = h[np.arange(n), best]
    odds = np.exp(-(h - lowest[:, None]) * np.minimum(letters, SCORE_LETTERS)[:, None])
    none = letters == 0
    return (
        ["und" if none[i] else model.languages[best[i]] for i in range(n)],
        np.where(none, 0.0, 1 / odds.sum(1)),
        lowest,
        none | (lowest > model.reject[best, np.searchsorted(LENGTHS, np.maximum(letters, 1), "right") - 1]),
    )


def train(docs: DataFrame, per_language: int = 400, max_chars: int = 4000) -> Model:
    """Fits on a bounded sample of the rows that have a language: ``per_language`` texts of ``max_chars`` each."""
    return fit(labelled_sample(docs, F.col("text"), F.col("lang"), per_language, max_chars))


RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected appended; one pass, no shuffle."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {f.name for f in RESULT}])
    names = [*docs.columns, *[f.name for f in RESULT]]

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            lang, sc, h, bad = score(model, texts_of(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(sc), pa.array(h), pa.array(bad)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT]))
