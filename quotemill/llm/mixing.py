"""Mixing sources to target weights by document rates.

A classifier fitted on the labelled table gives every document a posterior over domains (the pairs of ``quality`` and
``toxic``), so membership is soft.  Documents then get nonnegative rates, the expected number of times to use each,
such that the expected tokens of each domain come as close as possible (least squares, with a small pull to rate 1)
to target shares of the corpus's tokens.  The fit is projected gradient descent: each step is one distributed
aggregate of rate * tokens * posterior, a vector with one number per domain; a document's rate after any number of
steps follows from those vectors alone, so nothing is kept per document between steps.

Tokens are white-space separated words.  Null and empty texts have none, keep the domains' base rates as posterior
and rate 1.  Without labels there is one domain, ``all``.
"""

from __future__ import annotations

import dataclasses
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import sample_by_table
from .textvec import U, hashes, sums, words
from .workspace import pieces, released, texts_of, utf8_buffer, written

#: Bytes of text that are in work at once.
PIECE = 1 << 20
BUCKETS = 1 << 17
PER_DOMAIN, MAX_CHARS = 1500, 8000
EPOCHS, BATCH = 12, 64
STEPS, STEP, PULL = 40, 0.6, 1e-3
#: Share of all tokens by which a domain may miss its target without a warning.
WARN = 0.01
#: Target shares by domain (quality, toxic); domains that the labels lack are left out and the rest scaled to 1.
TARGETS = {"q1_t0": 0.80, "q0_t0": 0.17, "q1_t1": 0.02, "q0_t1": 0.01}


@dataclasses.dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.repeat(self.bias[None, :], len(offsets) - 1, 0)
        bucket, cut = _buckets(data, offsets)
        n = np.maximum(np.diff(cut), 1)
        for k in range(len(self.domains)):
            z[:, k] += sums(self.weights[:, k][bucket], cut) / np.sqrt(n)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text: its words, and what separates them (runs of other bytes hash as words do)."""
    starts, ends, doc = words(data, offsets)
    h = hashes(data, starts, ends)
    gap_end = np.r_[starts[1:], len(data)] if len(starts) else starts
    gap_end = np.minimum(gap_end, offsets[1:][doc]) if len(starts) else gap_end
    gap = hashes(data, ends, np.minimum(gap_end, ends + 8)) ^ U(0x165667B19E3779F9)
    both = np.stack([h, gap], 1).ravel()
    cut = np.zeros(len(offsets), np.int64)
    np.cumsum(2 * np.bincount(doc, minlength=len(offsets) - 1), out=cut[1:])
    return (both % U(BUCKETS)).astype(np.int32), cut


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8_buffer(pc.utf8_lower(pc.fill_null(column, "")))


def fit(sample: list[tuple[str, str]], shares: dict[str, float] | None = None) -> Classifier:
    """Softmax regression on hashed words by AdaGrad; the bias is set so that priors follow ``shares`` of the labels."""
    domains = sorted({k for k, _ in sample})
    if len(domains) < 2:
        return Classifier(domains or ["all"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(11)
    y = np.array([domains.index(k) for k, _ in sample])
    data, offsets = _lower(pa.array([t for _, t in sample], pa.string()))
    bucket, cut = _buckets(data, offsets)
    w = np.zeros((BUCKETS, len(domains)), np.float32)
    b = np.zeros(len(domains), np.float32)
    gw, gb = np.full(w.shape, 1e-6, np.float32), np.full(len(domains), 1e-6, np.float32)
    count = np.bincount(y, minlength=len(domains))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            size = cut[part + 1] - cut[part]
            at = np.repeat(cut[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = np.repeat(np.arange(len(part)), size)
            scale = 1 / np.sqrt(np.maximum(size, 1))
            off = np.r_[0, np.cumsum(size)]
            z = np.stack([sums(w[:, k][bucket[at]], off) for k in range(len(domains))], 1) * scale[:, None] + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= (len(y) / (len(domains) * np.maximum(count, 1)))[y[part]][:, None] / len(part)
            used, inverse = np.unique(bucket[at], return_inverse=True)
            g = np.stack([np.bincount(inverse, (p[:, k] * scale)[own], len(used)) for k in range(len(domains))], 1).astype(np.float32)
            gw[used] += g**2
            w[used] -= 0.1 * g / np.sqrt(gw[used])
            gb += p.sum(0) ** 2
            b -= 0.1 * p.sum(0) / np.sqrt(gb)
    # Trained on equal class weights; the labels' own shares come back as priors.
    prior = np.array([(shares or {}).get(d, c / len(y)) for d, c in zip(domains, count)])
    return Classifier(domains, w, b + np.log(np.maximum(prior, 1e-9) * len(domains)))


def train(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN, max_chars: int = MAX_CHARS) -> Classifier:
    """Fits on a bounded sample of the labelled documents: per_domain texts of max_chars of each domain."""
    domain = F.concat(F.lit("q"), F.col("quality").cast("int").cast("string"), F.lit("_t"), F.col("toxic").cast("int").cast("string"))
    marks = labels.select("doc_id", domain.alias("label")).filter("label IS NOT NULL")
    total = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(total.values())
    return fit(sample_by_table(docs, marks, per_domain, max_chars), {k: v / every for k, v in total.items()})


def _annotated(docs: DataFrame, model: Classifier, tokens: str, posterior: str) -> DataFrame:
    """docs with the number of tokens and the posterior appended; one pass, no shuffle."""
    names = [*docs.columns, tokens, posterior]

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            p = model.posteriors(*_lower(b.column("text")))
            n, d = p.shape
            col = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(t.split()) for t in texts_of(b)], pa.int64()), col], names=names)

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))]))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every row."""
    return _annotated(docs.select("doc_id", "text"), model, "n_tokens", "posterior").select("doc_id", "n_tokens", "posterior")


def rate_after(residuals: list[list[float]], scale: float, pull: float) -> Column:
    """A document's rate after the steps whose residual vectors are given: a fold that starts at 1 and projects to >= 0.

    A step moves a rate by -scale * (posterior . residual) - pull * (rate - 1).
    """
    if not residuals:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in residuals])

    def step(rate: Column, r: Column) -> Column:
        along = F.aggregate(F.zip_with("posterior", r, lambda p, x: p * x), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(F.lit(0.0), rate - F.lit(scale) * along - F.lit(pull) * (rate - F.lit(1.0)))

    fold = F.aggregate(steps, F.lit(1.0), step)
    return F.when(F.col("n_tokens") > 0, fold).otherwise(F.lit(1.0))


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float] | None = None, steps: int = STEPS) -> tuple[Column, dict]:
    """(the rate as an expression on (n_tokens, posterior), report) for the given target shares.

    With T tokens in all, residuals are (expected tokens of a domain - its target) / T.
    """
    wanted = np.array([(targets or TARGETS).get(d, 0.0) for d in domains])
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else np.full(len(domains), 1 / len(domains))

    def totals(rate: Column) -> np.ndarray:
        each = [F.sum(rate * F.col("n_tokens") * F.col("posterior")[k]).alias(f"d{k}") for k in range(len(domains))]
        return np.array([x or 0.0 for x in table.agg(*each).first()])

    before = totals(F.lit(1.0))
    total = before.sum()
    if total <= 0:
        return F.lit(1.0), {"domains": domains, "before": before.tolist(), "after": before.tolist(), "target": (wanted * total).tolist(), "residual": 0.0}
    # Residuals are weighted by the inverse of the posteriors' second moments, and rates measured by their tokens; in
    # this metric a full step from interior rates would reach the targets, so shorter steps descend.
    n = len(domains)
    moments = table.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i] * F.col("posterior")[j]) for i in range(n) for j in range(n)]).first()
    inverse = np.linalg.pinv(np.array(moments, float).reshape(n, n) / total + 1e-6 * np.eye(n))
    residuals: list[list[float]] = []
    now = before
    for _ in range(steps):
        gap = (now - wanted * total) / total
        if np.abs(gap).max() < 1e-4:
            break
        residuals.append((inverse @ gap).tolist())
        now = totals(rate_after(residuals, STEP, PULL))
    return rate_after(residuals, STEP, PULL), {"domains": domains, "before": before.tolist(), "after": now.tolist(), "target": (wanted * total).tolist(), "residual": float(np.abs(now - wanted * total).max() / total)}


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior and rate of every row of docs, and the domain's expected tokens
    before, its target and after.  Repeated rows get the same rate each; other columns are ignored."""
    model = train(docs, labels)
    table = written(posteriors(docs, model), "posteriors")
    rate, report = fit_rates(table, model.domains, targets)
    if report["residual"] > WARN:
        warnings.warn(f"the rates miss their targets by {report['residual']:.1%} of the tokens: {report}", stacklevel=2)
    # What each domain was to get and gets, in tokens, stands with its documents.
    place = F.array_position("posterior", F.array_max("posterior")).cast("int")
    told = {f"domain_{k}": F.element_at(F.array(*[F.lit(float(x)) for x in report[k]]), place) for k in ("before", "target", "after")}
    names = F.array(*[F.lit(d) for d in model.domains])
    return table.select("doc_id", "n_tokens", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("domain"), "posterior", F.round(rate, 6).alias("rate"), *[F.round(v, 3).alias(k) for k, v in told.items()])


def copies_of(rate: Column, key: Column) -> Column:
    """A whole number whose expectation is the rate: its floor, and one more if the key's hash falls below the rest."""
    unit = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs with every row as often as its rate says, all columns; rows whose likeliest domain is in ``keep`` stay at
    least once.  The rate is computed where the row is, so the texts don't move.
    """
    model = train(docs, labels)
    table = written(posteriors(docs, model), "posteriors")
    rate, _ = fit_rates(table, model.domains, targets)
    kept = [k + 1 for k, d in enumerate(model.domains) if d in keep]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    rows = _annotated(whole, model, "n_tokens", "posterior").select("_row", "n_tokens", "posterior")
    least = F.when(F.array_position("posterior", F.array_max("posterior")).isin(kept), 1).otherwise(0) if kept else F.lit(0)
    count = F.greatest(least, copies_of(rate, F.xxhash64("_row.doc_id", "_row.text")))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), count)).alias("_copy")).select("_row.*")
