"""Quality classifier by positive-unlabelled learning.

Known are trusted positives (texts marked as good) and unlabelled web text, a
mixture of good and bad with an unknown share of good ones, the class prior.
With logistic loss ``l`` and a linear score ``z`` the classifier minimises the
non-negative unbiased risk

    prior * E_pos[l(z)] + max(0, E_unl[l(-z)] - prior * E_pos[l(-z)])

over all unlabelled documents.  Negative labels are never used.

* Features of a text are shares and rates that need no vocabulary: bytes by
  value, words by shape, repetition of words, word triples and lines.  They
  are computed once per document and written as a table.
* Each Newton step is one pass over the table (gradient and curvature summed
  per task, the sums are ``features ** 2`` numbers) and one for the step
  length, chosen by the risk itself.  Steps end when the risk falls no more,
  in particular where the second term would become negative.
* The class prior is estimated from scores alone: a part of the positives is
  held back; among texts above a score, the share of unlabelled ones divided
  by the share of held-back positives bounds the prior from above, and the
  least such bound (with a margin for small counts) is taken.  The scores come
  from a first fit with a prior of one half.

The positives are at most ``max_positives`` labelled rows, those with the
smallest hash of their id; the bound is a parameter.  The unlabelled side is
every document.

Edge cases: null and empty texts have all-zero shares and get a score like any
other; without positives every score is 0.5; null labels and ids are no
positives; repeated rows count as often as they occur; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import discard, small_batches, written

N_BYTES = 129                    # ASCII by value, all others together
N_FEATURES = N_BYTES + 14
STEPS = (1.0, 0.5, 0.25, 0.1, 0.02, 0.0)
BINS = 1000


def text_features(text: str | None) -> np.ndarray:
    """The features of one text."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:128] = np.sqrt(counts[:128] / n)
    out[128] = np.sqrt(counts[128:].sum() / n)
    words = raw.split()
    lines = raw.split(b"\n")
    k = max(1, len(words))
    common = Counter(words).most_common(3)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, k - 2)
    distinct = len(set(lines))
    out[N_BYTES:] = (
        counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n,
        counts[33:48].sum() / n + counts[58:65].sum() / n + counts[91:97].sum() / n + counts[123:127].sum() / n,
        common[0][1] / k if common else 0.0, sum(c for _, c in common) / k,
        len(set(words)) / k ** 0.8, 1.0 - min(1.0, triples),
        1.0 - distinct / len(lines), np.log1p(n) / 10, np.log1p(k / len(lines)) / 5,
        sizes.mean() / 10 if len(words) else 0.0, sizes.std() / 10 if len(words) else 0.0,
        float((sizes <= 2).mean()) if len(words) else 0.0)
    return out


def features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x binary``: the features of each text as 32-bit floats."""
    import pyarrow as pa
    small_batches(df.sparkSession)
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return src.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, x binary")


def _matrix(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES)
    return np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)


def _total(table: DataFrame, partial, size: int) -> np.ndarray:
    """Sum of ``partial(matrix, part)`` over the feature table: one vector per task, added up by Spark."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                acc += partial(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(acc)], names=["i", "v"])

    sums = table.select("x", "part").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Fit:
    """Newton steps on the non-negative risk over a table ``x, part`` (0 unlabelled, 1 positive, 2 held back).

    Positives are rows of their own: as documents they also are unlabelled rows.  Standardised weights
    are held back by a ridge of ``ridge + ridge_rows / positives``.
    """

    def __init__(self, table: DataFrame, ridge: float = 0.01, ridge_rows: float = 20.0):
        self.table, self.d = table, N_FEATURES + 1
        d = self.d

        def moments(x, part):
            u, p, h = x[part == 0], x[part == 1], part == 2
            return np.concatenate([[len(u), len(p), h.sum()], u.sum(0), (u * u).sum(0), p.sum(0)])
        got = _total(table, moments, 3 + 3 * d)
        self.n_unl, self.n_pos, self.n_held = got[:3]
        if not self.n_pos or not self.n_unl:
            return
        self.l2 = ridge + ridge_rows / self.n_pos
        mean, square = got[3:3 + d] / self.n_unl, got[3 + d:3 + 2 * d] / self.n_unl
        scale = np.sqrt(np.maximum(square - mean * mean, 0))
        self.mean, self.scale = mean, np.where(scale > 1e-6, 1 / np.maximum(scale, 1e-6), 0.0)
        self.mean[-1], self.scale[-1] = 0.0, 1.0                     # the constant
        self.pos_mean = (got[3 + 2 * d:] / self.n_pos - self.mean) * self.scale
        self.w = np.zeros(d)

    def _scores(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8) @ w

    def step(self, prior: float) -> bool:
        """One Newton step; false if none of the step lengths lowers the risk.

        Where the second term of the risk is negative it counts as 0, so the step
        follows the first term alone.
        """
        d, w, mean, scale = self.d, self.w, self.mean, self.scale

        def curvature(x, part):
            z = np.clip((x - mean) * scale, -8, 8)
            u, p = z[part == 0], z[part == 1]
            s, t = 1 / (1 + np.exp(-(u @ w))), 1 / (1 + np.exp(-(p @ w)))
            return np.concatenate([s @ u, p.sum(0), (u.T @ (u * (s * (1 - s))[:, None])).ravel(), [_softplus(u @ w).sum(), _softplus(p @ w).sum()],
                                   (t - 1) @ p, (p.T @ (p * (t * (1 - t))[:, None])).ravel()])
        got = _total(self.table, curvature, 3 * d + 2 * d * d + 2)
        ridge = np.full(d, self.l2)
        ridge[-1] = 0.0
        # With logistic loss l(z) - l(-z) = -z, so the unclipped risk is E_unl[softplus(z)] - prior * E_pos[z].
        gradient = got[:d] / self.n_unl - prior * got[d:2 * d] / self.n_pos + ridge * w
        hessian = got[2 * d:2 * d + d * d].reshape(d, d) / self.n_unl + np.diag(ridge + 1e-9)
        rest = got[2 * d + d * d:]
        if rest[0] / self.n_unl - prior * rest[1] / self.n_pos < 0:
            gradient = prior * rest[2:2 + d] / self.n_pos + ridge * w
            hessian = prior * rest[2 + d:].reshape(d, d) / self.n_pos + np.diag(ridge + 1e-9)
        move = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        tries = [w + t * move for t in STEPS]

        def risks(x, part):
            out = []
            for v in tries:
                s = np.clip((x - mean) * scale, -8, 8) @ v
                out += [_softplus(-s[part == 1]).sum(), _softplus(s[part == 1]).sum(), _softplus(s[part == 0]).sum()]
            return np.array(out)
        r = _total(self.table, risks, 3 * len(tries)).reshape(-1, 3)
        pos, minus, unl = r[:, 0] / self.n_pos, r[:, 1] / self.n_pos, r[:, 2] / self.n_unl
        risk = prior * pos + np.maximum(0, unl - prior * minus) + np.array([(ridge * v * v).sum() / 2 for v in tries])
        best = int(np.argmin(risk))
        if risk[best] >= risk[-1] - 1e-7:
            return False
        self.w = tries[best]
        return True

    def prior(self) -> float:
        """Upper bound of the prior from the score distributions, the least over all thresholds."""
        w, mean, scale = self.w, self.mean, self.scale

        def histogram(x, part):
            p = 1 / (1 + np.exp(-(np.clip((x - mean) * scale, -8, 8) @ w)))
            b = np.minimum((p * BINS).astype(np.int64), BINS - 1)
            return np.concatenate([np.bincount(b[part == 0], minlength=BINS), np.bincount(b[part == 2], minlength=BINS)])
        got = _total(self.table, histogram, 2 * BINS).reshape(2, BINS)
        unl, held = got[:, ::-1].cumsum(axis=1) / np.maximum(got.sum(axis=1, keepdims=True), 1)
        slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(max(self.n_unl, 1)) + 1 / np.sqrt(max(self.n_held, 1)))
        usable = held > 0.05
        bound = (unl[usable] + slack) / held[usable]
        return float(np.clip(bound.min() - slack / held[usable][bound.argmin()], 0.01, 0.99)) if usable.any() else 0.5


def fit(table: DataFrame, positives: DataFrame, steps: int = 8) -> Fit:
    """Fit on a feature table (``doc_id, x``); ``positives`` has the ids of trusted rows."""
    marked = positives.select(F.col("doc_id"), (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).alias("held"))
    trusted = table.join(F.broadcast(marked), "doc_id").select("x", F.when(F.col("held"), 2).otherwise(1).alias("part"))
    # Read in every step, so the positives are looked up once.
    both = written(table.select("x", F.lit(0).alias("part")).union(trusted), "quality-rows")
    model = Fit(both)
    if model.n_pos and model.n_unl:
        for _ in range(steps // 2):
            if not model.step(0.5):
                break
        model.class_prior = model.prior()
        for _ in range(steps):
            if not model.step(model.class_prior):
                break
    discard(both)
    return model


def trusted_ids(labels: DataFrame, label: str, chosen: Column, max_positives: int, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` of at most ``max_positives`` positive label rows, by the hash of the id."""
    return (labels.where(chosen & (F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct()
            .orderBy(F.xxhash64(F.lit("trusted"), "doc_id"), "doc_id").limit(max_positives))


def score(table: DataFrame, model: Fit) -> DataFrame:
    """``doc_id, score``: probability of good quality for each row of a feature table."""
    import pyarrow as pa
    fitted = bool(model.n_pos and model.n_unl)
    w, mean, scale = (model.w, model.mean, model.scale) if fitted else (None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if fitted and batch.num_rows:
                z = np.clip((_matrix(batch.column(1)) - mean) * scale, -8, 8) @ w
                p = 1 / (1 + np.exp(-z))
            else:
                p = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def classify(df: DataFrame, labels: DataFrame, label: str = "quality", chosen: Column | None = None,
             max_positives: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row of ``df``, learned from the positives among ``labels`` and from ``df`` itself."""
    table = written(features(df, doc_id, text), "quality")
    chosen = F.lit(True) if chosen is None else chosen
    return score(table, fit(table, trusted_ids(labels, label, chosen, max_positives, doc_id)))
