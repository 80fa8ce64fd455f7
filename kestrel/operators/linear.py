"""Least-squares scoring from sufficient statistics.

One Spark pass computes, per fold, the centred cross-product sums of
``(x_1..x_p, y)``; every candidate subset is then scored from those
(p+1)^2 numbers without touching the data again.  Wrapper searches
(forward, backward, exhaustive, recursive addition) with a linear model
cost one scan in total, however many subsets they try.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import wrapper as W
from kestrel.operators.stats import _summed


class GramStats:
    """Per-fold sums: n, s (sum of z), P (sum of z z^T) for z = (x - mu, y - mu_y)."""

    def __init__(self, cols, n, s, P, mu):
        self.cols = list(cols)
        self.n, self.s, self.P, self.mu = n, s, P, mu  # dict fold -> arrays; mu = centre

    @property
    def folds(self):
        return sorted(self.n)

    def total(self):
        return (sum(self.n.values()), sum(self.s.values()), sum(self.P.values()))

    def train(self, k):
        n, s, P = self.total()
        return n - self.n[k], s - self.s[k], P - self.P[k]


def gram_stats(df: DataFrame, cols, label: str, fold_col: str | None = None) -> GramStats:
    """The centred sums of every fold in one pass after the means, for any
    number of columns; a null in any used column is an error, as in
    scikit-learn."""
    cols = list(cols)
    names = cols + [label]
    clean = df.select(*([F.col(fold_col).cast("int").alias("_kfold")] if fold_col else [F.lit(0).alias("_kfold")]),
                      *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    q = len(names)
    means = clean.agg(*[F.avg(f"c{i}") for i in range(q)], *[F.count_if(F.col(f"c{i}").isNull()) for i in range(q)],
                      F.min("_kfold"), F.max("_kfold")).first()
    if holes := [c for i, c in enumerate(names) if means[q + i]]:
        raise ValueError(f"null values in {', '.join(holes)}; fill or drop them first")
    mu = np.array([means[i] or 0.0 for i in range(q)])
    low, high = means[2 * q] or 0, means[2 * q + 1] or 0

    def partial(pdf):
        # For each fold q rows: sums of products, sum, and count of the rows.
        out = np.zeros(((high - low + 1) * q, q + 2))
        fold = pdf.iloc[:, 0].to_numpy()
        z = pdf.iloc[:, 1:].to_numpy(dtype=float) - mu
        for k in np.unique(fold):
            x = z[fold == k]
            block = out[(k - low) * q:(k - low + 1) * q]
            block[:, :q], block[:, q], block[:, q + 1] = x.T @ x, x.sum(axis=0), len(x)
        return out

    got = _summed(clean, partial)
    n, s, P = {}, {}, {}
    for k in range(low, high + 1):
        rows = np.array([got[(k - low) * q + i] for i in range(q)]) if got else np.zeros((q, q + 2))
        if rows[0, q + 1]:
            n[k], s[k], P[k] = int(rows[0, q + 1]), rows[:, q], rows[:, :q]
    return GramStats(cols, n, s, P, mu)


def _fit(n, s, P, idx, ridge: float = 0.0):
    """OLS with intercept on centred sums restricted to columns ``idx``."""
    q = P.shape[0]
    y = q - 1
    mx, my = s[idx] / n, s[y] / n
    Sxx = P[np.ix_(idx, idx)] - n * np.outer(mx, mx)
    Sxy = P[idx, y] - n * mx * my
    if ridge:
        Sxx = Sxx + ridge * np.eye(len(idx))
    beta = np.linalg.lstsq(Sxx, Sxy, rcond=None)[0] if len(idx) else np.zeros(0)
    b0 = my - mx @ beta
    return b0, beta


def _sse(n, s, P, idx, b0, beta):
    """Sum of squared errors of y - b0 - X beta from the sums."""
    y = P.shape[0] - 1
    w = np.concatenate([[-b0], -beta, [1.0]])          # residual = w . (1, x, y)
    ext = np.zeros((len(idx) + 2, len(idx) + 2))
    sel = list(idx) + [y]
    ext[0, 0] = n
    ext[0, 1:] = ext[1:, 0] = s[sel]
    ext[1:, 1:] = P[np.ix_(sel, sel)]
    return float(w @ ext @ w)


def r2_insample(g: GramStats, subset) -> float:
    idx = [g.cols.index(c) for c in subset]
    n, s, P = g.total()
    b0, beta = _fit(n, s, P, idx)
    y = P.shape[0] - 1
    tss = P[y, y] - s[y] ** 2 / n
    return float(1.0 - _sse(n, s, P, idx, b0, beta) / tss)


def r2_cv(g: GramStats, subset) -> float:
    """Mean over folds of the held-out R^2 (``cross_val_score(..., 'r2')``)."""
    idx = [g.cols.index(c) for c in subset]
    scores = []
    y = len(g.cols)
    for k in g.folds:
        b0, beta = _fit(*g.train(k), idx)
        nk, sk, Pk = g.n[k], g.s[k], g.P[k]
        tss = Pk[y, y] - sk[y] ** 2 / nk
        scores.append(1.0 - _sse(nk, sk, Pk, idx, b0, beta) / tss)
    return float(np.mean(scores))


def coefficients(g: GramStats, subset=None, ridge: float = 0.0) -> dict[str, float]:
    """Linear-regression coefficients on the original scale."""
    subset = list(subset or g.cols)
    idx = [g.cols.index(c) for c in subset]
    n, s, P = g.total()
    b0, beta = _fit(n, s, P, idx, ridge)
    mu = g.mu
    intercept = b0 + mu[-1] - float(np.dot(beta, mu[idx]))
    out = dict(zip(subset, map(float, beta)))
    out["intercept"] = float(intercept)
    return out


def score_fn(g: GramStats, cv: bool):
    return (lambda sub: r2_cv(g, sub)) if cv else (lambda sub: r2_insample(g, sub))


def forward_select(g: GramStats, k: int, cv: bool = False, tol: float | None = None):
    """Step forward (X1, X2) with a linear scorer; see :func:`wrapper.forward`."""
    f = score_fn(g, cv)
    return W.forward(g.cols, lambda many: [f(x) for x in many], k, tol)


def backward_select(g: GramStats, k: int, cv: bool = False, tol: float | None = None):
    """Step backward (X3, X4) with a linear scorer; see :func:`wrapper.backward`."""
    f = score_fn(g, cv)
    return W.backward(g.cols, lambda many: [f(x) for x in many], k, tol)


SUBSETS_PER_TASK = 5000


def exhaustive_scores(spark, g: GramStats, min_k: int, max_k: int, cv: bool = False) -> DataFrame:
    """Exhaustive search (X5): every subset of size min_k..max_k as a row.

    Subsets are numbered; a task makes its own from their numbers and scores
    them against the broadcast sums, so none is listed on the driver."""
    total = W.n_subsets(len(g.cols), min_k, max_k)
    numbers = spark.range(0, total, 1, max(1, -(-total // SUBSETS_PER_TASK)))
    bc = spark.sparkContext.broadcast((g.cols, g.n, g.s, g.P, g.mu))

    def score(it):
        import pandas as pd
        f = score_fn(GramStats(*bc.value), cv)
        for pdf in it:
            picked = [[bc.value[0][i] for i in W.subset_at(len(bc.value[0]), min_k, int(r))] for r in pdf["id"]]
            yield pd.DataFrame({"subset": [",".join(x) for x in picked], "k": np.array([len(x) for x in picked], np.int32),
                                "r2": [f(x) for x in picked]})

    return numbers.mapInPandas(score, "subset string, k int, r2 double")


def recursive_addition(g: GramStats, order, tol: float, cv: bool = True):
    """Recursive feature addition (Y6) with a linear scorer: walk features in
    ``order`` (most important first); keep one when the score gain >= tol and
    move the baseline.  Returns (kept, [(feature, gain, kept?)])."""
    f = score_fn(g, cv)
    kept = [order[0]]
    base = f(kept)
    log = [(order[0], float(base), True)]
    for c in order[1:]:
        sc = f(kept + [c])
        gain = sc - base
        keep = gain >= tol
        if keep:
            kept.append(c)
            base = sc
        log.append((c, float(gain), bool(keep)))
    return kept, log
