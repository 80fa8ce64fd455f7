"""Penalised linear models for many penalties at once.

* :func:`lasso_path`: squared error with an L1 penalty, from the cross-product
  sums of one scan (:func:`kestrel.operators.linear.gram_stats`).  Cyclic
  coordinate descent over descending penalties, each begun at the answer of
  the one before and ended by the optimality conditions.
* :func:`logistic_path`: logistic models with L2 or L1 penalties.  One Arrow pass
  sums loss, gradient and Hessian of all unfinished penalties; each then takes a
  Newton step (for L1 a coordinate descent on the quadratic model), halved if
  the next pass finds that its objective rose.  Passes are those of the
  slowest penalty, not of their number.

Columns are standardised (population deviation) inside the sums if asked.  The
driver holds p^2 numbers a penalty.  A null in any used column is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.linear import GramStats
from kestrel.operators.stats import _doubles, _summed


def soft(x: float, t: float) -> float:
    return np.sign(x) * max(abs(x) - t, 0.0)


@dataclass
class Fit:
    """One penalty's answer; ``violation`` is the largest breach of the optimality conditions, ``passes`` the scans or sweeps."""

    penalty: float
    coef: dict[str, float]
    intercept: float
    violation: float
    passes: int


def descend(q: np.ndarray, b: np.ndarray, beta: np.ndarray, l1: np.ndarray, tol: float, sweeps: int) -> tuple[np.ndarray, int]:
    """Minimise ``beta q beta / 2 - b beta + sum l1 |beta|`` by coordinates, from ``beta`` on."""
    beta = beta.copy()
    for n in range(1, sweeps + 1):
        for j in range(len(beta)):
            if q[j, j] > 0:
                beta[j] = soft(b[j] - q[j] @ beta + q[j, j] * beta[j], l1[j]) / q[j, j]
        if violation(b - q @ beta, beta, l1) <= tol:
            break
    return beta, n


def violation(slope: np.ndarray, beta: np.ndarray, l1: np.ndarray) -> float:
    """Largest breach of ``slope = l1 sign(beta)`` where beta is not 0, and ``|slope| <= l1`` where it is."""
    return float(np.where(beta != 0, np.abs(slope - l1 * np.sign(beta)), np.maximum(np.abs(slope) - l1, 0)).max(initial=0.0))


def lasso_path(g: GramStats, alphas, standardise: bool = False, tol: float = 1e-12, sweeps: int = 100_000) -> list[Fit]:
    """``Lasso(alpha)`` for every penalty, in the order given (E6, the regression form of E4).

    The objective is ``sum (y - a - x beta)^2 / (2 n) + alpha sum |beta|``.  A
    constant column gets 0.  ``tol`` is relative to the largest slope at 0.
    """
    n, s, P = g.total()
    p = len(g.cols)
    full = P / n - np.outer(s, s) / n ** 2
    q, b = full[:p, :p], full[:p, p]
    spread = np.sqrt(np.clip(np.diag(q), 0, None))
    unit = np.where(spread > 0, spread, 1.0) if standardise else np.ones(p)
    q, b = q / np.outer(unit, unit), b / unit
    limit = tol * max(float(np.abs(b).max(initial=0.0)), 1e-300)
    found, beta = {}, np.zeros(p)
    for alpha in sorted({float(a) for a in alphas}, reverse=True):
        l1 = np.full(p, alpha)
        beta, n_sweeps = descend(q, b, beta, l1, limit, sweeps)
        raw = beta / unit
        # The intercept refers to the columns as given.
        start = g.mu[p] + s[p] / n - float(raw @ (g.mu[:p] + s[:p] / n))
        found[alpha] = Fit(alpha, dict(zip(g.cols, map(float, beta))), start, violation(b - q @ beta, beta, l1), n_sweeps)
    return [found[float(a)] for a in alphas]


def logistic_path(df: DataFrame, cols, label: str, l2=(), l1=(), standardise: bool = False, tol: float = 1e-9,
                  max_passes: int = 100) -> tuple[list[Fit], list[Fit]]:
    """Logistic models for all L2 weights ``l2`` and all L1 weights ``l1`` together.

    The objectives are ``sum loss + l2 |beta|^2 / 2`` and ``sum loss + l1 sum |beta|``
    (scikit-learn's ``C`` is 1 over the weight); the intercept is free.  Ends
    when no optimality condition is off by more than ``tol`` a row.
    """
    cols, p = list(cols), len(list(cols))
    table = _doubles(df, [*cols, label])
    stats = table.agg(F.count(F.lit(1)), *[F.avg(f"c{i}") for i in range(p + 1)], *[F.stddev_pop(f"c{i}") for i in range(p)],
                      *[F.count_if(F.col(f"c{i}").isNull()) for i in range(p + 1)]).first()
    if holes := [c for i, c in enumerate([*cols, label]) if stats[2 * p + 2 + i]]:
        raise ValueError(f"null values in {', '.join(holes)}; fill or drop them first")
    n = stats[0]
    if not n:
        raise ValueError("no rows")
    mu = np.array([stats[1 + i] for i in range(p)])
    spread = np.array([stats[2 + p + i] or 0.0 for i in range(p)])
    unit = np.where(spread > 0, spread, 1.0) if standardise else np.ones(p)

    smooth = np.array([float(w) for w in l2] + [0.0] * len(l1))
    sharp = np.array([0.0] * len(l2) + [float(w) for w in l1])
    k = len(smooth)
    at = np.zeros((k, p + 1))                                 # intercept first, columns centred
    free = np.r_[0.0, np.ones(p)]
    kept = [None] * k                                         # (objective, place) of the last accepted point
    done: dict[int, Fit] = {}

    def measured(todo: list[int], places: np.ndarray) -> dict:
        def partial(pdf):
            z = pdf.to_numpy(dtype=float)
            x, y = np.c_[np.ones(len(z)), (z[:, :p] - mu) / unit], z[:, p]
            out = np.zeros((len(todo) * (p + 1), p + 3))
            for r, place in enumerate(places):
                m = x @ place
                t = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                block = out[r * (p + 1):(r + 1) * (p + 1)]
                block[:, :p + 1] = (x * (t * (1 - t))[:, None]).T @ x
                block[:, p + 1], block[0, p + 2] = x.T @ (y - t), (np.logaddexp(0, m) - y * m).sum()
            return out
        got = _summed(table, partial)
        return {i: np.array([got[r * (p + 1) + j] for j in range(p + 1)]) for r, i in enumerate(todo)}

    for n_pass in range(1, max_passes + 1):
        todo = [i for i in range(k) if i not in done]
        if not todo:
            break
        for i, sums in measured(todo, at[todo]).items():
            hessian, slope, loss = sums[:, :p + 1], sums[:, p + 1].copy(), sums[0, p + 2]
            value = loss + smooth[i] * (at[i, 1:] ** 2).sum() / 2 + sharp[i] * np.abs(at[i, 1:]).sum()
            if kept[i] is not None and value > kept[i][0] * (1 + 1e-12):
                at[i] = (at[i] + kept[i][1]) / 2                                # too far
                continue
            kept[i] = (value, at[i].copy())
            slope -= smooth[i] * free * at[i]
            weights = sharp[i] * free
            off = violation(slope, at[i], weights)
            if off <= tol * n:
                beta = at[i, 1:]
                done[i] = Fit(float(smooth[i] or sharp[i]), dict(zip(cols, map(float, beta))), float(at[i, 0] - (beta / unit) @ mu), off, n_pass)
                continue
            model = hessian + np.diag(smooth[i] * free + 1e-12 * np.trace(hessian) / (p + 1))
            if sharp[i]:
                at[i] = descend(model, slope + model @ at[i], at[i], weights, 1e-3 * min(off, 1.0) + 1e-3 * tol * n, 10_000)[0]
            else:
                at[i] = at[i] + np.linalg.solve(model, slope)
    if len(done) < k:
        raise ArithmeticError(f"{k - len(done)} penalties not at their optimum after {max_passes} passes")
    return [done[i] for i in range(len(l2))], [done[i] for i in range(len(l2), k)]


def table_of(fits: list[Fit], cols) -> list[tuple[str, float, float]]:
    """``(feature, penalty, coefficient)`` rows of a path."""
    return [(c, f.penalty, f.coef[c]) for f in fits for c in cols]
