"""Upper-tail probabilities for chi-square and F statistics.

Score tables have one row per feature, so the p-values are computed with a
vectorised pandas UDF over that small table (scipy is not required).  The
special functions are the textbook series / continued-fraction forms of the
regularised incomplete gamma and beta functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300


def _gammainc_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x)."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(10000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1.0 - _gammainc_upper_cf(a, x)


def _gammainc_upper_cf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) by Lentz's continued fraction."""
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(stat: float, dof: float) -> float:
    if stat is None or dof is None or dof <= 0 or stat != stat:
        return float("nan")
    if stat <= 0:
        return 1.0
    a, x = dof / 2.0, stat / 2.0
    return _gammainc_upper_cf(a, x) if x >= a + 1 else 1.0 - _gammainc_lower(a, x)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def f_sf(stat: float, d1: float, d2: float) -> float:
    if stat is None or stat != stat or d1 is None or d2 is None or d1 <= 0 or d2 <= 0:
        return float("nan")
    if stat <= 0:
        return 1.0
    if math.isinf(stat):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * stat))


@F.pandas_udf(DoubleType())
def _chi2_sf_udf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(s, k) if s == s and k == k else np.nan for s, k in zip(stat, dof)])


@F.pandas_udf(DoubleType())
def _f_sf_udf(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(s, a, b) if s == s else np.nan for s, a, b in zip(stat, d1, d2)])


def chi2_pvalue(stat, dof) -> Column:
    """p-value column for a chi-square statistic (run on score tables)."""
    return _chi2_sf_udf(F.col(stat).cast("double") if isinstance(stat, str) else stat,
                        F.col(dof).cast("double") if isinstance(dof, str) else dof)


def f_pvalue(stat, d1, d2) -> Column:
    """p-value column for an F statistic (run on score tables)."""
    c = (lambda x: F.col(x).cast("double") if isinstance(x, str) else x.cast("double"))
    return _f_sf_udf(c(stat), c(d1), c(d2))
