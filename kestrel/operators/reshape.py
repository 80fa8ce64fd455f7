"""Joins, unions, reshaping, top-k and distinct helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_by_feature(tables: dict[str, DataFrame], key: str = "feature", value: str = "score") -> DataFrame:
    """``concat(axis=1)`` of named score series (J4): full outer join on key."""
    frames = [t.select(key, F.col(value).alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def union_all(frames) -> DataFrame:
    """``pd.concat(ignore_index=True)`` (U1): missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def melt(df: DataFrame, id_vars, value_vars, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """``pd.melt`` (U4) via ``unpivot``."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def top_k(df: DataFrame, by, k: int, ascending: bool = False, tie=None) -> DataFrame:
    """``sort_values().head(k)`` (T2): TakeOrderedAndProject, k rows per task."""
    order = [F.col(by).asc() if ascending else F.col(by).desc()] + ([F.col(t) for t in ([tie] if isinstance(tie, str) else tie)] if tie else [])
    return df.orderBy(*order).limit(k)


def select_k_best(scores: DataFrame, k: int, score: str = "score", feature: str = "feature",
                  ascending: bool = False) -> DataFrame:
    """``SelectKBest`` (T3) over a score table; ``ascending`` for p-values."""
    return top_k(scores, score, k, ascending, feature)


def select_percentile(scores: DataFrame, percentile: float, score: str = "score", order: str = "i") -> DataFrame:
    """``SelectPercentile`` (T4): scores above the (100 - pct) percentile, then
    ties at the threshold in column order until ``floor(n * pct / 100)``.

    Runs on the score table (one row per feature).
    """
    n = scores.count()
    k = int(n * percentile / 100.0)
    if k == 0:
        return scores.limit(0)
    thr = scores.agg(F.percentile(score, 1.0 - percentile / 100.0).alias("t")).first()["t"]
    above = scores.where(F.col(score) > F.lit(thr))
    n_above = above.count()
    ties = scores.where(F.col(score) == F.lit(thr)).orderBy(order).limit(max(0, k - n_above))
    return above.unionByName(ties)


def keep_by_rule(scores: DataFrame, rule: str, score: str = "score", value: float | None = None) -> DataFrame:
    """Threshold rules on a score table (T5): '>', '<', '>mean', '<mean', '>mean_abs'."""
    if rule in (">", "<"):
        cond = F.col(score) > F.lit(value) if rule == ">" else F.col(score) < F.lit(value)
        return scores.where(cond)
    stat = F.avg(F.abs(score)) if rule == ">mean_abs" else F.avg(score)
    m = scores.agg(stat).scalar()
    x = F.abs(score) if rule == ">mean_abs" else F.col(score)
    cond = x > m if rule.startswith(">") else x < m
    return scores.where(cond)


def not_in(a: DataFrame, b: DataFrame, key: str = "feature") -> DataFrame:
    """Names in A not in B (U6): ``left_anti``."""
    return a.join(b.select(key), key, "left_anti")
