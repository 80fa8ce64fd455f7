"""Minimum-redundancy maximum-relevance selection.

Relevance (one score per feature) and redundancy (one score per feature
pair) are computed by Spark jobs; the greedy MRMR walk runs on the driver
over those p and p^2 numbers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import stats as ST


def binned(df: DataFrame, cols, discrete=(), bins: int = 10) -> DataFrame:
    """Continuous columns -> equal-frequency bin ids; discrete ones kept."""
    cont = [c for c in cols if c not in set(discrete)]
    edges = ST.quantile_edges(df, cont, bins) if cont else {}
    return df.withColumns({c: ST.bin_column(c, edges[c], outside="clip") for c in cont})


def relevance_mi(df: DataFrame, cols, label: str, discrete=(), bins: int = 10) -> dict[str, float]:
    b = binned(df, cols, discrete, bins)
    return {r["feature"]: r["mi"] for r in ST.mutual_info_discrete(b, cols, label).collect()}


def relevance_f(df: DataFrame, cols, label: str, regression: bool = False) -> dict[str, float]:
    t = ST.f_regression(df, cols, label) if regression else ST.anova_f(df, cols, label)
    return {r["feature"]: r["f"] for r in t.select("feature", "f").collect()}


def redundancy_corr(df: DataFrame, cols) -> dict[tuple[str, str], float]:
    out = {}
    for r in ST.corr_pairs(df, cols).collect():
        v = abs(r["corr"]) if r["corr"] is not None else 0.0
        out[(r["feature1"], r["feature2"])] = out[(r["feature2"], r["feature1"])] = v
    return out


WIDE = 256


def joint_counts(df: DataFrame, cols) -> dict[tuple[str, str], "np.ndarray"]:           # noqa: F821
    """Contingency tables of all pairs of coded columns in one pass after their distinct values.

    The codes of a batch become one matrix of zeros and ones, with a column for
    each value and one for nulls; its product with itself holds every pair's
    counts, which are summed over batches and tasks.  The driver receives the
    square of the number of values, so columns must be narrow (bins, or at most
    ``WIDE`` values).  The last row or column of a table is for nulls.
    """
    import numpy as np
    import pandas as pd
    cols = list(cols)
    known = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first()
    values = [{v: i for i, v in enumerate(known[c])} for c in cols]
    starts = np.concatenate([[0], np.cumsum([len(v) + 1 for v in values])])

    def partial(pdf: pd.DataFrame) -> np.ndarray:
        hot = np.zeros((len(pdf), starts[-1]), np.float32)
        rows = np.arange(len(pdf))
        for i, v in enumerate(values):
            code = pdf.iloc[:, i].map(v).to_numpy(dtype=float, na_value=np.nan)
            hot[rows, starts[i] + np.where(np.isnan(code), len(v), np.nan_to_num(code)).astype(int)] = 1
        return (hot.T @ hot).astype(float)            # a batch has far fewer rows than float32 can count

    got = ST._summed(df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]), partial)
    whole = np.array([got[i] for i in range(starts[-1])]) if got else np.zeros((starts[-1], starts[-1]))
    return {(a, c): whole[starts[i]:starts[i + 1], starts[j]:starts[j + 1]] for i, a in enumerate(cols) for j, c in enumerate(cols) if i != j}


def table_mi(counts: "np.ndarray") -> float | None:                                       # noqa: F821
    """Mutual information of a contingency table in nats; null for an empty one."""
    import numpy as np
    n = counts.sum()
    if not n:
        return None

    def entropy(x):
        x = x[x > 0]
        return float((x * np.log(x)).sum())
    return float((entropy(counts.ravel()) - entropy(counts.sum(axis=0)) - entropy(counts.sum(axis=1))) / n + np.log(n))


def redundancy_mi(df: DataFrame, cols, discrete=(), bins: int = 10) -> dict[tuple[str, str], float]:
    """Pairwise MI of binned features (nulls of the earlier column are a value, rows with a null later one are left out).

    All pairs of narrow columns come from one pass; a discrete column of more
    than ``WIDE`` values takes a contingency job of its own.
    """
    cols = list(cols)
    b = binned(df, cols, discrete, bins).select(*cols).cache()
    sizes = b.agg(*[F.count_distinct(c).alias(c) for c in discrete]).first() if discrete else {}
    wide = [c for c in discrete if sizes[c] > WIDE]
    narrow = [c for c in cols if c not in wide]
    tables = joint_counts(b, narrow) if len(narrow) > 1 else {}
    out = {}
    for i, a in enumerate(cols[:-1]):
        rest = cols[i + 1:]
        for c in rest:
            if (a, c) in tables and (mi := table_mi(tables[a, c][:, :-1])) is not None:
                out[(a, c)] = out[(c, a)] = mi
        left = rest if a in wide else [c for c in rest if c in wide]
        for r in ST.mutual_info_discrete(b, left, a).collect() if left else ():
            out[(a, r["feature"])] = out[(r["feature"], a)] = r["mi"]
    b.unpersist()
    return out


def mrmr(rel: dict[str, float], red: dict[tuple[str, str], float], k: int, scheme: str = "quotient",
         order=None) -> list[tuple[int, str, float]]:
    """Greedy MRMR: first the most relevant feature, then repeatedly the one
    maximising relevance / mean redundancy (MIQ, FCQ, RFCQ) or relevance -
    mean redundancy (MID).  Ties go to the earlier column in ``order``."""
    order = list(order or rel)
    pos = {c: i for i, c in enumerate(order)}
    chosen: list[str] = []
    steps = []
    while len(chosen) < min(k, len(order)):
        best, best_score = None, None
        for c in order:
            if c in chosen or rel.get(c) is None:
                continue
            if not chosen:
                sc = rel[c]
            else:
                m = sum(red.get((c, s), 0.0) for s in chosen) / len(chosen)
                if scheme == "difference":
                    sc = rel[c] - m
                else:
                    sc = rel[c] / m if m > 0 else float("inf")
            if best is None or sc > best_score or (sc == best_score and pos[c] < pos[best]):
                best, best_score = c, sc
        if best is None:
            break
        chosen.append(best)
        steps.append((len(chosen), best, float(best_score)))
    return steps
