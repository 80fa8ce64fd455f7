"""Column selection without a target.

Every detector computes a small per-feature or per-pair table with Spark
(see :mod:`kestrel.operators.stats`) and decides on it; decisions that are
greedy in column order run on the driver over that table only (p rows or
p^2/2 pairs, never data rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import stats as ST


# --- constant and quasi-constant ------------------------------------------------

def constant_by_std(df: DataFrame, cols) -> DataFrame:
    """Features whose sample std is 0 (F1); all-null columns are not flagged."""
    return ST.column_moments(df, cols).where(F.col("std") == 0).select("feature")


def constant_by_distinct(df: DataFrame, cols, dropna: bool = True) -> DataFrame:
    """Features with a single distinct value (F2): ``nunique() == 1``.
    With ``dropna=False`` a null counts as a value (``nunique(dropna=False)``).

    Decided from one aggregate of min, max and null count per column
    (nunique == 1 exactly when min == max), so no value table is built.
    """
    def stats(c):
        return [F.min(c).cast("string").alias(f"lo__{c}"), F.max(c).cast("string").alias(f"hi__{c}"),
                F.count_if(F.col(c).isNull()).alias(f"nn__{c}"), F.count(F.lit(1)).alias(f"n__{c}")]
    parts = [ST._long_from_row(df.agg(*[e for c in chunk for e in stats(c)]), chunk, ["lo", "hi", "nn", "n"])
             for chunk in ST._chunks(cols, 25)]
    t = ST._union(parts)
    one_value = (F.col("lo") == F.col("hi"))
    cond = one_value if dropna else ((one_value & (F.col("nn") == 0)) | (F.col("nn") == F.col("n")))
    return t.where(cond).select("feature")


def variance_threshold(df: DataFrame, cols, threshold: float = 0.0) -> DataFrame:
    """scikit-learn ``VarianceThreshold``: keep population variance > t.
    Returns (feature, var_pop, keep)."""
    m = ST.column_moments(df, cols)
    return m.select("feature", "var_pop", (F.col("var_pop") > F.lit(threshold)).alias("keep"))


def quasi_constant(df: DataFrame, cols, threshold: float = 0.998, denominator: str = "non_null",
                   inclusive: bool = False) -> DataFrame:
    """Features whose predominant value share exceeds ``threshold``.

    ``inclusive=True`` is feature-engine's ``DropConstantFeatures(tol)`` rule
    (share >= tol, F5)."""
    sh = ST.predominant_share(df, cols, denominator)
    cond = F.col("share") >= threshold if inclusive else F.col("share") > threshold
    return sh.where(cond)


def drop_constant_features(df: DataFrame, cols, tol: float = 1.0, missing_values: str = "raise") -> DataFrame:
    """feature-engine ``DropConstantFeatures`` (F5): ``features_to_drop_`` as a table."""
    if missing_values == "raise":
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
        bad = [c for c, n in nulls.items() if n]
        if bad:
            raise ValueError(f"missing values in {bad}")
    return quasi_constant(df, cols, tol, "non_null", inclusive=True).select("feature")


# --- duplicated columns ----------------------------------------------------------

def _fingerprint(key: str, c: str, numeric: bool):
    v = F.col(c).cast("double").cast("string") if numeric else F.col(c).cast("string")
    return F.bit_xor(F.xxhash64(F.col(key), F.coalesce(v, F.lit("\u0000null"))))


PAIRS_AT_ONCE = 200


def duplicate_pairs(df: DataFrame, cols, key: str) -> DataFrame:
    """(feature, duplicate_of) for every column equal to an earlier one.

    Pass 1: one aggregate of a per-column fingerprint ``bit_xor(xxhash64(key,
    value))`` (order-free, no overflow).  Columns with equal fingerprints are
    candidates; pass 2 verifies each candidate against the first of its group
    exactly with ``count_if(not (a <=> b)) == 0``.  p^2 column comparisons
    become two scans (one more for every ``PAIRS_AT_ONCE`` candidates).
    """
    cols = list(cols)
    num = {f.name for f in df.schema.fields if f.dataType.typeName() in
           ("byte", "short", "integer", "long", "float", "double", "decimal")}
    fps = df.agg(*[_fingerprint(key, c, c in num).alias(c) for c in cols]).first().asDict()
    groups: dict[tuple, list[str]] = {}
    for c in cols:
        groups.setdefault((fps[c], c in num), []).append(c)
    spark = df.sparkSession
    todo, first_of = [g for g in groups.values() if len(g) > 1], {}
    while todo:
        # Each column is held against the first of its group only; what differs (a hash collision) goes on as a group.
        cand = [(g[0], other) for g in todo for other in g[1:]]
        same = set()
        for chunk in ST._chunks(cand, PAIRS_AT_ONCE):
            check = df.agg(*[F.count_if(~F.col(x).eqNullSafe(F.col(y))) for x, y in chunk]).first()
            same.update(pair for pair, n in zip(chunk, check) if n == 0)
        first_of |= {y: x for x, y in cand if (x, y) in same}
        rest = [[y for y in g[1:] if (g[0], y) not in same] for g in todo]
        todo = [g for g in rest if len(g) > 1]
    rows = sorted(first_of.items(), key=lambda r: cols.index(r[0]))
    return spark.createDataFrame(rows, "feature string, duplicate_of string")


def duplicate_groups(df: DataFrame, cols, key: str) -> DataFrame:
    """{first: [copies]} as (feature, duplicates array)."""
    pairs = duplicate_pairs(df, cols, key)
    return pairs.groupBy(F.col("duplicate_of").alias("feature")).agg(
        F.sort_array(F.collect_list("feature")).alias("duplicates"))


# --- correlated columns -----------------------------------------------------------

def correlated_drops(pairs: DataFrame, threshold: float, rule: str = "later") -> DataFrame:
    """Drop list from a pair table (F9, F10): for each pair i < j with
    abs(r) > t, drop the later column (``rule='later'``) or the earlier one."""
    pick = "feature2" if rule == "later" else "feature1"
    return pairs.where(F.abs("corr") > threshold).select(F.col(pick).alias("feature")).distinct()


def _adjacent(pairs: DataFrame, threshold: float) -> dict[str, set[str]]:
    adj: dict[str, set[str]] = {}
    for r in pairs.where(F.abs("corr") > threshold).select("feature1", "feature2").collect():
        adj.setdefault(r[0], set()).add(r[1])
        adj.setdefault(r[1], set()).add(r[0])
    return adj


def correlated_groups(pairs: DataFrame, order: list[str], threshold: float) -> list[list[str]]:
    """feature-engine grouping: walk features in ``order``; each feature not yet
    grouped starts a group with every later, ungrouped feature correlated
    above the threshold with it (F12, F13, F14)."""
    adj = _adjacent(pairs, threshold)
    seen: set[str] = set()
    groups = []
    for i, f in enumerate(order):
        if f in seen:
            continue
        members = [g for g in order[i + 1:] if g not in seen and g in adj.get(f, ())]
        if members:
            groups.append([f] + members)
            seen.update(members)
        seen.add(f)
    return groups


def correlated_groups_by_strength(pairs: DataFrame, threshold: float) -> list[list[str]]:
    """Groups in order of the strongest pair (F11), over ``threshold <= abs(r) < 1``.

    Both directions of a pair count.  A feature that is in no group yet leads
    one with all its correlates, strongest first; those may be in earlier
    groups as well, so groups can overlap.  ``abs(r)`` is rounded to 12 digits
    first: the last bits depend on the order in which partial sums are added."""
    band = pairs.withColumn("r", S.rnd(F.abs("corr"), 12)).where((F.col("r") >= threshold) & (F.col("r") < 1)).select(
        "feature1", "feature2", "i1", "i2", "r")
    both = band.union(band.select("feature2", "feature1", "i2", "i1", "r"))
    rows = both.orderBy(F.col("r").desc(), "i1", "i2").select("feature1", "feature2").collect()
    grouped: set[str] = set()
    groups = []
    for leader, _ in rows:
        if leader not in grouped:
            members = [b for a, b in rows if a == leader]
            groups.append([leader] + members)
            grouped.update(members + [leader])
    return groups


def smart_order(df: DataFrame, cols, method: str = "variance") -> list[str]:
    """Feature order for ``SmartCorrelatedSelection``: highest variance first,
    highest cardinality first, or fewest missing values first (F13, F14)."""
    if method == "variance":
        t = ST.column_moments(df, cols).select("feature", F.col("var").alias("k"))
        asc = False
    elif method == "cardinality":
        t = ST.frequency_summary(df, cols).select("feature", F.col("n_distinct").alias("k"))
        asc = False
    elif method == "missing_values":
        t = ST.column_moments(df, cols).select("feature", F.col("n_null").alias("k"))
        asc = True
    else:
        raise ValueError(method)
    vals = {r[0]: r[1] for r in t.collect()}
    pos = {c: i for i, c in enumerate(cols)}
    return sorted(cols, key=lambda c: ((vals.get(c) if asc else -(vals.get(c) or 0)), pos[c]))


# --- selector API (fit/transform) ----------------------------------------------------

class Selector:
    """Base: ``fit(df)`` learns ``features_to_drop_``; ``transform`` selects."""

    features_to_drop_: list[str]

    def fit(self, df: DataFrame, cols=None):  # pragma: no cover - interface
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        drop = set(self.features_to_drop_)
        return df.select(*[c for c in df.columns if c not in drop])

    def fit_transform(self, df: DataFrame, cols=None) -> DataFrame:
        return self.fit(df, cols).transform(df)


class DropConstant(Selector):
    def __init__(self, tol: float = 1.0, missing_values: str = "ignore"):
        self.tol, self.missing_values = tol, missing_values

    def fit(self, df, cols=None):
        cols = cols or [c for c in df.columns]
        t = drop_constant_features(df, cols, self.tol, self.missing_values)
        self.features_to_drop_ = [r[0] for r in t.collect()]
        self.features_to_drop_.sort(key=cols.index)
        return self


class DropDuplicates(Selector):
    def __init__(self, key: str):
        self.key = key

    def fit(self, df, cols=None):
        cols = cols or [c for c in df.columns if c != self.key]
        t = duplicate_pairs(df, cols, self.key)
        self.features_to_drop_ = sorted((r[0] for r in t.collect()), key=cols.index)
        return self


class DropCorrelated(Selector):
    """``DropCorrelatedFeatures`` / ``SmartCorrelatedSelection``."""

    def __init__(self, threshold: float = 0.8, selection_method: str | None = None):
        self.threshold, self.selection_method = threshold, selection_method

    def fit(self, df, cols=None):
        from kestrel.operators.cleaning import numeric_columns
        cols = cols or numeric_columns(df)
        pairs = ST.corr_pairs(df, cols)
        order = cols if self.selection_method is None else smart_order(df, cols, self.selection_method)
        self.correlated_feature_sets_ = correlated_groups(pairs, order, self.threshold)
        self.features_to_drop_ = sorted({f for g in self.correlated_feature_sets_ for f in g[1:]}, key=cols.index)
        pairs.unpersist()
        return self


class SelectorChain(Selector):
    """Constant -> duplicated -> correlated, each fitted on the output of the
    previous one (F18)."""

    def __init__(self, steps):
        self.steps = steps

    def fit(self, df, cols=None):
        self.features_to_drop_ = []
        cur = df
        for step in self.steps:
            keep = [c for c in (cols or df.columns) if c in cur.columns]
            step.fit(cur, keep if cols else None)
            self.features_to_drop_ += step.features_to_drop_
            cur = step.transform(cur)
        return self
