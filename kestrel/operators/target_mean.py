"""Target-mean encoding and single-feature ranking.

Everything runs in long form (id, feature, value): one unpivot, one grouped
mean per (feature, value) on the training rows, one join to the test rows and
one AUC per feature.  Hot values are handled by map-side partial aggregation
(means) and by AQE (the join; the mean table has one row per distinct value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators import stats as ST
from kestrel.operators.sampling import random_split


def to_long(df: DataFrame, key: str, cols, target: str | None = None, extra=()) -> DataFrame:
    ids = [key] + ([target] if target else []) + list(extra)
    proj = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return proj.unpivot(ids, list(cols), "feature", "value")


def fit_target_means(train_long: DataFrame, target: str) -> DataFrame:
    """(feature, value, target_mean) from training rows (G4 for many columns)."""
    return train_long.groupBy("feature", "value").agg(F.avg(F.col(target).cast("double")).alias("target_mean"))


def apply_target_means(test_long: DataFrame, means: DataFrame) -> DataFrame:
    """Map categories to their training mean (J3); unseen values give null."""
    return test_long.join(means, ["feature", "value"], "left")


def mean_encoding(train: DataFrame, test: DataFrame, key: str, cols, target: str) -> DataFrame:
    """``mean_encoding(df_train, df_test, vars)`` (H3) in long form:
    (key, feature, value, target_mean) for the test rows."""
    means = fit_target_means(to_long(train, key, cols, target), target)
    return apply_target_means(to_long(test, key, cols), means)


def bin_numeric(train: DataFrame, test: DataFrame, cols, q: int = 10, outside: str = "zero", strategy: str = "equal_frequency"):
    """Equal-frequency or equal-width bins fitted on train (H4) applied to both (H5).

    Train uses ``qcut`` (lowest edge included); test uses ``cut`` on the train
    edges: values outside become null and then 0 with ``outside='zero'`` (the
    reference fills them with 0).
    """
    edges = {"equal_frequency": ST.quantile_edges, "equal_width": ST.width_edges}[strategy](train, cols, q)
    tr = train.withColumns({c: ST.bin_column(c, edges[c], outside="clip") for c in cols})
    te_expr = {}
    for c in cols:
        b = ST.bin_column(c, edges[c], outside="null")
        te_expr[c] = F.coalesce(b, F.lit(0)) if outside == "zero" else b
    return tr, test.withColumns(te_expr), edges


def _value_counts(df: DataFrame, key: str, cols, target: str, part) -> DataFrame:
    """(feature, value, part, pos, neg): label counts of every value, the only pass over the rows."""
    t = F.col(target).cast("double")
    return (to_long(df.withColumn("_kpart", part), key, cols, target, ["_kpart"]).where(F.col(target).isNotNull())
            .groupBy("feature", "value", "_kpart").agg(F.sum(t).alias("pos"), F.sum(1.0 - t).alias("neg")))


def _auc_of_means(counts: DataFrame) -> DataFrame:
    """AUC per feature of the training means (``_kpart`` false) on the test counts (``_kpart`` true)."""
    means = counts.where(~F.col("_kpart")).select("feature", "value", (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("target_mean"))
    test = counts.where(F.col("_kpart")).join(means, ["feature", "value"])
    per = test.groupBy("feature", "target_mean").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return ST.auc_from_counts(per, "feature", "target_mean")


def target_mean_auc(df: DataFrame, key: str, cols, target: str, test_pct: int = 30, seed: int = 0,
                    numeric=(), bins: int = 10) -> DataFrame:
    """KDD-cup ranking (H7): per feature, ROC-AUC on the test split of the
    training target mean of its category (numeric columns binned first)."""
    flagged = random_split(df, key, test_pct, seed, "_ktest")
    if numeric:
        train, test, _ = bin_numeric(flagged.where(~F.col("_ktest")), flagged.where(F.col("_ktest")), list(numeric), bins)
        flagged = train.unionByName(test)
    return _auc_of_means(ST._small(_value_counts(flagged, key, cols, target, F.col("_ktest"))))


def target_mean_performance(df: DataFrame, key: str, cols, target: str, folds: int = 3, seed: int = 0,
                            numeric=(), bins: int = 5, threshold: float | None = None,
                            strategy: str = "equal_frequency") -> DataFrame:
    """``SelectByTargetMeanPerformance`` (H8): cross-validated AUC of the
    target-mean encoding per feature; keep above ``threshold`` (default: the
    mean over features).  Returns (feature, auc_mean, auc_std, keep)."""
    from kestrel.operators.sampling import fold_column
    data = fold_column(df, key, folds, seed, "_kfold")
    parts = []
    for k in range(folds):
        train, test = data.where(F.col("_kfold") != k), data.where(F.col("_kfold") == k)
        if numeric:
            train, test, _ = bin_numeric(train, test, list(numeric), bins, strategy=strategy)
        counts = _value_counts(train.unionByName(test), key, cols, target, F.col("_kfold") == k)
        parts.append(_auc_of_means(ST._small(counts)).withColumn("fold", F.lit(k)))
    per = ST._union(parts).groupBy("feature").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"))
    # The per-feature table has one row per feature: a global window is fine.
    thr = F.lit(threshold) if threshold is not None else F.avg("auc_mean").over(Window.partitionBy())
    return per.withColumn("keep", F.col("auc_mean") > thr)
