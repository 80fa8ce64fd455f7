"""Grouped aggregates and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import stats as ST


def group_max(df: DataFrame, key, cols) -> DataFrame:
    """``groupby(key).agg(max)`` (G1, G2): partial + final hash aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def daily_mean(df: DataFrame, ts: str, col: str, out: str = "mean") -> DataFrame:
    """Mean by (year, month, day)."""
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day")).agg(
        F.avg(col).alias(out))


def target_mean(df: DataFrame, col: str, target: str) -> DataFrame:
    """``groupby(col)[target].mean()``."""
    return df.groupBy(col).agg(F.avg(target).alias("target_mean"))


def describe(df: DataFrame, cols) -> DataFrame:
    """pandas ``describe()`` in long form (G10): count, mean, std, min,
    25/50/75 % (linear interpolation) and max per column, one pass per chunk."""
    q = ST.quantiles(df, cols, [0.25, 0.5, 0.75])
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        parts.append(df.agg(F.lit(c).alias("feature"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                            F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                            F.array(*[F.lit(v).cast("double") for v in q[c]]).alias("_kq"), F.max(x).alias("max")))
    out = ST._union(parts)
    return out.select("feature", "count", "mean", "std", "min", F.col("_kq")[0].alias("p25"),
                      F.col("_kq")[1].alias("p50"), F.col("_kq")[2].alias("p75"), "max")


def profile(df: DataFrame) -> DataFrame:
    """Shape, dtypes and null counts (G11): (feature, dtype, n_rows, n_null)."""
    spark = df.sparkSession
    types = spark.createDataFrame(list(df.dtypes), "feature string, dtype string")
    wide = df.agg(F.count(F.lit(1)).alias("_krows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = wide.unpivot(["_krows"], df.columns, "feature", "n_null").withColumnRenamed("_krows", "n_rows")
    return types.join(long, "feature")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts behind ``hist(bins=n)`` (G14): equal-width bins over [min, max],
    the last bin closed on the right like numpy."""
    lo, hi = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()   # scalar subqueries
    x = F.col(col)
    width = (hi - lo) / F.lit(bins)
    b = F.least(F.floor(F.try_divide(x - lo, width)), F.lit(bins - 1))
    return (df.where(x.isNotNull())
            .groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")))


def per_feature_mean_std(scores: DataFrame, feature: str = "feature", value: str = "score") -> DataFrame:
    """Mean and std of a per-fold score per feature."""
    return scores.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def share_of_group(df: DataFrame, key: str, col: str, out: str = "share") -> DataFrame:
    """``groupby(key).apply(lambda g: g.assign(share=g[col] / g[col].sum()))``
    without a per-group function (Z2): group sums are a partial aggregate
    (one row per key) joined back, so a key holding a third of the rows is
    never gathered into one task."""
    sums = df.groupBy(key).agg(F.sum(col).alias("_ksum"))
    return df.join(sums, key).withColumn(out, F.try_divide(F.col(col), F.col("_ksum"))).drop("_ksum")
