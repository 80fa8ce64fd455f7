"""Repeatable splits, folds, samples and permutations.

Randomness comes from ``md5`` of a key and a seed, never from partition
layout, so every split is identical on any cluster size, on retry, and in
DuckDB (``('0x' || substr(md5(k), 1, 8))::BIGINT``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ordering import IDX, with_global_index


def hash_bucket(key, seed: int = 0, buckets: int = 100) -> Column:
    """Stable bucket in [0, buckets) from md5(key || ':' || seed)."""
    k = F.concat(F.col(key).cast("string"), F.lit(f":{seed}")) if seed else F.col(key).cast("string")
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def random_split(df: DataFrame, key: str, test_pct: int = 30, seed: int = 0,
                 flag: str = "is_test") -> DataFrame:
    """``train_test_split`` (P1): flag rows whose hash bucket < test_pct."""
    return df.withColumn(flag, hash_bucket(key, seed) < F.lit(test_pct))


def split_frames(df: DataFrame, key: str, test_pct: int = 30, seed: int = 0):
    flagged = random_split(df, key, test_pct, seed, "_ktest")
    return (flagged.where(~F.col("_ktest")).drop("_ktest"), flagged.where(F.col("_ktest")).drop("_ktest"))


def fold_column(df: DataFrame, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """k-fold assignment (P3), usable as ``CrossValidator(foldCol=...)``."""
    return df.withColumn(out, (hash_bucket(key, seed, 1 << 30) % F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int | None = None, out: str = "fold") -> DataFrame:
    """``StratifiedKFold`` (P3): folds whose sizes differ by at most one row within every class.

    Rows get their rank inside their class (in key order, or shuffled by md5 of
    key and seed) from one distributed index over (class, order): a class is the
    stretch of the index between its first and last row, however large it is.
    The fold is the rank's share of the class.  ``key`` must be unique; rows
    without a label are a class of their own.
    """
    order = [F.col(key)] if seed is None else [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]
    indexed = with_global_index(df, [F.col(label), *order])
    classes = indexed.groupBy(F.col(label).alias("_kclass")).agg(F.min(IDX).alias("_kfirst"), F.count(F.lit(1)).alias("_kn"))
    return (indexed.join(classes, F.col(label).eqNullSafe(F.col("_kclass")))
            .withColumn(out, F.expr(f"CAST(({IDX} - _kfirst) * {int(k)} DIV _kn AS INT)")).drop(IDX, "_kclass", "_kfirst", "_kn"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``sample(n, random_state)`` (T6): the n rows with the smallest md5 rank.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its top n, only n rows per task reach the final merge.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_kh", h).orderBy("_kh", key).limit(n).drop("_kh")


def permute_columns(df: DataFrame, key: str, cols, seed: int = 0) -> DataFrame:
    """``df`` with ``c__perm`` for each column: all columns follow one shuffled
    row order, so one pair of indexes and one join serve any number of them."""
    cols = list(cols)
    base = with_global_index(df, [key])
    donor = with_global_index(
        df.select(key, *cols).withColumn("_kh", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))),
        ["_kh", key]).select(F.col(IDX), *[F.col(c).alias(f"{c}__perm") for c in cols])
    return base.join(donor, IDX).drop(IDX)


def permute_column(df: DataFrame, key: str, col: str, seed: int = 0, out: str | None = None) -> DataFrame:
    """``sample(frac=1)`` of one column realigned to the key order.

    Row i in key order receives the value of row i in md5(key, seed) order:
    both orders get a distributed global index and are joined on it.
    """
    out = out or col
    base = with_global_index(df, [key])
    donor = with_global_index(
        df.select(key, col).withColumn("_kh", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))),
        ["_kh", key]).select(F.col(IDX), F.col(col).alias("_kperm"))
    joined = base.join(donor, IDX)
    if out == col:
        joined = joined.drop(col).withColumnRenamed("_kperm", col)
    else:
        joined = joined.withColumnRenamed("_kperm", out)
    return joined.drop(IDX)
