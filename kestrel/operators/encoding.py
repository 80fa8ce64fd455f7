"""Category codes and lookup maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ordering import IDX, with_global_index


def _distinct_values(df: DataFrame, cols) -> DataFrame:
    """``_kcol, _kint, _knum, _kval``: distinct values as text, with the keys that order numbers as numbers."""
    from functools import reduce
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    whole, real = ("byte", "short", "integer", "long"), ("float", "double", "decimal")

    def one(c):
        at = F.col(c)
        return df.where(at.isNotNull()).select(
            F.lit(c).alias("_kcol"), (at.cast("long") if kinds[c] in whole else F.lit(None).cast("long")).alias("_kint"),
            (at.cast("double") if kinds[c] in real else F.lit(None).cast("double")).alias("_knum"), at.cast("string").alias("_kval"))
    return reduce(lambda a, b: a.unionByName(b), [one(c) for c in cols]).distinct()


def code_tables(df: DataFrame, cols) -> DataFrame:
    """(column, value, code) for several columns in ONE indexed pass.

    The distinct (column, value) pairs are numbered in their order, numbers by
    size and all else as text; a column's codes are that index minus the
    column's first index.
    """
    indexed = with_global_index(_distinct_values(df, cols), ["_kcol", "_kint", "_knum", "_kval"])
    first = indexed.groupBy("_kcol").agg(F.min(IDX).alias("_kfirst"))
    return (indexed.join(F.broadcast(first), "_kcol")
            .select("_kcol", "_kval", (F.col(IDX) - F.col("_kfirst")).cast("long").alias("_kcode")))


SMALL_CODE_TABLE = 100_000


def _small_code_table(df: DataFrame, cols):
    """(column, value, code) built on the driver when the distinct values are
    provably few (at most ``SMALL_CODE_TABLE``; checked with ``limit``)."""
    rows = _distinct_values(df, cols).limit(SMALL_CODE_TABLE + 1).collect()
    if len(rows) > SMALL_CODE_TABLE:
        return None
    by_col: dict[str, list] = {}
    for name, whole, real, text in rows:
        # NaN comes after all numbers, as in Spark.
        by_col.setdefault(name, []).append((whole or 0, real != real, 0.0 if real is None or real != real else real, text))
    out = [(c, v[-1], i) for c, vals in by_col.items() for i, v in enumerate(sorted(vals))]
    return df.sparkSession.createDataFrame(out, "_kcol string, _kval string, _kcode long")


def ordinal_codes(df: DataFrame, cols, prefix: str = "cat_") -> DataFrame:
    """Add ``cat_<col>`` codes for each column (W7), numbers in the order of their
    size and all else in the order of its text.  Nulls get a null code.

    The code table has one row per distinct value; AQE turns each join into a
    broadcast when the runtime size allows it and splits skewed values
    otherwise.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    small = _small_code_table(df, cols)
    codes = small if small is not None else code_tables(df, cols)
    out = df
    for c in cols:
        table = codes.where(F.col("_kcol") == c).select("_kval", F.col("_kcode").alias(f"{prefix}{c}"))
        # The small table has a proven size bound: broadcast it.
        out = out.join(F.broadcast(table) if small is not None else table, F.col(c).cast("string") == F.col("_kval"), "left").drop("_kval")
    return out
