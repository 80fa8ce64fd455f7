"""Row and column cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from kestrel.functions import scalar as S


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """``select_dtypes(include='number')`` (B3): names of numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def sentinel_to_null(df: DataFrame, sentinel: str = "?", cols=None) -> DataFrame:
    """``replace('?', nan)`` over string columns."""
    cols = cols or string_columns(df)
    return df.withColumns({c: F.when(F.col(c) == sentinel, F.lit(None)).otherwise(F.col(c)) for c in cols})


def zero_to_small(df: DataFrame, cols, value: float = 0.001) -> DataFrame:
    """``replace(0, 0.001)``."""
    return df.withColumns({c: S.zero_to(c, value) for c in cols})


def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    """``dropna(subset)`` / ``dropna()`` (B7); NaN counts as missing like pandas."""
    cols = subset or df.columns
    types = dict(df.dtypes)
    conds = [F.col(c).isNotNull() & (~F.isnan(c) if types[c] in ("double", "float") else F.lit(True)) for c in cols]
    return df.where(reduce(lambda a, b: a & b, conds))


def fill_constant(df: DataFrame, value=0, cols=None) -> DataFrame:
    """``fillna(0)``."""
    return df.na.fill(value, subset=cols)


def fill_mean(df: DataFrame, cols) -> DataFrame:
    """``fillna(mean)`` (B10): one aggregate row, applied as literals."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols})


def fill_median(df: DataFrame, cols) -> DataFrame:
    """``fillna(median)`` (B11): the exact interpolated median, like pandas
    (see :func:`kestrel.operators.stats.quantiles`)."""
    from kestrel.operators.stats import quantiles
    med = {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast(df.schema[c].dataType)) for c in cols})


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """``isnull().sum()`` as a long table (feature, n_null) (B12): one pass."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "n_null")


def positive_rows(df: DataFrame, cols) -> DataFrame:
    """usage > 0 and request > 0 (B15); a plain conjunction pushed to Parquet."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in cols]))


def collapse_members(df: DataFrame, col: str, members, to: str) -> DataFrame:
    """``where(isin(members), to)``."""
    return df.withColumn(col, F.when(F.col(col).isin(list(members)), F.lit(to)).otherwise(F.col(col)))


def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """``Series.map(dict)`` (B20): unmapped values become null."""
    pairs = [x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return df.withColumn(out or col, F.create_map(*pairs)[F.col(col)])
