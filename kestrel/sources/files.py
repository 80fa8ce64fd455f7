"""File sources and sinks (CSV, JSON, JSON lines, multi-table reports).

Reads are lazy and let Catalyst prune columns and push filters; writes are
distributed (one file per task).  Scratch output goes under the cluster's
shared checkpoint folder, never a machine-local temporary directory.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kestrel.session import shared_scratch_dir

# Microsecond timestamps survive a JSON round trip (the default keeps millis).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared scratch area."""
    return shared_scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, usecols=None, nrows: int | None = None,
             order_by=None, na_values: str | None = None) -> DataFrame:
    """``read_csv(path, usecols, nrows)`` (A1-A3).

    Without a schema the types are inferred (one extra pass over the file);
    at scale pass ``schema``.  ``nrows`` keeps the first rows of a stable
    order (``order_by``), since a distributed scan has no file order.
    """
    reader = spark.read.option("header", header)
    if na_values is not None:
        reader = reader.option("nullValue", na_values)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if usecols is not None:
        df = df.select(*usecols)
    if nrows is not None:
        if order_by is not None:
            df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
        df = df.limit(nrows)
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None,
              lines: bool = True) -> DataFrame:
    """``read_json(path)`` for a JSON array document (``lines=False``, A4) or
    JSON lines (A5).  Timestamps need a schema (``TimestampNTZType``)."""
    reader = (spark.read.option("multiLine", not lines)
              .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT + "XXX"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """``to_json(orient='records', lines=True)`` (A6): one file per task."""
    (df.write.mode(mode).option("ignoreNullFields", False)
     .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT + "XXX").json(path))
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """``to_csv(index=False)`` (A7) with a header row per part file."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> dict[str, str]:
    """Several named result tables, one folder each (A8, re-aimed Excel sheets)."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(root, name)
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(path)
        out[name] = path
    return out


def read_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return {name: reader.load(p) for name, p in paths.items()}


def select_existing(df: DataFrame, cols) -> DataFrame:
    """Keep only the listed export columns that exist."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def roundtrip(df: DataFrame, fmt: str, name: str, schema=None) -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if fmt == "jsonl":
        write_json_lines(df, path)
        return read_json(spark, path, schema=schema or df.schema, lines=True)
    if fmt == "csv":
        write_csv(df, path)
        return read_csv(spark, path, schema=schema)
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
