"""Stateless capacity projections on a stream.

The reference has no streaming code.  Its per-row steps (all-zero filter,
unit conversion, calendar features, guarded ratios, the request rule) are
stateless, so the same column expressions run unchanged on a Structured
Streaming DataFrame; this module wires them to a file source and a sink.
Rolling windows, category codes and per-controller maxima need the whole
history and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.functions import scalar as S
from kestrel.operators import capacity as C


def stream_metrics(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def per_row_recommendations(df: DataFrame, factor: float = 1.2) -> DataFrame:
    """Stateless part of the recommendation job: works on batch or stream.
    The current usage stands in for the prediction."""
    out = C.utilisation(C.time_features(C.convert_units(C.drop_all_zero(df))))
    return out.select(
        "key", "controllerName", "timestamp", "hour", "dayofweek", "is_weekend", "cpuUsage", "memUsage",
        "cpu_utilization_ratio", "mem_utilization_ratio",
        S.request_rule(F.col("cpuUsage"), "cpuUsage", factor, 4).alias("recommended_cpuRequest"),
        S.request_rule(F.col("memUsage"), "memUsage", factor, 2).alias("recommended_memRequest"),
        S.under_provisioned("cpuUsage", "cpuRequest").alias("cpu_under"))


def start_to_parquet(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append the stream to Parquet with a reliable checkpoint folder
    (exactly-once file sink; restartable after a failure)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
