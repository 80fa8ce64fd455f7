"""Resource-usage analytics over pod metrics (cleaning, features, requests).

Input: one row per metric sample with ``key`` (unique), string dimensions
(namespace, pod, container, deployment, controllerName, controllerKind),
``collectionTimestamp`` and cpu/mem Request/Limit/Usage (cpu in cores,
memory in bytes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators.encoding import ordinal_codes
from kestrel.operators.ordering import rolling, shifted

METRIC_COLS = ["cpuRequest", "cpuLimit", "cpuUsage", "memRequest", "memLimit", "memUsage"]
CODE_COLS = ["deployment", "namespace", "controllerName", "controllerKind"]
PROCESSED_COLS = [
    "key", "timestamp", "controllerName", "cpuRequest", "cpuLimit", "cpuUsage",
    "memRequest", "memLimit", "memUsage", "avg_cpu_5min", "avg_mem_5min", "max_cpu", "max_mem",
    "hour", "dayofweek", "is_weekend", "cpu_utilization_ratio", "mem_utilization_ratio",
    "cat_deployment", "cat_namespace", "cat_controllerName", "cat_controllerKind",
]


def drop_all_zero(df: DataFrame, cols=METRIC_COLS) -> DataFrame:
    """Drop rows where every metric is zero (B16); pushed to the scan."""
    return df.where(~S.all_zero(cols))


def convert_units(df: DataFrame) -> DataFrame:
    """Memory bytes -> MiB (2 decimals), cpu rounded to 4 decimals."""
    return df.withColumns({
        "memUsage": S.bytes_to_mib("memUsage", 2),
        "memRequest": S.bytes_to_mib("memRequest", 2),
        "memLimit": S.bytes_to_mib("memLimit", 2),
        "cpuRequest": S.rnd(F.col("cpuRequest").cast("double"), 4),
        "cpuLimit": S.rnd(F.col("cpuLimit").cast("double"), 4),
        "cpuUsage": S.rnd(F.col("cpuUsage").cast("double"), 4),
    })


def time_features(df: DataFrame, ts: str = "collectionTimestamp") -> DataFrame:
    """timestamp, hour, dayofweek (Mon=0), is_weekend."""
    return df.withColumns({
        "timestamp": F.col(ts),
        "hour": F.hour(ts),
        "dayofweek": S.day_of_week_mon0(ts),
        "is_weekend": S.is_weekend(ts),
    })


def utilisation(df: DataFrame) -> DataFrame:
    """usage / limit with zero limits mapped to 0 (C11)."""
    return df.withColumns({
        "cpu_utilization_ratio": S.ratio_or_zero("cpuUsage", "cpuLimit", 4),
        "mem_utilization_ratio": S.ratio_or_zero("memUsage", "memLimit", 2),
    })


def rolling_usage(df: DataFrame, partition_by="controllerName",
                  order_by=("collectionTimestamp", "key"), rows: int = 5) -> DataFrame:
    """Mean and max of the last ``rows`` samples, partial at the start.

    ``partition_by=None`` gives the single global series of the reference.
    """
    aggs = {
        "avg_cpu_5min": lambda w: S.rnd(F.avg("cpuUsage").over(w), 4),
        "avg_mem_5min": lambda w: S.rnd(F.avg("memUsage").over(w), 2),
        "max_cpu": lambda w: S.rnd(F.max("cpuUsage").over(w), 4),
        "max_mem": lambda w: S.rnd(F.max("memUsage").over(w), 2),
    }
    return rolling(df, partition_by, list(order_by), rows, aggs)


def with_earlier_usage(df: DataFrame, partition_by="controllerName", order_by=("timestamp", "key")) -> DataFrame:
    """Rolling features of the sample before the current one, as ``<name>_before``.

    Predictors must not hold the value they predict; the first sample of a
    series has no earlier one and takes its current request instead."""
    out = shifted(df, partition_by, list(order_by), ["avg_cpu_5min", "avg_mem_5min", "max_cpu", "max_mem"], 1, "_before")
    return out.withColumns({f"{c}_before": F.coalesce(f"{c}_before", r) for c, r in (
        ("avg_cpu_5min", "cpuRequest"), ("avg_mem_5min", "memRequest"), ("max_cpu", "cpuRequest"), ("max_mem", "memRequest"))})


def preprocess_metrics(df: DataFrame, namespace: str | None = None,
                       partition_by="controllerName", keep=()) -> DataFrame:
    """The metric preprocessing job (R6): filter, units, calendar, ratios,
    category codes, rolling features, projection (and the columns in ``keep``)."""
    if namespace is not None:
        df = df.where(F.col("namespace") == namespace)
    df = drop_all_zero(df)
    df = utilisation(time_features(convert_units(df)))
    df = ordinal_codes(df, CODE_COLS)
    df = rolling_usage(df, partition_by=partition_by)
    return df.select(*PROCESSED_COLS, *keep)


def recommend(df: DataFrame, cpu_pred: str = "cpuRequest_predicted",
              mem_pred: str = "memRequest_predicted", factor: float = 1.2) -> DataFrame:
    """Recommended requests per row (R1): predicted vs. observed usage."""
    return df.withColumns({
        "recommended_cpuRequest": S.request_rule(cpu_pred, "cpuUsage", factor, 4),
        "recommended_memRequest": S.request_rule(mem_pred, "memUsage", factor, 2),
    })


def with_controller_max(df: DataFrame, key: str = "controllerName") -> DataFrame:
    """Per-controller max of the recommendations joined back, plus text.

    Pre-aggregated per controller (partial + final hash aggregate), then joined
    back; the aggregate has one row per controller, and AQE broadcasts it when
    its runtime size is small.
    """
    mx = df.groupBy(key).agg(
        F.max("recommended_cpuRequest").alias("max_recommended_cpuRequest"),
        F.max("recommended_memRequest").alias("max_recommended_memRequest"))
    return (df.join(mx, key, "left")
            .withColumn("recommended_request",
                        S.recommendation_text("max_recommended_cpuRequest", "max_recommended_memRequest")))


SUMMARY_COLS = ["cpuRequest", "cpuLimit", "cpuUsage", "memRequest", "memLimit", "memUsage",
                "cpuRequest_predicted", "memRequest_predicted",
                "recommended_cpuRequest", "recommended_memRequest"]


def controller_summary(df: DataFrame, key: str = "controllerName", cols=SUMMARY_COLS,
                       with_text: bool = True) -> DataFrame:
    """One row per controller with the max of each column."""
    out = df.groupBy(key).agg(*[F.max(c).alias(c) for c in cols])
    if with_text:
        out = out.withColumn("recommended_request",
                             S.recommendation_text(S.rnd("recommended_cpuRequest", 4),
                                                   S.rnd("recommended_memRequest", 2)))
    return out


def first_per_key(df: DataFrame, key: str, order_by) -> DataFrame:
    """``drop_duplicates(key)`` after a sort: first row per key.

    ``min_by`` over a struct plans as a sort aggregate, with partial
    aggregation before the shuffle, so a hot key sends one row per task.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    payload = [c for c in df.columns if c != key]
    agg = F.min_by(F.struct(*payload), F.struct(*order)).alias("_kfirst")
    return df.groupBy(key).agg(agg).select(key, "_kfirst.*")


def last_per_key(df: DataFrame, key, order_by) -> DataFrame:
    """Last row per key by time (W5): ``max_by`` with a struct tie-break."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    payload = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_klast")).select(*keys, "_klast.*")


def savings_curve(df: DataFrame, savings: str, tie: str, out: str = "cumulative_savings") -> DataFrame:
    """Cumulative savings, largest first (W4), distributed."""
    from kestrel.operators.ordering import running_sum
    return running_sum(df, [F.col(savings).desc(), F.col(tie)], savings, out)


def change_counts(df: DataFrame, current: str, recommended: str) -> DataFrame:
    """Counts of rows increased / decreased / unchanged."""
    c, r = F.col(current), F.col(recommended)
    return df.agg(F.count_if(r > c).alias("n_increase"),
                  F.count_if(r < c).alias("n_decrease"),
                  F.count_if(r == c).alias("n_unchanged"))
