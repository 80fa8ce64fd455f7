"""Registered capacity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import capacity as C
from kestrel.plans.registry import query
from kestrel.sources.fixtures import view

# Oracle building blocks (DuckDB SQL) -----------------------------------------

PRE_SQL = """
pre_u AS (
  SELECT key, collectionTimestamp, namespace, deployment, controllerName, controllerKind,
         RND(cpuRequest, 4) AS cpuRequest, RND(cpuLimit, 4) AS cpuLimit, RND(cpuUsage, 4) AS cpuUsage,
         RND(memRequest / 1048576.0, 2) AS memRequest, RND(memLimit / 1048576.0, 2) AS memLimit,
         RND(memUsage / 1048576.0, 2) AS memUsage
  FROM metrics
  WHERE NOT (cpuRequest = 0 AND cpuLimit = 0 AND cpuUsage = 0 AND memRequest = 0 AND memLimit = 0 AND memUsage = 0)
),
processed AS (
  SELECT key, collectionTimestamp AS timestamp, controllerName, cpuRequest, cpuLimit, cpuUsage,
         memRequest, memLimit, memUsage,
         RND(avg(cpuUsage) OVER w, 4) AS avg_cpu_5min,
         RND(avg(memUsage) OVER w, 2) AS avg_mem_5min,
         RND(max(cpuUsage) OVER w, 4) AS max_cpu,
         RND(max(memUsage) OVER w, 2) AS max_mem,
         CAST(hour(collectionTimestamp) AS INTEGER) AS hour,
         CAST(isodow(collectionTimestamp) - 1 AS INTEGER) AS dayofweek,
         isodow(collectionTimestamp) - 1 >= 5 AS is_weekend,
         RND(CASE WHEN cpuLimit = 0 THEN 0.0 ELSE cpuUsage / cpuLimit END, 4) AS cpu_utilization_ratio,
         RND(CASE WHEN memLimit = 0 THEN 0.0 ELSE memUsage / memLimit END, 2) AS mem_utilization_ratio,
         CAST(dense_rank() OVER (ORDER BY deployment) - 1 AS BIGINT) AS cat_deployment,
         CAST(dense_rank() OVER (ORDER BY namespace) - 1 AS BIGINT) AS cat_namespace,
         CAST(dense_rank() OVER (ORDER BY controllerName) - 1 AS BIGINT) AS cat_controllerName,
         CAST(dense_rank() OVER (ORDER BY controllerKind) - 1 AS BIGINT) AS cat_controllerKind
  FROM pre_u
  WINDOW w AS (PARTITION BY controllerName ORDER BY collectionTimestamp, key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
)"""

REC_SQL = PRE_SQL + """,
prd AS (
  SELECT *, coalesce(lag(max_cpu) OVER b, cpuRequest) AS cpuRequest_predicted,
         coalesce(lag(max_mem) OVER b, memRequest) AS memRequest_predicted
  FROM processed WINDOW b AS (PARTITION BY controllerName ORDER BY timestamp, key)
),
rec AS (
  SELECT *, RND(CASE WHEN cpuRequest_predicted < cpuUsage THEN cpuUsage * 1.2 ELSE cpuRequest_predicted * 1.2 END, 4) AS recommended_cpuRequest,
         RND(CASE WHEN memRequest_predicted < memUsage THEN memUsage * 1.2 ELSE memRequest_predicted * 1.2 END, 2) AS recommended_memRequest
  FROM prd
)"""


def processed(spark, sf_dir, keep=()):
    return C.preprocess_metrics(view(spark, sf_dir, "metrics"), keep=keep)


def recommended(spark, sf_dir, keep=()):
    """Rows with a predictor (the rolling max of the samples before) and the request rule applied."""
    df = C.with_earlier_usage(processed(spark, sf_dir, keep)).withColumns({
        "cpuRequest_predicted": F.col("max_cpu_before"), "memRequest_predicted": F.col("max_mem_before")})
    return C.recommend(df)


@query("r06_preprocess", "WITH " + PRE_SQL + "\nSELECT * FROM processed", views=("metrics",))
def r06_preprocess(spark, sf_dir):
    return processed(spark, sf_dir)


@query("r01_request_rule", "WITH " + REC_SQL + """
SELECT key, controllerName, cpuUsage, memUsage, cpuRequest_predicted, memRequest_predicted,
       recommended_cpuRequest, recommended_memRequest FROM rec""", views=("metrics",))
def r01_request_rule(spark, sf_dir):
    return recommended(spark, sf_dir).select(
        "key", "controllerName", "cpuUsage", "memUsage", "cpuRequest_predicted", "memRequest_predicted",
        "recommended_cpuRequest", "recommended_memRequest")


@query("r04_controller_summary", "WITH " + REC_SQL + """
SELECT controllerName, max(cpuRequest) AS cpuRequest, max(cpuLimit) AS cpuLimit, max(cpuUsage) AS cpuUsage,
       max(memRequest) AS memRequest, max(memLimit) AS memLimit, max(memUsage) AS memUsage,
       max(cpuRequest_predicted) AS cpuRequest_predicted, max(memRequest_predicted) AS memRequest_predicted,
       max(recommended_cpuRequest) AS recommended_cpuRequest, max(recommended_memRequest) AS recommended_memRequest,
       'cpu: ' || printf('%.4f', RND(max(recommended_cpuRequest), 4)) || ', mem: ' || printf('%.2f', RND(max(recommended_memRequest), 2)) AS recommended_request
FROM rec GROUP BY controllerName""", views=("metrics",))
def r04_controller_summary(spark, sf_dir):
    return C.controller_summary(recommended(spark, sf_dir))


@query("r03_recommendation_table", "WITH " + REC_SQL + """,
mx AS (SELECT controllerName, max(recommended_cpuRequest) AS max_recommended_cpuRequest,
              max(recommended_memRequest) AS max_recommended_memRequest FROM rec GROUP BY controllerName)
SELECT r.key, r.controllerName, r.cpuRequest, r.cpuLimit, r.cpuUsage, r.memRequest, r.memLimit, r.memUsage,
       r.cpuRequest_predicted, r.memRequest_predicted, r.recommended_cpuRequest, r.recommended_memRequest,
       'cpu: ' || printf('%.4f', m.max_recommended_cpuRequest) || ', mem: ' || printf('%.2f', m.max_recommended_memRequest) AS recommended_request
FROM rec r LEFT JOIN mx m ON r.controllerName = m.controllerName""", views=("metrics",))
def r03_recommendation_table(spark, sf_dir):
    df = C.with_controller_max(recommended(spark, sf_dir))
    return df.select("key", "controllerName", "cpuRequest", "cpuLimit", "cpuUsage", "memRequest", "memLimit",
                     "memUsage", "cpuRequest_predicted", "memRequest_predicted", "recommended_cpuRequest",
                     "recommended_memRequest", "recommended_request")
