"""Stand-in views over the driver's Parquet tables.

The reference's own inputs (a wide feature table with a binary target, a
categorical passenger table, pod metrics) are not available, so three views
derived from the TPC-H-like tables stand in for them.  The same SQL text
runs in Spark and in DuckDB, so every query can be replayed by the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# The three stand-in views (identical text in Spark and DuckDB).
METRICS_SQL = """
SELECT event_id AS key,
       'ns' || CAST(user_id % 3 AS STRING) AS namespace,
       'pod-' || CAST(user_id AS STRING) AS pod,
       event_type AS container,
       'dep-' || CAST(user_id % 20 AS STRING) AS deployment,
       'ctl-' || CAST(user_id % 10 AS STRING) AS controllerName,
       CASE WHEN user_id % 3 = 0 THEN 'ReplicaSet' ELSE 'DaemonSet' END AS controllerKind,
       ts AS collectionTimestamp,
       CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE value / 100.0 END AS cpuUsage,
       CAST(CASE WHEN event_id % 97 = 0 OR event_id % 7 = 0 THEN 0.0 ELSE (user_id % 5 + 1) * 0.25 END AS DOUBLE) AS cpuRequest,
       CAST(CASE WHEN event_id % 97 = 0 OR event_id % 7 = 0 THEN 0.0 ELSE (user_id % 5 + 1) * 0.5 END AS DOUBLE) AS cpuLimit,
       CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE value * 1048576.0 END AS memUsage,
       CAST(CASE WHEN event_id % 97 = 0 OR event_id % 11 = 0 THEN 0.0 ELSE (user_id % 8 + 1) * 67108864.0 END AS DOUBLE) AS memRequest,
       CAST(CASE WHEN event_id % 97 = 0 OR event_id % 11 = 0 THEN 0.0 ELSE (user_id % 8 + 1) * 134217728.0 END AS DOUBLE) AS memLimit
FROM events
"""

FEAT_SQL = """
SELECT o.o_orderkey AS id,
       CAST(count(*) AS DOUBLE) AS n_items,
       CAST(sum(l.l_quantity) AS DOUBLE) AS qty,
       CAST(sum(l.l_quantity) AS DOUBLE) AS qty_copy,
       CAST(sum(l.l_quantity) AS DOUBLE) * 2.0 + o.o_orderkey % 5 AS qty_corr,
       -1.0 * CAST(sum(l.l_quantity) AS DOUBLE) + o.o_orderkey % 3 AS qty_neg,
       CAST(max(l.l_discount) AS DOUBLE) AS max_disc,
       CAST(min(l.l_tax) AS DOUBLE) AS min_tax,
       CAST(o.o_orderkey * 7919 % 101 AS DOUBLE) AS noise,
       CAST(1 AS DOUBLE) AS const_one,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(5 AS DOUBLE) END AS const_nulls,
       CAST(CASE WHEN o.o_orderkey % 1000 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS quasi,
       CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE CAST(max(l.l_discount) AS DOUBLE) END AS disc_nulls,
       o.o_orderpriority AS priority,
       o.o_orderstatus AS status,
       o.o_totalprice AS price,
       CASE WHEN sum(l.l_quantity) + o.o_orderkey * 7919 % 41 > 110 THEN 1 ELSE 0 END AS target
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderstatus, o.o_totalprice
"""

PEOPLE_SQL = """
SELECT o.o_orderkey AS id, c.c_mktsegment AS segment, o.o_orderpriority AS priority,
       o.o_orderstatus AS status, CAST(c.c_nationkey AS INT) AS nation,
       CASE WHEN o.o_orderkey % 9 = 0 THEN '?' ELSE c.c_mktsegment || ' ' || c.c_name END AS cabin,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_acctbal END AS balance,
       o.o_totalprice AS fare,
       CASE WHEN o.o_orderkey % 10 < CASE WHEN c.c_mktsegment = 'BUILDING' THEN 7 ELSE 3 END THEN 1 ELSE 0 END AS target
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

VIEWS = {"metrics": METRICS_SQL, "feat": FEAT_SQL, "people": PEOPLE_SQL}

# Numeric feature columns of ``feat`` (the wide table) and its target.
FEAT_NUMERIC = ["n_items", "qty", "qty_copy", "qty_corr", "qty_neg", "max_disc",
                "min_tax", "noise", "const_one", "const_nulls", "quasi",
                "disc_nulls", "price"]
FEAT_DENSE = ["n_items", "qty", "qty_copy", "qty_corr", "qty_neg", "max_disc",
              "min_tax", "noise", "quasi", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stand-in views (``metrics``, ``feat``, ``people``) or a raw table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    register_tables(spark, sf_dir, ("events", "orders", "lineitem", "customer"))
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the stand-in views it uses (oracle side)."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
