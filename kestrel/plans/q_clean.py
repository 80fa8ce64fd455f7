"""Registered queries: scans, sinks, projections, cleaning, scalar functions
(SURVEY 2.1-2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import cleaning as CL
from kestrel.plans.registry import query
from kestrel.sources import files as IO
from kestrel.sources.fixtures import table, view

M = ("metrics",)
P = ("people",)
FT = ("feat",)

PART_COLS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


# --- 2.1 scans and sinks ----------------------------------------------------------

@query("a01_csv_scan", "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice "
       "FROM part")
def a01_csv_scan(spark, d):
    """Write ``part`` as CSV, read it back with header and inferred types
    (small keys infer as int, like pandas' narrowest fitting integer)."""
    path = IO.write_csv(table(spark, d, "part"), IO.scratch_path(spark, "a01"))
    return IO.read_csv(spark, path).select(*[c.strip() for c in PART_COLS.split(",")])


@query("a02_csv_head", f"SELECT {PART_COLS} FROM part ORDER BY p_partkey LIMIT 100")
def a02_csv_head(spark, d):
    path = IO.write_csv(table(spark, d, "part"), IO.scratch_path(spark, "a02"))
    return IO.read_csv(spark, path, schema=table(spark, d, "part").schema, nrows=100, order_by="p_partkey")


@query("a03_csv_usecols", "SELECT c_custkey, c_mktsegment FROM customer")
def a03_csv_usecols(spark, d):
    path = IO.write_csv(table(spark, d, "customer"), IO.scratch_path(spark, "a03"))
    return IO.read_csv(spark, path, schema=table(spark, d, "customer").schema, usecols=["c_custkey", "c_mktsegment"])


@query("a05_jsonl_roundtrip", "SELECT * FROM metrics", views=M)
def a05_jsonl_roundtrip(spark, d):
    """JSON-lines sink then scan with a declared schema."""
    df = view(spark, d, "metrics")
    return IO.roundtrip(df, "jsonl", "a05", schema=df.schema)


@query("a07_csv_sink", "SELECT id, segment, priority, status, nation, cabin, balance, fare, target FROM people",
       views=P)
def a07_csv_sink(spark, d):
    df = view(spark, d, "people")
    return IO.roundtrip(df, "csv", "a07", schema=df.schema)


@query("a08_report_tables", """
SELECT 'full' AS sheet, controllerName, cpuUsage FROM metrics
UNION ALL SELECT 'summary', controllerName, max(cpuUsage) FROM metrics GROUP BY controllerName""", views=M)
def a08_report_tables(spark, d):
    """Several named tables written in one report folder, read back."""
    df = view(spark, d, "metrics")
    tables = {"full": df, "summary": df.groupBy("controllerName").agg(F.max("cpuUsage").alias("cpuUsage"))}
    paths = IO.write_tables(tables, IO.scratch_path(spark, "a08"))
    back = IO.read_tables(spark, paths)
    return back["full"].select(F.lit("full").alias("sheet"), "controllerName", "cpuUsage").unionByName(
        back["summary"].select(F.lit("summary").alias("sheet"), "controllerName", "cpuUsage"))


@query("a09_select_existing", "SELECT key, controllerName, cpuUsage, memUsage FROM metrics", views=M)
def a09_select_existing(spark, d):
    return IO.select_existing(view(spark, d, "metrics"),
                              ["key", "controllerName", "cpuUsage", "cpuRequest_predicted", "memUsage", "no_such"])


# --- 2.2 projections, filters, cleaning ----------------------------------------------

@query("b01_drop_columns", "SELECT id, segment, priority, status, nation, balance, fare FROM people", views=P)
def b01_drop_columns(spark, d):
    return view(spark, d, "people").drop("cabin", "target")


@query("b02_select_columns", "SELECT target, fare, segment FROM people", views=P)
def b02_select_columns(spark, d):
    return view(spark, d, "people").select("target", "fare", "segment")


@query("b03_numeric_columns", "SELECT id, nation, balance, fare, target FROM people", views=P)
def b03_numeric_columns(spark, d):
    df = view(spark, d, "people")
    return df.select(*CL.numeric_columns(df))


@query("b04_rename", """SELECT key, cpuUsage AS current_cpu, memUsage AS current_mem FROM metrics""", views=M)
def b04_rename(spark, d):
    return view(spark, d, "metrics").select("key", "cpuUsage", "memUsage").withColumnsRenamed(
        {"cpuUsage": "current_cpu", "memUsage": "current_mem"})


@query("b05_sentinel_null", "SELECT id, CASE WHEN cabin = '?' THEN NULL ELSE cabin END AS cabin, "
       "CASE WHEN segment = '?' THEN NULL ELSE segment END AS segment FROM people", views=P)
def b05_sentinel_null(spark, d):
    return CL.sentinel_to_null(view(spark, d, "people").select("id", "cabin", "segment"))


@query("b06_zero_to_small", """SELECT key, CASE WHEN cpuRequest = 0 THEN 0.001 ELSE cpuRequest END AS cpuRequest,
       CASE WHEN memRequest = 0 THEN 0.001 ELSE memRequest END AS memRequest FROM metrics""", views=M)
def b06_zero_to_small(spark, d):
    return CL.zero_to_small(view(spark, d, "metrics").select("key", "cpuRequest", "memRequest"),
                            ["cpuRequest", "memRequest"])


@query("b07_dropna", "SELECT * FROM people WHERE balance IS NOT NULL", views=P)
def b07_dropna(spark, d):
    return CL.drop_null_rows(view(spark, d, "people"), ["balance"])


@query("b08_notnull_mask", """SELECT key, CASE WHEN cpuUsage IS NOT NULL AND pct IS NOT NULL THEN cpuUsage * pct END AS scaled
FROM (SELECT key, cpuUsage, CASE WHEN cpuLimit = 0 THEN NULL ELSE cpuUsage / cpuLimit END AS pct FROM metrics)""", views=M)
def b08_notnull_mask(spark, d):
    """Predictions only where every input is present, null elsewhere."""
    df = view(spark, d, "metrics").select("key", "cpuUsage", S.ratio_or_null("cpuUsage", "cpuLimit").alias("pct"))
    return df.select("key", F.when(S.all_not_null(["cpuUsage", "pct"]), F.col("cpuUsage") * F.col("pct")).alias("scaled"))


@query("b09_fillna_zero", "SELECT id, coalesce(balance, 0) AS balance FROM people", views=P)
def b09_fillna_zero(spark, d):
    return CL.fill_constant(view(spark, d, "people").select("id", "balance"), 0.0)


@query("b10_fillna_mean", "SELECT id, RND(coalesce(balance, (SELECT avg(balance) FROM people)), 6) AS balance FROM people",
       views=P)
def b10_fillna_mean(spark, d):
    out = CL.fill_mean(view(spark, d, "people").select("id", "balance"), ["balance"])
    return out.select("id", S.rnd("balance", 6).alias("balance"))


@query("b11_fillna_median", """SELECT id, coalesce(balance, (SELECT CAST(quantile_cont(balance, 0.5) AS DOUBLE) FROM people)) AS balance
FROM people""", views=P)
def b11_fillna_median(spark, d):
    return CL.fill_median(view(spark, d, "people").select("id", "balance"), ["balance"])


@query("b12_null_counts", """SELECT feature, n_null FROM (
 SELECT 'segment' AS feature, count(*) - count(segment) AS n_null FROM people UNION ALL
 SELECT 'cabin', count(*) - count(cabin) FROM people UNION ALL
 SELECT 'balance', count(*) - count(balance) FROM people UNION ALL
 SELECT 'fare', count(*) - count(fare) FROM people)""", views=P)
def b12_null_counts(spark, d):
    return CL.null_counts(view(spark, d, "people"), ["segment", "cabin", "balance", "fare"])


@query("b13_cast", """SELECT id, CAST(nation AS DOUBLE) AS nation_f, CAST(target AS VARCHAR) AS target_s,
 TRY_CAST(substr(priority, 1, 1) AS INTEGER) AS priority_i FROM people""", views=P)
def b13_cast(spark, d):
    """``astype`` casts; ``try_cast`` is ``errors='coerce'`` (bad text -> null)."""
    df = view(spark, d, "people")
    return df.select("id", F.col("nation").cast("double").alias("nation_f"), F.col("target").cast("string").alias("target_s"),
                     F.expr("try_cast(substr(priority, 1, 1) AS INT)").alias("priority_i"))


@query("b14_strip_timezone", "SELECT o_orderkey, o_orderdate AS orderdate FROM orders")
def b14_strip_timezone(spark, d):
    """Zone-aware timestamps back to naive UTC wall time."""
    o = table(spark, d, "orders")
    aware = F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")),
                           "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return o.select("o_orderkey", S.to_naive_utc(aware).alias("orderdate"))


@query("b15_positive_filter", "SELECT key, cpuUsage, cpuRequest, RND(cpuUsage / cpuRequest, 6) AS ratio FROM metrics "
       "WHERE cpuUsage > 0 AND cpuRequest > 0", views=M)
def b15_positive_filter(spark, d):
    df = CL.positive_rows(view(spark, d, "metrics"), ["cpuUsage", "cpuRequest"])
    return df.select("key", "cpuUsage", "cpuRequest", S.rnd(F.col("cpuUsage") / F.col("cpuRequest"), 6).alias("ratio"))


@query("b16_drop_all_zero", """SELECT key FROM metrics WHERE NOT (cpuRequest = 0 AND cpuLimit = 0 AND cpuUsage = 0
 AND memRequest = 0 AND memLimit = 0 AND memUsage = 0)""", views=M)
def b16_drop_all_zero(spark, d):
    from kestrel.operators.capacity import drop_all_zero
    return drop_all_zero(view(spark, d, "metrics")).select("key")


@query("b17_namespace_filter", "SELECT key, pod, namespace FROM metrics WHERE namespace = 'ns1'", views=M)
def b17_namespace_filter(spark, d):
    return view(spark, d, "metrics").where(F.col("namespace") == "ns1").select("key", "pod", "namespace")


@query("b18_collapse_members", """SELECT id, CASE WHEN substr(cabin, 1, 1) IN ('H', 'M') THEN 'N' ELSE substr(cabin, 1, 1) END AS deck
FROM people""", views=P)
def b18_collapse_members(spark, d):
    df = view(spark, d, "people").select("id", S.first_char("cabin").alias("deck"))
    return CL.collapse_members(df, "deck", ["H", "M"], "N")


@query("b19_cap_value", "SELECT id, CASE WHEN nation > 3 THEN 3 ELSE nation END AS nation FROM people", views=P)
def b19_cap_value(spark, d):
    return view(spark, d, "people").select("id", S.cap("nation", 3).alias("nation"))


@query("b20_map_labels", "SELECT id, CASE target WHEN 0 THEN 1 WHEN 1 THEN 0 END AS target FROM people", views=P)
def b20_map_labels(spark, d):
    return CL.map_values(view(spark, d, "people").select("id", "target"), "target", {0: 1, 1: 0})


@query("b21_nonzero_preview", "SELECT qty, qty_copy FROM feat WHERE quasi <> 0", views=FT)
def b21_nonzero_preview(spark, d):
    return view(spark, d, "feat").where(F.col("quasi") != 0).select("qty", "qty_copy")


# --- 2.3 scalar functions ------------------------------------------------------------

@query("c01_first_token", """SELECT id, CASE WHEN cabin IS NULL OR trim(cabin) = '' THEN 'N'
 ELSE split_part(regexp_replace(trim(cabin), '\\s+', ' ', 'g'), ' ', 1) END AS cabin FROM people""", views=P)
def c01_first_token(spark, d):
    return view(spark, d, "people").select("id", S.first_token_or("cabin").alias("cabin"))


@query("c02_first_char", "SELECT id, substr(cabin, 1, 1) AS cabin_letter FROM people", views=P)
def c02_first_char(spark, d):
    return view(spark, d, "people").select("id", S.first_char("cabin").alias("cabin_letter"))


@query("c03_key_concat", "SELECT key, deployment || '_' || controllerName AS dep_ctl FROM metrics", views=M)
def c03_key_concat(spark, d):
    return view(spark, d, "metrics").select("key", S.key_concat("deployment", "controllerName").alias("dep_ctl"))


@query("c04_recommendation_text", """SELECT key, 'cpu: ' || printf('%.4f', RND(cpuUsage * 1.2, 4)) || ', mem: ' ||
 printf('%.2f', RND(memUsage / 1048576.0 * 1.2, 2)) AS recommended_request FROM metrics""", views=M)
def c04_recommendation_text(spark, d):
    df = view(spark, d, "metrics")
    return df.select("key", S.recommendation_text(S.rnd(F.col("cpuUsage") * 1.2, 4),
                                                  S.rnd(S.bytes_to_mib("memUsage", None) * 1.2, 2)).alias("recommended_request"))


@query("c05_calendar", """SELECT key, CAST(hour(collectionTimestamp) AS INTEGER) AS hour,
 CAST(isodow(collectionTimestamp) - 1 AS INTEGER) AS dayofweek, isodow(collectionTimestamp) - 1 >= 5 AS is_weekend
FROM metrics""", views=M)
def c05_calendar(spark, d):
    from kestrel.operators.capacity import time_features
    return time_features(view(spark, d, "metrics")).select("key", "hour", "dayofweek", "is_weekend")


@query("c06_create_features", """SELECT o_orderkey, CAST(hour(o_orderdate) AS INTEGER) AS hour,
 CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dayofweek, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
 CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
 CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear, CAST(day(o_orderdate) AS INTEGER) AS dayofmonth,
 CAST(weekofyear(o_orderdate) AS INTEGER) AS weekofyear FROM orders""")
def c06_create_features(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[c.alias(n) for n, c in S.calendar_features("o_orderdate").items()])


@query("c07_seconds_since_first", """SELECT key, (epoch_us(collectionTimestamp) - (SELECT min(epoch_us(collectionTimestamp)) FROM metrics)) / 1e6 AS seconds
FROM metrics""", views=M)
def c07_seconds_since_first(spark, d):
    df = view(spark, d, "metrics")
    us = S.epoch_micros("collectionTimestamp")
    first = df.agg(F.min(us)).scalar()  # scalar subquery: one value, computed once
    return df.select("key", ((us - first) / 1e6).alias("seconds"))


@query("c08_bytes_to_mb", "SELECT key, RND(memUsage / 1048576.0, 2) AS memUsageMB, RND(memRequest / 1048576.0, 2) AS memRequestMB FROM metrics",
       views=M)
def c08_bytes_to_mb(spark, d):
    df = view(spark, d, "metrics")
    return df.select("key", S.bytes_to_mib("memUsage").alias("memUsageMB"), S.bytes_to_mib("memRequest").alias("memRequestMB"))


@query("c09_unit_sniff", """SELECT key, CASE WHEN (SELECT max(memUsage) FROM metrics) > 1048576.0
 THEN memUsage / 1048576.0 ELSE memUsage END AS memUsageMB FROM metrics""", views=M)
def c09_unit_sniff(spark, d):
    """Convert to MiB only if the column max exceeds 1 MiB."""
    df = view(spark, d, "metrics")
    mx = df.agg(F.max("memUsage")).scalar()
    return df.select("key", F.when(mx > S.MIB, F.col("memUsage") / S.MIB)
                                                 .otherwise(F.col("memUsage")).alias("memUsageMB"))


@query("c10_ratio", "SELECT key, cpuUsage / cpuRequest AS ratio FROM metrics WHERE cpuUsage > 0 AND cpuRequest > 0",
       views=M)
def c10_ratio(spark, d):
    df = CL.positive_rows(view(spark, d, "metrics"), ["cpuUsage", "cpuRequest"])
    return df.select("key", (F.col("cpuUsage") / F.col("cpuRequest")).alias("ratio"))


@query("c11_ratio_or_zero", "SELECT key, RND(CASE WHEN cpuLimit = 0 THEN 0.0 ELSE cpuUsage / cpuLimit END, 4) AS ratio FROM metrics",
       views=M)
def c11_ratio_or_zero(spark, d):
    return view(spark, d, "metrics").select("key", S.ratio_or_zero("cpuUsage", "cpuLimit", 4).alias("ratio"))


@query("c12_ratio_or_null", "SELECT key, CASE WHEN memLimit = 0 THEN NULL ELSE memUsage / memLimit END AS ratio FROM metrics",
       views=M)
def c12_ratio_or_null(spark, d):
    return view(spark, d, "metrics").select("key", S.ratio_or_null("memUsage", "memLimit").alias("ratio"))


@query("c13_log1p_expm1", "SELECT key, RND(ln(1 + memUsage / 1048576.0), 6) AS log_mem, RND(exp(cpuUsage) - 1, 6) AS expm1_cpu FROM metrics",
       views=M)
def c13_log1p_expm1(spark, d):
    df = view(spark, d, "metrics")
    return df.select("key", S.rnd(F.log1p(F.col("memUsage") / S.MIB), 6).alias("log_mem"),
                     S.rnd(F.expm1("cpuUsage"), 6).alias("expm1_cpu"))


@query("c14_least", "SELECT key, least(memRequest, memUsage * 1.2) AS target FROM metrics", views=M)
def c14_least(spark, d):
    return view(spark, d, "metrics").select("key", F.least("memRequest", F.col("memUsage") * 1.2).alias("target"))


@query("c15_percent_reduction", """SELECT key, CASE WHEN cpuRequest = 0 THEN NULL ELSE
 RND((cpuRequest - cpuUsage * 1.2) / cpuRequest * 100.0, 2) END AS reduction_pct FROM metrics""", views=M)
def c15_percent_reduction(spark, d):
    df = view(spark, d, "metrics")
    return df.select("key", S.percent_reduction("cpuRequest", F.col("cpuUsage") * 1.2).alias("reduction_pct"))


@query("c16_suggestion", """SELECT key, CASE WHEN abs(cpuUsage * 1.2 - cpuRequest) <= 1e-6 + 1e-5 * abs(cpuRequest) THEN 'No change'
 WHEN cpuUsage * 1.2 > cpuRequest THEN 'Increase to ' || printf('%.2f', RND(cpuUsage * 1.2, 2))
 ELSE 'Reduce to ' || printf('%.2f', RND(cpuUsage * 1.2, 2)) END AS suggestion FROM metrics""", views=M)
def c16_suggestion(spark, d):
    df = view(spark, d, "metrics")
    return df.select("key", S.suggestion_text("cpuRequest", F.col("cpuUsage") * 1.2).alias("suggestion"))


@query("c17_under_provisioned", "SELECT key, CAST(cpuUsage > cpuRequest * 1.2 AS INTEGER) AS cpu_under, "
       "CAST(memUsage > memRequest * 1.2 AS INTEGER) AS mem_under FROM metrics", views=M)
def c17_under_provisioned(spark, d):
    df = view(spark, d, "metrics")
    return df.select("key", S.under_provisioned("cpuUsage", "cpuRequest").alias("cpu_under"),
                     S.under_provisioned("memUsage", "memRequest").alias("mem_under"))


@query("c18_clip_zero", "SELECT key, greatest(cpuUsage - cpuRequest, 0.0) AS excess FROM metrics", views=M)
def c18_clip_zero(spark, d):
    return view(spark, d, "metrics").select("key", S.clip_lower(F.col("cpuUsage") - F.col("cpuRequest")).alias("excess"))


@query("c19_error_columns", """SELECT key, cpuUsage - cpuRequest AS error, abs(cpuUsage - cpuRequest) AS abs_error
FROM metrics""", views=M)
def c19_error_columns(spark, d):
    df = view(spark, d, "metrics")
    e = F.col("cpuUsage") - F.col("cpuRequest")
    return df.select("key", e.alias("error"), F.abs(e).alias("abs_error"))


@query("c20_round_half_even", """SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_quantity / 8.0, 2) AS q_even,
 RND(l_quantity / 8.0, 2) AS q_up FROM lineitem""")
def c20_round_half_even(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity") / 8.0
    return li.select("l_orderkey", "l_linenumber", "l_quantity", S.round_half_even(q, 2).alias("q_even"),
                     S.rnd(q, 2).alias("q_up"))


JSON_ARRAY_BYTES = 64 * 1024 * 1024


def write_json_arrays(df, path, array_bytes: int = JSON_ARRAY_BYTES):
    """Write all rows of ``df`` as JSON array documents, by Spark (no driver hop).

    A ``multiLine`` scan reads one document from a file, so a task writes one
    array for about every ``array_bytes`` of JSON, each in a file of its own;
    the size of Arrow batches plays no part.
    """
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("j"))

    def to_array(it):
        import pandas as pd
        held, size = [], 0
        for pdf in it:
            for j in pdf["j"]:
                if held and size + len(j) > array_bytes:
                    yield pd.DataFrame({"value": ["[" + ",".join(held) + "]"]})
                    held, size = [], 0
                held.append(j)
                size += len(j) + 1
        if held:
            yield pd.DataFrame({"value": ["[" + ",".join(held) + "]"]})

    lines.mapInPandas(to_array, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


@query("a04_json_array_scan", "SELECT controllerName, max(cpuUsage) AS cpuUsage FROM metrics GROUP BY controllerName",
       views=M)
def a04_json_array_scan(spark, d):
    """Scan of JSON array documents (A4, ``multiLine``) that hold the whole metrics view."""
    df = view(spark, d, "metrics")
    path = write_json_arrays(df, IO.scratch_path(spark, "a04"))
    scanned = IO.read_json(spark, path, schema="controllerName string, cpuUsage double", lines=False)
    return scanned.groupBy("controllerName").agg(F.max("cpuUsage").alias("cpuUsage"))


@query("a06_jsonl_summary_sink", """SELECT controllerName, max(cpuUsage) AS cpuUsage, max(memUsage) AS memUsage,
 count(*) AS n FROM metrics GROUP BY controllerName""", views=M)
def a06_jsonl_summary_sink(spark, d):
    """Per-controller summary written as JSON lines (A6) and read back."""
    df = view(spark, d, "metrics").groupBy("controllerName").agg(
        F.max("cpuUsage").alias("cpuUsage"), F.max("memUsage").alias("memUsage"), F.count(F.lit(1)).alias("n"))
    path = IO.write_json_lines(df, IO.scratch_path(spark, "a06"))
    return IO.read_json(spark, path, schema=df.schema)
