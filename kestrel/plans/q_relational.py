"""Registered queries: joins, aggregates, windows, sorts, set operations,
splits (SURVEY 2.4-2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import aggregates as AG
from kestrel.operators import capacity as C
from kestrel.operators import ordering as O
from kestrel.operators import reshape as RS
from kestrel.operators import sampling as SP
from kestrel.operators import stats as ST
from kestrel.operators.encoding import ordinal_codes
from kestrel.plans.registry import query
from kestrel.sources.fixtures import table, view

M, P, FT = ("metrics",), ("people",), ("feat",)
SPLIT = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 100"


# --- 2.4 joins ----------------------------------------------------------------------

@query("j01_controller_max_join", """SELECT m.key, m.controllerName, m.cpuUsage, x.max_cpuUsage
FROM metrics m LEFT JOIN (SELECT controllerName, max(cpuUsage) AS max_cpuUsage FROM metrics GROUP BY controllerName) x
ON m.controllerName = x.controllerName""", views=M)
def j01_controller_max_join(spark, d):
    df = view(spark, d, "metrics").select("key", "controllerName", "cpuUsage")
    mx = AG.group_max(df, "controllerName", ["cpuUsage"]).withColumnRenamed("cpuUsage", "max_cpuUsage")
    return df.join(mx, "controllerName", "left")


@query("j02_full_outer_time", """WITH tr AS (SELECT ts, value AS value_train FROM events WHERE ts < TIMESTAMP '2024-01-21'),
te AS (SELECT ts, value AS value_test FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT coalesce(te.ts, tr.ts) AS ts, tr.value_train, te.value_test FROM te FULL OUTER JOIN tr ON te.ts = tr.ts""")
def j02_full_outer_time(spark, d):
    ev = table(spark, d, "events")
    tr = ev.where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")).select("ts", F.col("value").alias("value_train"))
    te = ev.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("ts", F.col("value").alias("value_test"))
    return te.join(tr, "ts", "full_outer")


@query("j03_lookup_map", f"""WITH tr AS (SELECT * FROM people WHERE {SPLIT.format(k='id')} >= 30),
te AS (SELECT * FROM people WHERE {SPLIT.format(k='id')} < 30),
mp AS (SELECT segment, avg(target) AS target_mean FROM tr GROUP BY segment)
SELECT te.id, te.segment, mp.target_mean FROM te LEFT JOIN mp ON te.segment = mp.segment""", views=P)
def j03_lookup_map(spark, d):
    tr, te = SP.split_frames(view(spark, d, "people"), "id", 30)
    mp = AG.target_mean(tr, "segment", "target")
    return te.select("id", "segment").join(mp, "segment", "left")


@query("j04_align_scores", """WITH a AS (SELECT 'qty' AS feature, RND(corr(qty, target), 6) AS corr_target FROM feat
  UNION ALL SELECT 'noise', RND(corr(noise, target), 6) FROM feat UNION ALL SELECT 'price', RND(corr(price, target), 6) FROM feat),
b AS (SELECT 'qty' AS feature, RND(var_samp(qty), 6) AS variance FROM feat UNION ALL SELECT 'noise', RND(var_samp(noise), 6) FROM feat
  UNION ALL SELECT 'max_disc', RND(var_samp(max_disc), 6) FROM feat)
SELECT coalesce(a.feature, b.feature) AS feature, a.corr_target, b.variance FROM a FULL OUTER JOIN b ON a.feature = b.feature""",
       views=FT)
def j04_align_scores(spark, d):
    df = view(spark, d, "feat")
    a = ST.corr_with(df, ["qty", "noise", "price"], "target").select("feature", S.rnd("corr", 6).alias("score"))
    b = ST.column_moments(df, ["qty", "noise", "max_disc"]).select("feature", S.rnd("var", 6).alias("score"))
    return RS.align_by_feature({"corr_target": a, "variance": b})


# --- 2.5 aggregations ----------------------------------------------------------------

@query("g01_group_max2", "SELECT controllerName, max(cpuUsage) AS cpuUsage, max(memUsage) AS memUsage FROM metrics GROUP BY controllerName",
       views=M)
def g01_group_max2(spark, d):
    return AG.group_max(view(spark, d, "metrics"), "controllerName", ["cpuUsage", "memUsage"])


@query("g03_daily_mean", """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
 CAST(day(ts) AS INTEGER) AS day, RND(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3""")
def g03_daily_mean(spark, d):
    out = AG.daily_mean(table(spark, d, "events"), "ts", "value")
    return out.withColumn("mean", S.rnd("mean", 6))


@query("g04_target_mean", "SELECT priority, RND(avg(target), 6) AS target_mean FROM people GROUP BY priority", views=P)
def g04_target_mean(spark, d):
    return AG.target_mean(view(spark, d, "people"), "priority", "target").withColumn("target_mean", S.rnd("target_mean", 6))


FEAT_FREQ = ["const_one", "const_nulls", "quasi", "n_items", "status", "priority"]


def _freq_sql(cols, body):
    return " UNION ALL ".join(body.format(c=c) for c in cols)


@query("g05_nunique", "SELECT feature, n_distinct FROM (" + _freq_sql(
    FEAT_FREQ, "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM feat") + ")", views=FT)
def g05_nunique(spark, d):
    return ST.frequency_summary(view(spark, d, "feat"), FEAT_FREQ).select("feature", "n_distinct")


@query("g06_distinct_values", "SELECT DISTINCT controllerName FROM metrics", views=M)
def g06_distinct_values(spark, d):
    return view(spark, d, "metrics").select("controllerName").distinct()


@query("g07_value_counts", """SELECT priority AS value, count(*) AS count, RND(count(*) / sum(count(*)) OVER (), 6) AS share
FROM people GROUP BY priority""", views=P)
def g07_value_counts(spark, d):
    vc = ST.value_counts(view(spark, d, "people"), ["priority"])
    tot = vc.agg(F.sum("count")).scalar()
    return vc.select("value", "count", S.rnd(F.col("count") / tot, 6).alias("share"))


@query("g08_predominant_share", "SELECT feature, RND(share, 6) AS share FROM (" + _freq_sql(
    FEAT_FREQ, "SELECT '{c}' AS feature, (SELECT max(n) FROM (SELECT count(*) AS n FROM feat WHERE {c} IS NOT NULL GROUP BY {c})) "
               "/ count({c}) AS share FROM feat") + ")", views=FT)
def g08_predominant_share(spark, d):
    return ST.predominant_share(view(spark, d, "feat"), FEAT_FREQ).withColumn("share", S.rnd("share", 6))


@query("g09_crosstab", "SELECT CAST(target AS VARCHAR) AS target, segment, count(*) AS count FROM people GROUP BY target, segment",
       views=P)
def g09_crosstab(spark, d):
    ct = ST.contingency(view(spark, d, "people"), ["segment"], "target")
    return ct.select(F.col("label").cast("string").alias("target"), F.col("value").alias("segment"), "count")


DESC_COLS = ["qty", "price", "disc_nulls"]


@query("g10_describe", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, RND(avg({c}), 6) AS mean, RND(stddev_samp({c}), 6) AS std,
 min({c}) AS min, RND(quantile_cont({c}, 0.25), 6) AS p25, RND(quantile_cont({c}, 0.5), 6) AS p50,
 RND(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM feat""" for c in DESC_COLS) + ")", views=FT)
def g10_describe(spark, d):
    out = AG.describe(view(spark, d, "feat"), DESC_COLS)
    return out.select("feature", "count", *[S.rnd(c, 6).alias(c) for c in ("mean", "std")], "min",
                      *[S.rnd(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("g11_profile", """SELECT feature, dtype, n_rows, n_null FROM (VALUES
 ('id', 'bigint'), ('segment', 'string'), ('priority', 'string'), ('status', 'string'), ('nation', 'int'),
 ('cabin', 'string'), ('balance', 'double'), ('fare', 'double'), ('target', 'int')) t(feature, dtype)
JOIN (SELECT 'id' AS f, count(*) - count(id) AS n_null FROM people UNION ALL SELECT 'segment', count(*) - count(segment) FROM people
 UNION ALL SELECT 'priority', count(*) - count(priority) FROM people UNION ALL SELECT 'status', count(*) - count(status) FROM people
 UNION ALL SELECT 'nation', count(*) - count(nation) FROM people UNION ALL SELECT 'cabin', count(*) - count(cabin) FROM people
 UNION ALL SELECT 'balance', count(*) - count(balance) FROM people UNION ALL SELECT 'fare', count(*) - count(fare) FROM people
 UNION ALL SELECT 'target', count(*) - count(target) FROM people) n ON t.feature = n.f
CROSS JOIN (SELECT count(*) AS n_rows FROM people) r""", views=P)
def g11_profile(spark, d):
    return AG.profile(view(spark, d, "people"))


@query("g12_std_var", """SELECT 'qty' AS feature, RND(stddev_samp(qty), 6) AS std, RND(var_samp(qty), 3) AS var,
 RND(var_pop(qty), 3) AS var_pop FROM feat UNION ALL
SELECT 'price', RND(stddev_samp(price), 6), RND(var_samp(price), 3), RND(var_pop(price), 3) FROM feat""", views=FT)
def g12_std_var(spark, d):
    """Sample std and variance, population variance; variances of prices are
    around 1e10, so they are compared at 3 decimals (about 13 digits)."""
    m = ST.column_moments(view(spark, d, "feat"), ["qty", "price"])
    return m.select("feature", S.rnd("std", 6).alias("std"), S.rnd("var", 3).alias("var"), S.rnd("var_pop", 3).alias("var_pop"))


@query("g13_change_counts", """SELECT count(*) FILTER (WHERE cpuUsage * 1.2 > cpuRequest) AS n_increase,
 count(*) FILTER (WHERE cpuUsage * 1.2 < cpuRequest) AS n_decrease,
 count(*) FILTER (WHERE cpuUsage * 1.2 = cpuRequest) AS n_unchanged FROM metrics""", views=M)
def g13_change_counts(spark, d):
    df = view(spark, d, "metrics").withColumn("rec", F.col("cpuUsage") * 1.2)
    return C.change_counts(df, "cpuRequest", "rec")


@query("g14_histogram", """WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(coalesce(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9), 0) AS INTEGER) AS bin, count(*) AS count
FROM lineitem, mm WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def g14_histogram(spark, d):
    return AG.histogram(table(spark, d, "lineitem"), "l_extendedprice", 10)


CORR_COLS = ["n_items", "qty", "qty_corr", "qty_neg", "max_disc", "noise", "price", "disc_nulls"]


def _pairs_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, RND(corr({a}, {b}), 6) AS corr FROM feat"
        for i, a in enumerate(cols) for b in cols[i + 1:])


@query("g15_corr_matrix", "SELECT * FROM (" + _pairs_sql(CORR_COLS) + ")", views=FT)
def g15_corr_matrix(spark, d):
    pairs = ST.corr_pairs(view(spark, d, "feat"), CORR_COLS)
    return pairs.select("feature1", "feature2", S.rnd("corr", 6).alias("corr"))


@query("g16_fold_mean_std", f"""WITH f AS (SELECT {SPLIT.format(k='id')} % 5 AS fold, * FROM feat),
s AS (SELECT fold, 'qty' AS feature, avg(qty) AS score FROM f GROUP BY fold
      UNION ALL SELECT fold, 'price', avg(price) FROM f GROUP BY fold)
SELECT feature, RND(avg(score), 6) AS mean, RND(stddev_samp(score), 6) AS std FROM s GROUP BY feature""", views=FT)
def g16_fold_mean_std(spark, d):
    df = view(spark, d, "feat").withColumn("fold", SP.hash_bucket("id") % 5)
    s = df.groupBy("fold").agg(F.avg("qty").alias("qty"), F.avg("price").alias("price"))
    long = s.unpivot(["fold"], ["qty", "price"], "feature", "score")
    return AG.per_feature_mean_std(long).select("feature", S.rnd("mean", 6).alias("mean"), S.rnd("std", 6).alias("std"))


# --- 2.6 windows ---------------------------------------------------------------------

W5 = "PARTITION BY controllerName ORDER BY collectionTimestamp, key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"


@query("w01_rolling_mean", f"SELECT key, RND(avg(cpuUsage) OVER ({W5}), 6) AS avg_cpu_5 FROM metrics", views=M)
def w01_rolling_mean(spark, d):
    df = view(spark, d, "metrics").select("key", "controllerName", "collectionTimestamp", "cpuUsage")
    out = O.rolling(df, "controllerName", ["collectionTimestamp", "key"], 5,
                    {"avg_cpu_5": lambda w: S.rnd(F.avg("cpuUsage").over(w), 6)})
    return out.select("key", "avg_cpu_5")


@query("w01b_rolling_mean_global", """SELECT key, RND(avg(cpuUsage) OVER (ORDER BY collectionTimestamp, key
 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS avg_cpu_5 FROM metrics""", views=M)
def w01b_rolling_mean_global(spark, d):
    """The reference's form: one series over all controllers in time order,
    computed in bounded blocks (no single-task window)."""
    df = view(spark, d, "metrics").select("key", "collectionTimestamp", "cpuUsage")
    out = O.rolling(df, None, ["collectionTimestamp", "key"], 5,
                    {"avg_cpu_5": lambda w: S.rnd(F.avg("cpuUsage").over(w), 6)}, block_rows=997)
    return out.select("key", "avg_cpu_5")


@query("w02_rolling_max", f"SELECT key, max(memUsage) OVER ({W5}) AS max_mem_5 FROM metrics", views=M)
def w02_rolling_max(spark, d):
    df = view(spark, d, "metrics").select("key", "controllerName", "collectionTimestamp", "memUsage")
    out = O.rolling(df, "controllerName", ["collectionTimestamp", "key"], 5, {"max_mem_5": F.max("memUsage")},
                    block_rows=1009)
    return out.select("key", "max_mem_5")


@query("w03_lag", """SELECT key, lag(cpuUsage, 1) OVER (ORDER BY collectionTimestamp, key) AS cpuUsage_lag1,
 lag(memUsage, 1) OVER (ORDER BY collectionTimestamp, key) AS memUsage_lag1 FROM metrics""", views=M)
def w03_lag(spark, d):
    df = view(spark, d, "metrics").select("key", "collectionTimestamp", "cpuUsage", "memUsage")
    out = O.shifted(df, None, ["collectionTimestamp", "key"], ["cpuUsage", "memUsage"], block_rows=1013)
    return out.select("key", "cpuUsage_lag1", "memUsage_lag1")


@query("w04_cumulative_savings", """SELECT key, RND(savings, 6) AS savings, RND(sum(savings) OVER (ORDER BY savings DESC, key
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cumulative_savings
FROM (SELECT key, cpuRequest - cpuUsage * 1.2 AS savings FROM metrics)""", views=M)
def w04_cumulative_savings(spark, d):
    df = view(spark, d, "metrics").select("key", (F.col("cpuRequest") - F.col("cpuUsage") * 1.2).alias("savings"))
    out = C.savings_curve(df, "savings", "key")
    return out.select("key", S.rnd("savings", 6).alias("savings"), S.rnd("cumulative_savings", 4).alias("cumulative_savings"))


@query("w05_last_per_key", """SELECT deployment, collectionTimestamp, key, cpuUsage FROM (SELECT deployment, collectionTimestamp, key, cpuUsage,
 row_number() OVER (PARTITION BY deployment ORDER BY collectionTimestamp DESC, key DESC) AS rn FROM metrics) WHERE rn = 1""",
       views=M)
def w05_last_per_key(spark, d):
    df = view(spark, d, "metrics").select("deployment", "collectionTimestamp", "key", "cpuUsage")
    return C.last_per_key(df, "deployment", ["collectionTimestamp", "key"])


@query("w06_last_step", """SELECT deployment, CAST(coalesce(epoch_us(last_ts) - epoch_us(prev_ts), 86400000000) AS BIGINT) AS step_us
FROM (SELECT deployment, max(collectionTimestamp) AS last_ts,
 max(collectionTimestamp) FILTER (WHERE rn = 2) AS prev_ts FROM (SELECT deployment, collectionTimestamp,
 row_number() OVER (PARTITION BY deployment ORDER BY collectionTimestamp DESC, key DESC) AS rn FROM metrics) GROUP BY deployment)""",
       views=M)
def w06_last_step(spark, d):
    """Step between the last two timestamps per key; one day if only one.

    ``max_by`` over the two latest entries, computed as a plain aggregate:
    the top-2 per key come from ``max`` and ``max`` below it.
    """
    df = view(spark, d, "metrics").select("deployment", "collectionTimestamp", "key")
    us = S.epoch_micros("collectionTimestamp")
    last = df.groupBy("deployment").agg(F.max_by(F.struct(us.alias("u"), F.col("key")),
                                                 F.struct(us, F.col("key"))).alias("l"))
    prev = (df.join(last, "deployment")
            .where(F.struct(us, F.col("key")) < F.struct(F.col("l.u"), F.col("l.key")))
            .groupBy("deployment").agg(F.max(us).alias("p")))
    return (last.join(prev, "deployment", "left")
            .select("deployment", F.coalesce(F.col("l.u") - F.col("p"), F.lit(86400000000)).cast("long").alias("step_us")))


@query("w07_label_codes", """SELECT key, CAST(dense_rank() OVER (ORDER BY deployment) - 1 AS BIGINT) AS cat_deployment,
 CAST(dense_rank() OVER (ORDER BY controllerKind) - 1 AS BIGINT) AS cat_controllerKind FROM metrics""", views=M)
def w07_label_codes(spark, d):
    df = view(spark, d, "metrics").select("key", "deployment", "controllerKind")
    return ordinal_codes(df, ["deployment", "controllerKind"]).select("key", "cat_deployment", "cat_controllerKind")


@query("w08_first_per_controller", """SELECT controllerName, key, cpuUsage FROM (SELECT controllerName, key, cpuUsage,
 row_number() OVER (PARTITION BY controllerName ORDER BY cpuUsage DESC, key) AS rn FROM metrics) WHERE rn = 1""", views=M)
def w08_first_per_controller(spark, d):
    df = view(spark, d, "metrics").select("controllerName", "key", "cpuUsage").withColumn("_kneg", -F.col("cpuUsage"))
    return C.first_per_key(df, "controllerName", ["_kneg", "key"]).drop("_kneg")


# --- 2.7 sorts, top-k, sampling ------------------------------------------------------------

@query("t01_sort", "SELECT controllerName, key, cpuUsage FROM metrics ORDER BY controllerName, key", views=M)
def t01_sort(spark, d):
    return view(spark, d, "metrics").select("controllerName", "key", "cpuUsage").orderBy("controllerName", "key")


@query("t02_top_k", "SELECT key, cpuUsage FROM metrics ORDER BY cpuUsage DESC, key LIMIT 10", views=M)
def t02_top_k(spark, d):
    return RS.top_k(view(spark, d, "metrics").select("key", "cpuUsage"), "cpuUsage", 10, tie="key")


@query("t06_seeded_sample", "SELECT key, cpuUsage FROM metrics ORDER BY md5(CAST(key AS VARCHAR) || ':42'), key LIMIT 50",
       views=M)
def t06_seeded_sample(spark, d):
    return SP.seeded_sample(view(spark, d, "metrics").select("key", "cpuUsage"), "key", 50, seed=42)


@query("t07_last_n", """SELECT key, cpuUsage FROM (SELECT key, cpuUsage, row_number() OVER (ORDER BY collectionTimestamp DESC, key DESC) AS rn
FROM metrics) WHERE rn <= 500""", views=M)
def t07_last_n(spark, d):
    df = view(spark, d, "metrics").select("key", "cpuUsage", "collectionTimestamp")
    # Each task keeps its last 500 rows; no global sort of the table.
    return df.orderBy(F.col("collectionTimestamp").desc(), F.col("key").desc()).limit(500).select("key", "cpuUsage")


# --- 2.8 set operations and reshaping ----------------------------------------------------

@query("u01_union", f"""SELECT 'train' AS part, key, cpuUsage, NULL AS prediction FROM metrics WHERE NOT ({SPLIT.format(k='key')} < 20)
UNION ALL SELECT 'test', key, cpuUsage, cpuUsage * 1.2 FROM metrics WHERE {SPLIT.format(k='key')} < 20""", views=M)
def u01_union(spark, d):
    """``pd.concat(ignore_index=True)`` of a train part and a scored test
    part (U1); columns missing on one side become null."""
    tr, te = SP.split_frames(view(spark, d, "metrics"), "key", 20)
    a = tr.select(F.lit("train").alias("part"), "key", "cpuUsage")
    b = te.select(F.lit("test").alias("part"), "key", "cpuUsage", (F.col("cpuUsage") * 1.2).alias("prediction"))
    return RS.union_all([a, b])


@query("u02_distinct_rows", "SELECT DISTINCT deployment, controllerName, controllerKind FROM metrics", views=M)
def u02_distinct_rows(spark, d):
    return view(spark, d, "metrics").select("deployment", "controllerName", "controllerKind").distinct()


@query("u03_distinct_subset_first", """SELECT deployment, container, key, cpuUsage FROM (SELECT deployment, container, key, cpuUsage,
 row_number() OVER (PARTITION BY deployment, container ORDER BY key) AS rn FROM metrics) WHERE rn = 1""", views=M)
def u03_distinct_subset_first(spark, d):
    df = view(spark, d, "metrics").select("deployment", "container", "key", "cpuUsage")
    return C.first_per_key(df.withColumn("_kk", F.struct("deployment", "container")).drop("deployment", "container"),
                           "_kk", ["key"]).select("_kk.deployment", "_kk.container", "key", "cpuUsage")


@query("u04_melt", """SELECT key, variable, value FROM (SELECT key, 'cpuUsage' AS variable, cpuUsage AS value FROM metrics
 UNION ALL SELECT key, 'cpuRequest', cpuRequest FROM metrics)""", views=M)
def u04_melt(spark, d):
    return RS.melt(view(spark, d, "metrics").select("key", "cpuUsage", "cpuRequest"), ["key"], ["cpuUsage", "cpuRequest"])


@query("u05_corr_pairs_band", "SELECT * FROM (" + _pairs_sql(CORR_COLS) + ") WHERE abs(corr) >= 0.8 AND abs(corr) < 1",
       views=FT)
def u05_corr_pairs_band(spark, d):
    pairs = ST.corr_pairs(view(spark, d, "feat"), CORR_COLS).select("feature1", "feature2", S.rnd("corr", 6).alias("corr"))
    return pairs.where((F.abs("corr") >= 0.8) & (F.abs("corr") < 1))


U06_COLS = ["n_items", "qty", "qty_copy", "noise", "price"]


@query("u06_not_in", "WITH m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, price) AS with_price, corr({c}, qty) AS with_qty FROM feat" for c in U06_COLS) + """)
SELECT feature FROM m WHERE abs(with_price) >= 0.1 AND feature NOT IN (SELECT feature FROM m WHERE abs(with_qty) > 0.99 AND feature <> 'qty')""",
       views=FT)
def u06_not_in(spark, d):
    """Features that go with the price but are not copies of ``qty``: two selections computed from the data."""
    df = view(spark, d, "feat")
    a = ST.corr_with(df, U06_COLS, "price").where(F.abs("corr") >= 0.1).select("feature")
    b = ST.corr_with(df, U06_COLS, "qty").where((F.abs("corr") > 0.99) & (F.col("feature") != "qty")).select("feature")
    return RS.not_in(a, b)


# --- 2.9 splits, permutation -------------------------------------------------------------------

@query("p01_random_split", f"SELECT id, {SPLIT.format(k='id')} < 30 AS is_test FROM people", views=P)
def p01_random_split(spark, d):
    return SP.random_split(view(spark, d, "people").select("id"), "id", 30)


@query("p02_chrono_split", """SELECT key, rn <= CAST(floor(n * 0.8) AS BIGINT) AS is_train FROM (SELECT key,
 row_number() OVER (ORDER BY collectionTimestamp, key) AS rn, count(*) OVER () AS n FROM metrics)""", views=M)
def p02_chrono_split(spark, d):
    df = view(spark, d, "metrics").select("key", "collectionTimestamp")
    return O.first_n(df, ["collectionTimestamp", "key"], fraction=0.8, flag="is_train").select("key", "is_train")


@query("p04_permute_column", """WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM feat),
b AS (SELECT qty, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id) AS i FROM feat)
SELECT a.id, b.qty FROM a JOIN b ON a.i = b.i""", views=FT)
def p04_permute_column(spark, d):
    return SP.permute_column(view(spark, d, "feat").select("id", "qty"), "id", "qty", seed=7)


@query("g02_group_max10", """SELECT controllerName, max(cpuRequest) AS cpuRequest, max(cpuLimit) AS cpuLimit, max(cpuUsage) AS cpuUsage,
 max(memRequest) AS memRequest, max(memLimit) AS memLimit, max(memUsage) AS memUsage, max(key) AS key,
 max(collectionTimestamp) AS collectionTimestamp, max(pod) AS pod, max(container) AS container FROM metrics GROUP BY controllerName""",
       views=M)
def g02_group_max10(spark, d):
    """Max of ten columns per controller."""
    cols = ["cpuRequest", "cpuLimit", "cpuUsage", "memRequest", "memLimit", "memUsage", "key", "collectionTimestamp",
            "pod", "container"]
    return AG.group_max(view(spark, d, "metrics"), "controllerName", cols)


@query("p03b_stratified_folds", """SELECT id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(CAST(id AS VARCHAR) || ':5'), id) - 1) * 5
 // count(*) OVER (PARTITION BY target) AS INTEGER) AS fold FROM feat""", views=FT)
def p03b_stratified_folds(spark, d):
    """Five folds balanced by class, shuffled by hash (P3, ``StratifiedKFold``)."""
    return SP.stratified_folds(view(spark, d, "feat").select("id", "target"), "id", "target", 5, seed=5)


@query("w07b_numeric_codes", """SELECT key, CAST(dense_rank() OVER (ORDER BY cpuRequest) - 1 AS BIGINT) AS "cat_cpuRequest",
 CAST(dense_rank() OVER (ORDER BY key % 23) - 1 AS BIGINT) AS cat_part FROM metrics""", views=M)
def w07b_numeric_codes(spark, d):
    """Codes of numeric columns follow the numbers' size."""
    df = view(spark, d, "metrics").select("key", "cpuRequest", (F.col("key") % 23).alias("part"))
    return ordinal_codes(df, ["cpuRequest", "part"]).select("key", "cat_cpuRequest", "cat_part")


@query("p03_kfold_assignment", """SELECT id, CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':5'), 1, 8)) AS BIGINT)
 % 1073741824 % 5 AS INTEGER) AS fold FROM feat""", views=FT)
def p03_kfold_assignment(spark, d):
    """k-fold assignment from a key hash (P3), the ``foldCol`` of CrossValidator."""
    return SP.fold_column(view(spark, d, "feat").select("id"), "id", 5, seed=5)


@query("z01_native_scalar", """SELECT id, CASE WHEN cabin IS NULL OR trim(cabin) = '' THEN 'N'
 ELSE split_part(regexp_replace(trim(cabin), '\\s+', ' ', 'g'), ' ', 1) END AS first_token,
 abs(fare - 100000.0) AS abs_dev, RND(fare / 1000.0, 3) AS fare_k FROM people""", views=P)
def z01_native_scalar(spark, d):
    """Row functions the reference applies with ``apply``/``map``/``np.abs``
    as native column expressions (Z1): no Python UDF."""
    df = view(spark, d, "people")
    return df.select("id", S.first_token_or("cabin").alias("first_token"), F.abs(F.col("fare") - 100000.0).alias("abs_dev"),
                     S.rnd(F.col("fare") / 1000.0, 3).alias("fare_k"))


@query("z02_group_function_native", """SELECT key, deployment, RND(cpuUsage / sum(cpuUsage) OVER (PARTITION BY deployment), 8) AS share
FROM metrics""", views=M)
def z02_group_function_native(spark, d):
    """A group function returning a frame, re-keyed as aggregate + join."""
    df = view(spark, d, "metrics").select("key", "deployment", "cpuUsage")
    return AG.share_of_group(df, "deployment", "cpuUsage").select("key", "deployment", S.rnd("share", 8).alias("share"))
