"""Registered queries: remaining capacity rows and per-key forecasts
(SURVEY 2.17 R2, R5, R7-R11)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import capacity as C
from kestrel.operators import forecast as FC
from kestrel.operators.ordering import rolling
from kestrel.operators.reshape import top_k
from kestrel.plans.q_capacity import REC_SQL, recommended
from kestrel.plans.registry import query
from kestrel.sources.fixtures import view

M = ("metrics",)


@query("r02_optimised_target", """SELECT key, RND(ln(1 + least(memRequest, memUsage * 1.2)), 6) AS log_target FROM metrics""",
       views=M)
def r02_optimised_target(spark, d):
    """Training target min(request, usage * 1.2) in bytes, log1p (R2)."""
    df = view(spark, d, "metrics")
    return df.select("key", S.rnd(F.log1p(F.least("memRequest", F.col("memUsage") * 1.2)), 6).alias("log_target"))


@query("r05_savings_summary", """WITH s AS (SELECT key, cpuRequest, greatest(cpuUsage * 1.2, 0.0) AS rec FROM metrics)
SELECT count(*) FILTER (WHERE rec > cpuRequest) AS n_increase, count(*) FILTER (WHERE rec < cpuRequest) AS n_decrease,
 count(*) FILTER (WHERE rec = cpuRequest) AS n_unchanged, RND(sum(cpuRequest - rec), 4) AS total_savings,
 RND(max(cum), 4) AS max_cumulative_savings FROM (SELECT *, sum(cpuRequest - rec) OVER (ORDER BY cpuRequest - rec DESC, key
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s)""", views=M)
def r05_savings_summary(spark, d):
    """Savings curve (largest first) and increase/decrease/unchanged counts."""
    df = view(spark, d, "metrics").select("key", "cpuRequest", S.clip_lower(F.col("cpuUsage") * 1.2).alias("rec"))
    curve = C.savings_curve(df.withColumn("savings", F.col("cpuRequest") - F.col("rec")), "savings", "key")
    counts = C.change_counts(df, "cpuRequest", "rec")
    return counts.select("*", S.rnd(curve.agg(F.sum("savings")).scalar(), 4).alias("total_savings"),
                         S.rnd(curve.agg(F.max("cumulative_savings")).scalar(), 4).alias("max_cumulative_savings"))


@query("r07_rows_by_deployment", "WITH " + REC_SQL + """, dep AS (SELECT key, deployment FROM metrics)
SELECT dep.deployment, rec.key, rec.recommended_cpuRequest, rec.recommended_memRequest FROM rec JOIN dep USING (key)""",
       views=M)
def r07_rows_by_deployment(spark, d):
    """Rows grouped by deployment with their recommendations (R7): a re-keyed
    projection, no per-group function needed."""
    return recommended(spark, d, keep=("deployment",)).select("deployment", "key", "recommended_cpuRequest",
                                                              "recommended_memRequest")


@query("r08_arima_forecast")
def r08_arima_forecast(spark, d):
    """5-step ARIMA(1,1,1) forecasts of the predicted cpu and memory requests
    per deployment (R8), stamped at last timestamp + h * last gap, with the
    last usage / request / prediction of the deployment."""
    rows = recommended(spark, d, keep=("deployment",))
    out = FC.forecast_requests(rows, "deployment", "timestamp", "key", {
        "cpu": ("cpuRequest_predicted", "cpuUsage", "cpuRequest"),
        "memory": ("memRequest_predicted", "memUsage", "memRequest")}, steps=5)
    return out.select("deployment", "resource", "step", "forecast_timestamp",
                      S.rnd("forecasted_value", 6).alias("forecasted_value"), "last_usage", "last_request",
                      "last_predicted", "last_actual_timestamp", S.rnd("phi", 6).alias("phi"),
                      S.rnd("theta", 6).alias("theta"))


def _css_sql(key, ts, tie, y, steps, table_="metrics"):
    """The same grids: the residual recursion goes through all series and candidates row by row."""
    ctes = [f"""base AS (SELECT {key} AS k, {y} AS y, row_number() OVER w AS nth, count(*) OVER (PARTITION BY {key}) AS n,
  {y} - lag({y}) OVER w AS w, lag({y}) OVER w - lag({y}, 2) OVER w AS w1
  FROM {table_} WHERE {y} IS NOT NULL WINDOW w AS (PARTITION BY {key} ORDER BY {ts}, {tie}))""",
            "rows AS (SELECT k, nth - 2 AS t, y, w, w1 FROM base WHERE n >= 4 AND nth > 2)",
            "sizes AS (SELECT k, max(t) AS n FROM rows GROUP BY k)",
            "best_0 AS (SELECT k, 0.0 AS phi, 0.0 AS theta FROM sizes)"]
    for z in range(FC.CSS_ZOOMS + 1):
        n = FC.CSS_FINE if z else FC.CSS_COARSE
        step = repr(FC.css_step(z))

        def at(c, i):
            value = f"CAST({c} AS DOUBLE) + {step} * ({i} - {n // 2})" if z else f"-{FC.CSS_LIMIT} + {step} * {i}"
            return f"greatest(least(CAST({value} AS DOUBLE), {FC.CSS_CLIP}), -{FC.CSS_CLIP})"
        ctes += [f"cand_{z} AS (SELECT k, i * {n} + j AS g, {at('phi', 'i')} AS phi, {at('theta', 'j')} AS theta FROM best_{z}, range({n}) a(i), range({n}) b(j))",
                 f"""walk_{z}(k, g, phi, theta, t, e, sse) AS (
  SELECT k, g, phi, theta, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cand_{z}
  UNION ALL SELECT k, g, phi, theta, t, e, sse + e * e FROM (
    SELECT x.k, x.g, x.phi, x.theta, r.t, x.sse, (r.w - x.phi * r.w1) - x.theta * x.e AS e FROM walk_{z} x JOIN rows r ON r.k = x.k AND r.t = x.t + 1))""",
                 f"best_{z + 1} AS (SELECT w.k, phi, theta, sse, e FROM walk_{z} w JOIN sizes ON sizes.k = w.k AND sizes.n = w.t "
                 "QUALIFY row_number() OVER (PARTITION BY w.k ORDER BY sse, g) = 1)"]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT b.k AS {key}, CAST(h AS INTEGER) AS step, RND(phi, 6) AS phi, RND(theta, 6) AS theta, RND(sse, 4) AS sse,
  RND(r.y + (phi * r.w + theta * e) * (1 - phi ** h) / (1 - phi), 6) AS forecast
FROM best_{FC.CSS_ZOOMS + 1} b JOIN sizes ON sizes.k = b.k JOIN rows r ON r.k = b.k AND r.t = sizes.n, range(1, {steps + 1}) s(h)"""


@query("r08b_arima_css", _css_sql("deployment", "collectionTimestamp", "key", "cpuUsage", 5), views=M)
def r08b_arima_css(spark, d):
    """ARIMA(1,1,1) of cpu usage per deployment by the conditional sum of squares, five steps ahead."""
    out = FC.arima111_css(view(spark, d, "metrics"), "deployment", "collectionTimestamp", "key", "cpuUsage", steps=5)
    return out.select("deployment", "step", S.rnd("phi", 6).alias("phi"), S.rnd("theta", 6).alias("theta"), S.rnd("sse", 4).alias("sse"),
                      S.rnd("forecast", 6).alias("forecast"))


R9_SQL = """WITH base AS (SELECT controllerName AS k, collectionTimestamp AS ts, cpuUsage AS y FROM metrics WHERE cpuUsage IS NOT NULL),
o AS (SELECT k, min(epoch_us(ts)) AS orig, count(*) AS n FROM base GROUP BY k HAVING count(*) >= 2),
b AS (SELECT base.*, orig, (epoch_us(ts) - orig) / 86400e6 AS t FROM base JOIN o USING (k)),
fit AS (SELECT k, coalesce(regr_slope(y, t), 0.0) AS slope, coalesce(regr_intercept(y, t), 0.0) AS intercept FROM b GROUP BY k),
res AS (SELECT k, hour(ts) AS hour, avg(y - (intercept + slope * t)) AS season FROM b JOIN fit USING (k) GROUP BY k, hour(ts)),
lst AS (SELECT k, max(ts) AS lt FROM b GROUP BY k),
frame AS (SELECT k, ts, false AS is_future FROM b UNION ALL
          SELECT k, lt + to_seconds(h * 3600) AS ts, true FROM lst, range(1, 31) r(h)),
sc AS (SELECT frame.k, frame.ts, frame.is_future, (epoch_us(frame.ts) - o.orig) / 86400e6 AS t FROM frame JOIN o USING (k))
SELECT sc.k AS controllerName, sc.ts AS ds, sc.is_future,
 RND(fit.intercept + fit.slope * sc.t + coalesce(res.season, 0.0), 6) AS yhat
FROM sc JOIN fit USING (k) LEFT JOIN res ON res.k = sc.k AND res.hour = hour(sc.ts)"""


@query("r09_trend_season_forecast", R9_SQL, views=M)
def r09_trend_season_forecast(spark, d):
    """Trend + hour-of-day seasonality per controller, history + 30 hourly steps."""
    df = view(spark, d, "metrics")
    out = FC.trend_season_forecast(df, "controllerName", "collectionTimestamp", "cpuUsage", periods=30)
    return out.select("controllerName", "ds", "is_future", S.rnd("yhat", 6).alias("yhat"))


def _additive_sql(key, ts, y, periods, step, table_="metrics"):
    """The additive forecast: sums of products by key, penalties added, the terms swept out one by one."""
    model = FC.Additive()
    t, days = "((us - a) / CAST(b - a AS DOUBLE))", "(us / 86400e6)"
    terms = ["1.0", t] + [f"greatest({t} - {h!r}, 0)" for h in model.hinges]
    for period, k in model.waves:
        angle = f"({2 * math.pi * k / period!r} * {days})"
        terms += [f"sin({angle})", f"cos({angle})"]
    p = len(terms)
    size, split = p + 1, 2 + len(model.hinges)
    as_terms = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(terms, 1))
    sums = ", ".join("[" + ", ".join(f"sum(x{i} * x{j})" for j in range(1, size + 1)) + "]" for i in range(1, size + 1))
    ridge = "[" + ", ".join("0.0" if s is None else repr(1 / s ** 2) for s in model.priors) + "]"
    value = " + ".join(f"beta[{i}] * x{i}" for i in range(1, split + 1)), " + ".join(f"beta[{i}] * x{i}" for i in range(split + 1, p + 1))
    return f"""WITH RECURSIVE base AS (SELECT {key} AS k, {ts} AS ts, epoch_us({ts}) AS us, {y} AS y FROM {table_} WHERE {y} IS NOT NULL AND {ts} IS NOT NULL),
ranges AS (SELECT k, min(us) AS a, max(us) AS b, CASE WHEN max(abs(y)) > 0 THEN max(abs(y)) ELSE 1 END AS top FROM base GROUP BY k
           HAVING count(*) >= 2 AND max(us) > min(us)),
xs AS (SELECT k, {as_terms}, y / top AS x{size} FROM base JOIN ranges USING (k)),
sums AS (SELECT k, [{sums}] AS m FROM xs GROUP BY k),
ridged AS (SELECT k, list_transform(m, lambda r, i: list_transform(r, lambda v, j: v + CASE WHEN i = j AND i <= {p}
  THEN {ridge}[i] * (greatest(m[{size}][{size}] / m[1][1] - (m[1][{size}] / m[1][1]) ** 2, 0) + 1e-9) ELSE 0 END)) AS m FROM sums),
sweep(k, n, a) AS (
  SELECT k, 1, m FROM ridged UNION ALL
  SELECT k, n + 1, list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j:
    CASE WHEN i = n AND j = n THEN -1 / a[n][n] WHEN i = n OR j = n THEN a[i][j] / a[n][n] ELSE a[i][j] - a[i][n] * a[n][j] / a[n][n] END))
  FROM sweep WHERE n <= {p}),
fitted AS (SELECT k, list_transform(range(1, {size}), lambda i: a[i][{size}]) AS beta FROM sweep WHERE n = {size}),
lst AS (SELECT k, max(ts) AS lt FROM base JOIN ranges USING (k) GROUP BY k),
frame AS (SELECT k, ts, false AS is_future FROM base UNION ALL SELECT k, lt + to_seconds(h * {step}), true FROM lst, range(1, {periods + 1}) r(h)),
placed AS (SELECT frame.k, ts, is_future, top, {as_terms} FROM (SELECT *, epoch_us(ts) AS us FROM frame) frame JOIN ranges ON ranges.k = frame.k)
SELECT placed.k AS {key}, ts AS ds, is_future, RND(({value[0]}) * top, 4) AS trend, RND(({value[1]}) * top, 4) AS season,
       RND(({value[0]}) * top + ({value[1]}) * top, 4) AS yhat FROM placed JOIN fitted ON fitted.k = placed.k"""


@query("r09b_additive_forecast", _additive_sql("controllerName", "collectionTimestamp", "cpuUsage", 30, 3600), views=M)
def r09b_additive_forecast(spark, d):
    """Trend with changepoints, daily and weekly seasons per controller, history + 30 hourly steps."""
    out = FC.additive_forecast(view(spark, d, "metrics"), "controllerName", "collectionTimestamp", "cpuUsage", periods=30)
    return out.select("controllerName", "ds", "is_future", *[S.rnd(c, 4).alias(c) for c in ("trend", "season", "yhat")])


@query("r10_future_frame", """WITH lst AS (SELECT controllerName, max(collectionTimestamp) AS lt FROM metrics GROUP BY 1)
SELECT controllerName, collectionTimestamp, false AS is_future FROM metrics UNION ALL
SELECT controllerName, lt + to_seconds(h * 86400), true FROM lst, range(1, 8) r(h)""", views=M)
def r10_future_frame(spark, d):
    """History plus 7 daily steps per controller."""
    df = view(spark, d, "metrics")
    return FC.future_frame(df, "controllerName", "collectionTimestamp", 7, 86400)


ERR_SQL = """WITH p AS (SELECT collectionTimestamp AS ts, cpuUsage, avg(cpuUsage) OVER (PARTITION BY controllerName
 ORDER BY collectionTimestamp, key ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pred FROM metrics),
e AS (SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
 cpuUsage - pred AS error, abs(cpuUsage - pred) AS abs_error FROM p WHERE pred IS NOT NULL),
daily AS (SELECT year, month, day, RND(avg(error), 6) AS error, RND(avg(abs_error), 6) AS abs_error FROM e GROUP BY 1, 2, 3)"""


def _daily_errors(spark, d):
    df = view(spark, d, "metrics").select("key", "controllerName", "collectionTimestamp", "cpuUsage")
    p = rolling(df, "controllerName", ["collectionTimestamp", "key"], 5,
                {"pred": lambda w: F.avg("cpuUsage").over(w.rowsBetween(-4, -1))}).where(F.col("pred").isNotNull())
    e = p.select(F.year("collectionTimestamp").alias("year"), F.month("collectionTimestamp").alias("month"),
                 F.dayofmonth("collectionTimestamp").alias("day"), (F.col("cpuUsage") - F.col("pred")).alias("error"))
    return e.groupBy("year", "month", "day").agg(S.rnd(F.avg("error"), 6).alias("error"),
                                                  S.rnd(F.avg(F.abs("error")), 6).alias("abs_error"))


@query("r11_error_by_day", ERR_SQL + " SELECT * FROM daily", views=M)
def r11_error_by_day(spark, d):
    """Forecast error and absolute error averaged by day (R11, C19 + G3)."""
    return _daily_errors(spark, d)


@query("r11b_worst_days", ERR_SQL + " SELECT * FROM daily ORDER BY abs_error DESC, year, month, day LIMIT 5", views=M)
def r11b_worst_days(spark, d):
    """The five days with the largest mean absolute error."""
    return top_k(_daily_errors(spark, d), "abs_error", 5, tie=["year", "month", "day"])
