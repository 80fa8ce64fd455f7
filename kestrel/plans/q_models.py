"""Registered queries: model-based scores and selection, fitting, tuning and
metrics (SURVEY 2.12 H1-H2, 2.13 X6, 2.14, 2.15, 2.16).

Seeded Spark ML fits have no SQL twin (rows-only checks); the metric rows
(L7, L11-L13) and standardisation (E1) are value-checked.  Models stay small
(depth <= 4, <= 10 trees, <= 7 columns) so the checks run quickly; the
operators take any size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import linear as LN
from kestrel.operators import models as ML
from kestrel.operators import penalties as PN
from kestrel.operators import selection as SEL
from kestrel.operators import stats as ST
from kestrel.operators.reshape import select_k_best
from kestrel.operators.sampling import fold_column, split_frames
from kestrel.plans.q_capacity import PRE_SQL
from kestrel.plans.q_select import SPLIT
from kestrel.plans.registry import query
from kestrel.session import shared_scratch_dir
from kestrel.sources.fixtures import view

FT, M = ("feat",), ("metrics",)
XCOLS = ["n_items", "qty", "max_disc", "min_tax", "noise", "price"]
TREE = {"maxDepth": 3}
FOREST = {"numTrees": 10, "maxDepth": 4}


def _feat(spark, d):
    return view(spark, d, "feat").select("id", *XCOLS, "qty_corr", "target")


_HELD: list = []


def _held(*frames):
    """Cache the frames of one query; those of the query before are released first."""
    while _HELD:
        _HELD.pop().unpersist()
    _HELD.extend(f.cache() for f in frames)
    return frames if len(frames) > 1 else frames[0]


def _split(spark, d):
    return _held(*split_frames(_feat(spark, d), "id", 30))


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- X6 ---------------------------------------------------------------------------

@query("x06_compare_subsets")
def x06_compare_subsets(spark, d):
    """Fit on train, report train and test ROC-AUC for named column subsets."""
    tr, te = _split(spark, d)
    subsets = {"all": XCOLS + ["qty_corr"], "selected": ["qty", "noise"]}
    rows = []
    for name, cols in subsets.items():
        m = ML.fit("rf_clf", tr, cols, "target", **FOREST)
        for split, data in (("train", tr), ("test", te)):
            rows.append((name, split, float(ML.metric_value("rf_clf", m.transform(data), "target", "roc_auc"))))
    return _rows(spark, rows, "subset string, split string, roc_auc double")


# --- 2.14 embedded ------------------------------------------------------------------------------

@query("e01_standardize", """SELECT id, RND((qty - avg(qty) OVER ()) / stddev_pop(qty) OVER (), 6) AS qty,
 RND((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price FROM feat""", views=FT)
def e01_standardize(spark, d):
    """``StandardScaler`` with the population std."""
    out = ML.standardize(view(spark, d, "feat").select("id", "qty", "price"), ["qty", "price"])
    return out.select("id", S.rnd("qty", 6).alias("qty"), S.rnd("price", 6).alias("price"))


def _logistic(spark, d, l2=(), l1=()):
    """Paths over the scaled training columns; scikit-learn's C is 1 over the weight."""
    tr, _ = _split(spark, d)
    return PN.logistic_path(tr, XCOLS, "target", l2=l2, l1=l1, standardise=True)


@query("e02_logistic_coefficients")
def e02_logistic_coefficients(spark, d):
    """``SelectFromModel(LogisticRegression(C=1000))``: keep abs(coef) > mean."""
    (fit,), _ = _logistic(spark, d, l2=[1 / 1000.0])
    keep = set(ML.select_from_model(list(fit.coef.items())))
    return _rows(spark, [(c, v, c in keep) for c, v in fit.coef.items()], "feature string, coef double, keep boolean")


@query("e04_coefficient_path")
def e04_coefficient_path(spark, d):
    """Coefficients over five penalties C (E4): feature x C table, all fitted in the same passes."""
    path, _ = _logistic(spark, d, l2=[1 / C for C in (10.0, 1.0, 0.1, 0.01, 0.001)])
    return _rows(spark, [(c, round(1 / w, 6), v) for c, w, v in PN.table_of(path, XCOLS)], "feature string, C double, coef double")


@query("e05_lasso_logistic")
def e05_lasso_logistic(spark, d):
    """L1 logistic regression, C = 0.5: keep non-zero coefficients (E5)."""
    _, (fit,) = _logistic(spark, d, l1=[1 / 0.5])
    return _rows(spark, [(c, v, v != 0) for c, v in fit.coef.items()], "feature string, coef double, keep boolean")


LASSO_COLS = [c for c in XCOLS if c != "price"]


def _lasso_sql(cols, y, alphas, source, steps=20_000):
    """Lasso coefficients on scaled columns by cyclic coordinate descent from 0, one coordinate a step of a recursion."""
    q = ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))" for b in cols) + "]" for a in cols)
    b = ", ".join(f"covar_pop({a}, {y}) / stddev_pop({a})" for a in cols)
    j, p = "CAST(i % {0} AS INTEGER) + 1".format(len(cols)), len(cols)
    return f"""WITH RECURSIVE src AS ({source}),
sums AS (SELECT [{q}] AS q, [{b}] AS b FROM src),
walk(i, alpha, beta) AS (
  SELECT 0, alpha, [{", ".join(["CAST(0 AS DOUBLE)"] * p)}] FROM (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in alphas)}]) AS alpha)
  UNION ALL
  SELECT i + 1, alpha, list_concat(list_concat(beta[1:j - 1], [sign(rho) * greatest(abs(rho) - alpha, 0) / q[j][j]]), beta[j + 1:])
  FROM (SELECT i, alpha, beta, q, {j} AS j, b[{j}] - list_dot_product(q[{j}], beta) + q[{j}][{j}] * beta[{j}] AS rho FROM walk, sums WHERE i < {steps})),
fin AS (SELECT alpha, beta FROM walk WHERE i = {steps})
SELECT unnest([{", ".join(f"'{c}'" for c in cols)}]) AS feature, alpha, unnest(beta) AS coef FROM fin"""


_TRAIN = f"SELECT * FROM feat WHERE {SPLIT.format(k='id')} >= 30"


def _lasso(spark, d, alphas):
    tr, _ = _split(spark, d)
    return PN.lasso_path(LN.gram_stats(tr, LASSO_COLS, "price"), alphas, standardise=True)


@query("e06_lasso_regression", "SELECT feature, RND(coef, 3) AS coef, coef <> 0 AS nonzero FROM (" + _lasso_sql(LASSO_COLS, "price", [100], _TRAIN, 2000) + ")",
       views=FT)
def e06_lasso_regression(spark, d):
    """``Lasso(alpha=100)`` on the price target, features scaled (E6), from the sums of one scan."""
    (fit,) = _lasso(spark, d, [100.0])
    out = _rows(spark, [(c, v, v != 0) for c, v in fit.coef.items()], "feature string, coef double, nonzero boolean")
    return out.withColumn("coef", S.rnd("coef", 3))


ALPHAS = [1000.0, 300.0, 100.0, 30.0, 1.0]


@query("e04b_lasso_path", "SELECT feature, alpha, RND(coef, 3) AS coef FROM (" + _lasso_sql(LASSO_COLS, "price", ALPHAS, _TRAIN, 2000) + ")", views=FT)
def e04b_lasso_path(spark, d):
    """Regression form of the coefficient path (E4): five penalties from one scan, each begun at the answer before."""
    rows = PN.table_of(_lasso(spark, d, ALPHAS), LASSO_COLS)
    return _rows(spark, rows, "feature string, alpha double, coef double").withColumn("coef", S.rnd("coef", 3))


@query("e07_zero_coefficients")
def e07_zero_coefficients(spark, d):
    """Zero coefficients of L1 and L2 logistic regression, C = 0.5 on scaled
    features (E7): L1 zeroes some, L2 none.  Both fitted in the same passes."""
    (ridge,), (lasso,) = _logistic(spark, d, l2=[1 / 0.5], l1=[1 / 0.5])
    return _rows(spark, [(name, sum(v == 0 for v in fit.coef.values())) for name, fit in (("l1", lasso), ("l2", ridge))],
                 "model string, n_zero int")


@query("e08_forest_importance")
def e08_forest_importance(spark, d):
    """``SelectFromModel(RandomForestClassifier)``: importance > mean."""
    tr, _ = _split(spark, d)
    m = ML.fit("rf_clf", tr, XCOLS, "target", **FOREST)
    imp = ML.importance_table(m, XCOLS)
    keep = set(ML.select_from_model(imp))
    return _rows(spark, [(c, v, c in keep) for c, v in imp], "feature string, importance double, keep boolean")


@query("e09_rfe")
def e09_rfe(spark, d):
    """``RFE(RandomForest, n_features_to_select=3)``."""
    tr, _ = _split(spark, d)
    kept = ML.rfe("rf_clf", tr, XCOLS, "target", 3, **FOREST)
    return _rows(spark, [(c,) for c in kept], "feature string")


@query("e10_stacked_selection")
def e10_stacked_selection(spark, d):
    """Basic filters + correlation, then one of four selectors (ANOVA top 3,
    logistic coefficients, lasso, forest importance), then a forest on the
    survivors, train and test ROC-AUC, beside all columns (E10)."""
    tr, te = _split(spark, d)
    cols = XCOLS + ["qty_corr"]
    chain = SEL.SelectorChain([SEL.DropConstant(tol=0.998), SEL.DropDuplicates("id"), SEL.DropCorrelated(0.8)])
    chain.fit(tr.select("id", *cols, "target"), cols)
    left = [c for c in cols if c not in chain.features_to_drop_]
    top = [r[0] for r in select_k_best(ST.anova_f(tr, left, "target").withColumnRenamed("f", "score"), 3).collect()]
    scaled, n = ML.standardize(tr, left), tr.count()

    def logistic(C, enet):
        m = ML.fit("log_reg", scaled, left, "target", regParam=1.0 / (C * n), elasticNetParam=enet, standardization=False)
        return ML.coefficient_table(m, left)
    importance = ML.importance_table(ML.fit("rf_clf", tr, left, "target", **FOREST), left)
    rows = []
    for name, cs in (("all", cols), ("anova", top), ("coefficients", ML.select_from_model(logistic(1000.0, 0.0))),
                     ("lasso", ML.select_from_model(logistic(0.5, 1.0), "nonzero")), ("forest", ML.select_from_model(importance))):
        if not cs:                       # a selector may keep nothing
            rows.append((name, "", None, None))
            continue
        m = ML.fit("rf_clf", tr, cs, "target", **FOREST)
        auc = [float(ML.metric_value("rf_clf", m.transform(x), "target", "roc_auc")) for x in (tr, te)]
        rows.append((name, ",".join(cs), *auc))
    return _rows(spark, rows, "subset string, columns string, train_roc_auc double, test_roc_auc double")


# --- 2.15 hybrid ----------------------------------------------------------------------------------

@query("y01_permutation_classification")
def y01_permutation_classification(spark, d):
    """Drift = AUC - AUC with the column shuffled; keep > 0."""
    tr, _ = _split(spark, d)
    dr = ML.permutation_drift("rf_clf", tr, XCOLS, "target", "id", "roc_auc", seed=3, **FOREST)
    return dr.withColumn("keep", F.col("drift") > 0)


@query("y02_permutation_regression")
def y02_permutation_regression(spark, d):
    """Drift = RMSE - RMSE shuffled; a useful feature gives a negative drift (Y2)."""
    tr, _ = _split(spark, d)
    cols = [c for c in XCOLS if c != "price"]
    dr = ML.permutation_drift("rf_reg", tr, cols, "price", "id", "rmse", seed=3, **FOREST)
    return dr.withColumn("keep", F.col("drift") < 0)


@query("y03_select_by_shuffling")
def y03_select_by_shuffling(spark, d):
    """``SelectByShuffling(cv=2)``: drift on the held-out fold, mean over folds, keep > mean."""
    df = _held(fold_column(_feat(spark, d), "id", 2))
    parts = []
    for k in (0, 1):
        dr = ML.permutation_drift("rf_clf", df.where(F.col("fold") != k), XCOLS, "target", "id", "roc_auc", seed=k,
                                  test=df.where(F.col("fold") == k), **FOREST)
        parts.append(dr.withColumn("fold", F.lit(k)))
    per = ST._union(parts).groupBy("feature").agg(F.avg("drift").alias("drift"))
    return per.withColumn("keep", F.col("drift") > per.agg(F.avg("drift")).scalar())


@query("y04_recursive_elimination")
def y04_recursive_elimination(spark, d):
    """Recursive elimination by GBT importance, tol 0.0005 on test AUC."""
    tr, te = _split(spark, d)
    log = ML.recursive_elimination("gbt_clf", tr, te, XCOLS, "target", "roc_auc", 0.0005, maxIter=10, maxDepth=3)
    return _rows(spark, log, "feature string, drift double, kept boolean")


@query("y04b_recursive_elimination_regression")
def y04b_recursive_elimination_regression(spark, d):
    """Y4 for a continuous target: boosted regressor, tol 0.001 on test R^2."""
    tr, te = _split(spark, d)
    cols = [c for c in XCOLS if c != "price"]
    log = ML.recursive_elimination("gbt_reg", tr, te, cols, "price", "r2", 0.001, maxIter=10, maxDepth=3)
    return _rows(spark, log, "feature string, drift double, kept boolean")


@query("y05_recursive_elimination_cv")
def y05_recursive_elimination_cv(spark, d):
    """``RecursiveFeatureElimination(cv=2, threshold)``: one elimination, drift of the mean score over the folds."""
    df = _held(fold_column(_feat(spark, d), "id", 2))
    splits = [(df.where(F.col("fold") != k), df.where(F.col("fold") == k)) for k in (0, 1)]
    log = ML.recursive_elimination_cv("dt_clf", splits, df, XCOLS, "target", "roc_auc", 0.001, **TREE)
    return _rows(spark, log, "feature string, drift double, kept boolean")


@query("y07_recursive_addition_model")
def y07_recursive_addition_model(spark, d):
    """``RecursiveFeatureAddition`` with a forest, tol 0.001."""
    tr, te = _split(spark, d)
    log = ML.recursive_addition("rf_clf", tr, te, XCOLS, "target", "roc_auc", 0.001, **FOREST)
    return _rows(spark, log, "feature string, score double, gain double, kept boolean")


@query("y07b_recursive_addition_regression")
def y07b_recursive_addition_regression(spark, d):
    """Y7 for a continuous target: forest regressor, tol 0.001 on test R^2."""
    tr, te = _split(spark, d)
    cols = [c for c in XCOLS if c != "price"]
    log = ML.recursive_addition("rf_reg", tr, te, cols, "price", "r2", 0.001, **FOREST)
    return _rows(spark, log, "feature string, score double, gain double, kept boolean")


# --- 2.16 fitting, tuning, metrics ------------------------------------------------------------------

def _metrics_frame(spark, d):
    """Processed metrics with the rolling features of earlier samples only (no target among the features)."""
    from kestrel.operators.capacity import with_earlier_usage
    from kestrel.plans.q_capacity import processed
    return with_earlier_usage(processed(spark, d))


MCOLS = ["cpuRequest", "cpuLimit", "avg_cpu_5min_before", "max_cpu_before", "hour", "dayofweek"]


@query("l01_decision_tree_regressor")
def l01_decision_tree_regressor(spark, d):
    """Decision-tree regressor for cpu usage on the processed metrics (L1)."""
    df = _metrics_frame(spark, d)
    tr, te = split_frames(df, "key", 20)
    m = ML.fit("dt_reg", tr, MCOLS, "cpuUsage", maxDepth=4)
    return ML.regression_metrics(m.transform(te), "cpuUsage", "prediction")


@query("l02_random_forest")
def l02_random_forest(spark, d):
    """Random-forest regressor and classifier (L2)."""
    df = _metrics_frame(spark, d)
    tr, te = split_frames(df, "key", 20)
    reg = ML.fit("rf_reg", tr, MCOLS, "cpuUsage", **FOREST)
    r = ML.regression_metrics(reg.transform(te), "cpuUsage", "prediction").first()
    tr2, te2 = _split(spark, d)
    clf = ML.fit("rf_clf", tr2, XCOLS, "target", **FOREST)
    auc = ML.metric_value("rf_clf", clf.transform(te2), "target", "roc_auc")
    return _rows(spark, [("rf_reg", "rmse", float(r["rmse"])), ("rf_clf", "roc_auc", float(auc))],
                 "model string, metric string, value double")


@query("l03_gradient_boosting")
def l03_gradient_boosting(spark, d):
    """Gradient-boosted regressor (L3) on log1p of the memory target."""
    df = _metrics_frame(spark, d).withColumn("y", F.log1p("memUsage"))
    tr, te = split_frames(df, "key", 20)
    m = ML.fit("gbt_reg", tr, MCOLS, "y", maxIter=10, maxDepth=3)
    return ML.regression_metrics(m.transform(te), "y", "prediction")


@query("l04_boosting_early_stopping")
def l04_boosting_early_stopping(spark, d):
    """Boosting with an evaluation set and early stopping (L4, re-aimed
    XGBoost): ``validationIndicatorCol`` + ``validationTol``; chronological
    80/20 split."""
    from kestrel.operators.ordering import first_n
    df = first_n(_metrics_frame(spark, d), ["timestamp", "key"], fraction=0.8, flag="is_train")
    # evaluation set: a repeatable 20 % hash sample of the training period
    from kestrel.operators.sampling import hash_bucket
    tr = df.where("is_train").withColumn("is_val", hash_bucket("key", 7) < 20)
    te = df.where(~F.col("is_train"))
    est = ML.estimator("gbt_reg", "cpuUsage", maxIter=30, maxDepth=3, validationIndicatorCol="is_val",
                       validationTol=0.01)
    from pyspark.ml import Pipeline
    m = Pipeline(stages=[ML.assemble(MCOLS), est]).fit(tr)
    out = ML.regression_metrics(m.transform(te), "cpuUsage", "prediction")
    return out.withColumn("n_trees", F.lit(m.stages[-1].getNumTrees))


@query("l06_logistic_regression")
def l06_logistic_regression(spark, d):
    """Logistic regression, train/test ROC-AUC."""
    tr, te = _split(spark, d)
    m = ML.fit("log_reg", tr, XCOLS, "target", maxIter=50)
    return _rows(spark, [(s, float(ML.metric_value("log_reg", m.transform(x), "target", "roc_auc")))
                         for s, x in (("train", tr), ("test", te))], "split string, roc_auc double")


@query("l07_polynomial", """SELECT id, qty AS p0, qty * qty AS p1, max_disc AS p2, qty * max_disc AS p3,
 max_disc * max_disc AS p4 FROM feat""", views=FT)
def l07_polynomial(spark, d):
    """``PolynomialFeatures(degree=2, include_bias=False)``."""
    out = ML.polynomial(view(spark, d, "feat").select("id", "qty", "max_disc"), ["qty", "max_disc"], 2)
    return out.select("id", *[F.col("poly")[i].alias(f"p{i}") for i in range(5)])


@query("l08_column_transformer")
def l08_column_transformer(spark, d):
    """Scale numerics + one-hot categoricals, then a linear model."""
    df = view(spark, d, "people").na.drop(subset=["balance"])
    pipe = ML.preprocessing(["balance", "fare"], ["segment", "priority"])
    from pyspark.ml import Pipeline
    model = Pipeline(stages=pipe.getStages() + [ML.estimator("log_reg", "target")]).fit(df)
    out = model.transform(df)
    return _rows(spark, [("n_features", float(out.first()["features"].size)),
                         ("train_auc", float(ML.metric_value("log_reg", out, "target", "roc_auc")))],
                 "name string, value double")


@query("l09_grid_search")
def l09_grid_search(spark, d):
    """``GridSearchCV(cv=3)``: random forest depth x trees, RMSE."""
    df = fold_column(_metrics_frame(spark, d), "key", 3)
    _, rows = ML.grid_search("rf_reg", df, MCOLS, "cpuUsage", {"maxDepth": [2, 4], "numTrees": [5, 10]}, metric="rmse")
    return _rows(spark, rows, "params string, rmse double")


@query("l10_random_search")
def l10_random_search(spark, d):
    """``RandomizedSearchCV(n_iter=10)``: seeded draws from the grid."""
    df = fold_column(_metrics_frame(spark, d), "key", 2)
    _, rows = ML.grid_search("gbt_reg", df, MCOLS, "cpuUsage",
                             {"maxDepth": [2, 3, 4], "maxIter": [5, 10], "stepSize": [0.05, 0.1, 0.3]}, metric="mae",
                             sample=10, seed=42, num_folds=2)
    return _rows(spark, rows, "params string, mae double")


@query("l11_regression_metrics", """SELECT RND(avg((cpuUsage - avg_cpu_5min) * (cpuUsage - avg_cpu_5min)), 8) AS mse,
 RND(sqrt(avg((cpuUsage - avg_cpu_5min) * (cpuUsage - avg_cpu_5min))), 8) AS rmse, RND(avg(abs(cpuUsage - avg_cpu_5min)), 8) AS mae,
 RND(1 - avg((cpuUsage - avg_cpu_5min) * (cpuUsage - avg_cpu_5min)) / var_pop(cpuUsage), 8) AS r2 FROM (
 SELECT cpuUsage / 1.0 AS cpuUsage, avg(cpuUsage) OVER (PARTITION BY controllerName ORDER BY collectionTimestamp, key
 ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS avg_cpu_5min FROM metrics) WHERE avg_cpu_5min IS NOT NULL""", views=M)
def l11_regression_metrics(spark, d):
    """MSE, RMSE, MAE, R2 of a baseline forecast (mean of the 4 previous samples)."""
    from kestrel.operators.ordering import rolling
    df = view(spark, d, "metrics").select("key", "controllerName", "collectionTimestamp", "cpuUsage")
    pred = rolling(df, "controllerName", ["collectionTimestamp", "key"], 5,
                   {"avg_cpu_5min": lambda w: F.avg("cpuUsage").over(w.rowsBetween(-4, -1))})
    out = ML.regression_metrics(pred.where(F.col("avg_cpu_5min").isNotNull()), "cpuUsage", "avg_cpu_5min")
    return out.select(*[S.rnd(c, 8).alias(c) for c in ("mse", "rmse", "mae", "r2")])


@query("l12_mape", """SELECT RND(avg(abs((value - pred) / value)) * 100, 6) AS mape FROM (
 SELECT value, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pred FROM events)
WHERE pred IS NOT NULL AND value <> 0""")
def l12_mape(spark, d):
    """MAPE of a naive previous-value forecast, in percent."""
    from kestrel.operators.ordering import shifted
    from kestrel.sources.fixtures import table
    ev = table(spark, d, "events").select("event_id", "ts", "value")
    p = shifted(ev, None, ["ts", "event_id"], ["value"], suffix="_pred")
    p = p.where(F.col("value_pred").isNotNull() & (F.col("value") != 0))
    return ML.mape(p, "value", "value_pred").select(S.rnd("mape", 6).alias("mape"))


@query("l13_classification_report", """WITH c AS (SELECT target AS y, CAST(qty > 100 AS INTEGER) AS p FROM feat),
cls AS (SELECT y AS cls FROM c UNION SELECT p FROM c)
SELECT cls, RND(coalesce(tp / nullif(pr, 0), 0.0), 6) AS precision, RND(coalesce(tp / nullif(sup, 0), 0.0), 6) AS recall,
 RND(coalesce(2 * (tp / nullif(pr, 0)) * (tp / nullif(sup, 0)) / nullif(tp / nullif(pr, 0) + tp / nullif(sup, 0), 0), 0.0), 6) AS f1,
 CAST(sup AS BIGINT) AS support FROM (SELECT cls, (SELECT count(*) FROM c WHERE y = cls AND p = cls) AS tp,
 (SELECT count(*) FROM c WHERE p = cls) AS pr, (SELECT count(*) FROM c WHERE y = cls) AS sup FROM cls)""", views=FT)
def l13_classification_report(spark, d):
    """Per-class precision / recall / F1 / support of a rule classifier."""
    df = view(spark, d, "feat").select(F.col("target").alias("y"), (F.col("qty") > 100).cast("int").alias("p"))
    rep = ML.classification_report(df, "y", "p")
    return rep.select("cls", *[S.rnd(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("l14_feature_importances")
def l14_feature_importances(spark, d):
    """Sorted importance table of a fitted forest."""
    df = _metrics_frame(spark, d)
    m = ML.fit("rf_reg", df, MCOLS, "cpuUsage", **FOREST)
    return _rows(spark, ML.importance_table(m, MCOLS), "feature string, importance double")


@query("l15_save_load_model", "WITH " + PRE_SQL + "\nSELECT key, TRUE AS same FROM processed", views=M)
def l15_save_load_model(spark, d):
    """Persist a fitted pipeline; the reloaded copy predicts the same for every row."""
    import uuid
    df = _metrics_frame(spark, d)
    m = ML.fit("dt_reg", df, MCOLS, "cpuUsage", maxDepth=3)
    path = ML.save_model(m, shared_scratch_dir(spark, f"model-{uuid.uuid4().hex[:10]}"))
    back = ML.load_model(path)
    both = back.transform(m.transform(df).withColumnRenamed("prediction", "before").drop("features"))
    return both.select("key", (F.col("before") == F.col("prediction")).alias("same"))


@query("l16_models_side_by_side")
def l16_models_side_by_side(spark, d):
    """Decision tree vs gradient boosting on two targets, one split."""
    df = _held(_metrics_frame(spark, d).select("key", *MCOLS, "cpuUsage", "memUsage"))      # read by every fit: made once
    tr, te = split_frames(df, "key", 20)
    parts = []
    for kind, params in (("dt_reg", {"maxDepth": 4}), ("gbt_reg", {"maxIter": 10, "maxDepth": 3})):
        for target in ("cpuUsage", "memUsage"):
            m = ML.fit(kind, tr, MCOLS, target, **params)
            parts.append(ML.regression_metrics(m.transform(te), target, "prediction")
                         .select(F.lit(kind).alias("model"), F.lit(target).alias("target"), "*"))
    return ST._union(parts)


@query("r12_underprovision_classifier")
def r12_underprovision_classifier(spark, d):
    """Random-forest classifier of the under-provisioning flag (R12, C17 + L13)."""
    df = _metrics_frame(spark, d).withColumn("flag", S.under_provisioned("cpuUsage", "cpuRequest"))
    tr, te = split_frames(df, "key", 20)
    m = ML.fit("rf_clf", tr, ["cpuRequest", "cpuLimit", "avg_cpu_5min_before", "hour", "dayofweek"], "flag", **FOREST)
    pred = m.transform(te).withColumn("prediction", F.col("prediction").cast("int"))
    return ML.classification_report(pred, "flag", "prediction")


@query("z03_pluggable_scorers")
def z03_pluggable_scorers(spark, d):
    """Pluggable estimator and scoring names (Z3): the same CV loop with
    ``roc_auc`` for a classifier and ``r2`` / ``neg_rmse`` / ``mae`` for a
    regressor."""
    df = _held(fold_column(_feat(spark, d), "id", 2))
    rows = []
    for kind, label, cols, metric in (("dt_clf", "target", XCOLS, "roc_auc"),
                                      ("dt_reg", "price", ["qty", "n_items", "max_disc"], "r2"),
                                      ("dt_reg", "price", ["qty", "n_items", "max_disc"], "neg_rmse"),
                                      ("dt_reg", "price", ["qty", "n_items", "max_disc"], "mae")):
        sc = ML.cv_score(kind, df, cols, label, metric, "fold", [0, 1], **TREE)
        rows.append((kind, metric, float(sum(sc) / len(sc))))
    return _rows(spark, rows, "estimator string, scoring string, mean_score double")
