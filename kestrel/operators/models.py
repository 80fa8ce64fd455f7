"""Model fitting, scoring and model-based selection on Spark ML (SURVEY
2.12 H1-H2, 2.13 X6, 2.14, 2.15 Y1-Y7, 2.16).

Estimators are Spark ML (distributed fits).  Searches that need many fits
(single-feature scores, permutation, recursive elimination) loop on the
driver over a cached training frame; each iteration is one distributed
fit/evaluate, and independent fits are submitted from a small thread pool so
the cluster runs them concurrently.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.sampling import permute_columns
from kestrel.operators.stats import auc_by_group

ESTIMATORS = {
    "dt_reg": DecisionTreeRegressor, "dt_clf": DecisionTreeClassifier,
    "rf_reg": RandomForestRegressor, "rf_clf": RandomForestClassifier,
    "gbt_reg": GBTRegressor, "gbt_clf": GBTClassifier,
    "lin_reg": LinearRegression, "log_reg": LogisticRegression,
}
CLASSIFIERS = {"dt_clf", "rf_clf", "gbt_clf", "log_reg"}


def estimator(kind: str, label: str, features: str = "features", **params):
    est = ESTIMATORS[kind](featuresCol=features, labelCol=label)
    if est.hasParam("seed"):
        params.setdefault("seed", 0)
    return est.setParams(**params) if params else est


def assemble(cols, out: str = "features") -> VectorAssembler:
    """Feature vector; a null feature is an error, fill it before (no row is left out silently)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")


def fit(kind: str, df: DataFrame, cols, label: str, **params) -> PipelineModel:
    """Assemble + estimator as one pipeline."""
    return Pipeline(stages=[assemble(cols), estimator(kind, label, **params)]).fit(df)


def score_column(kind: str) -> F.Column:
    """Prediction for regressors, P(class 1) for classifiers."""
    if kind in CLASSIFIERS:
        return vector_to_array("probability")[1]
    return F.col("prediction")


# --- metrics (V: plain aggregates) ------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 (L11) in one aggregate."""
    e = F.col(label) - F.col(pred)
    agg = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(label).alias("_kv"))
    return agg.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.col("_kv")).alias("r2"))


def mape(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Mean absolute percentage error in percent (L12); y = 0 rows give null terms."""
    return df.agg((F.avg(F.abs(F.try_divide(F.col(label) - F.col(pred), F.col(label)))) * 100).alias("mape"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support (L13) from confusion counts."""
    cm = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    predn = cm.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = sup.join(predn, "cls", "full_outer").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    prec = F.try_divide(F.col("tp"), F.col("predicted"))
    rec = F.try_divide(F.col("tp"), F.col("support"))
    return j.select("cls", F.coalesce(prec, F.lit(0.0)).alias("precision"), F.coalesce(rec, F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def metric_value(kind: str, scored: DataFrame, label: str, metric: str) -> float:
    if metric == "roc_auc":
        # Exact AUC (numBins=0: every distinct score is a threshold; ties
        # handled), computed by Spark's distributed sort.
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        raw = "probability" if kind in CLASSIFIERS else "prediction"
        ev = BinaryClassificationEvaluator(rawPredictionCol=raw, labelCol=label, metricName="areaUnderROC", numBins=0)
        return ev.evaluate(scored.withColumn(label, F.col(label).cast("double")))
    m = regression_metrics(scored, label, "prediction").first()
    return {"mse": m["mse"], "rmse": m["rmse"], "neg_rmse": -m["rmse"], "mae": m["mae"], "r2": m["r2"]}[metric]


def cv_score(kind: str, df: DataFrame, cols, label: str, metric: str, fold_col: str = "fold", folds=None,
             **params) -> list[float]:
    """Score per held-out fold."""
    if folds is None:
        folds = [r[0] for r in df.select(fold_col).distinct().orderBy(fold_col).collect()]
    out = []
    for k in folds:
        m = fit(kind, df.where(F.col(fold_col) != k), cols, label, **params)
        out.append(metric_value(kind, m.transform(df.where(F.col(fold_col) == k)), label, metric))
    return out


def _parallel(fn, items, threads: int = 8):
    with ThreadPoolExecutor(max_workers=threads) as ex:
        return list(ex.map(fn, items))


def subset_scorer(kind: str, df: DataFrame, label: str, metric: str, fold_col: str = "fold", **params):
    """``score_many`` of a wrapper search: mean CV score of a model on each
    subset; the subsets of one call are fitted concurrently."""
    folds = [r[0] for r in df.select(fold_col).distinct().orderBy(fold_col).collect()]

    def one(cols):
        scores = cv_score(kind, df, cols, label, metric, fold_col, folds, **params)
        return sum(scores) / len(scores)
    return lambda many: _parallel(one, many)


# --- embedded selection -----------------------------------------------------------------------

def coefficient_table(model: PipelineModel, cols) -> list[tuple[str, float]]:
    last = model.stages[-1]
    coef = last.coefficients.toArray() if hasattr(last, "coefficients") else last.coefficientMatrix.toArray()[0]
    return [(c, float(v)) for c, v in zip(cols, coef)]


def importance_table(model: PipelineModel, cols) -> list[tuple[str, float]]:
    """Feature importances of a tree model, sorted descending."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted([(c, float(v)) for c, v in zip(cols, imp)], key=lambda t: -t[1])


def select_from_model(pairs: list[tuple[str, float]], rule: str = "mean_abs") -> list[str]:
    """``SelectFromModel``: keep abs(value) > mean abs value (E2, E8), or
    non-zero (E5, E6)."""
    if rule == "nonzero":
        return [c for c, v in pairs if v != 0]
    m = sum(abs(v) for _, v in pairs) / len(pairs)
    return [c for c, v in pairs if abs(v) > m]


def standardize(df: DataFrame, cols) -> DataFrame:
    """``StandardScaler().fit(train)``: population std (E1); constant -> 0."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.lit(st[f"m_{c}"]), F.lit(st[f"s_{c}"])), F.lit(0.0))
                           for c in cols})


def rfe(kind: str, df: DataFrame, cols, label: str, n_features: int, **params) -> list[str]:
    """``RFE``: fit, drop the least important, refit until n remain."""
    cur = list(cols)
    while len(cur) > n_features:
        imp = dict(importance_table(fit(kind, df, cur, label, **params), cur))
        cur.remove(min(cur, key=lambda c: (imp[c], -cur.index(c))))
    return cur


# --- hybrid searches ----------------------------------------------------------------------------

def permutation_drift(kind: str, train: DataFrame, cols, label: str, key: str, metric: str,
                      seed: int = 0, test: DataFrame | None = None, **params) -> DataFrame:
    """Drift = score - score with one column permuted.

    The model is fitted once on ``train`` and scored on ``test`` (default:
    ``train``).  All columns are permuted by one pair of indexes and one join
    (:func:`permute_columns`), stored once.  Every row then gives one row as it
    is and one with each column replaced by its permuted twin; the model scores
    them in one pass, and one grouped job makes all metrics."""
    cols = list(cols)
    model = fit(kind, train, cols, label, **params)
    both = permute_columns(train if test is None else test, key, cols, seed).checkpoint(eager=True)
    forms = [F.struct(F.lit(swapped).alias("_kform"), *[F.col(f"{c}__perm" if c == swapped else c).alias(c) for c in cols]) for swapped in ("", *cols)]
    rows = both.select(F.col(label).cast("double").alias("_ky"), F.explode(F.array(*forms)).alias("_kf")).select("_ky", "_kf.*")
    scored = model.transform(rows).select("_kform", "_ky", score_column(kind).alias("_kscore"))
    if metric == "roc_auc":
        values = {r["_kform"]: r["auc"] for r in auc_by_group(scored, "_kform", "_kscore", "_ky").collect()}
    else:
        e = F.col("_ky") - F.col("_kscore")
        sums = scored.groupBy("_kform").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("_ky").alias("var")).collect()
        make = {"mse": lambda r: r["mse"], "rmse": lambda r: r["mse"] ** 0.5, "neg_rmse": lambda r: -r["mse"] ** 0.5, "mae": lambda r: r["mae"],
                "r2": lambda r: 1 - r["mse"] / r["var"]}[metric]
        values = {r["_kform"]: make(r) for r in sums}
    return train.sparkSession.createDataFrame([(c, float(values[""] - values[c])) for c in cols], "feature string, drift double")


def recursive_elimination(kind: str, train: DataFrame, test: DataFrame, cols, label: str, metric: str,
                          tol: float, **params) -> list[tuple[str, float, bool]]:
    """Recursive elimination by importance with tolerance (Y4, Y5): remove
    the least important remaining feature; keep it back if the score drops by
    more than ``tol``, else the baseline moves to the new score."""
    return recursive_elimination_cv(kind, [(train, test)], train, cols, label, metric, tol, **params)


def _mean_score(kind: str, splits, cols, label: str, metric: str, **params) -> float:
    """Mean score over (train, test) pairs; fits of different pairs run concurrently."""
    def one(pair):
        return metric_value(kind, fit(kind, pair[0], cols, label, **params).transform(pair[1]), label, metric)
    scores = _parallel(one, splits)
    return float(sum(scores) / len(scores))


def recursive_elimination_cv(kind: str, splits, full: DataFrame, cols, label: str, metric: str, tol: float,
                             **params) -> list[tuple[str, float, bool]]:
    """One elimination whose score is the mean over the folds.

    ``log``: every feature in the order it was tried (least important in the
    model on ``full`` first) with its drift, the baseline before the trial
    minus the score without it, and whether it was kept.  The last feature
    left is kept without a trial (drift null)."""
    base = _mean_score(kind, splits, cols, label, metric, **params)
    order = [c for c, _ in reversed(importance_table(fit(kind, full, cols, label, **params), cols))]
    kept, log = list(cols), []
    for c in order:
        trial = [x for x in kept if x != c]
        if not trial:
            log.append((c, None, True))
            continue
        score = _mean_score(kind, splits, trial, label, metric, **params)
        drift = float(base - score)
        log.append((c, drift, drift >= tol))
        if drift < tol:
            kept, base = trial, score
    return log


def recursive_addition(kind: str, train: DataFrame, test: DataFrame, cols, label: str, metric: str,
                       tol: float, **params) -> list[tuple[str, float, float | None, bool]]:
    """Recursive addition (Y6, Y7): most important first; keep when the gain
    is at least ``tol`` and move the baseline.  Rows: feature, score with it,
    gain over the baseline before it (null for the first), kept."""
    model = fit(kind, train, cols, label, **params)
    order = [c for c, _ in importance_table(model, cols)]
    kept = [order[0]]
    base = metric_value(kind, fit(kind, train, kept, label, **params).transform(test), label, metric)
    log = [(order[0], float(base), None, True)]
    for c in order[1:]:
        sc = metric_value(kind, fit(kind, train, kept + [c], label, **params).transform(test), label, metric)
        gain = float(sc - base)
        log.append((c, float(sc), gain, gain >= tol))
        if gain >= tol:
            kept.append(c)
            base = sc
    return log


# --- tuning, preprocessing, persistence ----------------------------------------------------------

def grid_search(kind: str, df: DataFrame, cols, label: str, grid: dict, fold_col: str = "fold",
                metric: str = "rmse", parallelism: int = 4, sample: int | None = None, seed: int = 0,
                num_folds: int = 3):
    """``GridSearchCV`` / ``RandomizedSearchCV`` (L9, L10) as a CrossValidator
    over a hash-derived fold column.  ``sample`` draws that many grid points
    with a seeded RNG (randomised search).  The rounds of a boosted regressor
    are scored from one fit (:func:`_boosted_scores`)."""
    import random

    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    est = estimator(kind, label)
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), list(values))
    maps = b.build()
    if sample is not None and sample < len(maps):
        maps = random.Random(seed).sample(maps, sample)
    ev = (BinaryClassificationEvaluator(labelCol=label) if metric == "roc_auc"
          else RegressionEvaluator(labelCol=label, metricName=metric))
    pipeline = Pipeline(stages=[assemble(cols), est])
    held = df.select(fold_col, *dict.fromkeys([*cols, label])).cache()              # many fits read it: no more columns than they need
    try:
        if kind == "gbt_reg" and metric in BOOSTED_LOSSES:
            scores = _boosted_scores(pipeline, held, maps, metric, fold_col, num_folds, parallelism)
            best = min(range(len(maps)), key=lambda i: scores[i])
            model = CrossValidatorModel(pipeline.fit(held, maps[best]), scores)
        else:
            model = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col, numFolds=num_folds,
                                   parallelism=parallelism).fit(held)
    finally:
        held.unpersist()
    rows = []
    for pm, score in zip(maps, model.avgMetrics):
        rows.append((";".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)), float(score)))
    return model, rows


BOOSTED_LOSSES = {"mae": ("absolute", float), "mse": ("squared", float), "rmse": ("squared", math.sqrt)}


def _boosted_scores(pipeline: Pipeline, df: DataFrame, maps, metric: str, fold_col: str, num_folds: int, parallelism: int) -> list[float]:
    """Mean held-out score of every grid point of a boosted regressor.

    Fewer rounds with the same other settings are the first trees of more
    rounds, so one fit and one pass over the held-out rows score all of them.
    """
    est = pipeline.getStages()[-1]
    rounds = [pm.get(est.maxIter, est.getMaxIter()) for pm in maps]
    longest: dict[frozenset, int] = {}
    same = [frozenset((p.name, v) for p, v in pm.items() if p.name != "maxIter") for pm in maps]
    for i, g in enumerate(same):
        if g not in longest or rounds[i] > rounds[longest[g]]:
            longest[g] = i
    loss, made = BOOSTED_LOSSES[metric]
    splits = [(df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)) for f in range(num_folds)]
    for f, (train, test) in enumerate(splits):
        if train.isEmpty() or test.isEmpty():
            raise ValueError(f"fold {f} leaves no rows to fit or to score")

    def one(item):
        (train, test), i = item
        assembler, model = pipeline.fit(train, maps[i]).stages
        return model.evaluateEachIteration(assembler.transform(test), loss)

    items = [(split, i) for split in splits for i in longest.values()]
    found = dict(zip([(f, g) for f in range(num_folds) for g in longest], _parallel(one, items, parallelism)))
    return [sum(made(found[f, g][n - 1]) for f in range(num_folds)) / num_folds for g, n in zip(same, rounds)]


def polynomial(df: DataFrame, cols, degree: int = 2, out: str = "poly") -> DataFrame:
    """``PolynomialFeatures(include_bias=False)`` (L7) as an array column."""
    vec = VectorAssembler(inputCols=list(cols), outputCol="_kvec").transform(df)
    pe = PolynomialExpansion(degree=degree, inputCol="_kvec", outputCol="_kpoly").transform(vec)
    return pe.withColumn(out, vector_to_array("_kpoly")).drop("_kvec", "_kpoly")


def preprocessing(numeric, categorical, out: str = "features") -> Pipeline:
    """``ColumnTransformer``: scale numerics, one-hot categoricals."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_ohe" for c in categorical],
                        handleInvalid="keep")
    num = VectorAssembler(inputCols=list(numeric), outputCol="_knum", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_knum", outputCol="_knum_s", withMean=True, withStd=True)
    allv = VectorAssembler(inputCols=["_knum_s"] + [f"{c}_ohe" for c in categorical], outputCol=out)
    return Pipeline(stages=idx + [ohe, num, scaler, allv])


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (L15) with the ML writer."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
