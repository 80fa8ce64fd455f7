"""Model helpers: metrics against numpy, a small fit, persistence."""

import math
import os
import tempfile

import numpy as np
import pandas as pd

from kestrel.operators import models as ML
from kestrel.operators import sampling as SP


def test_regression_metrics_and_report(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=300) + 5
    p = y + rng.normal(scale=0.3, size=300)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    m = ML.regression_metrics(df, "y", "p").first()
    assert math.isclose(m["mse"], float(np.mean((y - p) ** 2)), rel_tol=1e-9)
    assert math.isclose(m["mae"], float(np.mean(np.abs(y - p))), rel_tol=1e-9)
    assert math.isclose(m["r2"], 1 - np.mean((y - p) ** 2) / np.var(y), rel_tol=1e-9)
    assert math.isclose(ML.mape(df, "y", "p").first()["mape"], float(np.mean(np.abs((y - p) / y)) * 100), rel_tol=1e-9)
    yy = rng.integers(0, 2, 200)
    pp = np.where(rng.random(200) < 0.8, yy, 1 - yy)
    rep = {r["cls"]: r for r in ML.classification_report(
        spark.createDataFrame(pd.DataFrame({"y": yy, "p": pp})), "y", "p").collect()}
    tp = int(((yy == 1) & (pp == 1)).sum())
    assert math.isclose(rep[1]["precision"], tp / (pp == 1).sum()) and math.isclose(rep[1]["recall"], tp / (yy == 1).sum())


def test_fit_score_and_persist(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=(x[:, 0] > 0).astype(int), id=np.arange(400))
    df = spark.createDataFrame(pdf)
    m = ML.fit("dt_clf", df, ["a", "b", "c"], "y", maxDepth=2)
    assert ML.metric_value("dt_clf", m.transform(df), "y", "roc_auc") > 0.95
    imp = ML.importance_table(m, ["a", "b", "c"])
    assert imp[0][0] == "a"
    path = os.path.join(tempfile.mkdtemp(prefix="kestrel-model-"), "m")
    back = ML.load_model(ML.save_model(m, path))
    a = m.transform(df).select("prediction").toPandas()
    b = back.transform(df).select("prediction").toPandas()
    assert a.equals(b)


def test_permutation_drift_equals_one_column_at_a_time(spark):
    """One scoring pass for all columns gives what scoring each permuted table gives, in as many jobs at any width."""
    from .test_histtrees import jobs
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({c: rng.normal(size=400) for c in "abcdefgh"})
    pdf["id"], pdf["y"], pdf["t"] = range(400), 3 * pdf.a - pdf.b + 0.1 * rng.normal(size=400), (pdf.a + 0.3 * pdf.c > 0).astype(int)
    df = spark.createDataFrame(pdf)
    for kind, label, metric in (("lin_reg", "y", "rmse"), ("log_reg", "t", "roc_auc"), ("dt_clf", "t", "roc_auc")):
        got = {r.feature: r.drift for r in ML.permutation_drift(kind, df, list("abc"), label, "id", metric, seed=3).collect()}
        model = ML.fit(kind, df, list("abc"), label)
        base = ML.metric_value(kind, model.transform(df), label, metric)
        for c in "abc":
            one = SP.permute_column(df, "id", c, seed=3)
            assert abs(got[c] - (base - ML.metric_value(kind, model.transform(one), label, metric))) < 1e-9
    few = jobs(spark, lambda: ML.permutation_drift("lin_reg", df, list("ab"), "y", "id", "rmse"))
    assert jobs(spark, lambda: ML.permutation_drift("lin_reg", df, list("abcdefgh"), "y", "id", "rmse")) == few > 0


def test_rounds_of_a_boosted_grid_come_from_one_fit(spark, monkeypatch):
    """Same scores and choice as a cross-validator that fits every point, with a fit for each other setting only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x[:, 0] ** 2 + x[:, 1], "fold": np.arange(300) % 2, "other": "text"}))
    df = df.withColumn("fold", df["fold"].cast("int")).coalesce(1)
    est = ML.estimator("gbt_reg", "y")
    maps = ParamGridBuilder().addGrid(est.maxDepth, [2]).addGrid(est.maxIter, [1, 3]).build()
    want = CrossValidator(estimator=Pipeline(stages=[ML.assemble(["a", "b"]), est]), estimatorParamMaps=maps, foldCol="fold", numFolds=2,
                          evaluator=RegressionEvaluator(labelCol="y", metricName="mae")).fit(df).avgMetrics
    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a, **b: fits.append(1) or fit(self, *a, **b))
    model, rows = ML.grid_search("gbt_reg", df, ["a", "b"], "y", {"maxDepth": [2], "maxIter": [1, 3]}, metric="mae", num_folds=2)
    assert np.allclose([r[1] for r in rows], want, rtol=1e-12) and len(model.bestModel.stages[-1].trees) == 3
    # A pipeline with a parameter map fits a copy of itself; 2 folds and the best point.
    assert len(fits) <= 2 * 3


def test_the_side_by_side_frame_is_made_once(spark, monkeypatch):
    from kestrel.plans import q_models as Q
    made = Q._metrics_frame(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(Q, "_metrics_frame", lambda s, d: made)
    Q.l16_models_side_by_side(spark, "/root/testdata/sf0.001")
    assert Q._HELD and Q._HELD[-1].storageLevel.useMemory and set(Q._HELD[-1].columns) == {"key", *Q.MCOLS, "cpuUsage", "memUsage"}
