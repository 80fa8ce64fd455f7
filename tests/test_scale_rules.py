"""Bounds that must not change results: block sizes, frame lengths, value ranges and nulls."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import linear as LN
from kestrel.operators import models as ML
from kestrel.operators import ordering as O
from kestrel.operators import sampling as SP
from kestrel.operators import selection as SEL
from kestrel.operators import stats as ST


def test_rounding_is_half_even_and_passes_every_double(spark):
    values = [0.5, 1.5, 2.5, -0.5, 0.125, 1e19, -1e300, float("inf"), float("nan"), 2.675]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.y for r in df.select(S.rnd("x", 0).alias("y")).collect()]
    for g, w in zip(got, np.round(values)):
        assert g == w or (math.isnan(g) and math.isnan(w))
    assert df.select(S.rnd("x", 2).alias("y")).collect()[4].y == 0.12


def test_quantiles_are_exact_at_any_size(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=3000) * 10.0 ** rng.integers(-5, 6, 3000), "b": rng.integers(-3, 4, 3000).astype(float),
                        "c": np.where(rng.random(3000) < 0.3, np.nan, rng.random(3000)), "d": np.nan})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = ST.quantiles(df, list("abcd"), probs)
    for c in "abc":
        assert np.allclose(got[c], pdf[c].quantile(probs), rtol=1e-12, atol=0)
    assert got["d"] == [None] * len(probs)
    assert ST.quantiles(spark.range(1, 101).select(F.col("id").cast("double").alias("x")), ["x"], [0.5])["x"] == [50.5]


def test_frames_longer_than_a_block(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("v"))
    spark.conf.set("kestrel.window.maxTaskRows", "5")
    try:
        got = O.rolling(df, None, ["id"], 50, {"s": F.sum("v")}, block_rows=10).orderBy("id").collect()
        lag = O.shifted(df, None, ["id"], ["v"], offset=35, block_rows=10).orderBy("id").collect()
        many = O.lags(df, None, ["id"], ["v"], 25, block_rows=10).orderBy("id").collect()
    finally:
        spark.conf.unset("kestrel.window.maxTaskRows")
    assert [r.s for r in got] == [float(sum(range(max(0, i - 49), i + 1))) for i in range(200)]
    assert [r.v_lag1 for r in lag] == [None] * 35 + [float(i) for i in range(165)]
    assert many[60].v_lag25 == 35.0 and many[24].v_lag25 is None


def test_running_sum_over_blocks_of_blocks(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("v"))
    got = O.running_sum(df, ["id"], "v", "s", block_rows=5).orderBy("id").collect()
    assert [r.s for r in got] == list(np.cumsum([i % 7 for i in range(300)]).astype(float))


def test_anova_does_not_depend_on_the_offset(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=400), rng.integers(0, 3, 400)
    x = np.round(x + y * 0.3, 3)
    for offset in (0.0, 1e6, 1e9):
        df = spark.createDataFrame(pd.DataFrame({"x": x + offset, "y": y}))
        got = ST.anova_f(df, ["x"], "y").first()["f"]
        if not offset:
            want = got
        assert math.isclose(got, want, rel_tol=1e-5)


def test_nulls_are_errors_not_lost_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, 5.0)], "x double, y double")
    with pytest.raises(ValueError):
        LN.gram_stats(df, ["x"], "y")
    with pytest.raises(Exception):
        ML.fit("lin_reg", df, ["x"], "y").transform(df).count()


def test_correlated_groups_overlap(spark):
    pairs = spark.createDataFrame([("a", "b", 0, 1, 0.5), ("a", "c", 0, 2, 0.95), ("b", "c", 1, 2, 0.85), ("a", "d", 0, 3, 1.0)],
                                  "feature1 string, feature2 string, i1 int, i2 int, corr double")
    assert SEL.correlated_groups_by_strength(pairs, 0.8) == [["a", "c"], ["b", "c"]]


def test_one_permutation_serves_all_columns(spark):
    df = spark.range(50).select("id", F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    both = SP.permute_columns(df, "id", ["a", "b"], seed=4).orderBy("id").collect()
    one = SP.permute_column(df.select("id", "a"), "id", "a", seed=4).orderBy("id").collect()
    assert [r.a__perm for r in both] == [r.a for r in one] and all(r.b__perm == 2 * r.a__perm for r in both)


def test_elimination_logs_the_drift_of_every_trial(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(300), "x": rng.normal(size=300), "z": rng.normal(size=300)})
    pdf["y"] = (pdf.x + 0.1 * rng.normal(size=300) > 0).astype(int)
    df = SP.fold_column(spark.createDataFrame(pdf), "id", 2)
    splits = [(df.where(f"fold <> {k}"), df.where(f"fold = {k}")) for k in (0, 1)]
    log = ML.recursive_elimination_cv("dt_clf", splits, df, ["x", "z"], "y", "roc_auc", 0.01, maxDepth=2)
    kept = {f: k for f, _, k in log}
    assert kept == {"x": True, "z": False} and log[0][0] == "z" and log[0][1] is not None and log[0][1] < 0.01


def test_suggestion_has_a_relative_tolerance(spark):
    df = spark.createDataFrame([(100000.0, 100000.5), (100.0, 101.0), (100.0, 99.0)], "cur double, pred double")
    got = [r[0] for r in df.select(S.suggestion_text("cur", "pred")).collect()]
    assert got == ["No change", "Increase to 101.00", "Reduce to 99.00"]


def test_json_arrays_hold_every_row(spark, tmp_path):
    from kestrel.plans.q_clean import write_json_arrays
    from kestrel.sources import files
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        path = write_json_arrays(spark.range(0, 95, 1, 2).selectExpr("id", "id / 7 AS x"), str(tmp_path / "arrays"))
    finally:
        spark.conf.set(name, before)
    rows = files.read_json(spark, path, schema="id long, x double", lines=False).collect()
    assert sorted((r.id, r.x) for r in rows) == [(i, i / 7) for i in range(95)]


def test_json_scan_reads_the_whole_view(spark):
    from kestrel.plans import registry
    from kestrel.sources.fixtures import view
    from tests.conftest import SF_SMALL
    registry.load_all()
    out = registry.QUERIES["a04_json_array_scan"](spark, SF_SMALL)
    want = view(spark, SF_SMALL, "metrics").groupBy("controllerName").agg({"cpuUsage": "max"}).collect()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want))
    assert "HashAggregate" in out._jdf.queryExecution().executedPlan().toString()      # summed up after the scan


def test_chi_square_gathers_no_feature_in_one_task(spark):
    from kestrel.operators import stats
    df = spark.range(400).selectExpr("id % 2 AS y", "CAST(id % 3 = 0 AS INT) AS two", "id % 7 AS seven", "id AS own")
    out = stats.chi_square(df, ["two", "seven", "own"], "y")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 1 and "value#" in windows[0].split("], [")[1]
    for r in out.collect():
        cells = {}
        for v in range(400):
            x = {"two": int(v % 3 == 0), "seven": v % 7, "own": v}[r.feature]
            cells[x, v % 2] = cells.get((x, v % 2), 0) + 1
        left = {x: cells.get((x, 0), 0) + cells.get((x, 1), 0) for x, _ in cells}
        gap = {(x, y): abs(cells.get((x, y), 0) - left[x] / 2) for x in left for y in (0, 1)}
        assert abs(r.chi2 - sum(g * g / (left[x] / 2) for (x, _), g in gap.items())) < 1e-9
        yates = sum((g - min(g, 0.5)) ** 2 / (left[x] / 2) for (x, _), g in gap.items()) if len(left) == 2 else r.chi2
        assert abs(r.chi2_yates - yates) < 1e-9 and r.dof == len(left) - 1


def test_a_perfect_pair_stays_out_of_the_strength_groups(spark):
    """Equal columns have r = 1 up to the last bits, whichever way the partial sums are added."""
    import random
    rnd = random.Random(3)
    rows = [(x, x, x + rnd.random() / 4, None if rnd.random() < 0.1 else x) for x in (rnd.random() / 7 for _ in range(4000))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for parts in (1, 3, 7):
        pairs = ST.corr_pairs(df.repartition(parts), ["a", "b", "c", "d"])
        assert pairs.where("abs(corr) > 1").count() == 0
        assert SEL.correlated_groups_by_strength(pairs, 0.999) == []
        groups = SEL.correlated_groups_by_strength(pairs, 0.2)
        assert groups and all("c" in g for g in groups)
