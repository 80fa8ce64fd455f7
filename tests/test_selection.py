"""Planted-truth and hand-computed checks for the selection statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel.functions.distributions import chi2_sf, f_sf
from kestrel.operators import selection as SEL
from kestrel.operators import stats as ST


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    n = 2000
    x = rng.normal(size=n)
    pdf = pd.DataFrame({
        "id": np.arange(n), "x": x, "x_copy": x, "x_corr": 2 * x + rng.normal(scale=0.1, size=n),
        "noise": rng.normal(size=n), "const": 1.0, "quasi": (np.arange(n) % 1000 == 0).astype(float),
        "cat": rng.choice(["a", "b", "c"], n), "y": (x + rng.normal(scale=0.5, size=n) > 0).astype(int)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_constant_quasi_and_duplicates(planted):
    pdf, df = planted
    num = ["x", "x_copy", "x_corr", "noise", "const", "quasi"]
    assert [r[0] for r in SEL.constant_by_std(df, num).collect()] == ["const"]
    q = {r["feature"] for r in SEL.quasi_constant(df, num, 0.998).collect()}
    assert q == {"const", "quasi"}
    dups = {(r[0], r[1]) for r in SEL.duplicate_pairs(df, num, "id").collect()}
    assert dups == {("x_copy", "x")}


def test_correlated_groups(planted):
    pdf, df = planted
    cols = ["x", "x_corr", "noise"]
    pairs = ST.corr_pairs(df, cols)
    got = {(r["feature1"], r["feature2"]): r["corr"] for r in pairs.collect()}
    assert math.isclose(got[("x", "x_corr")], pdf["x"].corr(pdf["x_corr"]), rel_tol=1e-9)
    assert SEL.correlated_groups(pairs, cols, 0.8) == [["x", "x_corr"]]
    sel = SEL.DropCorrelated(0.8).fit(df, cols)
    assert sel.features_to_drop_ == ["x_corr"]


def test_chi_square_two_by_two(spark):
    # the 2x2 table of the slides: 200 / 60 and 100 / 10
    rows = [("g1", 0)] * 200 + [("g1", 1)] * 60 + [("g2", 0)] * 100 + [("g2", 1)] * 10
    df = spark.createDataFrame(rows, "g string, y int")
    r = ST.chi_square(df, ["g"], "y").first()
    assert round(r["chi2"], 3) == 9.857 and round(r["chi2_yates"], 3) == 8.966 and r["dof"] == 1
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(f_sf(10.0, 2, 20), 2 ** -10, rel_tol=1e-9)


def test_anova_and_mi_against_numpy(planted):
    pdf, df = planted
    f = ST.anova_f(df, ["x", "noise"], "y").toPandas().set_index("feature")["f"]
    for c in ("x", "noise"):
        groups = [pdf.loc[pdf.y == k, c].to_numpy() for k in (0, 1)]
        allv = pdf[c].to_numpy()
        ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert math.isclose(f[c], (ssb / 1) / (ssw / (len(allv) - 2)), rel_tol=1e-6)
    mi = ST.mutual_info_discrete(df, ["cat"], "y").first()["mi"]
    ct = pd.crosstab(pdf["cat"], pdf["y"]).to_numpy() / len(pdf)
    px, py = ct.sum(1, keepdims=True), ct.sum(0, keepdims=True)
    exp = float(np.nansum(ct * np.log(ct / (px * py))))
    assert math.isclose(mi, exp, rel_tol=1e-9)


def test_auc_with_ties_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 20, 500).astype(float)
    y = (rng.random(500) < 0.3 + s / 40).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    got = ST.auc_by_group(df, None, "s", "y").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert math.isclose(got, exp, rel_tol=1e-12)


def test_selection_is_invariant_to_partitioning(planted):
    _, df = planted
    num = ["x", "x_copy", "x_corr", "noise", "const", "quasi"]
    a = sorted(r[0] for r in SEL.duplicate_pairs(df.repartition(1), num, "id").collect())
    b = sorted(r[0] for r in SEL.duplicate_pairs(df.repartition(11), num, "id").collect())
    assert a == b == ["x_copy"]
    f1 = ST.anova_f(df.repartition(2), ["x"], "y").first()["f"]
    f2 = ST.anova_f(df.repartition(9), ["x"], "y").first()["f"]
    assert math.isclose(f1, f2, rel_tol=1e-9)


def test_bins_follow_pandas_cut(spark):
    edges = [0.0, 1.0, 2.0, 4.0]
    vals = [-1.0, 0.0, 0.5, 1.0, 1.5, 4.0, 5.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(ST.bin_column("x", edges, "null")).collect()]
    exp = pd.cut(pd.Series(vals, dtype=float), edges, labels=False)
    assert got == [None if pd.isna(e) else int(e) for e in exp]
    clip = [r[0] for r in df.select(ST.bin_column("x", edges, "clip")).collect()]
    assert clip == [0, 0, 0, 0, 1, 2, 2, None]
    assert F is not None


def test_one_pass_correlation_matches_pandas(spark):
    rng = np.random.default_rng(9)
    n, p = 800, 6
    X = rng.normal(size=(n, p)) * 50 + 1000
    X[:, 1] = X[:, 0] * 0.5 + rng.normal(size=n)
    X[rng.random((n, p)) < 0.15] = np.nan
    pdf = pd.DataFrame(X, columns=[f"c{i}" for i in range(p)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"c{i} double" for i in range(p)))
    a = {(r[0], r[1]): r[4] for r in ST.corr_pairs(df, list(pdf.columns)).collect()}
    exp = pdf.corr()
    for (f1, f2), v in a.items():
        assert math.isclose(v, exp.loc[f1, f2], rel_tol=1e-9, abs_tol=1e-12)
