"""Paths of penalised models against their optimality conditions and plain solvers."""

import numpy as np
import pandas as pd
import pytest

from kestrel.operators import linear as LN
from kestrel.operators import penalties as PN

from .test_histtrees import jobs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 5)) * [1, 5, 0.2, 3, 1] + [10, -3, 0, 100, 2]
    x[:, 1] += 3 * x[:, 0]
    z = (x - x.mean(0)) / x.std(0)
    m = 1.5 * z[:, 0] - z[:, 2] + 0.2
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["y"] = 4 * z[:, 0] - 2 * z[:, 3] + rng.normal(size=800)
    pdf["t"] = (rng.random(800) < 1 / (1 + np.exp(-m))).astype(int)
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("standardise", [True, False])
def test_lasso_meets_the_optimality_conditions(data, standardise):
    pdf, df = data
    x, y = pdf[list("abcde")].to_numpy(), pdf["y"].to_numpy()
    x = (x - x.mean(0)) / (x.std(0) if standardise else 1)
    alphas = [0.01, 3.0, 0.5, 100.0]
    path = PN.lasso_path(LN.gram_stats(df, list("abcde"), "y"), alphas, standardise)
    assert [f.penalty for f in path] == alphas
    for f in path:
        beta = np.array(list(f.coef.values()))
        slope = x.T @ (y - y.mean() - x @ beta) / len(y)
        assert np.allclose(slope[beta != 0], f.penalty * np.sign(beta[beta != 0]), atol=1e-6)
        assert (np.abs(slope[beta == 0]) <= f.penalty + 1e-6).all()
        raw = pdf[list("abcde")].to_numpy() @ (beta / (pdf[list("abcde")].to_numpy().std(0) if standardise else 1))
        assert abs(f.intercept - (y - raw).mean()) < 1e-6
    assert all(v == 0 for v in path[3].coef.values()) and sum(v != 0 for v in path[0].coef.values()) >= 4


def test_logistic_paths_meet_the_optimality_conditions(data):
    pdf, df = data
    x, t = pdf[list("abcde")].to_numpy(), pdf["t"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    l2, l1 = PN.logistic_path(df, list("abcde"), "t", l2=[0.001, 1.0, 100.0, 1e4], l1=[0.5, 20.0, 1e5], standardise=True)
    for f, sharp in [(f, False) for f in l2] + [(f, True) for f in l1]:
        beta = np.array(list(f.coef.values()))
        m = x @ (beta / x.std(0)) + f.intercept
        slope = z.T @ (t - 1 / (1 + np.exp(-m)))
        assert abs((t - 1 / (1 + np.exp(-m))).sum()) < 1e-4
        if sharp:
            assert np.allclose(slope[beta != 0], f.penalty * np.sign(beta[beta != 0]), atol=1e-4)
            assert (np.abs(slope[beta == 0]) <= f.penalty + 1e-4).all()
        else:
            assert np.allclose(slope, f.penalty * beta, atol=1e-4)
    assert all(v == 0 for v in l1[2].coef.values()) and not any(v == 0 for f in l2 for v in f.coef.values())
    sizes = [sum(abs(v) for v in f.coef.values()) for f in l2]
    assert sizes == sorted(sizes, reverse=True)


def test_passes_do_not_grow_with_the_penalties(spark, data):
    df = data[1]
    penalties = [1000.0, 100.0, 10.0, 1.0, 0.1]
    alone = max(jobs(spark, lambda w=w: PN.logistic_path(df, list("abcde"), "t", l2=[w], standardise=True)) for w in penalties)
    assert jobs(spark, lambda: PN.logistic_path(df, list("abcde"), "t", l2=penalties, standardise=True)) == alone > 0
    g = LN.gram_stats(df, list("abcde"), "y")
    assert jobs(spark, lambda: PN.lasso_path(g, np.geomspace(10, 1e-3, 50).tolist())) == 0


def test_nulls_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1, 1.0), (2.0, 5.0, 0, 2.0), (3.0, 5.0, 1, 4.0), (4.0, 5.0, 0, 3.0)], "x double, k double, t int, y double")
    (fit,), _ = PN.logistic_path(df, ["x", "k"], "t", l2=[1.0], standardise=True)
    assert fit.coef["k"] == 0 and fit.coef["x"] < 0
    assert PN.lasso_path(LN.gram_stats(df, ["x", "k"], "y"), [0.1])[0].coef["k"] == 0
    with pytest.raises(ValueError):
        PN.logistic_path(df.selectExpr("nullif(x, 1) x", "t"), ["x"], "t", l2=[1.0])
