"""Gram-based linear scores and per-key forecasts against brute force."""

import math

import numpy as np
import pandas as pd

from kestrel.operators import forecast as FC
from kestrel.operators import linear as LN
from kestrel.operators.sampling import fold_column


def _lin(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4))
    y = 3 + X @ np.array([1.5, -2.0, 0.0, 0.5]) + rng.normal(scale=0.3, size=n)
    pdf = pd.DataFrame(X, columns=["a", "b", "c", "d"]).assign(y=y, id=np.arange(n))
    return pdf, spark.createDataFrame(pdf)


def test_insample_r2_and_coefficients(spark):
    pdf, df = _lin(spark)
    g = LN.gram_stats(df, ["a", "b", "c", "d"], "y")
    for sub in (["a"], ["a", "b"], ["a", "b", "c", "d"]):
        X = np.column_stack([np.ones(len(pdf)), pdf[sub].to_numpy()])
        beta, *_ = np.linalg.lstsq(X, pdf["y"].to_numpy(), rcond=None)
        res = pdf["y"].to_numpy() - X @ beta
        r2 = 1 - (res ** 2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum()
        assert math.isclose(LN.r2_insample(g, sub), r2, rel_tol=1e-9)
    coef = LN.coefficients(g)
    X = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c", "d"]].to_numpy()])
    beta, *_ = np.linalg.lstsq(X, pdf["y"].to_numpy(), rcond=None)
    assert math.isclose(coef["intercept"], beta[0], rel_tol=1e-9)
    assert np.allclose([coef[c] for c in "abcd"], beta[1:])


def test_cv_r2_matches_refits(spark):
    pdf, df = _lin(spark)
    df = fold_column(df, "id", 3)
    g = LN.gram_stats(df, ["a", "b"], "y", "fold")
    folds = df.select("id", "fold").toPandas().set_index("id")["fold"]
    pdf = pdf.assign(fold=pdf["id"].map(folds))
    scores = []
    for k in range(3):
        tr, te = pdf[pdf.fold != k], pdf[pdf.fold == k]
        X = np.column_stack([np.ones(len(tr)), tr[["a", "b"]]])
        beta, *_ = np.linalg.lstsq(X, tr["y"], rcond=None)
        pred = np.column_stack([np.ones(len(te)), te[["a", "b"]]]) @ beta
        scores.append(1 - ((te["y"] - pred) ** 2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum())
    assert math.isclose(LN.r2_cv(g, ["a", "b"]), float(np.mean(scores)), rel_tol=1e-9)
    steps = LN.forward_select(g, 2, cv=True)
    assert [s[1] for s in steps] == ["b", "a"]
    ex = LN.exhaustive_scores(spark, g, 1, 2, cv=True).toPandas().set_index("subset")["r2"]
    assert math.isclose(ex["a,b"], LN.r2_cv(g, ["a", "b"]), rel_tol=1e-12)


def test_arima_matches_numpy_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("k1", 400), ("k2", 60), ("short", 3)):
        e = rng.normal(size=n + 1)
        w = np.zeros(n)
        for t in range(1, n):
            w[t] = 0.5 * w[t - 1] + e[t] + 0.3 * e[t - 1]
        y = 10 + np.cumsum(w)
        rows += [(key, i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), float(y[i])) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["k", "id", "ts", "y"])
    df = spark.createDataFrame(pdf).repartition(3)
    out = FC.arima111_forecast(df, "k", "ts", "id", "y", steps=3).toPandas()
    assert set(out["k"]) == {"k1", "k2"}
    for key in ("k1", "k2"):
        y = pdf[pdf.k == key].sort_values("id")["y"].to_numpy()
        w = np.diff(y)
        p = 5
        g = np.array([np.dot(w[k:], w[:len(w) - k]) for k in range(p + 1)])
        a = FC._levinson(g, p)
        ww = np.concatenate([np.zeros(p + 1), w])
        e = np.array([ww[t] - sum(a[i] * ww[t - i - 1] for i in range(p)) for t in range(p + 1, len(ww))])
        X = np.column_stack([w[:-1], e[:-1]])
        phi, theta = np.linalg.solve(X.T @ X, X.T @ w[1:])
        phi = min(max(phi, -0.99), 0.99)
        w1 = phi * w[-1] + theta * e[-1]
        exp = [y[-1] + w1 * (1 - phi ** h) / (1 - phi) for h in (1, 2, 3)]
        got = out[out.k == key].sort_values("step")["forecast"].to_numpy()
        assert np.allclose(got, exp, rtol=1e-8), (key, got, exp)


def test_future_frame_counts(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "b"], "ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-05"])})
    out = FC.future_frame(spark.createDataFrame(pdf), "k", "ts", 3, 86400).toPandas()
    assert len(out) == 3 + 6
    assert out[(out.k == "b") & out.is_future]["ts"].max() == pd.Timestamp("2024-01-08")


def test_exhaustive_scores_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    pdf, df = _lin(spark, 600)
    g = LN.gram_stats(df, ["a", "b", "c", "d"], "y")
    small = LN.exhaustive_scores(spark, g, 1, 3).toPandas().set_index("subset")["r2"]
    monkeypatch.setattr(LN, "SUBSETS_PER_TASK", 2)
    big = LN.exhaustive_scores(spark, g, 1, 3).toPandas().set_index("subset")["r2"]
    assert len(small) == len(big) == 14
    assert all(math.isclose(small[k], big[k], rel_tol=1e-12) for k in small.index)


def test_additive_forecast_equals_a_plain_solve(spark):
    """Every key alone: terms in numpy, shrunken normal equations, and recovery of a bend and of both seasons."""
    import datetime as dt

    rng = np.random.default_rng(4)
    begin, rows, model = dt.datetime(2024, 1, 1), [], FC.Additive(hinge_prior=5.0)
    for key in ("a", "b"):
        for h in range(24 * 35):
            days = h / 24
            y = 10 + 0.2 * days + (days > 14) * -0.5 * (days - 14) + 2 * np.sin(2 * np.pi * days) + (key == "b") * 3 * np.cos(2 * np.pi * days / 7)
            rows.append((key, begin + dt.timedelta(hours=h), float(y + 0.05 * rng.normal()) if h % 50 else None))
    rows += [("one", begin, 1.0), ("zero", begin, 0.0), ("zero", begin + dt.timedelta(days=1), 0.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double").repartition(5)
    got = {(r.k, r.ds): r for r in FC.additive_forecast(df, "k", "ts", "y", periods=48, model=model).collect()}
    assert {k for k, _ in got} == {"a", "b", "zero"} and all(abs(r.yhat) < 1e-9 for (k, _), r in got.items() if k == "zero")
    for key in ("a", "b"):
        mine = [(t, y) for k, t, y in rows if k == key and y is not None]
        us = np.array([(t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 for t, _ in mine])
        y = np.array([v for _, v in mine])
        top = np.abs(y).max()

        def terms(at):
            t, days = (at - us.min()) / (us.max() - us.min()), at / 86400e6
            x = [np.ones(len(at)), t] + [np.maximum(t - h, 0) for h in model.hinges]
            for period, k in model.waves:
                x += [np.sin(2 * np.pi * k * days / period), np.cos(2 * np.pi * k * days / period)]
            return np.stack(x, axis=1)
        x = terms(us)
        ridge = np.array([0 if s is None else 1 / s ** 2 for s in model.priors]) * ((y / top).var() + 1e-9)
        beta = np.linalg.solve(x.T @ x + np.diag(ridge), x.T @ (y / top))
        ahead = [k for k in got if k[0] == key]
        at = np.array([(t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 for _, t in ahead])
        want = terms(at) @ beta * top
        assert np.allclose([got[k].yhat for k in ahead], want, atol=1e-6)
        future = sorted(t for k, t in ahead if got[k, t].is_future)
        assert len(future) == 48
        for t in future:
            days = (t - begin).total_seconds() / 86400
            true = 10 + 0.2 * days - 0.5 * (days - 14) + 2 * np.sin(2 * np.pi * days) + (key == "b") * 3 * np.cos(2 * np.pi * days / 7)
            assert abs(got[key, t].yhat - true) < 1.0


def plain_css(y, phi, theta):
    """``(sum of squares, last residual)`` by the recursion over the differences."""
    w = np.diff(y)
    e = total = 0.0
    for t in range(1, len(w)):
        e = w[t] - phi * w[t - 1] - theta * e
        total += e * e
    return total, e


def test_css_equals_the_plain_recursion_in_any_blocks(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key, (phi, theta, n) in {"a": (0.6, 0.3, 300), "b": (-0.5, -0.2, 90), "c": (0.2, -0.7, 41), "d": (0, 0, 4)}.items():
        w = e0 = 0.0
        y = 5.0
        for t in range(n):
            e = rng.normal()
            w, e0 = phi * w + e + theta * e0, e
            y += w
            rows.append((key, t, t, float(y)))
    rows += [("few", t, t, 1.0) for t in range(3)] + [("a", 1000, 1000, None)]
    df = spark.createDataFrame(rows, "k string, ts int, tie int, y double").repartition(4)
    whole = {(r.k, r.step): r for r in FC.arima111_css(df, "k", "ts", "tie", "y").collect()}
    cut = {(r.k, r.step): r for r in FC.arima111_css(df, "k", "ts", "tie", "y", block_rows=6).collect()}          # three levels of blocks
    assert {k for k, _ in whole} == {"a", "b", "c", "d"} and set(whole) == set(cut)
    start = {(r.k, r.step): r for r in FC.arima111_forecast(df, "k", "ts", "tie", "y").collect()}
    for (key, step), r in whole.items():
        assert math.isclose(r.phi, cut[key, step].phi, abs_tol=1e-12) and math.isclose(r.forecast, cut[key, step].forecast, abs_tol=1e-9)
        y = np.array([v for k, _, _, v in rows if k == key and v is not None])
        sse, e = plain_css(y, r.phi, r.theta)
        assert math.isclose(r.sse, sse, rel_tol=1e-9)
        value, w = y[-1], y[-1] - y[-2]
        for h in range(step):
            w = r.phi * w + (r.theta * e if h == 0 else 0.0)
            value += w
        assert math.isclose(r.forecast, value, abs_tol=1e-9)
        if key != "d":
            assert sse <= plain_css(y, start[key, 1].phi, start[key, 1].theta)[0] * (1 + 1e-6)
            near = [plain_css(y, r.phi + a, r.theta + b)[0] for a in (-0.002, 0, 0.002) for b in (-0.002, 0, 0.002)
                    if max(abs(r.phi + a), abs(r.theta + b)) < 0.99]
            assert sse <= min(near) * (1 + 1e-5)
