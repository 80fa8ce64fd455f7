"""Distributed order-dependent operators against pandas brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kestrel.operators import ordering as O


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    # one key holds a third of all rows
    keys = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b", "c", "d"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys, "t": rng.permutation(n), "v": rng.normal(size=n).round(3)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_global_index_is_a_permutation_in_order(spark):
    pdf, df = _skewed(spark)
    out = O.with_global_index(df, ["k", "t", "id"]).toPandas()
    exp = pdf.sort_values(["k", "t", "id"]).reset_index(drop=True)
    got = out.sort_values(O.IDX).reset_index(drop=True)
    assert list(got[O.IDX]) == list(range(len(pdf)))
    assert list(got["id"]) == list(exp["id"])


def test_rolling_matches_pandas_across_block_borders(spark):
    pdf, df = _skewed(spark)
    out = O.rolling(df, "k", ["t", "id"], 5, {"m": F.avg("v"), "x": F.max("v")}, block_rows=97).toPandas()
    s = pdf.sort_values(["k", "t", "id"])
    s["m"] = s.groupby("k")["v"].transform(lambda x: x.rolling(5, min_periods=1).mean())
    s["x"] = s.groupby("k")["v"].transform(lambda x: x.rolling(5, min_periods=1).max())
    m = s.merge(out, on="id", suffixes=("", "_s"))
    assert len(m) == len(pdf)
    assert np.allclose(m["m"], m["m_s"]) and np.allclose(m["x"], m["x_s"])


def test_global_rolling_and_lag(spark):
    pdf, df = _skewed(spark, 500)
    out = O.rolling(df, None, ["t", "id"], 3, {"m": F.avg("v")}, block_rows=31).toPandas()
    s = pdf.sort_values(["t", "id"])
    s["m"] = s["v"].rolling(3, min_periods=1).mean()
    m = s.merge(out, on="id", suffixes=("", "_s"))
    assert np.allclose(m["m"], m["m_s"])
    lag = O.shifted(df, "k", ["t", "id"], ["v"], block_rows=29).toPandas()
    s = pdf.sort_values(["k", "t", "id"])
    s["v_lag1"] = s.groupby("k")["v"].shift(1)
    m = s.merge(lag, on="id", suffixes=("", "_s"))
    assert ((m["v_lag1"] == m["v_lag1_s"]) | (m["v_lag1"].isna() & m["v_lag1_s"].isna())).all()


def test_running_sum_and_first_n(spark):
    pdf, df = _skewed(spark, 800)
    out = O.running_sum(df, [F.col("v").desc(), F.col("id")], "v", "cum", block_rows=53).toPandas()
    s = pdf.sort_values(["v", "id"], ascending=[False, True])
    s["cum"] = s["v"].cumsum()
    m = s.merge(out, on="id", suffixes=("", "_s"))
    assert np.allclose(m["cum"], m["cum_s"])
    head = O.first_n(df, ["t", "id"], fraction=0.8).toPandas()
    assert sorted(head["id"]) == sorted(pdf.sort_values(["t", "id"]).head(int(len(pdf) * 0.8))["id"])


def test_lags_multiple_offsets(spark):
    pdf, df = _skewed(spark, 400)
    out = O.lags(df, "k", ["t", "id"], ["v"], 3, block_rows=37).toPandas()
    s = pdf.sort_values(["k", "t", "id"])
    for k in (1, 2, 3):
        s[f"e{k}"] = s.groupby("k")["v"].shift(k)
    m = s.merge(out, on="id")
    for k in (1, 2, 3):
        a, b = m[f"e{k}"], m[f"v_lag{k}"]
        assert ((a == b) | (a.isna() & b.isna())).all()
