"""Property tests: the distributed window equals pandas for any block size,
key skew and partitioning."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.operators import ordering as O


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(20, 400), block=st.integers(7, 200), frame=st.integers(1, 6), hot=st.floats(0.0, 0.9),
       parts=st.integers(1, 9), seed=st.integers(0, 10_000))
def test_rolling_equals_pandas(spark, n, block, frame, hot, parts, seed):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys, "t": rng.integers(0, 50, n), "v": rng.normal(size=n).round(4)})
    df = spark.createDataFrame(pdf).repartition(parts)
    out = O.rolling(df, "k", ["t", "id"], frame, {"s": F.sum("v"), "m": F.min("v")}, block_rows=block).toPandas()
    s = pdf.sort_values(["k", "t", "id"])
    s["s"] = s.groupby("k")["v"].transform(lambda x: x.rolling(frame, min_periods=1).sum())
    s["m"] = s.groupby("k")["v"].transform(lambda x: x.rolling(frame, min_periods=1).min())
    m = s.merge(out, on="id", suffixes=("", "_got"))
    assert len(m) == n
    assert np.allclose(m["s"], m["s_got"]) and np.allclose(m["m"], m["m_got"])
