"""Hand cases from SURVEY section 5: an exactly linear target and selector
properties (subset of the inputs, idempotent)."""

import math

import numpy as np
import pandas as pd

from kestrel.operators import linear as LN
from kestrel.operators import selection as SEL


def test_exactly_linear_target(spark):
    # The five-row training file of the capacity scripts
    # (feature1..feature3 move together, target = 10 * row number).
    rows = [(1, 2, 3, 10), (4, 5, 6, 20), (7, 8, 9, 30), (10, 11, 12, 40), (13, 14, 15, 50)]
    df = spark.createDataFrame(rows, "feature1 int, feature2 int, feature3 int, target int")
    g = LN.gram_stats(df, ["feature1"], "target")
    assert math.isclose(LN.r2_insample(g, ["feature1"]), 1.0, rel_tol=1e-12)
    c = LN.coefficients(g)
    assert math.isclose(c["feature1"], 10 / 3, rel_tol=1e-12)
    assert math.isclose(c["intercept"], 10 - 10 / 3, rel_tol=1e-12)
    # the three features are exact copies up to a shift: all pairs correlate at 1
    sel = SEL.DropCorrelated(0.8).fit(df, ["feature1", "feature2", "feature3"])
    assert sel.features_to_drop_ == ["feature2", "feature3"]


def test_selector_chain_is_a_subset_and_idempotent(spark):
    rng = np.random.default_rng(12)
    n = 1500
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "x2": x, "z": 3 * x + rng.normal(scale=0.01, size=n),
                        "w": rng.normal(size=n), "c": 2.0})
    df = spark.createDataFrame(pdf)
    cols = ["x", "x2", "z", "w", "c"]

    def chain():
        return SEL.SelectorChain([SEL.DropConstant(tol=0.998), SEL.DropDuplicates("id"), SEL.DropCorrelated(0.8)])

    first = chain().fit(df, cols)
    kept = first.transform(df)
    assert set(kept.columns) <= set(df.columns)
    assert [c for c in cols if c in kept.columns] == ["x", "w"]
    again = chain().fit(kept, [c for c in cols if c in kept.columns])
    assert again.features_to_drop_ == []
