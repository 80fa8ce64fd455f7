"""Wide tables in a fixed number of passes, and wrapper searches with any scorer."""

import itertools
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kestrel.operators import linear as LN
from kestrel.operators import models as ML
from kestrel.operators import stats as ST
from kestrel.operators import wrapper as W
from kestrel.operators.sampling import fold_column
from tests.conftest import SF_SMALL


def test_subsets_by_number():
    for n, low, high in ((5, 1, 3), (6, 2, 2), (4, 1, 4)):
        want = [list(c) for k in range(low, high + 1) for c in itertools.combinations(range(n), k)]
        assert W.n_subsets(n, low, high) == len(want)
        assert [W.subset_at(n, low, i) for i in range(len(want))] == want


def test_exhaustive_linear_over_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(200, 6)), columns=list("abcdey"))
    g = LN.gram_stats(spark.createDataFrame(pdf), list("abcde"), "y")
    monkeypatch.setattr(LN, "SUBSETS_PER_TASK", 4)
    got = {r.subset: r.r2 for r in LN.exhaustive_scores(spark, g, 1, 3).collect()}
    assert len(got) == W.n_subsets(5, 1, 3)
    for subset, r2 in got.items():
        x = np.column_stack([np.ones(200), pdf[subset.split(",")]])
        left = pdf.y - x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]
        assert math.isclose(r2, 1 - (left ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum(), abs_tol=1e-9)


def wide_frame(spark, p):
    """``p`` numeric columns from lineitem and orders expressions."""
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    cols = [(F.col(base[i % 5]).cast("double") * (i + 1) + F.col(base[(i // 5) % 5]).cast("double")).alias(f"x{i}") for i in range(p)]
    return li.select(*cols, F.col("l_extendedprice").cast("double").alias("y"))


def jobs(spark, run):
    sc = spark.sparkContext
    group = f"count-{uuid.uuid4()}"
    sc.setJobGroup(group, "")
    try:
        run()
    finally:
        n = len(sc.statusTracker().getJobIdsForGroup(group))
        sc._jsc.clearJobGroup()
    return n


def test_number_of_jobs_does_not_grow_with_the_columns(spark):
    few, many = wide_frame(spark, 6), wide_frame(spark, 300)
    a, b = [f"x{i}" for i in range(6)], [f"x{i}" for i in range(300)]
    for run in (lambda df, c: ST.column_moments(df, c), lambda df, c: ST.corr_with(df, c, "y"), lambda df, c: ST.corr_pairs(df, c),
                lambda df, c: ST.f_regression(df, c, "y"), lambda df, c: LN.gram_stats(df, c, "y")):
        assert jobs(spark, lambda: run(few, a)) == jobs(spark, lambda: run(many, b)) <= 6
    pdf = many.select("x7", "x123", "y").toPandas()
    got = {r.feature: r for r in ST.column_moments(many, b).collect()}
    assert math.isclose(got["x123"].std, pdf.x123.std(), rel_tol=1e-9) and got["x7"].min == pdf.x7.min()
    assert math.isclose({r.feature: r.corr for r in ST.corr_with(many, b, "y").collect()}["x123"], pdf.x123.corr(pdf.y), rel_tol=1e-9)


def test_model_scored_searches_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(240), **{c: rng.normal(size=240) for c in "abc"}})
    pdf["y"] = (pdf.a + 0.5 * pdf.b + 0.2 * rng.normal(size=240) > 0).astype(int)
    df = fold_column(spark.createDataFrame(pdf), "id", 2).cache()
    score = ML.subset_scorer("dt_clf", df, "y", "roc_auc", maxDepth=2)

    def alone(cols):
        return float(np.mean(ML.cv_score("dt_clf", df, list(cols), "y", "roc_auc", maxDepth=2)))
    every = {tuple(c): alone(c) for k in (1, 2, 3) for c in itertools.combinations("abc", k)}
    assert {tuple(c): s for c, s in W.exhaustive(list("abc"), score, 1, 3)} == every
    steps = W.forward(list("abc"), score, 2)
    first = max("abc", key=lambda c: every[(c,)])
    assert steps[0][1] == first and steps[0][2] == every[(first,)]
    pairs = {c: every[tuple(sorted((first, c)))] for c in "abc" if c != first}
    assert steps[1][2] == max(pairs.values())
    kept, removed = W.backward(list("abc"), score, 2)
    assert removed[0][2] == max(every[p] for p in itertools.combinations("abc", 2)) and len(kept) == 2
    df.unpersist()


def test_pair_counts_take_one_pass_at_any_width(spark):
    from kestrel.operators import mrmr as MR

    from .test_histtrees import jobs
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({f"x{i}": rng.integers(0, 4 + i % 3, 300) for i in range(108)})
    pdf["x3"] = pdf.x1 % 2
    pdf["holes"] = np.where(rng.random(300) < 0.2, None, pdf.x1)
    df = spark.createDataFrame(pdf.astype({"holes": "Int64"}))
    cols = list(pdf.columns)
    got = {}
    few = jobs(spark, lambda: MR.redundancy_mi(df, cols[:3], discrete=cols[:3]))
    assert jobs(spark, lambda: got.update(MR.redundancy_mi(df, cols, discrete=cols))) == few > 0
    assert len(got) == len(cols) * (len(cols) - 1)
    for a in ("x1", "x5"):
        later = cols[cols.index(a) + 1:]
        for r in ST.mutual_info_discrete(df, later, a).collect():
            assert math.isclose(got[a, r.feature], r.mi, abs_tol=1e-9)
    old = MR.WIDE
    try:
        MR.WIDE = 4                      # columns of 5 and 6 values take jobs of their own
        again = MR.redundancy_mi(df, cols[:8], discrete=cols[:8])
    finally:
        MR.WIDE = old
    assert all(math.isclose(v, got[k], abs_tol=1e-9) for k, v in again.items()) and len(again) == 56
