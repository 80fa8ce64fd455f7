"""Category codes (both size paths), splits and permutations."""

import numpy as np
import pandas as pd

from kestrel.operators import encoding as EN
from kestrel.operators import sampling as SP


def _frame(spark, n=600):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.choice(["x", "y", "z", "w"], n),
                        "b": rng.choice(["p", "q", None], n), "v": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_codes_small_and_distributed_paths_agree(spark, monkeypatch):
    pdf, df = _frame(spark)
    small = EN.ordinal_codes(df, ["a", "b"]).select("id", "cat_a", "cat_b").toPandas().sort_values("id")
    monkeypatch.setattr(EN, "SMALL_CODE_TABLE", 2)   # forces the distributed index path
    big = EN.ordinal_codes(df, ["a", "b"]).select("id", "cat_a", "cat_b").toPandas().sort_values("id")
    assert small.equals(big)
    exp = pdf["a"].astype("category").cat.codes
    assert list(small["cat_a"]) == list(exp.loc[small["id"]])
    assert small.loc[pdf["b"].isna().to_numpy()[small["id"]], "cat_b"].isna().all()


def test_split_is_repeatable_and_partition_free(spark):
    _, df = _frame(spark)
    a = SP.random_split(df.repartition(1), "id", 30, seed=3).select("id", "is_test").toPandas().sort_values("id").reset_index(drop=True)
    b = SP.random_split(df.repartition(9), "id", 30, seed=3).select("id", "is_test").toPandas().sort_values("id").reset_index(drop=True)
    assert a.equals(b)
    assert 0.2 < a["is_test"].mean() < 0.4


def test_permutation_keeps_values(spark):
    pdf, df = _frame(spark)
    out = SP.permute_column(df, "id", "v", seed=1).toPandas()
    assert sorted(out["v"]) == sorted(pdf["v"])
    assert sorted(out["id"]) == sorted(pdf["id"])
    assert (out.sort_values("id")["v"].to_numpy() != pdf.sort_values("id")["v"].to_numpy()).mean() > 0.9
    sample = SP.seeded_sample(df, "id", 50, seed=2).toPandas()
    again = SP.seeded_sample(df.repartition(3), "id", 50, seed=2).toPandas()
    assert sorted(sample["id"]) == sorted(again["id"]) and len(sample) == 50


def test_numeric_codes_follow_size_on_both_paths(spark, monkeypatch):
    rows = [(i, v, w, t) for i, (v, w, t) in enumerate([(10, 2.5, "b"), (9, float("nan"), "a"), (-3, -1.0, "10"), (None, None, None), (9, 2.5, "9"), (100, 0.0, "b")])]
    df = spark.createDataFrame(rows, "id int, n long, x double, t string")
    want = {0: (2, 2, 3), 1: (1, 3, 2), 2: (0, 0, 0), 3: (None, None, None), 4: (1, 2, 1), 5: (3, 1, 3)}
    for limit in (EN.SMALL_CODE_TABLE, 2):
        monkeypatch.setattr(EN, "SMALL_CODE_TABLE", limit)
        got = {r.id: (r.cat_n, r.cat_x, r.cat_t) for r in EN.ordinal_codes(df, ["n", "x", "t"]).collect()}
        assert got == want


def test_stratified_folds_are_balanced(spark):
    from collections import Counter

    from kestrel.operators import sampling
    df = spark.range(503).selectExpr("id", "CASE WHEN id % 17 = 0 THEN 'rare' WHEN id % 50 = 1 THEN NULL ELSE 'common' END AS label")
    for seed in (None, 3):
        rows = sampling.stratified_folds(df, "id", "label", 4, seed).collect()
        assert len(rows) == 503
        for label in ("rare", "common", None):
            sizes = Counter(r.fold for r in rows if r.label == label)
            assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
    plain = {r.id: r.fold for r in sampling.stratified_folds(df, "id", "label", 4).collect()}
    common = sorted(r.id for r in df.where("label = 'common'").collect())
    assert [plain[i] for i in common] == sorted(plain[i] for i in common)
