"""Histogram trees against plain versions over the same bins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import histtrees as HT
from kestrel.operators import wrapper as W


def plain_tree(codes, y, depth):
    """CART over one column of codes by trying every split; returns a function of a code."""
    def grow(rows, left):
        values = [y[i] for i in rows]
        mean = sum(values) / len(values)
        best = None
        if left:
            for b in sorted({codes[i] for i in rows})[:-1]:
                lo, hi = [y[i] for i in rows if codes[i] <= b], [y[i] for i in rows if codes[i] > b]
                score = sum(lo) ** 2 / len(lo) + sum(hi) ** 2 / len(hi)
                if best is None or score > best[0]:
                    best = (score, b)
        if best is None or best[0] <= sum(values) ** 2 / len(values) * (1 + 1e-12):
            return lambda c: mean
        lo = grow([i for i in rows if codes[i] <= best[1]], left - 1)
        hi = grow([i for i in rows if codes[i] > best[1]], left - 1)
        return lambda c: lo(c) if c <= best[1] else hi(c)
    return grow(list(range(len(codes))), depth)


def plain_auc(scores, labels):
    pos, neg = [s for s, v in zip(scores, labels) if v], [s for s, v in zip(scores, labels) if not v]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = []
    for i in range(900):
        a, b, c = rnd.randrange(12), rnd.randrange(9), rnd.gauss(0, 1)
        target = int(a * b % 7 + rnd.randrange(4) > 5)
        out.append((i, float(a), float(b), c if rnd.random() > 0.1 else None, target, float(a * 3 - b + rnd.randrange(5)), i * 7919 % 3))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, target int, price double, fold int").repartition(3)


@pytest.mark.parametrize("metric, label, at", [("roc_auc", "target", 4), ("mse", "price", 5)])
def test_single_columns_equal_a_plain_cart(rows, table, metric, label, at):
    got = {(r.feature, r.fold): r.score for r in HT.single_feature_scores(table, ["a", "b", "c"], label, "fold", metric).collect()}
    cuts = HT.inner_cuts(table, ["a", "b", "c"], 32)
    for k, c in enumerate(["a", "b", "c"]):
        codes = [int(HT.coded(np.array([math.nan if r[k + 1] is None else r[k + 1]]), cuts[k])[0]) for r in rows]
        for f in range(3):
            if c == "c":            # missing values may go either way; see the test below
                assert got[c, f] is not None
                continue
            train, test = [i for i, r in enumerate(rows) if r[6] != f], [i for i, r in enumerate(rows) if r[6] == f]
            tree = plain_tree([codes[i] for i in train], [rows[i][at] for i in train], 3)
            p = [tree(codes[i]) for i in test]
            y = [rows[i][at] for i in test]
            want = plain_auc(p, y) if metric == "roc_auc" else sum((u - v) ** 2 for u, v in zip(p, y)) / len(y)
            assert abs(got[c, f] - want) < 1e-9


def test_missing_values_take_the_better_side():
    codes = np.array([[-1], [-1], [0], [0], [1], [1], [2], [2]])
    y = np.array([5.0, 5.0, 0, 0, 5, 5, 5, 5])
    tree = HT.grow_small(codes, y, np.ones(8), 1)
    assert tree.predict(codes).tolist() == y.tolist() and not tree.missing_left[0]


def jobs(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    sc = spark.sparkContext
    name = f"jobs-{random.random()}"
    sc.setJobGroup(name, "counted")
    run()
    n = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setJobGroup("none", "none")
    return n


def test_jobs_do_not_grow_with_the_columns(spark):
    wide = spark.range(400).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 7 % 5 > 2).cast("int").alias("y"),
                                   *[(F.col("id") * (2 * k + 1) % 17).cast("double").alias(f"v{k}") for k in range(300)])
    cuts = [np.arange(16.0)] * 300
    few = jobs(spark, lambda: HT.single_feature_scores(wide, ["v0", "v1"], "y", "fold", "roc_auc", cuts=cuts[:2]).collect())
    many = {}
    n = jobs(spark, lambda: many.update({(r.feature, r.fold): r.score for r in HT.single_feature_scores(
        wide, [f"v{k}" for k in range(300)], "y", "fold", "roc_auc", cuts=cuts).collect()}))
    assert n == few > 0 and len(many) == 900


@pytest.mark.parametrize("kind", [dict(metric="roc_auc", label="target"), dict(metric="r2", label="price"),
                                  dict(metric="roc_auc", label="target", trees=1, bagged=False, depth=3)])
def test_candidates_together_equal_one_at_a_time(table, kind):
    forests = HT.Forests(table, ["a", "b", "c"], key="id", fold="fold", **{"trees": 3, **kind})
    subsets = [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"], ["a", "b", "c"]]
    together = forests.score_many(subsets)
    assert together == [forests.score_many([s])[0] for s in subsets]
    assert W.forward(forests.cols, forests.score_many, 2) == W.forward(forests.cols, lambda many: [forests.score_many([s])[0] for s in many], 2)


def test_an_unbagged_tree_equals_a_plain_cart(rows, table):
    forests = HT.Forests(table, ["a", "b", "c"], "target", "id", "fold", trees=1, bagged=False, depth=3)
    got = {(r.subset, r.fold): r.score for r in forests.fold_scores([["a"], ["b"]]).collect()}
    alone = {(r.feature, r.fold): r.score for r in HT.single_feature_scores(table, ["a", "b"], "target", "fold", "roc_auc").collect()}
    # Scores are kept to 16 bits, so leaves closer than that may tie.
    assert all(abs(got[k, f] - alone["ab"[k], f]) < 1e-3 for k in (0, 1) for f in range(3))


def test_jobs_of_a_step_do_not_grow_with_the_candidates(spark, table):
    forests = HT.Forests(table, ["a", "b", "c"], "target", "id", "fold", trees=2, depth=3)
    one = jobs(spark, lambda: forests.score_many([["a", "b", "c"]]))
    assert jobs(spark, lambda: forests.score_many([["a", "b", "c"]] * 7)) == one > 0


def plain_boost(codes, y, train, objective, rounds, depth, eta, l2, min_child):
    """Second-order boosting by trying every split of every column, missing values on either side."""
    mean = y[train].mean()
    margin = np.full(len(y), mean if objective == "squared" else math.log(mean / (1 - mean)))
    log = []

    def grow(rows, g, h, left):
        value = eta * g[rows].sum() / (h[rows].sum() + l2)
        best, parent = None, g[rows].sum() ** 2 / (h[rows].sum() + l2)
        for f in range(codes.shape[1]) if left else ():
            c = codes[rows, f]
            for b in sorted(set(c[c >= 0].tolist())):
                for missing_left in (True, False):
                    go = np.where(c < 0, missing_left, c <= b)
                    lo, hi = rows[go], rows[~go]
                    if len(lo) and len(hi) and h[lo].sum() >= min_child and h[hi].sum() >= min_child:
                        score = g[lo].sum() ** 2 / (h[lo].sum() + l2) + g[hi].sum() ** 2 / (h[hi].sum() + l2)
                        if best is None or score > best[0] + 1e-9:
                            best = (score, f, b, missing_left, lo, hi)
        if best is None or best[0] <= parent * (1 + 1e-12):
            return lambda r: value
        _, f, b, missing_left, lo, hi = best
        lo, hi = grow(lo, g, h, left - 1), grow(hi, g, h, left - 1)
        return lambda r: lo(r) if (missing_left if codes[r, f] < 0 else codes[r, f] <= b) else hi(r)

    for _ in range(rounds):
        p = margin if objective == "squared" else 1 / (1 + np.exp(-margin))
        g, h = y - p, np.ones(len(y)) if objective == "squared" else p * (1 - p)
        tree = grow(np.flatnonzero(train), g, h, depth)
        margin = margin + np.array([tree(r) for r in range(len(y))])
        each = HT.loss_of(objective, y, margin)
        sets = [each[train].mean(), each[~train].mean()]
        log.append([math.sqrt(v) for v in sets] if objective == "squared" else sets)
    return log


@pytest.mark.parametrize("objective, at", [("squared", 5), ("logistic", 4)])
def test_boosting_equals_a_plain_version(rows, table, objective, at):
    label = "price" if objective == "squared" else "target"
    df = table.withColumn("held", F.col("fold") == 2)
    model = HT.boost(df, ["a", "b", "c"], label, "id", "held", objective, rounds=4, depth=2, bins=8)
    codes = np.array([[int(HT.coded(np.array([math.nan if r[k + 1] is None else r[k + 1]]), model.cuts[k])[0]) for k in range(3)] for r in rows])
    want = plain_boost(codes, np.array([float(r[at]) for r in rows]), np.array([r[6] != 2 for r in rows]), objective, 4, 2, 0.3, 1.0, 1.0)
    assert np.allclose([x[1:] for x in model.log], want, atol=1e-9)
    scored = {r.id: r.prediction for r in model.transform(df).collect()}
    m = model.margin(codes)
    m = 1 / (1 + np.exp(-m)) if objective == "logistic" else m
    assert all(abs(scored[r[0]] - m[i]) < 1e-12 for i, r in enumerate(rows))


def test_boosting_stops_when_the_evaluation_set_gets_worse(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, rnd.random(), rnd.randrange(2), i % 2 == 0) for i in range(300)], "id long, x double, y int, held boolean")
    model = HT.boost(df, ["x"], "y", "id", "held", "logistic", rounds=60, patience=3, depth=3)
    assert len(model.log) == model.best_round + 3 < 60
    assert model.log[model.best_round - 1][2] == min(x[2] for x in model.log)


def test_equal_rows_are_stored_once(spark):
    """Twenty copies of the rows make no larger table for the passes, and give the same boosted trees."""
    one = spark.range(300).select("id", (F.col("id") % 12).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                  (F.col("id") % 12 * (F.col("id") % 5) > 15).cast("int").alias("y"), (F.col("id") % 4 == 0).alias("held"))
    many = one.crossJoin(spark.range(20).select(F.col("id").alias("copy"))).withColumn("id", F.col("id") + 300 * F.col("copy")).drop("copy")
    cuts = [np.arange(11.0), np.arange(4.0)]
    rows = [HT.binned(df, ["a", "b"], "y", "id", cuts, trees=2).orderBy("c0", "c1").collect() for df in (one, many)]
    assert len(rows[0]) == len(rows[1]) == 60 and [20 * r.n for r in rows[0]] == [r.n for r in rows[1]]
    logs = [HT.boost(df, ["a", "b"], "y", "id", "held", "logistic", rounds=3, l2=0.0, min_child=0.0).log for df in (one, many)]
    assert np.allclose(logs[0], logs[1], atol=1e-12)
    forests = HT.Forests(many.withColumn("fold", (F.col("id") % 2).cast("int")), ["a", "b"], "y", "id", "fold", trees=3)
    assert forests._table.count() <= 120 and forests.score_many([["a", "b"]])[0] > 0.9
