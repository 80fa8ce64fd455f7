"""Registered queries on histogram trees: single-column trees (H1, H2, F15),
wrapper searches scored by forests (X1, X3, X5) and boosting with an evaluation set (L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import histtrees as HT
from kestrel.operators import selection as SEL
from kestrel.operators import stats as ST
from kestrel.operators import wrapper as W
from kestrel.operators.cleaning import fill_median
from kestrel.operators.sampling import fold_column, random_split
from kestrel.plans.q_models import XCOLS
from kestrel.plans.q_select import CORR_COLS, SPLIT, _bin_expr, _greedy_sql, _groups_df
from kestrel.plans.registry import query
from kestrel.sources.fixtures import view

FT = ("feat",)
BINS = 32


def _hash_fold_sql(key, k, seed=0):
    text = f"CAST({key} AS VARCHAR)" + (f" || ':{seed}'" if seed else "")
    return f"CAST(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) % 1073741824 % {k} AS INTEGER)"


def _tree_ctes(cols, y, src, cuts_from, folds, depth=3):
    """CTEs up to ``judged``: the value that each column's tree, grown without fold ``f``, gives to each bin of fold ``f``.

    ``src`` is a relation with the columns, ``y`` and ``fold``; every level picks, for each
    node, the bin whose split of the label sums judges best, and sends later bins right.
    """
    hist = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, fold, {_bin_expr(c, BINS, cuts_from)} AS bin, count(*) AS n, "
        f"sum(CAST({y} AS DOUBLE)) AS s, sum(CAST({y} AS DOUBLE) * {y}) AS ss FROM {src} GROUP BY 2, 3" for c in cols)
    out = [f"hist AS ({hist})", f"fs AS (SELECT unnest([{', '.join(map(str, folds))}]) AS f)",
           "t0 AS (SELECT feature, f, 1 AS node, bin, sum(n) AS n, sum(s) AS s FROM hist, fs WHERE fold <> f GROUP BY feature, f, bin)",
           "r0 AS (SELECT feature, fold AS f, 1 AS node, bin, n, s, ss FROM hist WHERE fold IN (SELECT f FROM fs))"]
    for k in range(depth):
        out += [
            f"""c{k} AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature, f, node) AS nt,
             sum(s) OVER (PARTITION BY feature, f, node) AS st FROM t{k} WINDOW w AS (PARTITION BY feature, f, node ORDER BY bin))""",
            f"""b{k} AS (SELECT feature, f, node, bin FROM (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS score FROM c{k} WHERE nt > nl)
             QUALIFY row_number() OVER (PARTITION BY feature, f, node ORDER BY score DESC, bin) = 1 AND score > st * st / nt * (1 + 1e-12))"""]
        for rel, rest in (("t", "n, s"), ("r", "n, s, ss")):
            out.append(f"""{rel}{k + 1} AS (SELECT a.feature, a.f, 2 * a.node + CASE WHEN a.bin > b.bin THEN 1 ELSE 0 END AS node, a.bin, {rest}
             FROM {rel}{k} a LEFT JOIN b{k} b ON b.feature = a.feature AND b.f = a.f AND b.node = a.node)""")
    out += [f"leaf AS (SELECT feature, f, node, sum(s) / sum(n) AS v FROM t{depth} GROUP BY feature, f, node)",
            f"judged AS (SELECT r.feature, r.f, r.n, r.s, r.ss, leaf.v FROM r{depth} r JOIN leaf ON leaf.feature = r.feature AND leaf.f = r.f AND leaf.node = r.node)"]
    return ",\n".join(out)


AUC_CTES = """steps AS (SELECT feature, f, v, sum(s) AS p, sum(n - s) AS q FROM judged GROUP BY feature, f, v),
ranks AS (SELECT *, sum(q) OVER (PARTITION BY feature, f ORDER BY v) - q AS below FROM steps),
scores AS (SELECT feature, f, sum(p * (below + 0.5 * q)) / (sum(p) * sum(q)) AS score FROM ranks GROUP BY feature, f)"""
MSE_CTES = "scores AS (SELECT feature, f, sum(ss - 2 * v * s + n * v * v) / sum(n) AS score FROM judged GROUP BY feature, f)"


def _split_src(cols, y):
    fold = f"CASE WHEN {SPLIT.format(k='id')} < 30 THEN 1 ELSE 0 END"
    return (f"src AS (SELECT id, {', '.join(cols)}, {y}, {fold} AS fold FROM feat),\n"
            "train AS (SELECT * FROM src WHERE fold = 0)")


def _split_scores(spark, d, cols, label, metric):
    """Test scores of a tree on each column; bins from the training rows."""
    df = random_split(view(spark, d, "feat").select("id", *cols, label), "id", 30, flag="held").withColumn("fold", F.col("held").cast("int"))
    cuts = HT.inner_cuts(df.where("fold = 0"), cols, BINS)
    return HT.single_feature_scores(df, cols, label, "fold", metric, folds=[1], cuts=cuts).select("feature", "score")


@query("h01_single_feature_tree", "WITH " + _split_src(XCOLS, "target") + ",\n" + _tree_ctes(XCOLS, "target", "src", "train", [1]) + ",\n"
       + AUC_CTES + "\nSELECT feature, RND(score, 6) AS score, score > 0.5 AS keep FROM scores", views=FT)
def h01_single_feature_tree(spark, d):
    """One decision tree per feature, test ROC-AUC; keep > 0.5 (H1), all features in one histogram pass."""
    sc = _split_scores(spark, d, XCOLS, "target", "roc_auc")
    return sc.select("feature", S.rnd("score", 6).alias("score"), (F.col("score") > 0.5).alias("keep"))


MSE_COLS = [c for c in XCOLS if c != "price"]


@query("h01b_single_feature_tree_mse", "WITH " + _split_src(MSE_COLS, "price") + ",\n" + _tree_ctes(MSE_COLS, "price", "src", "train", [1]) + ",\n"
       + MSE_CTES + "\nSELECT feature, RND(score, 2) AS score, score < avg(score) OVER () AS keep FROM scores", views=FT)
def h01b_single_feature_tree_mse(spark, d):
    """Regression form: test MSE per feature, keep below the mean MSE (H1)."""
    sc = _split_scores(spark, d, MSE_COLS, "price", "mse")
    return sc.select("feature", S.rnd("score", 2).alias("score"), (F.col("score") < sc.agg(F.avg("score")).scalar()).alias("keep"))


def _cv_src(cols, y, k, table="feat"):
    return f"src AS (SELECT id, {', '.join(cols)}, {y}, {_hash_fold_sql('id', k)} AS fold FROM {table})"


@query("h02_single_feature_cv", "WITH " + _cv_src(XCOLS, "target", 3) + ",\n" + _tree_ctes(XCOLS, "target", "src", "src", range(3)) + ",\n" + AUC_CTES
       + "\nSELECT feature, RND(avg(score), 6) AS mean, RND(stddev_samp(score), 6) AS std, avg(score) > 0.5 AS keep FROM scores GROUP BY feature", views=FT)
def h02_single_feature_cv(spark, d):
    """``SelectBySingleFeaturePerformance(cv=3, scoring='roc_auc')`` (H2)."""
    df = fold_column(view(spark, d, "feat").select("id", *XCOLS, "target"), "id", 3)
    sc = HT.single_feature_scores(df, XCOLS, "target", "fold", "roc_auc")
    return sc.groupBy("feature").agg(S.rnd(F.avg("score"), 6).alias("mean"), S.rnd(F.stddev_samp("score"), 6).alias("std"),
                                     (F.avg("score") > 0.5).alias("keep"))


FILLED = ("filled AS (SELECT * REPLACE (coalesce(disc_nulls, (SELECT median(disc_nulls) FROM feat)) AS disc_nulls) FROM feat)")
F15_ORDER = ("SELECT feature, CAST(row_number() OVER (ORDER BY RND(avg(score), 9) DESC, list_position([" + ", ".join(f"'{c}'" for c in CORR_COLS)
             + "], feature)) - 1 AS INTEGER) AS pos FROM scores GROUP BY feature")


@query("f15_smart_correlated_performance", _greedy_sql(
    CORR_COLS, F15_ORDER, table_="filled", extra_ctes=FILLED + ",\n" + _cv_src(CORR_COLS, "target", 3, "filled") + ",\n"
    + _tree_ctes(CORR_COLS, "target", "src", "src", range(3)) + ",\n" + AUC_CTES + ",\n"), views=FT)
def f15_smart_correlated_performance(spark, d):
    """``SmartCorrelatedSelection(selection_method='model_performance')`` (F15):
    within each correlated group keep the best single-feature CV score."""
    df = view(spark, d, "feat")
    holes = [r["feature"] for r in ST.column_moments(df, CORR_COLS).where("n_null > 0").collect()]
    df = fold_column(fill_median(df, holes) if holes else df, "id", 3)           # all features on the same rows
    sc = HT.single_feature_scores(df, CORR_COLS, "target", "fold", "roc_auc")
    means = sc.groupBy("feature").agg(S.rnd(F.avg("score"), 9).alias("mean")).collect()
    score = {r["feature"]: r["mean"] for r in means}
    order = sorted(CORR_COLS, key=lambda c: (-score[c], CORR_COLS.index(c)))
    return _groups_df(spark, SEL.correlated_groups(ST.corr_pairs(df, CORR_COLS), order, 0.8))


# --- wrapper searches: all candidates of a step in the same jobs -------------------------------

FOREST_COLS = ["n_items", "qty", "max_disc", "noise"]


def _forests(spark, d, label, **params):
    df = fold_column(view(spark, d, "feat").select("id", *FOREST_COLS, label), "id", 2, seed=1)
    return HT.Forests(df, FOREST_COLS, label, "id", "fold", **params)


@query("x01b_forward_forest")
def x01b_forward_forest(spark, d):
    """Step-forward selection with a random forest scored by CV ROC-AUC."""
    steps = W.forward(FOREST_COLS, _forests(spark, d, "target", trees=10, depth=4).score_many, 3)
    return spark.createDataFrame(steps, "step int, feature string, score double")


@query("x03b_backward_forest")
def x03b_backward_forest(spark, d):
    """Step-backward selection with a random-forest regressor scored by CV R^2."""
    kept, steps = W.backward(FOREST_COLS, _forests(spark, d, "price", metric="r2", trees=10, depth=4).score_many, 2)
    rows = [(f, False, sc) for _, f, sc in steps] + [(f, True, None) for f in kept]
    return spark.createDataFrame(rows, "feature string, kept boolean, score double")


@query("x05d_exhaustive_tree")
def x05d_exhaustive_tree(spark, d):
    """Every subset of 1 or 2 columns scored by a decision tree's CV ROC-AUC."""
    score = _forests(spark, d, "target", trees=1, bagged=False, depth=3).score_many
    rows = [(",".join(cols), len(cols), float(sc)) for cols, sc in W.exhaustive(FOREST_COLS, score, 1, 2)]
    return spark.createDataFrame(rows, "subset string, k int, score double")


# --- boosting with an evaluation set ----------------------------------------------------------

BOOST_COLS = ["n_items", "qty", "min_tax", "noise", "disc_nulls"]


@query("l04b_boosting_with_evaluation_set")
def l04b_boosting_with_evaluation_set(spark, d):
    """Second-order boosting for ``target`` with early stopping on the held-out rows (L4): the log loss of every round, and the chosen round.

    ``disc_nulls`` has missing values; they follow the side that judges better.
    """
    df = random_split(view(spark, d, "feat").select("id", *BOOST_COLS, "target"), "id", 30, flag="held")
    model = HT.boost(df, BOOST_COLS, "target", "id", "held", "logistic", rounds=12, patience=3, eta=0.5)
    rows = [(r, train, held, r == model.best_round) for r, train, held in model.log]
    return spark.createDataFrame(rows, "round int, train_loss double, eval_loss double, chosen boolean")
