"""Registered queries: MRMR variants."""

from __future__ import annotations


from kestrel.functions import scalar as S
from kestrel.operators import models as ML
from kestrel.operators import mrmr as MR
from kestrel.plans.q_select import ANOVA_COLS, _anova_sql, _binned_sql, _pairs_sql
from kestrel.plans.registry import query
from kestrel.sources.fixtures import view

FT = ("feat",)
MI_COLS = ["n_items", "qty", "max_disc", "min_tax", "noise", "price"]


def _mi_long_sql(pairs):
    """MI (nats) for (name, x, y) column pairs of the binned table ``b``."""
    ct = " UNION ALL ".join(
        f"SELECT '{a}' AS f, '{g}' AS g, CAST({a} AS VARCHAR) AS xv, CAST({g} AS VARCHAR) AS yv, count(*) AS o "
        f"FROM b WHERE {a} IS NOT NULL AND {g} IS NOT NULL GROUP BY {a}, {g}" for a, g in pairs)
    return f"""ct AS ({ct}),
mx AS (SELECT f, g, xv, sum(o) AS nx FROM ct GROUP BY 1, 2, 3),
my AS (SELECT f, g, yv, sum(o) AS ny FROM ct GROUP BY 1, 2, 3),
mn AS (SELECT f, g, sum(o) AS n FROM ct GROUP BY 1, 2),
mi AS (SELECT ct.f, ct.g, sum(o / n * ln(o * n / (nx * ny))) AS mi FROM ct JOIN mx USING (f, g, xv)
       JOIN my USING (f, g, yv) JOIN mn USING (f, g) GROUP BY ct.f, ct.g)"""


def _mrmr_sql(cols, k, scheme, discrete=("n_items",), label="target", bin_label=False):
    """Greedy MRMR as a recursive CTE over MI relevance / redundancy tables."""
    pairs = [(c, label) for c in cols] + [(a, g) for i, a in enumerate(cols) for g in cols[i + 1:]]
    binned = (_binned_sql(cols + [label], keep=(), discrete=discrete) if bin_label
              else _binned_sql(cols, discrete=discrete, keep=(label,)))
    order = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS i" for i, c in enumerate(cols))
    red = "(SELECT avg(r.mi) FROM red r WHERE r.f = x.feature AND list_contains(w.chosen, r.g))"
    score = f"x.rel / {red}" if scheme == "quotient" else f"x.rel - {red}"
    pick = (f"(SELECT {{col}} FROM (SELECT x.feature, x.i, CASE WHEN len(w.chosen) = 0 THEN x.rel ELSE {score} END AS sc "
            f"FROM rel x WHERE NOT list_contains(w.chosen, x.feature)) ORDER BY sc DESC, i LIMIT 1)")
    return f"""WITH RECURSIVE b AS ({binned}),
{_mi_long_sql(pairs)},
ord AS ({order}),
rel AS (SELECT mi.f AS feature, ord.i, mi.mi AS rel FROM mi JOIN ord ON ord.feature = mi.f WHERE mi.g = '{label}'),
red AS (SELECT f, g, mi FROM mi WHERE g <> '{label}' UNION ALL SELECT g, f, mi FROM mi WHERE g <> '{label}'),
walk(step, chosen, scores) AS (
  SELECT 0, []::VARCHAR[], []::DOUBLE[]
  UNION ALL
  SELECT w.step + 1, list_append(w.chosen, {pick.format(col='feature')}), list_append(w.scores, {pick.format(col='sc')})
  FROM walk w WHERE w.step < {min(k, len(cols))}),
fin AS (SELECT chosen, scores FROM walk ORDER BY step DESC LIMIT 1)
SELECT CAST(generate_subscripts(chosen, 1) AS INTEGER) AS step, unnest(chosen) AS feature, RND(unnest(scores), 6) AS score FROM fin"""


def _steps(spark, steps):
    return spark.createDataFrame(steps, "step int, feature string, score double")


@query("y08_mrmr_miq", _mrmr_sql(MI_COLS, 4, "quotient"), views=FT)
def y08_mrmr_miq(spark, d):
    """MRMR with MI relevance and MI redundancy, quotient (MIQ), k = 4.
    MI on equal-frequency bins; ``n_items`` is discrete."""
    df = view(spark, d, "feat")
    rel = MR.relevance_mi(df, MI_COLS, "target", discrete=["n_items"])
    red = MR.redundancy_mi(df, MI_COLS, discrete=["n_items"])
    return _steps(spark, MR.mrmr(rel, red, 4, "quotient", MI_COLS)).withColumn("score", S.rnd("score", 6))


@query("y09_mrmr_mid_loop", _mrmr_sql(MI_COLS, 10, "difference"), views=FT)
def y09_mrmr_mid_loop(spark, d):
    """MRMR difference scheme (MID) looped to k = 10 or all features."""
    df = view(spark, d, "feat")
    rel = MR.relevance_mi(df, MI_COLS, "target", discrete=["n_items"])
    red = MR.redundancy_mi(df, MI_COLS, discrete=["n_items"])
    return _steps(spark, MR.mrmr(rel, red, 10, "difference", MI_COLS)).withColumn("score", S.rnd("score", 6))


def _fcq_sql(cols, k=3):
    f = _anova_sql(cols).replace("WITH cm AS", "cm AS", 1)
    body = f.split("SELECT feature, CAST(n AS BIGINT) AS n, k, ")[0]
    fsel = ("SELECT feature, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM per")
    idx = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS i" for i, c in enumerate(cols))
    return f"""WITH {body.rstrip().rstrip(',')},
fs AS ({fsel}), ix AS ({idx}), fr AS (SELECT fs.feature, fs.f, ix.i FROM fs JOIN ix USING (feature)),
pr0 AS ({_pairs_sql(cols)}),
pr AS (SELECT feature1 AS a, feature2 AS b, abs(corr) AS r FROM pr0 UNION ALL SELECT feature2, feature1, abs(corr) FROM pr0),
s1 AS (SELECT feature, f AS score FROM fr ORDER BY f DESC, i LIMIT 1),
s2 AS (SELECT fr.feature, fr.f / pr.r AS score FROM fr JOIN pr ON pr.a = fr.feature JOIN s1 ON pr.b = s1.feature
       ORDER BY score DESC, fr.i LIMIT 1),
s3 AS (SELECT fr.feature, fr.f / ((p1.r + p2.r) / 2) AS score FROM fr
       JOIN pr p1 ON p1.a = fr.feature JOIN s1 ON p1.b = s1.feature
       JOIN pr p2 ON p2.a = fr.feature JOIN s2 ON p2.b = s2.feature
       ORDER BY score DESC, fr.i LIMIT 1)
SELECT 1 AS step, feature, RND(score, 4) AS score FROM s1 UNION ALL SELECT 2, feature, RND(score, 4) FROM s2
UNION ALL SELECT 3, feature, RND(score, 4) FROM s3"""


@query("y10_mrmr_fcq", _fcq_sql(ANOVA_COLS), views=FT)
def y10_mrmr_fcq(spark, d):
    """MRMR with F-statistic relevance and abs-correlation redundancy (FCQ), k = 3."""
    df = view(spark, d, "feat")
    steps = MR.mrmr(MR.relevance_f(df, ANOVA_COLS, "target"), MR.redundancy_corr(df, ANOVA_COLS), 3, "quotient",
                    ANOVA_COLS)
    return _steps(spark, steps).select("step", "feature", S.rnd("score", 4).alias("score"))


@query("y11_mrmr_rfcq")
def y11_mrmr_rfcq(spark, d):
    """MRMR with random-forest importance relevance (RFCQ), forest depth tuned
    by a small grid on 2 folds (Y11)."""
    from kestrel.operators.sampling import fold_column
    df = fold_column(view(spark, d, "feat").select("id", *MI_COLS, "target"), "id", 2).cache()
    cv, rows = ML.grid_search("rf_clf", df, MI_COLS, "target", {"maxDepth": [2, 4], "numTrees": [10]},
                              metric="roc_auc", num_folds=2)
    best = cv.bestModel
    rel = dict(ML.importance_table(best, MI_COLS))
    steps = MR.mrmr(rel, MR.redundancy_corr(df, MI_COLS), 4, "quotient", MI_COLS)
    df.unpersist()
    return _steps(spark, steps)


@query("y12_mrmr_subset_discrete", _mrmr_sql(["qty", "noise", "max_disc", "priority", "status"], 3, "quotient",
                                            discrete=("priority", "status"), label="price", bin_label=True), views=FT)
def y12_mrmr_subset_discrete(spark, d):
    """MRMR on a variable subset with a discrete mask (Y12): MI relevance
    against the continuous price target (regression), ``priority`` and
    ``status`` discrete."""
    df = view(spark, d, "feat").select("qty", "noise", "max_disc", "priority", "status", "price")
    cols = ["qty", "noise", "max_disc", "priority", "status"]
    b = MR.binned(df, cols + ["price"], discrete=["priority", "status"])
    from kestrel.operators.stats import mutual_info_discrete
    rel = {r["feature"]: r["mi"] for r in mutual_info_discrete(b, cols, "price").collect()}
    red = MR.redundancy_mi(df, cols, discrete=["priority", "status"])
    return _steps(spark, MR.mrmr(rel, red, 3, "quotient", cols)).withColumn("score", S.rnd("score", 6))
