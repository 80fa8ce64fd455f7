"""Registered queries: column filters, statistical filters and target-mean
scores (SURVEY 2.10-2.12, T3-T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.functions.distributions import chi2_pvalue, f_pvalue
from kestrel.operators import reshape as RS
from kestrel.operators import selection as SEL
from kestrel.operators.cleaning import fill_median
from kestrel.operators import neighbours as NB
from kestrel.operators import stats as ST
from kestrel.operators import target_mean as TM
from kestrel.plans.registry import query
from kestrel.sources.fixtures import FEAT_NUMERIC, table, view

FT, P = ("feat",), ("people",)
SPLIT = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 100"


def per_feature(cols, body, table_="feat"):
    """UNION ALL of one SELECT per column (oracle helper)."""
    return " UNION ALL ".join(body.format(c=c, t=table_) for c in cols)


# --- 2.10 filters without a target ---------------------------------------------------

@query("f01_constant_std", "SELECT feature FROM (" + per_feature(
    FEAT_NUMERIC, "SELECT '{c}' AS feature, stddev_samp({c}) AS s FROM feat") + ") WHERE s = 0", views=FT)
def f01_constant_std(spark, d):
    return SEL.constant_by_std(view(spark, d, "feat"), FEAT_NUMERIC)


@query("f02_constant_distinct", "SELECT feature FROM (" + per_feature(
    FEAT_NUMERIC + ["priority", "status"], "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n FROM feat") + ") WHERE n = 1",
       views=FT)
def f02_constant_distinct(spark, d):
    return SEL.constant_by_distinct(view(spark, d, "feat"), FEAT_NUMERIC + ["priority", "status"])


@query("f02b_constant_with_nulls", "SELECT feature FROM (" + per_feature(
    FEAT_NUMERIC, "SELECT '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM feat")
       + ") WHERE n = 1", views=FT)
def f02b_constant_with_nulls(spark, d):
    """``nunique(dropna=False) == 1``: a null counts as a second value."""
    return SEL.constant_by_distinct(view(spark, d, "feat"), FEAT_NUMERIC, dropna=False)


@query("f03_variance_threshold", "SELECT feature, RND(v, 3) AS var_pop, v > 0.01 AS keep FROM (" + per_feature(
    FEAT_NUMERIC, "SELECT '{c}' AS feature, var_pop({c}) AS v FROM feat") + ")", views=FT)
def f03_variance_threshold(spark, d):
    out = SEL.variance_threshold(view(spark, d, "feat"), FEAT_NUMERIC, 0.01)
    return out.select("feature", S.rnd("var_pop", 3).alias("var_pop"), "keep")


SHARE_SQL = ("SELECT '{c}' AS feature, (SELECT max(n) FROM (SELECT count(*) AS n FROM feat WHERE {c} IS NOT NULL "
             "GROUP BY {c})) / count({c}) AS share FROM feat")


@query("f04_quasi_constant", "SELECT feature, RND(share, 6) AS share FROM (" + per_feature(FEAT_NUMERIC, SHARE_SQL)
       + ") WHERE share > 0.998", views=FT)
def f04_quasi_constant(spark, d):
    return SEL.quasi_constant(view(spark, d, "feat"), FEAT_NUMERIC, 0.998).withColumn("share", S.rnd("share", 6))


@query("f05_drop_constant_tol", "SELECT feature FROM (" + per_feature(FEAT_NUMERIC, SHARE_SQL) + ") WHERE share >= 0.998",
       views=FT)
def f05_drop_constant_tol(spark, d):
    return SEL.drop_constant_features(view(spark, d, "feat"), FEAT_NUMERIC, tol=0.998, missing_values="ignore")


def _dup_sql(cols):
    pairs = " UNION ALL ".join(
        f"SELECT '{b}' AS feature, '{a}' AS duplicate_of, {i} AS ia FROM feat HAVING count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) = 0"
        for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"SELECT feature, arg_min(duplicate_of, ia) AS duplicate_of FROM ({pairs}) GROUP BY feature"


@query("f06_duplicate_pairs", _dup_sql(FEAT_NUMERIC), views=FT)
def f06_duplicate_pairs(spark, d):
    return SEL.duplicate_pairs(view(spark, d, "feat"), FEAT_NUMERIC, "id")


@query("f08_duplicate_sets", "SELECT duplicate_of AS feature, string_agg(feature, ',' ORDER BY feature) AS duplicates FROM ("
       + _dup_sql(FEAT_NUMERIC) + ") GROUP BY duplicate_of", views=FT)
def f08_duplicate_sets(spark, d):
    g = SEL.duplicate_groups(view(spark, d, "feat"), FEAT_NUMERIC, "id")
    return g.select("feature", F.array_join("duplicates", ",").alias("duplicates"))


CORR_COLS = ["n_items", "qty", "qty_corr", "qty_neg", "max_disc", "min_tax", "noise", "price", "disc_nulls"]


def _pairs_sql(cols, t="feat"):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, {i} AS i1, {j} AS i2, corr({a}, {b}) AS corr FROM {t}"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i)


@query("f09_corr_drop_earlier", "SELECT DISTINCT feature1 AS feature FROM (" + _pairs_sql(CORR_COLS) + ") WHERE abs(corr) > 0.8",
       views=FT)
def f09_corr_drop_earlier(spark, d):
    return SEL.correlated_drops(ST.corr_pairs(view(spark, d, "feat"), CORR_COLS), 0.8, rule="earlier")


@query("f10_corr_drop_later", "SELECT DISTINCT feature2 AS feature FROM (" + _pairs_sql(CORR_COLS) + ") WHERE abs(corr) > 0.6",
       views=FT)
def f10_corr_drop_later(spark, d):
    return SEL.correlated_drops(ST.corr_pairs(view(spark, d, "feat"), CORR_COLS), 0.6, rule="later")


def _groups_df(spark, groups):
    rows = [(i, g[0], m) for i, g in enumerate(groups) for m in g]
    return spark.createDataFrame(rows, "group_id int, leader string, feature string")


GROUPS_FINAL = "SELECT CAST(gi - 1 AS INTEGER) AS group_id, g[1] AS leader, unnest(g) AS feature FROM gs"


def _greedy_sql(cols, order_sql, threshold=0.8, final=GROUPS_FINAL, extra_ctes="", table_="feat"):
    """Feature-engine grouping walk as a recursive CTE (oracle for F12-F14):
    state = features already grouped + groups so far, one step per position."""
    nxt = ("(SELECT list(a.g ORDER BY a.gpos) FROM adjp a WHERE a.f = o.feature AND a.gpos > w.pos "
           "AND NOT list_contains(w.seen, a.g))")
    return f"""WITH RECURSIVE {extra_ctes}pr AS ({_pairs_sql(cols, table_)}),
ord AS ({order_sql}),
adj AS (SELECT feature1 AS f, feature2 AS g FROM pr WHERE abs(corr) > {threshold}
        UNION ALL SELECT feature2, feature1 FROM pr WHERE abs(corr) > {threshold}),
adjp AS (SELECT adj.f, adj.g, o.pos AS gpos FROM adj JOIN ord o ON o.feature = adj.g),
walk(pos, seen, grp) AS (
  SELECT 0, []::VARCHAR[], []::VARCHAR[][]
  UNION ALL
  SELECT w.pos + 1,
    CASE WHEN list_contains(w.seen, o.feature) THEN w.seen ELSE list_concat(w.seen, [o.feature], coalesce({nxt}, [])) END,
    CASE WHEN list_contains(w.seen, o.feature) OR coalesce(len({nxt}), 0) = 0 THEN w.grp
         ELSE list_append(w.grp, list_concat([o.feature], {nxt})) END
  FROM walk w JOIN ord o ON o.pos = w.pos),
fin AS (SELECT grp FROM walk ORDER BY pos DESC LIMIT 1),
gs AS (SELECT unnest(grp) AS g, generate_subscripts(grp, 1) AS gi FROM fin)
{final}"""


def _order_sql(cols, metric_sql=None, desc=True):
    base = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS i, " + (metric_sql.format(c=c) + " AS v FROM feat" if metric_sql else "0 AS v")
        for i, c in enumerate(cols))
    direction = "DESC" if desc else "ASC"
    return f"SELECT feature, CAST(row_number() OVER (ORDER BY coalesce(v, 0) {direction}, i) - 1 AS INTEGER) AS pos FROM ({base})"


def _strength_sql(cols, threshold=0.8):
    """Oracle for the strongest-pair-first grouping (F11) as a recursive CTE."""
    nxt = "(SELECT list(a.feature2 ORDER BY a.rk) FROM e a WHERE a.feature1 = e.feature1)"
    return f"""WITH RECURSIVE pr AS (SELECT feature1, feature2, i1, i2, RND(abs(corr), 12) AS r FROM ({_pairs_sql(cols)})),
band AS (SELECT feature1, feature2, i1, i2, r FROM pr WHERE r >= {threshold} AND r < 1
         UNION ALL SELECT feature2, feature1, i2, i1, r FROM pr WHERE r >= {threshold} AND r < 1),
e AS (SELECT feature1, feature2, row_number() OVER (ORDER BY r DESC, i1, i2) AS rk FROM band),
walk(rk, seen, grp) AS (
  SELECT 0, []::VARCHAR[], []::VARCHAR[][]
  UNION ALL
  SELECT w.rk + 1,
    CASE WHEN list_contains(w.seen, e.feature1) THEN w.seen ELSE list_concat(w.seen, [e.feature1], {nxt}) END,
    CASE WHEN list_contains(w.seen, e.feature1) THEN w.grp
         ELSE list_append(w.grp, list_concat([e.feature1], {nxt})) END
  FROM walk w JOIN e ON e.rk = w.rk + 1),
fin AS (SELECT grp FROM walk ORDER BY rk DESC LIMIT 1),
gs AS (SELECT unnest(grp) AS g, generate_subscripts(grp, 1) AS gi FROM fin)
{GROUPS_FINAL}"""


@query("f11_corr_groups_by_strength", _strength_sql(CORR_COLS), views=FT)
def f11_corr_groups_by_strength(spark, d):
    """Greedy groups from the strongest pair down (F11); driver walk over the pair table."""
    pairs = ST.corr_pairs(view(spark, d, "feat"), CORR_COLS)
    return _groups_df(spark, SEL.correlated_groups_by_strength(pairs, 0.8))


@query("f12_drop_correlated", _greedy_sql(CORR_COLS, _order_sql(CORR_COLS)), views=FT)
def f12_drop_correlated(spark, d):
    """``DropCorrelatedFeatures(threshold=0.8)``: first feature of each group kept."""
    sel = SEL.DropCorrelated(0.8).fit(view(spark, d, "feat"), CORR_COLS)
    return _groups_df(spark, sel.correlated_feature_sets_)


@query("f13_smart_correlated_variance", _greedy_sql(CORR_COLS, _order_sql(CORR_COLS, "var_samp({c})")), views=FT)
def f13_smart_correlated_variance(spark, d):
    """``SmartCorrelatedSelection(selection_method='variance')``."""
    sel = SEL.DropCorrelated(0.8, "variance").fit(view(spark, d, "feat"), CORR_COLS)
    return _groups_df(spark, sel.correlated_feature_sets_)


@query("f14_smart_correlated_cardinality", "SELECT *, 'cardinality' AS method FROM (" + _greedy_sql(
    CORR_COLS, _order_sql(CORR_COLS, "count(DISTINCT {c})")) + ") UNION ALL SELECT *, 'missing_values' AS method FROM (" +
       _greedy_sql(CORR_COLS, _order_sql(CORR_COLS, "count(*) - count({c})", desc=False)) + ")", views=FT)
def f14_smart_correlated_cardinality(spark, d):
    """``SmartCorrelatedSelection`` with 'cardinality' / 'missing_values' orders."""
    df = view(spark, d, "feat")
    a = SEL.DropCorrelated(0.8, "cardinality").fit(df, CORR_COLS)
    b = SEL.DropCorrelated(0.8, "missing_values").fit(df, CORR_COLS)
    return _groups_df(spark, a.correlated_feature_sets_).withColumn("method", F.lit("cardinality")).unionByName(
        _groups_df(spark, b.correlated_feature_sets_).withColumn("method", F.lit("missing_values")))


@query("f17_correlates_of_one", "SELECT feature2 AS feature, RND(corr, 6) AS corr FROM (" + _pairs_sql(CORR_COLS) +
       ") WHERE feature1 = 'qty' AND (corr > 0.8 OR corr < -0.8)", views=FT)
def f17_correlates_of_one(spark, d):
    pairs = ST.corr_pairs(view(spark, d, "feat"), CORR_COLS)
    return (pairs.where((F.col("feature1") == "qty") & ((F.col("corr") > 0.8) | (F.col("corr") < -0.8)))
            .select(F.col("feature2").alias("feature"), S.rnd("corr", 6).alias("corr")))


F18_CTES = ("sh AS (" + per_feature(FEAT_NUMERIC, SHARE_SQL) + "),\n"
            "dropc AS (SELECT feature FROM sh WHERE share >= 0.998),\n"
            "dup AS (SELECT feature FROM (" + _dup_sql(FEAT_NUMERIC) + ") WHERE feature NOT IN (SELECT feature FROM dropc)),\n"
            "rest AS (SELECT feature, i FROM (" + " UNION ALL ".join(
                f"SELECT '{c}' AS feature, {i} AS i" for i, c in enumerate(FEAT_NUMERIC)) + ") WHERE feature NOT IN "
            "(SELECT feature FROM dropc) AND feature NOT IN (SELECT feature FROM dup)),\n")
F18_ORDER = "SELECT feature, CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS pos FROM rest"
F18_FINAL = ("SELECT 'id' AS feature UNION ALL SELECT feature FROM rest WHERE feature NOT IN "
             "(SELECT unnest(g[2:]) FROM gs)")


@query("f18_selector_chain", _greedy_sql(FEAT_NUMERIC, F18_ORDER, 0.8, F18_FINAL, F18_CTES), views=FT)
def f18_selector_chain(spark, d):
    """Constant -> duplicated -> correlated chain, fit then transform.
    Returns the columns kept."""
    df = view(spark, d, "feat").select("id", *FEAT_NUMERIC)
    chain = SEL.SelectorChain([SEL.DropConstant(tol=0.998), SEL.DropDuplicates("id"), SEL.DropCorrelated(0.8)])
    chain.fit(df, FEAT_NUMERIC)
    kept = chain.transform(df)
    return spark.createDataFrame([(c,) for c in kept.columns], "feature string")


# --- 2.11 statistical filters against a target ---------------------------------------------

CAT_COLS = ["segment", "priority", "status", "nation"]


def _ct_sql(cols, t="people", label="target"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {label} AS label, count(*) AS o FROM {t} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}, {label}" for c in cols)


def _mi_sql(ct):
    return f"""WITH ct AS ({ct}),
nx AS (SELECT feature, value, sum(o) AS nx FROM ct GROUP BY 1, 2),
ny AS (SELECT feature, label, sum(o) AS ny FROM ct GROUP BY 1, 2),
n AS (SELECT feature, sum(o) AS n FROM ct GROUP BY 1)
SELECT ct.feature, RND(sum(o / n * ln(o * n / (nx * ny))), 6) AS mi FROM ct JOIN nx USING (feature, value)
 JOIN ny USING (feature, label) JOIN n USING (feature) GROUP BY ct.feature"""


@query("s01_mutual_info_discrete", _mi_sql(_ct_sql(CAT_COLS)), views=P)
def s01_mutual_info_discrete(spark, d):
    mi = ST.mutual_info_discrete(view(spark, d, "people"), CAT_COLS, "target")
    return mi.withColumn("mi", S.rnd("mi", 6))


BIN_COLS = ["qty", "noise", "price", "max_disc"]


def _bin_expr(c, q=10, table="feat"):
    """Equal-frequency bin id of ``c`` as SQL: the number of inner cut points
    below the value; cut points are the distinct inner percentiles strictly
    between the minimum and the maximum (the deduplicated edges of qcut)."""
    probs = ", ".join(str(i / q) for i in range(1, q))
    cuts = (f"(SELECT list_filter(list_distinct(quantile_cont({c}, [{probs}])), "
            f"lambda e: e > min({c}) AND e < max({c})) FROM {table})")
    return f"len(list_filter({cuts}, lambda e: e < {c}))"


def _binned_sql(cols, q=10, keep=("target",), discrete=()):
    """Equal-frequency bins (inner percentile edges, lowest included), as text."""
    sel = ", ".join((f"{c}" if c in discrete else f"{_bin_expr(c, q)} AS {c}") for c in cols)
    return f"SELECT {', '.join(keep)}{', ' if keep else ''}{sel} FROM feat"


@query("s02_mutual_info_binned", "WITH b AS (" + _binned_sql(BIN_COLS) + ")\n" + _mi_sql(_ct_sql(BIN_COLS, "b")).replace(
    "WITH ct AS", ", ct AS", 1).replace(", ct AS", "WITH ct AS", 0), views=FT)
def s02_mutual_info_binned(spark, d):
    """MI of continuous features with the class after equal-frequency binning
    (S2; documented deviation from the kNN estimator)."""
    df = view(spark, d, "feat")
    edges = ST.quantile_edges(df, BIN_COLS, 10)
    binned = df.select("target", *[ST.bin_column(c, edges[c], outside="clip").alias(c) for c in BIN_COLS])
    return ST.mutual_info_discrete(binned, BIN_COLS, "target").withColumn("mi", S.rnd("mi", 6))


# --- neighbour-based mutual information ------------------------------------------------------

NEAR_COLS = ["qty", "noise", "max_disc"]


def _jitter_sql(c, key="id", seed=0, table="feat"):
    unit = f"CAST(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{c}:{seed}'), 1, 12)) AS BIGINT) AS DOUBLE) / 281474976710656.0 - 0.5"
    return f"{c} + ({unit}) * pow(2, floor(log2((SELECT max(abs({c})) FROM {table}))) - 33)"


def _psi_sql(n):
    x = f"({n} + 6.0)"
    low = " - ".join(f"1.0 / ({n} + {i}.0)" for i in range(6))
    return f"(ln({x}) - 0.5 / {x} - 1.0 / (12 * {x} ** 2) + 1.0 / (120 * {x} ** 4) - 1.0 / (252 * {x} ** 6) + 1.0 / (240 * {x} ** 8) - {low})"


def _near_class_sql(cols, label, k):
    """Distances to the k-th row of the class by lag and lead; rows inside by a running count over rows and boundaries."""
    points = " UNION ALL ".join(f"SELECT '{c}' AS feature, id, {label} AS label, {_jitter_sql(c)} AS x FROM feat "
                                f"WHERE {c} IS NOT NULL AND {label} IS NOT NULL" for c in cols)
    near = ", ".join([f"{{'d': x - lag(x, {t}) OVER w, 'side': 0, 'v': lag(x, {t}) OVER w}}" for t in range(1, k + 1)]
                     + [f"{{'d': lead(x, {t}) OVER w - x, 'side': 1, 'v': lead(x, {t}) OVER w}}" for t in range(1, k + 1)])
    return f"""WITH all_points AS ({points}),
points AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS size FROM all_points QUALIFY size > 1),
near AS (SELECT feature, id, x, size, unnest([{near}]) AS c FROM points WINDOW w AS (PARTITION BY feature, label ORDER BY x, id)),
kth AS (SELECT feature, id, x, size, c.d AS d, c.side AS side, c.v AS v,
        row_number() OVER (PARTITION BY feature, id ORDER BY c.d, c.side) AS nth FROM near WHERE c.d IS NOT NULL),
radius AS (SELECT feature, id, size, least({k}, size - 1) AS own_k, CASE WHEN side = 0 THEN v ELSE x - d END AS lo,
           CASE WHEN side = 1 THEN v ELSE x + d END AS hi FROM kth WHERE nth = least({k}, size - 1)),
events AS (SELECT feature, x AS place, 1 AS turn, id FROM points UNION ALL SELECT feature, hi, 0, id FROM radius
           UNION ALL SELECT feature, lo, 2, id FROM radius),
ranked AS (SELECT feature, id, turn, count(*) FILTER (WHERE turn = 1) OVER (PARTITION BY feature ORDER BY place, turn, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM events),
inside AS (SELECT feature, id, sum(CASE turn WHEN 0 THEN below WHEN 2 THEN -below ELSE 0 END) AS m FROM ranked GROUP BY feature, id)
SELECT r.feature, RND(greatest(0, {_psi_sql('count(*)')} + avg({_psi_sql('own_k')}) - avg({_psi_sql('size')}) - avg({_psi_sql('m')})), 6) AS mi
FROM radius r JOIN inside i ON i.feature = r.feature AND i.id = r.id GROUP BY r.feature"""


@query("s02c_mutual_info_neighbours", _near_class_sql(NEAR_COLS, "target", 3), views=FT)
def s02c_mutual_info_neighbours(spark, d):
    """MI of continuous features with the class from 3 neighbours (S2), without bins."""
    return NB.against_class(view(spark, d, "feat"), NEAR_COLS, "target", "id", k=3).withColumn("mi", S.rnd("mi", 6))


def _near_plane_sql(cols, target, k):
    """All pairs of rows, the k-th nearest in the plane, and the counts closer in either coordinate."""
    points = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, id, {_jitter_sql(c)} AS x, {_jitter_sql(target)} AS y, "
        f"(SELECT stddev_samp({target}) / stddev_samp({c}) FROM feat WHERE {c} IS NOT NULL AND {target} IS NOT NULL) AS s FROM feat "
        f"WHERE {c} IS NOT NULL AND {target} IS NOT NULL" for c in cols)
    return f"""WITH points AS ({points}),
near AS (SELECT a.feature, a.id, arg_min({{'vx': b.x, 'vy': b.y}}, greatest(abs(a.x - b.x) * a.s, abs(a.y - b.y)), {k})[{k}] AS v
         FROM points a JOIN points b ON b.feature = a.feature AND b.id <> a.id GROUP BY a.feature, a.id),
kth AS (SELECT p.*, v.vx AS vx, v.vy AS vy, abs(v.vx - x) AS dx, abs(v.vy - y) AS dy, abs(v.vx - x) * s >= abs(v.vy - y) AS by_x
        FROM near JOIN points p ON p.feature = near.feature AND p.id = near.id WHERE v IS NOT NULL),
ends AS (
  SELECT 'x' AS axis, feature, id, CASE WHEN by_x AND vx < x THEN vx ELSE x - CASE WHEN by_x THEN dx ELSE dy / s END END AS lo,
         CASE WHEN by_x AND vx > x THEN vx ELSE x + CASE WHEN by_x THEN dx ELSE dy / s END END AS hi FROM kth
  UNION ALL
  SELECT 'y', feature, id, CASE WHEN NOT by_x AND vy < y THEN vy ELSE y - CASE WHEN by_x THEN dx * s ELSE dy END END,
         CASE WHEN NOT by_x AND vy > y THEN vy ELSE y + CASE WHEN by_x THEN dx * s ELSE dy END END FROM kth),
events AS (SELECT 'x' AS axis, feature, x AS place, 1 AS turn, id FROM points UNION ALL SELECT 'y', feature, y, 1, id FROM points
           UNION ALL SELECT axis, feature, hi, 0, id FROM ends UNION ALL SELECT axis, feature, lo, 2, id FROM ends),
ranked AS (SELECT axis, feature, id, turn, count(*) FILTER (WHERE turn = 1) OVER (PARTITION BY axis, feature ORDER BY place, turn, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM events),
inside AS (SELECT axis, feature, id, sum(CASE turn WHEN 0 THEN below WHEN 2 THEN -below ELSE 0 END) AS m
           FROM ranked WHERE turn <> 1 GROUP BY axis, feature, id)
SELECT feature, RND(greatest(0, {_psi_sql("count(*) FILTER (WHERE axis = 'x')")} + {_psi_sql(k)}
       - 2 * avg({_psi_sql('m')})), 6) AS mi FROM inside GROUP BY feature"""


@query("s03b_mutual_info_regression_neighbours", _near_plane_sql(["qty", "noise"], "price", 3), views=FT)
def s03b_mutual_info_regression_neighbours(spark, d):
    """MI of continuous features with a continuous target from 3 neighbours in the plane (S3)."""
    return NB.against_target(view(spark, d, "feat"), ["qty", "noise"], "price", "id", k=3).withColumn("mi", S.rnd("mi", 6))


def _chi_sql(ct):
    return f"""WITH ct AS ({ct}),
r AS (SELECT feature, value, sum(o) AS rn FROM ct GROUP BY 1, 2),
c AS (SELECT feature, label, sum(o) AS cn FROM ct GROUP BY 1, 2),
t AS (SELECT feature, sum(o) AS n, count(DISTINCT value) AS nr, count(DISTINCT label) AS nc FROM ct GROUP BY 1),
cells AS (SELECT r.feature, coalesce(ct.o, 0) AS o, rn * cn / n AS e, nr, nc FROM r JOIN c USING (feature) JOIN t USING (feature)
 LEFT JOIN ct ON ct.feature = r.feature AND ct.value = r.value AND ct.label = c.label)
SELECT feature, RND(sum((o - e) * (o - e) / e), 6) AS chi2,
 RND(CASE WHEN max((nr - 1) * (nc - 1)) = 1
  THEN sum(greatest(abs(o - e) - least(abs(o - e), 0.5), 0) * greatest(abs(o - e) - least(abs(o - e), 0.5), 0) / e)
  ELSE sum((o - e) * (o - e) / e) END, 6) AS chi2_yates,
 CAST(max((nr - 1) * (nc - 1)) AS BIGINT) AS dof FROM cells GROUP BY feature"""


@query("s04_chi_square", _chi_sql(_ct_sql(CAT_COLS)), views=P)
def s04_chi_square(spark, d):
    out = ST.chi_square(view(spark, d, "people"), CAT_COLS, "target")
    return out.select("feature", S.rnd("chi2", 6).alias("chi2"), S.rnd("chi2_yates", 6).alias("chi2_yates"), "dof")


@query("s04b_chi_square_pvalue")
def s04b_chi_square_pvalue(spark, d):
    """Chi-square p-values (scipy's rule: Yates when dof == 1), smallest first (T3 with p-values)."""
    out = ST.chi_square(view(spark, d, "people"), CAT_COLS, "target")
    stat = F.col("chi2_yates")
    return out.select("feature", stat.alias("stat"), "dof", chi2_pvalue(stat, "dof").alias("p_value")).orderBy("p_value")


@query("s05_goodness_of_fit", """WITH o AS (SELECT priority, count(*) AS o FROM people GROUP BY priority),
e AS (SELECT sum(o) / count(*) AS e, count(*) AS k FROM o)
SELECT RND(sum((o - e) * (o - e) / e), 6) AS chi2, CAST(max(k) - 1 - 1 AS BIGINT) AS dof FROM o, e""", views=P)
def s05_goodness_of_fit(spark, d):
    """``chisquare(f_obs, ddof=1)`` against a uniform expectation."""
    o = view(spark, d, "people").groupBy("priority").agg(F.count(F.lit(1)).alias("o"))
    e = o.agg(F.sum("o") / F.count(F.lit(1))).scalar()      # scalar subquery, one value
    k = o.agg(F.count(F.lit(1))).scalar()
    diff = F.col("o") - e
    return o.agg(S.rnd(F.sum(diff * diff / e), 6).alias("chi2"), (F.max(F.lit(1)) * k - 2).cast("long").alias("dof"))


ANOVA_COLS = ["n_items", "qty", "max_disc", "min_tax", "noise", "price", "disc_nulls"]


def _anova_sql(cols):
    cm = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, target, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM feat GROUP BY target"
        for c in cols)
    return f"""WITH cm AS ({cm}),
per AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * v) AS ssw, sum(n * (m - g) * (m - g)) AS ssb FROM (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM cm)
        GROUP BY feature)
SELECT feature, CAST(n AS BIGINT) AS n, k, RND((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f FROM per"""


@query("s06_anova_f", _anova_sql(ANOVA_COLS), views=FT)
def s06_anova_f(spark, d):
    out = ST.anova_f(view(spark, d, "feat"), ANOVA_COLS, "target")
    return out.select("feature", "n", "k", S.rnd("f", 4).alias("f"))


@query("s06b_anova_select_k_best")
def s06b_anova_select_k_best(spark, d):
    """``SelectKBest(f_classif, k=3)`` with p-values."""
    out = ST.anova_f(view(spark, d, "feat"), ANOVA_COLS, "target")
    scored = out.withColumn("p_value", f_pvalue("f", F.col("k") - 1, F.col("n") - F.col("k"))).withColumnRenamed("f", "score")
    return RS.select_k_best(scored, 3)


REG_COLS = [c for c in ANOVA_COLS if c != "price"]


@query("s07_f_regression", "SELECT feature, n, RND(corr, 6) AS corr, RND(corr * corr / (1 - corr * corr) * (n - 2), 4) AS f FROM ("
       + per_feature(REG_COLS, "SELECT '{c}' AS feature, corr({c}, price) AS corr, count({c}) AS n FROM feat") + ")",
       views=FT)
def s07_f_regression(spark, d):
    out = ST.f_regression(view(spark, d, "feat"), REG_COLS, "price")
    return out.select("feature", "n", S.rnd("corr", 6).alias("corr"), S.rnd("f", 4).alias("f"))


@query("s08_corr_with_target", "SELECT feature, RND(corr, 6) AS corr FROM (" + per_feature(
    ANOVA_COLS, "SELECT '{c}' AS feature, corr({c}, target) AS corr FROM feat") + ")", views=FT)
def s08_corr_with_target(spark, d):
    return ST.corr_with(view(spark, d, "feat"), ANOVA_COLS, "target").withColumn("corr", S.rnd("corr", 6))


@query("s09_corrwith_column", "SELECT feature, RND(corr, 6) AS corr FROM (" + per_feature(
    ["n_items", "qty_corr", "noise", "price"], "SELECT '{c}' AS feature, corr({c}, qty) AS corr FROM feat") + ")", views=FT)
def s09_corrwith_column(spark, d):
    return ST.corr_with(view(spark, d, "feat"), ["n_items", "qty_corr", "noise", "price"], "qty").withColumn(
        "corr", S.rnd("corr", 6))


# --- selection on score tables (T3-T5) ------------------------------------------------------

@query("t03_select_k_best", "SELECT feature, RND(abs(corr), 6) AS score FROM (" + per_feature(
    ANOVA_COLS, "SELECT '{c}' AS feature, corr({c}, target) AS corr FROM feat") + ") ORDER BY score DESC, feature LIMIT 3",
       views=FT)
def t03_select_k_best(spark, d):
    sc = ST.corr_with(view(spark, d, "feat"), ANOVA_COLS, "target").select("feature", S.rnd(F.abs("corr"), 6).alias("score"))
    return RS.select_k_best(sc, 3)


@query("t04_select_percentile", """WITH s AS (SELECT feature, i, RND(abs(corr), 6) AS score FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS i, corr({c}, target) AS corr FROM feat" for i, c in enumerate(ANOVA_COLS)) + """)),
t AS (SELECT quantile_cont(score, 0.7) AS thr, CAST(floor(count(*) * 30 / 100.0) AS BIGINT) AS k FROM s),
a AS (SELECT s.* FROM s, t WHERE score > thr),
ties AS (SELECT s.*, row_number() OVER (ORDER BY i) AS r FROM s, t WHERE score = thr)
SELECT feature, i, score FROM a UNION ALL
SELECT feature, i, score FROM ties, t WHERE r <= k - (SELECT count(*) FROM a)""", views=FT)
def t04_select_percentile(spark, d):
    sc = ST.corr_with(view(spark, d, "feat"), ANOVA_COLS, "target")
    pos = spark.createDataFrame([(c, i) for i, c in enumerate(ANOVA_COLS)], "feature string, i int")
    sc = sc.join(pos, "feature").select("feature", "i", S.rnd(F.abs("corr"), 6).alias("score"))
    return RS.select_percentile(sc, 30, "score", "i")


@query("t05_threshold_rule", """WITH s AS (SELECT feature, RND(abs(corr), 6) AS score FROM (""" + per_feature(
    ANOVA_COLS, "SELECT '{c}' AS feature, corr({c}, target) AS corr FROM feat") + """))
SELECT feature, score FROM s WHERE score > (SELECT avg(score) FROM s)""", views=FT)
def t05_threshold_rule(spark, d):
    sc = ST.corr_with(view(spark, d, "feat"), ANOVA_COLS, "target").select("feature", S.rnd(F.abs("corr"), 6).alias("score"))
    return RS.keep_by_rule(sc, ">mean")


# --- 2.12 target-mean scores ------------------------------------------------------------------

@query("h03_mean_encoding", f"""WITH tr AS (SELECT * FROM people WHERE {SPLIT.format(k='id')} >= 30),
te AS (SELECT * FROM people WHERE {SPLIT.format(k='id')} < 30),
m AS (SELECT 'segment' AS feature, segment AS value, avg(target) AS tm FROM tr GROUP BY segment
      UNION ALL SELECT 'priority', priority, avg(target) FROM tr GROUP BY priority)
SELECT te.id, 'segment' AS feature, te.segment AS value, RND(m.tm, 6) AS target_mean FROM te LEFT JOIN m ON m.feature = 'segment' AND m.value = te.segment
UNION ALL SELECT te.id, 'priority', te.priority, RND(m.tm, 6) FROM te LEFT JOIN m ON m.feature = 'priority' AND m.value = te.priority""",
       views=P)
def h03_mean_encoding(spark, d):
    from kestrel.operators.sampling import split_frames
    tr, te = split_frames(view(spark, d, "people"), "id", 30)
    enc = TM.mean_encoding(tr, te, "id", ["segment", "priority"], "target")
    return enc.select("id", "feature", "value", S.rnd("target_mean", 6).alias("target_mean"))


@query("h04_quantile_edges", "SELECT " + ", ".join(
    f"RND(quantile_cont(qty, {i / 10}), 6) AS q{i}" for i in range(11)) + " FROM feat", views=FT)
def h04_quantile_edges(spark, d):
    """``qcut(q=10, retbins=True)`` edges (H4), exact interpolated percentiles."""
    df = view(spark, d, "feat")
    edges = ST.quantiles(df, ["qty"], [i / 10 for i in range(11)])["qty"]
    row = spark.createDataFrame([tuple(edges)], ", ".join(f"q{i} double" for i in range(11)))
    return row.select(*[S.rnd(f"q{i}", 6).alias(f"q{i}") for i in range(11)])


@query("h05_cut_apply", f"""WITH tr AS (SELECT * FROM feat WHERE {SPLIT.format(k='id')} >= 30),
te AS (SELECT * FROM feat WHERE {SPLIT.format(k='id')} < 30),
e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM tr)
SELECT id, CAST(coalesce(CASE WHEN price <= ed[1] OR price > ed[len(ed)] THEN NULL
 ELSE len(list_filter(ed, lambda x: x < price)) - 1 END, 0) AS INTEGER) AS price_bin FROM te, e""", views=FT)
def h05_cut_apply(spark, d):
    """Bins fitted on train applied to test; outside values -> null -> 0 (H5)."""
    from kestrel.operators.sampling import split_frames
    tr, te = split_frames(view(spark, d, "feat"), "id", 30)
    _, te_b, _ = TM.bin_numeric(tr, te, ["price"], q=5)
    return te_b.select("id", F.col("price").cast("int").alias("price_bin"))


@query("h06_roc_auc", """WITH s AS (SELECT value, sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS pos,
 sum(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS neg FROM events GROUP BY value),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT RND(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM r""")
def h06_roc_auc(spark, d):
    ev = table(spark, d, "events").withColumn("is_error", (F.col("event_type") == "error").cast("int"))
    return ST.auc_by_group(ev, None, "value", "is_error").select(S.rnd("auc", 6).alias("auc"))


KDD_COLS = ["segment", "priority", "status", "nation"]


def _kdd_sql(cols, pct=30):
    long = lambda t: " UNION ALL ".join(
        f"SELECT id, target, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM {t}" for c in cols)
    return f"""WITH tr AS (SELECT * FROM people WHERE {SPLIT.format(k='id')} >= {pct}),
te AS (SELECT * FROM people WHERE {SPLIT.format(k='id')} < {pct}),
m AS (SELECT feature, value, avg(target) AS tm FROM ({long('tr')}) GROUP BY 1, 2),
sc AS (SELECT l.feature, m.tm AS score, l.target FROM ({long('te')}) l LEFT JOIN m USING (feature, value)),
g AS (SELECT feature, score, sum(target) AS pos, sum(1 - target) AS neg FROM sc WHERE score IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT feature, RND(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM r GROUP BY feature"""


@query("h07_kdd_target_mean_auc", _kdd_sql(KDD_COLS), views=P)
def h07_kdd_target_mean_auc(spark, d):
    out = TM.target_mean_auc(view(spark, d, "people"), "id", KDD_COLS, "target", 30)
    return out.select("feature", S.rnd("auc", 6).alias("auc"))


def _h08_sql(cats, nums, folds=3, bins=5, equal_width=False):
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    fold = "CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1073741824 % {k} AS INTEGER)".format(k=folds)
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{probs}]) FILTER (WHERE fold <> k))) AS e_{c}" for c in nums)
    if equal_width:
        low, high = "min({c}) FILTER (WHERE fold <> k)", "max({c}) FILTER (WHERE fold <> k)"
        edges = ", ".join("[" + ", ".join(f"{low} + ({high} - {low}) * {i} / {bins}" for i in range(bins + 1)).replace("{c}", c)
                          + f"] AS e_{c}" for c in nums)
    tr_bin = lambda c: f"len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda v: v < {c}))"
    te_bin = lambda c: (f"CASE WHEN {c} IS NULL OR {c} <= e_{c}[1] OR {c} > e_{c}[len(e_{c})] THEN 0 "  # noqa: E731
                        f"ELSE len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda v: v < {c})) END")

    def long(side):
        parts = [f"SELECT k, id, target, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM {side}" for c in cats]
        parts += [f"SELECT k, id, target, '{c}' AS feature, CAST({c}_b AS VARCHAR) AS value FROM {side}" for c in nums]
        return " UNION ALL ".join(parts)
    trb = ", ".join(f"{tr_bin(c)} AS {c}_b" for c in nums)
    teb = ", ".join(f"{te_bin(c)} AS {c}_b" for c in nums)
    return f"""WITH f AS (SELECT *, {fold} AS fold FROM people),
ks AS (SELECT unnest(range({folds})) AS k),
ed AS (SELECT k, {edges} FROM f, ks GROUP BY k),
tr AS (SELECT f.*, ed.k, {trb} FROM f JOIN ed ON f.fold <> ed.k),
te AS (SELECT f.*, ed.k, {teb} FROM f JOIN ed ON f.fold = ed.k),
m AS (SELECT k, feature, value, avg(target) AS tm FROM ({long('tr')}) GROUP BY 1, 2, 3),
sc AS (SELECT l.k, l.feature, m.tm AS score, l.target FROM ({long('te')}) l
       JOIN m ON m.k = l.k AND m.feature = l.feature AND m.value = l.value),
g AS (SELECT k, feature, score, sum(target) AS pos, sum(1 - target) AS neg FROM sc WHERE score IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY k, feature ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT k, feature, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY 1, 2),
per AS (SELECT feature, avg(auc) AS auc_mean, stddev_samp(auc) AS auc_std FROM auc GROUP BY feature)
SELECT feature, RND(auc_mean, 6) AS auc_mean, RND(auc_std, 6) AS auc_std, auc_mean > (SELECT avg(auc_mean) FROM per) AS keep FROM per"""


@query("h08b_target_mean_equal_width", _h08_sql(KDD_COLS, ["fare", "balance"], equal_width=True), views=P)
def h08b_target_mean_equal_width(spark, d):
    """H8 with ``strategy='equal_width'``."""
    out = TM.target_mean_performance(view(spark, d, "people"), "id", KDD_COLS + ["fare", "balance"], "target", folds=3,
                                     numeric=["fare", "balance"], bins=5, strategy="equal_width")
    return out.select("feature", S.rnd("auc_mean", 6).alias("auc_mean"), S.rnd("auc_std", 6).alias("auc_std"), "keep")


@query("h08_target_mean_performance", _h08_sql(KDD_COLS, ["fare", "balance"]), views=P)
def h08_target_mean_performance(spark, d):
    """``SelectByTargetMeanPerformance(bins=5, cv=3)`` over categorical and
    binned numeric columns (H8)."""
    df = view(spark, d, "people")
    out = TM.target_mean_performance(df, "id", KDD_COLS + ["fare", "balance"], "target", folds=3,
                                     numeric=["fare", "balance"], bins=5)
    return out.select("feature", S.rnd("auc_mean", 6).alias("auc_mean"), S.rnd("auc_std", 6).alias("auc_std"), "keep")


@query("f07_duplicate_list", "SELECT DISTINCT feature FROM (" + _dup_sql(FEAT_NUMERIC) + ")", views=FT)
def f07_duplicate_list(spark, d):
    """Flat list of later copies."""
    return SEL.duplicate_pairs(view(spark, d, "feat"), FEAT_NUMERIC, "id").select("feature").distinct()


@query("f16_group_best_by_forest")
def f16_group_best_by_forest(spark, d):
    """Best member of each correlated group by forest importance (F16)."""
    from kestrel.operators import models as ML
    df = view(spark, d, "feat")
    groups = SEL.correlated_groups_by_strength(ST.corr_pairs(df, CORR_COLS), 0.8)
    used = sorted({c for g in groups for c in g})
    holes = [r["feature"] for r in ST.column_moments(df, used).where("n_null > 0").collect()]
    df = fill_median(df, holes) if holes else df
    rows = []
    for i, g in enumerate(groups):
        imp = ML.importance_table(ML.fit("rf_clf", df, g, "target", numTrees=10, maxDepth=3), g)
        rows.append((i, imp[0][0], ",".join(g)))
    return spark.createDataFrame(rows, "group_id int, best string, members string")


@query("s03_mutual_info_regression", "WITH b AS (" + _binned_sql(["qty", "noise", "max_disc", "price"], keep=()) + ")\n"
    + _mi_sql(_ct_sql(["qty", "noise", "max_disc"], "b", "price")).replace("WITH ct AS", ", ct AS", 1), views=FT)
def s03_mutual_info_regression(spark, d):
    """MI against a continuous target (S3): both sides binned, then S1."""
    df = view(spark, d, "feat")
    cols = ["qty", "noise", "max_disc", "price"]
    edges = ST.quantile_edges(df, cols, 10)
    b = df.select(*[ST.bin_column(c, edges[c], outside="clip").alias(c) for c in cols])
    return ST.mutual_info_discrete(b, cols[:-1], "price").withColumn("mi", S.rnd("mi", 6))


@query("z04_pluggable_score_function", "SELECT feature, RND(abs(corr), 6) AS score FROM (" + per_feature(
    ANOVA_COLS, "SELECT '{c}' AS feature, corr({c}, target) AS corr FROM feat") + ") ORDER BY score DESC, feature LIMIT 2",
       views=FT)
def z04_pluggable_score_function(spark, d):
    """``SelectKBest(score_func=...)`` with any function returning a score
    table (Z4): here abs correlation with the target, k = 2."""
    def score_func(df, cols, label):
        return ST.corr_with(df, cols, label).select("feature", S.rnd(F.abs("corr"), 6).alias("score"))
    return RS.select_k_best(score_func(view(spark, d, "feat"), ANOVA_COLS, "target"), 2)
