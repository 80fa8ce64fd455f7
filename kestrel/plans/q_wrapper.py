"""Registered queries: wrapper searches and linear scores from one Gram pass
(SURVEY 2.13, E3, L5, Y6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import linear as LN
from kestrel.operators.sampling import fold_column
from kestrel.plans.registry import query
from kestrel.sources.fixtures import table, view

FT = ("feat",)
WRAP_COLS = ["n_items", "qty", "max_disc", "min_tax", "noise"]
TARGET = "price"


def _r_sql(cols, y):
    rs = [f"corr({c}, {y}) AS r_{c}" for c in cols]
    rs += [f"corr({a}, {b}) AS r_{a}_{b}" for i, a in enumerate(cols) for b in cols[i + 1:]]
    return "SELECT " + ", ".join(rs) + " FROM feat"


def _subset_sql(cols, y):
    one = [f"SELECT '{c}' AS subset, 1 AS k, RND(r_{c} * r_{c}, 6) AS r2, {i} AS i1, -1 AS i2 FROM c" for i, c in enumerate(cols)]
    two = [f"SELECT '{a},{b}' AS subset, 2 AS k, RND((r_{a} * r_{a} + r_{b} * r_{b} - 2 * r_{a} * r_{b} * r_{a}_{b}) / "
           f"(1 - r_{a}_{b} * r_{a}_{b}), 6) AS r2, {i} AS i1, {j} AS i2 FROM c"
           for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i]
    return f"WITH c AS ({_r_sql(cols, y)}), s AS (" + " UNION ALL ".join(one + two) + ")"


@query("x05_exhaustive_linear", _subset_sql(WRAP_COLS, TARGET) + " SELECT subset, k, r2 FROM s", views=FT)
def x05_exhaustive_linear(spark, d):
    """All subsets of size 1-2 scored by in-sample R^2 from one Gram pass."""
    g = LN.gram_stats(view(spark, d, "feat"), WRAP_COLS, TARGET)
    return LN.exhaustive_scores(spark, g, 1, 2).select("subset", "k", S.rnd("r2", 6).alias("r2"))


@query("x01_forward_linear", _subset_sql(WRAP_COLS, TARGET) + """,
b1 AS (SELECT subset AS f1, i1 AS j1, r2 FROM s WHERE k = 1 ORDER BY r2 DESC, i1 LIMIT 1),
b2 AS (SELECT CASE WHEN s.i1 = b1.j1 THEN split_part(s.subset, ',', 2) ELSE split_part(s.subset, ',', 1) END AS f2, s.r2,
       CASE WHEN s.i1 = b1.j1 THEN s.i2 ELSE s.i1 END AS j2
       FROM s, b1 WHERE s.k = 2 AND (s.i1 = b1.j1 OR s.i2 = b1.j1) ORDER BY s.r2 DESC, j2 LIMIT 1)
SELECT 1 AS step, f1 AS feature, r2 AS score FROM b1 UNION ALL SELECT 2, f2, r2 FROM b2""", views=FT)
def x01_forward_linear(spark, d):
    """Step-forward selection to k = 2 with a linear scorer."""
    g = LN.gram_stats(view(spark, d, "feat"), WRAP_COLS, TARGET)
    steps = [(s, f, float(sc)) for s, f, sc in LN.forward_select(g, 2)]
    df = spark.createDataFrame(steps, "step int, feature string, score double")
    return df.select("step", "feature", S.rnd("score", 6).alias("score"))


def _cv_gram(spark, d, cols=WRAP_COLS, k=3):
    df = fold_column(view(spark, d, "feat"), "id", k, seed=1)
    return LN.gram_stats(df, cols, TARGET, "fold")


def _linear_ctes(cols, y, folds=3, seed=1):
    """CTEs ``sub(mask, r2)``, the mean held-out R^2 of every subset, and ``coefs(i, beta)`` of all columns on all rows.

    A subset's least squares come from sweeping its columns out of the matrix of
    covariances, one column a step of a recursion; the rows of fold -1 are all rows.
    """
    names, p = [*cols, y], len(cols)
    fold = f"CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) % 1073741824 % {folds} AS INTEGER)"
    means = ", ".join(f"avg({c})" for c in names)
    moments = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in names) + "]" for a in names)
    sums = f"count(*) AS n, [{means}] AS m, [{moments}] AS c"
    size = p + 1
    swept = (f"list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: "
             "CASE WHEN i = k AND j = k THEN -1 / a[k][k] WHEN i = k OR j = k THEN a[i][j] / a[k][k] ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END))")
    return f"""rows AS (SELECT *, {fold} AS fold FROM feat),
train AS (SELECT f, {sums} FROM rows, (SELECT unnest(range({folds})) AS f) WHERE fold <> f GROUP BY f
          UNION ALL SELECT -1, {sums} FROM rows),
test AS (SELECT fold AS f, {sums} FROM rows GROUP BY fold),
sweep(mask, f, k, a) AS (
  SELECT CAST(mask AS INTEGER), f, 1, c FROM train, range(1, {1 << p}) r(mask)
  UNION ALL
  SELECT mask, f, k + 1, CASE WHEN (mask >> (k - 1)) & 1 = 1 THEN {swept} ELSE a END FROM sweep WHERE k <= {p}),
fitted AS (SELECT mask, f, list_transform(range(1, {p + 1}), lambda i: CASE WHEN (mask >> CAST(i - 1 AS INTEGER)) & 1 = 1 THEN a[i][{size}] ELSE 0 END) AS beta
           FROM sweep WHERE k = {p + 1}),
held AS (SELECT w.mask, t.f, t.c[{size}][{size}] AS spread,
         t.m[{size}] - tr.m[{size}] - list_dot_product(beta, list_transform(range(1, {p + 1}), lambda i: t.m[i] - tr.m[i])) AS off,
         t.c[{size}][{size}] - 2 * list_dot_product(beta, list_transform(range(1, {p + 1}), lambda i: t.c[i][{size}]))
           + list_dot_product(beta, list_transform(range(1, {p + 1}), lambda i: list_dot_product(beta, t.c[i][1:{p}]))) AS var
         FROM fitted w JOIN train tr ON tr.f = w.f JOIN test t ON t.f = w.f),
sub AS (SELECT mask, avg(1 - (var + off * off) / spread) AS r2 FROM held GROUP BY mask),
coefs AS (SELECT unnest(range(1, {p + 1})) AS i, unnest(list_transform(range(1, {p + 1}), lambda i: beta[i] * sqrt(tr.c[i][i]))) AS beta
          FROM fitted w JOIN train tr ON tr.f = -1 WHERE w.f = -1 AND w.mask = {(1 << p) - 1})"""


def _names_sql(cols):
    return "[" + ", ".join(f"'{c}'" for c in cols) + "]"


NAMES = _names_sql(WRAP_COLS)
BIT = "CAST(log2({0}) AS INTEGER) + 1"
ALL_MASK = (1 << len(WRAP_COLS)) - 1


def _walk_sql(forward, stop, tol):
    """The greedy search over ``sub``: ``walk(step, mask, bit, score)``, ``bit`` the column added or removed."""
    more, begin = ("s.mask & w.mask = w.mask", 0) if forward else ("s.mask & w.mask = s.mask", ALL_MASK)
    bit = "(s.mask - w.mask)" if forward else "(w.mask - s.mask)"
    gain = "true" if tol is None else f"(prev IS NULL OR r2 - prev >= {tol})" if forward else f"prev - r2 <= {tol}"
    return f"""walk(step, mask, bit, score) AS (
  SELECT 0, {begin}, 0, {'CAST(NULL AS DOUBLE)' if forward else f'(SELECT r2 FROM sub WHERE mask = {ALL_MASK})'}
  UNION ALL
  SELECT step + 1, mask, bit, r2 FROM (
    SELECT w.step, w.score AS prev, s.mask, {bit} AS bit, s.r2, row_number() OVER (ORDER BY s.r2 DESC, {bit} {'ASC' if forward else 'DESC'}) AS nth
    FROM walk w JOIN sub s ON {more} AND bit_count(s.mask) = bit_count(w.mask) {'+ 1' if forward else '- 1'}
    WHERE bit_count(w.mask) {'<' if forward else '>'} {stop}) WHERE nth = 1 AND {gain})"""


@query("x02_forward_tol_cv", "WITH RECURSIVE " + _linear_ctes(WRAP_COLS, TARGET) + ",\n" + _walk_sql(True, 4, 0.0) + f"""
SELECT step, {NAMES}[{BIT.format('bit')}] AS feature, RND(score, 9) AS score FROM walk WHERE step > 0""", views=FT)
def x02_forward_tol_cv(spark, d):
    """Forward search with ``n_features_to_select = 4`` on 3-fold CV R^2, ended before that when the best gain is negative."""
    steps = LN.forward_select(_cv_gram(spark, d), 4, cv=True, tol=0.0)
    return spark.createDataFrame(steps, "step int, feature string, score double").withColumn("score", S.rnd("score", 9))


@query("x03_backward_cv", "WITH RECURSIVE " + _linear_ctes(WRAP_COLS, TARGET) + ",\n" + _walk_sql(False, 2, None) + f"""
SELECT CAST(bit_count(mask) AS INTEGER) AS n_left, {NAMES}[{BIT.format('bit')}] AS removed, RND(score, 9) AS score FROM walk WHERE step > 0""", views=FT)
def x03_backward_cv(spark, d):
    """Step-backward to k = 2 on 3-fold CV R^2 (X3); rows are removals."""
    _, steps = LN.backward_select(_cv_gram(spark, d), 2, cv=True)
    return spark.createDataFrame(steps, "n_left int, removed string, score double").withColumn("score", S.rnd("score", 9))


X4_TOL = 0.0


@query("x04_backward_tol_cv", "WITH RECURSIVE " + _linear_ctes(WRAP_COLS, TARGET) + ",\n" + _walk_sql(False, 1, X4_TOL) + f""",
fin AS (SELECT arg_max(mask, step) AS mask FROM walk)
SELECT {NAMES}[{BIT.format('bit')}] AS feature, false AS kept, RND(score, 9) AS score FROM walk WHERE step > 0
UNION ALL SELECT {NAMES}[b + 1], true, NULL FROM fin, range({len(WRAP_COLS)}) r(b) WHERE (mask >> CAST(b AS INTEGER)) & 1 = 1""", views=FT)
def x04_backward_tol_cv(spark, d):
    """Backward with a tolerance (X4): stop when a removal costs more than tol; removals, then what is left."""
    kept, steps = LN.backward_select(_cv_gram(spark, d), 1, cv=True, tol=X4_TOL)
    rows = [(f, False, float(score)) for _, f, score in steps] + [(f, True, None) for f in kept]
    return spark.createDataFrame(rows, "feature string, kept boolean, score double").withColumn("score", S.rnd("score", 9))


@query("x05b_exhaustive_cv", "WITH RECURSIVE " + _linear_ctes(WRAP_COLS, TARGET) + f"""
SELECT array_to_string([x FOR x, i IN {NAMES} IF (mask >> CAST(i - 1 AS INTEGER)) & 1 = 1], ',') AS subset, CAST(bit_count(mask) AS INTEGER) AS k,
       RND(r2, 9) AS r2 FROM sub WHERE bit_count(mask) <= 3""", views=FT)
def x05b_exhaustive_cv(spark, d):
    """Exhaustive search over sizes 1-3 with 3-fold CV R^2 (X5), best first."""
    scores = LN.exhaustive_scores(spark, _cv_gram(spark, d), 1, 3, cv=True)
    return scores.orderBy(F.desc("r2"), "subset").withColumn("r2", S.rnd("r2", 9))


def _standardised(g):
    """Coefficients of all columns in population standard deviations (E1), from the same sums."""
    n, s, P = g.total()
    coef = LN.coefficients(g)
    return [(c, float(coef[c] * (P[i, i] / n - (s[i] / n) ** 2) ** 0.5)) for i, c in enumerate(g.cols)]


@query("e03_linear_coefficients", "WITH RECURSIVE " + _linear_ctes(WRAP_COLS, TARGET) + f"""
SELECT {NAMES}[i] AS feature, RND(beta, 4) AS coef, abs(beta) > avg(abs(beta)) OVER () AS keep FROM coefs""", views=FT)
def e03_linear_coefficients(spark, d):
    """Linear-regression coefficients on standardised features; keep abs(coef) > mean abs coef."""
    rows = _standardised(LN.gram_stats(view(spark, d, "feat"), WRAP_COLS, TARGET))
    mean_abs = sum(abs(v) for _, v in rows) / len(rows)
    out = spark.createDataFrame([(c, v, abs(v) > mean_abs) for c, v in rows], "feature string, coef double, keep boolean")
    return out.withColumn("coef", S.rnd("coef", 4))


Y6_TOL = 0.001


@query("y06_recursive_addition_linear", "WITH RECURSIVE " + _linear_ctes(WRAP_COLS, TARGET) + f""",
ranked AS (SELECT CAST(row_number() OVER (ORDER BY abs(beta) DESC, i) AS INTEGER) AS nth, CAST(1 << CAST(i - 1 AS INTEGER) AS INTEGER) AS bit FROM coefs),
walk(nth, mask, base, bit, gain, kept) AS (
  SELECT 1, bit, (SELECT r2 FROM sub WHERE sub.mask = bit), bit, (SELECT r2 FROM sub WHERE sub.mask = bit), true FROM ranked WHERE nth = 1
  UNION ALL
  SELECT w.nth + 1, CASE WHEN s.r2 - w.base >= {Y6_TOL} THEN s.mask ELSE w.mask END, CASE WHEN s.r2 - w.base >= {Y6_TOL} THEN s.r2 ELSE w.base END,
         r.bit, s.r2 - w.base, s.r2 - w.base >= {Y6_TOL}
  FROM walk w JOIN ranked r ON r.nth = w.nth + 1 JOIN sub s ON s.mask = w.mask + r.bit)
SELECT {NAMES}[{BIT.format('bit')}] AS feature, RND(gain, 9) AS gain, kept FROM walk""", views=FT)
def y06_recursive_addition_linear(spark, d):
    """Recursive feature addition with a linear CV scorer (Y6): features
    ordered by abs standardised coefficient, kept when the gain >= 0.001."""
    g = _cv_gram(spark, d)
    order = [c for c, _ in sorted(_standardised(g), key=lambda t: -abs(t[1]))]
    _, log = LN.recursive_addition(g, order, Y6_TOL, cv=True)
    return spark.createDataFrame(log, "feature string, gain double, kept boolean").withColumn("gain", S.rnd("gain", 9))


@query("l05_linear_regression", """SELECT RND(covar_samp(p_size, p_retailprice) / var_samp(p_size), 6) AS slope,
 RND(avg(p_retailprice) - covar_samp(p_size, p_retailprice) / var_samp(p_size) * avg(p_size), 6) AS intercept FROM part""")
def l05_linear_regression(spark, d):
    """Least squares fit of retail price on size from the sufficient statistics."""
    g = LN.gram_stats(table(spark, d, "part"), ["p_size"], "p_retailprice")
    c = LN.coefficients(g)
    return spark.createDataFrame([(c["p_size"], c["intercept"])], "slope double, intercept double").select(
        S.rnd("slope", 6).alias("slope"), S.rnd("intercept", 6).alias("intercept"))


def _cv_subset_sql(cols, y, folds=3, seed=1):
    """Held-out R^2 per subset of size 1-2, averaged over hash folds, with the
    OLS fit of each training part written out in closed form (oracle for
    ``x05c``)."""
    fold = (f"CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) "
            f"% 1073741824 % {folds} AS INTEGER)")
    names = list(cols) + [y]
    mom = [f"avg({c}) AS m_{c}" for c in names]
    mom += [f"covar_pop({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]
    subsets = [(c,) for c in cols] + [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    preds = []
    for sub in subsets:
        if len(sub) == 1:
            a = sub[0]
            b1 = f"(t.c_{a}_{y} / t.c_{a}_{a})"
            pred = f"(t.m_{y} + {b1} * (f.{a} - t.m_{a}))"
        else:
            a, b = sub
            det = f"(t.c_{a}_{a} * t.c_{b}_{b} - t.c_{a}_{b} * t.c_{a}_{b})"
            ba = f"((t.c_{a}_{y} * t.c_{b}_{b} - t.c_{b}_{y} * t.c_{a}_{b}) / {det})"
            bb = f"((t.c_{b}_{y} * t.c_{a}_{a} - t.c_{a}_{y} * t.c_{a}_{b}) / {det})"
            pred = f"(t.m_{y} + {ba} * (f.{a} - t.m_{a}) + {bb} * (f.{b} - t.m_{b}))"
        preds.append(f"SELECT t.k, '{','.join(sub)}' AS subset, {len(sub)} AS k_size, "
                     f"1 - sum((f.{y} - {pred}) * (f.{y} - {pred})) / (var_pop(f.{y}) * count(*)) AS r2 "
                     f"FROM f JOIN t ON f.fold = t.k GROUP BY t.k")
    return f"""WITH f AS (SELECT *, {fold} AS fold FROM feat),
ks AS (SELECT unnest(range({folds})) AS k),
t AS (SELECT ks.k, {', '.join(mom)} FROM f JOIN ks ON f.fold <> ks.k GROUP BY ks.k),
s AS ({' UNION ALL '.join(preds)})
SELECT subset, k_size AS k, RND(avg(r2), 6) AS r2 FROM s GROUP BY subset, k_size"""


@query("x05c_exhaustive_cv_k2", _cv_subset_sql(WRAP_COLS, TARGET), views=FT)
def x05c_exhaustive_cv_k2(spark, d):
    """Exhaustive search over sizes 1-2 scored by 3-fold held-out R^2 from the
    fold-wise Gram sums (X5 with cv)."""
    g = _cv_gram(spark, d)
    return LN.exhaustive_scores(spark, g, 1, 2, cv=True).select("subset", "k", S.rnd("r2", 6).alias("r2"))
