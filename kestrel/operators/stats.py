"""Column statistics in few distributed passes.

Conventions
* Inputs are one DataFrame holding features (and a label where needed).
* Results are small long tables: one row per feature, per (feature, value)
  or per feature pair.  Only those reach the driver, never data rows.
* Wide aggregates are chunked (about 100 expressions per ``agg``) to stay
  inside whole-stage codegen limits.
* Long forms (``unpivot``) are aggregated with map-side combine, so a value
  holding a third of all rows costs one partial count per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100


def _chunks(xs, n=CHUNK):
    xs = list(xs)
    return [xs[i:i + n] for i in range(0, len(xs), n)] or [[]]


def _union(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _long_from_row(wide: DataFrame, cols, stats: list[str]) -> DataFrame:
    """One-row frame with ``<stat>__<col>`` columns -> (feature, stat...) rows."""
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols
    ])).alias("r")).select("r.*")


# --- per-column moments ------------------------------------------------------

def _summed(table: DataFrame, partial) -> dict:
    """Sum per row number of what ``partial`` makes of each task's pandas batches.

    ``partial(pdf)`` gives a matrix; the matrices of a task are added up in
    the task, then row by row over the tasks by a distributed aggregate, so
    the driver receives one matrix whatever the size of the table.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def run(it):
        acc = None
        for pdf in it:
            if len(pdf):
                part = partial(pdf)
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"i": np.arange(len(acc), dtype=np.int32), "v": list(acc)})

    rows = table.mapInPandas(run, "i int, v array<double>").groupBy("i").agg(
        Summarizer.sum(array_to_vector("v")).alias("s")).collect()
    return {r["i"]: r["s"].toArray() for r in rows}


def _doubles(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def column_moments(df: DataFrame, cols) -> DataFrame:
    """(feature, n_rows, n_null, mean, std, var, var_pop, min, max) in two passes, for any number of columns.

    ``std``/``var`` are sample statistics (pandas ``std()``), ``var_pop`` is
    scikit-learn's ``VarianceThreshold`` variance.  Null and NaN are missing.
    The first pass takes one mean, minimum and maximum per column, the second
    sums the squared deviations.
    """
    import numpy as np
    cols = list(cols)
    table = _doubles(df, cols).select(*[F.nanvl(f"c{i}", F.lit(None)).alias(f"c{i}") for i in range(len(cols))])
    first = table.agg(F.count(F.lit(1)), *[f(f"c{i}") for i in range(len(cols)) for f in (F.avg, F.min, F.max, F.count)]).first()
    n_rows, mean = first[0], [first[1 + 4 * i] for i in range(len(cols))]
    mu = np.array([0.0 if m is None else m for m in mean])

    def squares(pdf):
        x = np.nan_to_num(pdf.to_numpy(dtype=float, na_value=np.nan) - mu, nan=0.0, posinf=np.inf, neginf=-np.inf)
        return np.stack([(x * x).sum(axis=0), x.sum(axis=0)])
    got = _summed(table, squares)
    rows = []
    for i, c in enumerate(cols):
        n, low, high = first[4 + 4 * i], first[2 + 4 * i], first[3 + 4 * i]
        m2 = max(0.0, float(got[0][i]) - float(got[1][i]) ** 2 / n) if n and got else None
        var = m2 / (n - 1) if n > 1 else None
        rows.append((c, n_rows, n_rows - n, mean[i], None if var is None else var ** 0.5, var, m2 / n if n else None, low, high))
    return df.sparkSession.createDataFrame(
        rows, "feature string, n_rows long, n_null long, mean double, std double, var double, var_pop double, min double, max double")


def value_counts(df: DataFrame, cols, dropna: bool = True) -> DataFrame:
    """(feature, value, count) for every column (G7) in one unpivot pass.

    Values are compared as strings (numeric columns first cast to double, so
    1 and 1.0 agree).  ``dropna=False`` keeps a null value group.
    """
    num = {f.name for f in df.schema.fields if f.dataType.typeName() in
           ("byte", "short", "integer", "long", "float", "double", "decimal")}
    proj = df.select(*[(F.col(c).cast("double") if c in num else F.col(c)).cast("string").alias(c) for c in cols])
    long = proj.unpivot([], list(cols), "feature", "value")
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))


def frequency_summary(df: DataFrame, cols, dropna: bool = True) -> DataFrame:
    """(feature, n_distinct, top_count, n_counted, n_rows) per column.

    ``n_distinct`` is ``nunique()`` (nulls ignored unless ``dropna=False``);
    ``top_count / n_counted`` is ``value_counts(normalize=True).max()``.
    """
    vc = value_counts(df, cols, dropna)
    total = df.agg(F.count(F.lit(1))).scalar()
    return (vc.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("count").alias("top_count"),
                                      F.sum("count").alias("n_counted"))
            .withColumn("n_rows", total))


def predominant_share(df: DataFrame, cols, denominator: str = "non_null") -> DataFrame:
    """(feature, share) of the most frequent value.

    ``denominator='non_null'`` is ``value_counts(normalize=True)``;
    ``'all'`` is ``value_counts() / len(df)``.
    """
    fs = frequency_summary(df, cols)
    den = F.col("n_counted") if denominator == "non_null" else F.col("n_rows")
    return fs.select("feature", (F.col("top_count") / den).alias("share"))


# --- correlation -------------------------------------------------------------

def corr_pairs(df: DataFrame, cols) -> DataFrame:
    """(feature1, feature2, i1, i2, corr) for every pair i1 < i2 in column order.

    Pairwise-complete Pearson r (pandas ``corr()``) in one pass, whatever the
    number of columns; null and NaN are missing; a constant side gives null.

    Each task turns its Arrow batches into four p x p partial sums (numpy
    matrix products with a presence mask, values centred on the global
    means); the driver receives 4p^2 numbers.
    """
    cols = list(cols)
    r, _ = _pairwise(df, cols, range(len(cols)))
    rows = [(cols[i], cols[j], i, j, r[i][j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "feature1 string, feature2 string, i1 int, i2 int, corr double")


def _pairwise(df: DataFrame, cols, others) -> tuple[list[list], list[list]]:
    """Pearson r and number of complete rows of each column with the columns at positions ``others``."""
    import numpy as np
    p, others = len(cols), list(others)
    table = _doubles(df, cols)
    means = table.agg(*[F.avg(F.nanvl(f"c{i}", F.lit(None))) for i in range(p)]).first()
    mu = np.array([m if m is not None else 0.0 for m in means], dtype=float)

    def partial(pdf):
        x = pdf.to_numpy(dtype=float, na_value=np.nan) - mu
        m = ~np.isnan(x)
        x0, mf = np.where(m, x, 0.0), m.astype(float)
        y0, yf = x0[:, others], mf[:, others]
        return np.concatenate([mf.T @ yf, x0.T @ yf, (x0 * x0).T @ yf, x0.T @ y0, mf.T @ y0, mf.T @ (y0 * y0)], axis=1)

    got, q = _summed(table, partial), len(others)
    r = [[None] * q for _ in range(p)]
    count = [[0] * q for _ in range(p)]
    for i in range(p):
        if i not in got:
            continue
        n, sx, sxx, sxy, sy, syy = (got[i][k * q:(k + 1) * q] for k in range(6))
        for j in range(q):
            count[i][j] = int(n[j])
            vx, vy = n[j] * sxx[j] - sx[j] * sx[j], n[j] * syy[j] - sy[j] * sy[j]
            if n[j] > 1 and vx > 0 and vy > 0:
                r[i][j] = float(np.clip((n[j] * sxy[j] - sx[j] * sy[j]) / np.sqrt(vx * vy), -1.0, 1.0))
    return r, count


def corr_with(df: DataFrame, cols, target: str) -> DataFrame:
    """(feature, corr) of each column with one column (S8, S9), in one pass after the means."""
    cols = list(cols)
    r, _ = _pairwise(df, [*cols, target], [len(cols)])
    return df.sparkSession.createDataFrame([(c, r[i][0]) for i, c in enumerate(cols)], "feature string, corr double")


# --- label-conditional statistics ---------------------------------------------

def class_moments(df: DataFrame, cols, label: str) -> DataFrame:
    """(feature, label, n, mean, m2) = count, mean and sum of squared deviations per class.

    One ``groupBy(label)`` pass with partial aggregation, whatever the class
    balance; the result has (#classes x #features) rows.  Deviations are from
    the class mean (merged by ``var_pop``), so a large common offset costs no
    precision.
    """
    parts = []
    for chunk in _chunks(cols, CHUNK // 3):
        exprs = []
        for c in chunk:
            x = F.col(c).cast("double")
            exprs += [F.count(x).alias(f"n__{c}"), F.avg(x).alias(f"mean__{c}"), F.var_pop(x).alias(f"var__{c}")]
        wide = df.groupBy(label).agg(*exprs)
        parts.append(wide.select(F.col(label).alias("label"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"n__{c}").alias("n"), F.col(f"mean__{c}").alias("mean"),
                     (F.col(f"n__{c}") * F.col(f"var__{c}")).alias("m2")) for c in chunk])).alias("r")).select("label", "r.*"))
    return _union(parts)


def anova_f(df: DataFrame, cols, label: str) -> DataFrame:
    """One-way ANOVA F per feature against a class label (S6, ``f_classif``).

    F = (SSB / (k - 1)) / (SSW / (n - k)); SSW sums the classes' own squared
    deviations, SSB is the weighted variance of the class means.
    """
    cm = class_moments(df, cols, label).where(F.col("n") > 0)
    grand = Window.partitionBy("feature")                # one row per class
    mean = F.sum(F.col("n") * F.col("mean")).over(grand) / F.sum("n").over(grand)
    per = cm.withColumn("away", F.col("mean") - mean).groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("away") * F.col("away")).alias("ssb"), F.sum("m2").alias("ssw"))
    return per.select("feature", "n", "k",
                      F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("f"))


def f_regression(df: DataFrame, cols, target: str) -> DataFrame:
    """F statistic of a univariate linear fit per feature (S7):
    F = r^2 / (1 - r^2) * (n - 2), n = rows with both values present."""
    cols = list(cols)
    r, n = _pairwise(df, [*cols, target], [len(cols)])
    table = df.sparkSession.createDataFrame([(c, n[i][0], r[i][0]) for i, c in enumerate(cols)], "feature string, n long, corr double")
    r2 = F.col("corr") * F.col("corr")
    return table.withColumn("f", F.try_divide(r2, 1 - r2) * (F.col("n") - 2))


def _small(df: DataFrame) -> DataFrame:
    """Materialise a small derived table that several branches reuse (a
    contingency table has one row per (feature, value, label)), as a reliable
    checkpoint: the big input is scanned once and the lineage is cut."""
    from kestrel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def contingency(df: DataFrame, cols, label: str) -> DataFrame:
    """(feature, value, label, count) long contingency table."""
    proj = df.select(F.col(label).alias("_klabel"), *[F.col(c).cast("string").alias(c) for c in cols])
    long = proj.unpivot(["_klabel"], list(cols), "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy("feature", "value", "_klabel").agg(F.count(F.lit(1)).alias("count")).withColumnRenamed(
        "_klabel", "label")


def chi_square(df: DataFrame, cols, label: str) -> DataFrame:
    """Chi-square test of independence per feature.

    Returns the plain statistic, the Yates-corrected one (what scipy's
    ``chi2_contingency`` reports when dof == 1) and dof.  With margins r, c of
    the observed cells o the plain statistic is n * (sum o^2 / (r * c) - 1),
    so empty cells need no rows; a 2 x 2 table has one deviation
    d = |o - r * c / n| in all four cells, and the Yates form scales the plain
    one by ((d - min(d, 0.5)) / d)^2.
    """
    ct = contingency(df, cols, label)
    # A window over one value's cells has as many rows as there are labels; the other margins are partial sums.
    cells = ct.select("feature", "value", "label", F.col("count").alias("o"),
                      F.sum("count").over(Window.partitionBy("feature", "value")).alias("r"))
    columns = cells.groupBy("feature", "label").agg(
        F.sum("o").alias("c"), F.sum(F.col("o") * F.col("o") / F.col("r")).alias("s"), F.min(F.struct("value", "o", "r")).alias("cell"))
    values = ct.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    one = F.min(F.struct(F.col("label").isNull(), "label", "cell.o", "cell.r", "c"))
    per = (columns.groupBy("feature").agg(F.sum("c").alias("n"), F.sum(F.col("s") / F.col("c")).alias("share"), one.alias("one"),
                                          F.count("label").alias("columns"))
           .withColumn("d", F.abs(F.col("one.o") - F.col("one.r") * F.col("one.c") / F.col("n"))).join(values, "feature"))
    chi2 = F.col("n") * (F.col("share") - 1)
    cut = F.try_divide(F.col("d") - F.least("d", F.lit(0.5)), F.col("d"))
    two = (F.col("rows") == 2) & (F.col("columns") == 2)
    return per.select("feature", chi2.alias("chi2"), F.when(two, chi2 * F.coalesce(cut * cut, F.lit(0.0))).otherwise(chi2).alias("chi2_yates"),
                      ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("long").alias("dof"))


def mutual_info_discrete(df: DataFrame, cols, label: str) -> DataFrame:
    """Mutual information (nats) between discrete features and a class (S1):
    sum p(x,y) ln(p(x,y) / (p(x) p(y))), computed as
    (sum o ln o - sum n_x ln n_x - sum n_y ln n_y) / n + ln n from the
    contingency table and its margins (no cell-level joins)."""
    ct = _small(contingency(df, cols, label))
    xlogx = lambda c: F.col(c) * F.log(F.col(c))
    cells = ct.groupBy("feature").agg(F.sum(xlogx("count")).alias("a"), F.sum("count").alias("n"))
    rows = (ct.groupBy("feature", "value").agg(F.sum("count").alias("nx"))
            .groupBy("feature").agg(F.sum(xlogx("nx")).alias("b")))
    colm = (ct.groupBy("feature", "label").agg(F.sum("count").alias("ny"))
            .groupBy("feature").agg(F.sum(xlogx("ny")).alias("c")))
    j = cells.join(rows, "feature").join(colm, "feature")
    return j.select("feature", ((F.col("a") - F.col("b") - F.col("c")) / F.col("n") + F.log("n")).alias("mi"))


# --- exact quantiles -----------------------------------------------------------

RADIX_BITS = 13


def _ordered_keys(x):
    """Doubles as 64-bit unsigned integers in the same order (-0.0 counts as 0.0)."""
    import numpy as np
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _key_value(key: int) -> float:
    import struct
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _next_digits(table: DataFrame, wanted: list[dict], shift: int, width: int) -> list[tuple[int, int, int, int]]:
    """``(column, rank, digit, rank among values with it)`` for every wanted rank.

    One pass counts, by column and known bits, the next digit of the values that
    have them; the digit in which a rank falls is found by running counts in
    Spark (a window has at most 2^width rows), so one row a rank reaches the driver.
    """
    import numpy as np
    import pandas as pd
    prefixes = [sorted({known for known, _ in w.values()}) for w in wanted]

    def partial(it):
        acc = {}
        for pdf in it:
            for c, known in enumerate(prefixes):
                if not known:
                    continue
                x = pdf.iloc[:, c].to_numpy(dtype=float, na_value=np.nan)
                keys = _ordered_keys(x[~np.isnan(x)])
                top, digit = keys >> np.uint64(shift), (1 << width) - 1
                for q in known:
                    mine = top if shift + width >= 64 else top[(top >> np.uint64(width)) == np.uint64(q)]
                    n = np.bincount((mine & np.uint64(digit)).astype(np.int64), minlength=1 << width)
                    acc[c, q] = acc.get((c, q), 0) + n
        for (c, q), n in acc.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"c": np.int32(c), "q": str(q), "d": at.astype(np.int32), "n": n[at]})

    counts = table.mapInPandas(partial, "c int, q string, d int, n long").groupBy("c", "q", "d").agg(F.sum("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "q").orderBy("d")))
    ranks = table.sparkSession.createDataFrame(
        [(c, str(known), rank, left) for c, w in enumerate(wanted) for rank, (known, left) in w.items()], "c int, q string, rank long, left long")
    hit = upto.join(F.broadcast(ranks), ["c", "q"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
    return [tuple(r) for r in hit.select("c", "rank", "d", F.col("left") - (F.col("upto") - F.col("n"))).collect()]


def quantiles(df: DataFrame, cols, probs) -> dict[str, list]:
    """{column: [quantile per prob]}, exact and interpolated like pandas.

    One method at every size: a radix select over the ordered bits of the
    doubles.  Each of five passes over the stored columns counts the next 13
    bits of the values that can still be the wanted ranks and chooses the digit
    of every rank in Spark; the driver sees one row for each column and rank.
    Null and NaN are missing; a column without values gives None.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    table = _small(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))
    first = table.agg(*[F.count(F.nanvl(f"c{i}", F.lit(None))) for i in range(len(cols))]).first() if cols else ()
    totals = list(first)
    wanted: list[dict[int, tuple[int, int]]] = []                     # rank -> (known bits, rank among values with them)
    for n in totals:
        ranks = {int(p * (n - 1)) + up for p in probs for up in (0, 1)} if n else set()
        wanted.append({r: (0, r) for r in ranks if r < n})
    shift = 64
    while shift and any(wanted):
        width = min(RADIX_BITS, shift)
        shift -= width
        for c, rank, digit, left in _next_digits(table, wanted, shift, width):
            wanted[c][rank] = (wanted[c][rank][0] << width | digit, left)
    out = {}
    for c, name in enumerate(cols):
        value = {rank: _key_value(key) for rank, (key, _) in wanted[c].items()}
        out[name] = []
        for p in probs:
            at = p * (totals[c] - 1)
            low = value.get(int(at)) if totals[c] else None
            part = at - int(at)
            out[name].append(low if low is None or not part else low + (value[int(at) + 1] - low) * part)
    return out


def quantile_edges(df: DataFrame, cols, q: int = 10) -> dict[str, list[float]]:
    """Equal-frequency bin edges per column, duplicates dropped (H4, ``qcut``).

    (q + 1) numbers per column reach the driver.
    """
    probs = [i / q for i in range(q + 1)]
    vals = quantiles(df, cols, probs)
    out = {}
    for c in cols:
        edges = []
        for v in vals[c]:
            if v is not None and (not edges or v > edges[-1]):
                edges.append(float(v))
        out[c] = edges
    return out


def width_edges(df: DataFrame, cols, q: int = 10) -> dict[str, list[float]]:
    """Equal-width bin edges per column (``cut(q)``): least value plus i / q of the range."""
    cols = list(cols)
    row = df.agg(*[f(F.col(c).cast("double")) for c in cols for f in (F.min, F.max)]).first()
    out = {}
    for k, c in enumerate(cols):
        low, high = row[2 * k], row[2 * k + 1]
        out[c] = [] if low is None else [low] if low == high else [low + (high - low) * i / q for i in range(q + 1)]
    return out


def bin_column(c, edges: list[float], outside: str = "null") -> Column:
    """``pd.cut(x, edges, labels=False)``: right-closed bins (H5).

    The lowest bin includes its left edge (``include_lowest``) when
    ``outside='clip'``; with ``'null'`` values outside (edge0, edge_last] are
    null like pandas.
    """
    x = F.col(c) if isinstance(c, str) else c
    lo = edges[0] if edges else None
    if len(edges) < 2:
        return F.lit(None).cast("int")
    chain = None
    for i in range(1, len(edges)):
        cond = x <= F.lit(edges[i])
        chain = F.when(cond, F.lit(i - 1)) if chain is None else chain.when(cond, F.lit(i - 1))
    if outside == "clip":
        chain = chain.otherwise(F.lit(len(edges) - 2))
        return F.when(x.isNull(), None).when(x <= F.lit(lo), F.lit(0)).otherwise(chain)
    return F.when(x.isNull() | (x <= F.lit(lo)), F.lit(None).cast("int")).otherwise(chain)


def auc_by_group(df: DataFrame, group: str | None, score: str, label: str) -> DataFrame:
    """Exact ROC-AUC per group with tie handling (H6): rank-sum over distinct scores.

    Positives/negatives per (group, score) are pre-aggregated (map-side
    combine); see :func:`auc_from_counts`.
    """
    g = [group] if group else []
    lab = F.col(label).cast("double")
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*g, score).agg(
        F.sum(lab).alias("pos"), F.sum(1.0 - lab).alias("neg"))
    return auc_from_counts(per, group, score)


def auc_from_counts(per: DataFrame, group: str | None, score: str) -> DataFrame:
    """Exact ROC-AUC per group from one row ``pos, neg`` per (group, score).

    Negatives ranked below each score come from a distributed running sum in
    (group, score) order, so neither a single global AUC nor a group holding
    most rows is squeezed into one task.
    """
    from kestrel.operators.ordering import running_sum
    g = [group] if group else []
    cum = _small(running_sum(per, g + [score], "neg", "_kcum").withColumn("_kbefore", F.col("_kcum") - F.col("neg")))
    if g:   # one row per group; AQE broadcasts it when its runtime size allows
        joined = cum.join(cum.groupBy(*g).agg(F.min("_kbefore").alias("_kstart")), g)
    else:
        joined = cum.withColumn("_kstart", cum.agg(F.min("_kbefore")).scalar())
    ranked = joined.withColumn("neg_below", F.col("_kbefore") - F.col("_kstart"))
    agg = ranked.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return agg.select(*g, F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))
