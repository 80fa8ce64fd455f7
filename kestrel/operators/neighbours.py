"""Mutual information from nearest neighbours.

Continuous columns are judged without bins, with ``k`` neighbours:

* a continuous feature against a class (:func:`against_class`): the distance of
  a row to its k-th neighbour of the same class, and the number of rows of any
  class closer than that;
* a continuous feature against a continuous target (:func:`against_target`): the
  distance to the k-th neighbour in the plane (the larger of the two coordinate
  distances, both in standard deviations), and the numbers of rows closer than
  that in either coordinate.

All features go through the same jobs as one long table.  Neighbours on a line
come from a sorted range shuffle with halos, counts below a boundary from a
running sum over rows and boundaries in one order, so neither a large class
nor a wide neighbourhood is gathered in one task.  Neighbours in the plane are
searched in cells of about as many rows each, cut across the wider of their two
sides in turn; rows whose neighbourhood leaves their cell ask the cells that it
reaches.

Equal values are told apart by a jitter from a hash of the row's key, below
``2^-33`` of the largest absolute value of the column, so results repeat on any
cluster.  A double holds about ``2^19`` places inside that jitter; where a
row's k-th neighbour of the class shares its place, both the neighbour and the
rows closer are told by a second offset from the same hash.  Rows where either side is null or NaN are left out for that feature;
so are classes of one row.  Fewer than two rows (a plane: ``k + 1``) give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators import ordering as O
from kestrel.operators import stats as ST

JITTER_BITS = 33


def digamma(n) -> Column:
    """psi(n) for n > 0: recurrence up to n + 6, then the asymptotic series (error below 1e-10)."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    x = n + 6.0
    low = sum((1.0 / (n + float(i)) for i in range(1, 6)), 1.0 / n)
    s = 1.0 / (x * x)
    return F.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240))) - low


def jittered(df: DataFrame, cols, key: str, seed: int = 0) -> list[Column]:
    """Each column plus a small offset from a hash of key, column and seed (null and NaN give null)."""
    cols = list(cols)
    doubles = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols]
    tops = df.agg(*[F.max(F.abs(x)) for x in doubles]).first()
    out = []
    for c, x, top in zip(cols, doubles, tops):
        size = 2.0 ** (math.frexp(top)[1] - 1 - JITTER_BITS) if top else 2.0 ** -JITTER_BITS
        text = F.concat(F.col(key).cast("string"), F.lit(f":{c}:{seed}"))
        unit = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)) - 0.5
        out.append((x + unit * F.lit(size)).alias(c))
    return out


def second_offset(feature, key) -> Column:
    """A place in [0, 1) from a hash of feature and key, for rows at the same jittered value."""
    text = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(feature), F.lit(":second"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _long(df: DataFrame, cols, rest: list[Column]) -> DataFrame:
    """``feature, x`` and ``rest`` for every column, without missing values."""
    named = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols]
    return df.select(*rest, F.explode(F.array(*named)).alias("_kf")).select("_kf.*", *[c for c in df.columns if c not in cols])


def closer(points: DataFrame, asked: DataFrame) -> DataFrame:
    """``feature, key, n``: rows of ``points`` (``feature, x, key``) strictly between ``lo`` and ``hi`` of ``asked``.

    Rows and boundaries are sorted together once; the running number of rows at
    a boundary is its rank, whatever the distance between the two boundaries.
    With a column ``u`` in ``points``, and ``lo_u`` and ``hi_u`` in ``asked``, rows at
    the same ``x`` are in the order of ``u``; a boundary without one leaves out all rows
    at its place.  If both boundaries are the same place, the rows at it count.
    """
    second = "u" in points.columns
    at = ["at", "u"] if second else ["at"]

    def end(side: str, turn: int, sign: int) -> Column:
        alone = F.col("lo") == F.col("hi")
        if second:
            alone = alone & F.col("lo_u").eqNullSafe(F.col("hi_u"))
        place = [F.coalesce(f"{side}_u", F.lit(float(turn) - 1)).alias("u")] if second else []      # -1 and 1: no row is there
        return F.struct(F.col(side).alias("at"), *place, F.when(alone, 2 - turn).otherwise(turn).alias("turn"), F.lit(sign).alias("sign"))

    # At equal places an upper boundary comes before the rows, a lower one after them.
    rows = points.select("feature", F.col("x").alias("at"), *at[1:], F.lit(1).alias("turn"), F.lit(0).alias("sign"), "key")
    ends = asked.select("feature", F.explode(F.array(end("hi", 0, 1), end("lo", 2, -1))).alias("e"), "key")
    both = rows.union(ends.select("feature", "e.*", "key")).withColumn("one", F.when(F.col("turn") == 1, 1.0).otherwise(0.0))
    ranked = O.running_sum(both, ["feature", *at, "turn", "key"], "one", "below").where("turn <> 1")
    return ranked.groupBy("feature", "key").agg(F.sum(F.col("below") * F.col("sign")).cast("long").alias("n"))


def _by_class(points: DataFrame, k: int) -> DataFrame:
    """``feature, mi`` of ``x`` against ``label`` (``points``: feature, x, key, label)."""
    sizes = points.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    points = ST._small(points.join(sizes, ["feature", "label"]).select("feature", "label", "x", "key", second_offset("feature", "key").alias("u")))
    found = O.neighbours(points.withColumn("at", F.struct("x", "u")), ["feature", "label"], ["x", "u", "key"], "at", k)

    def candidate(v: Column, d: Column, side: int) -> Column:
        # The second offset counts only between rows at the same place.
        return F.struct(d.alias("d"), F.when(d == 0, F.abs(F.col("u") - v["u"])).otherwise(0.0).alias("du"), F.lit(side).alias("side"),
                        v["x"].alias("v"), v["u"].alias("vu"))

    near = F.array_sort(F.concat(F.transform("before", lambda v: candidate(v, F.col("x") - v["x"], 0)),
                                 F.transform("after", lambda v: candidate(v, v["x"] - F.col("x"), 1))))
    kth = found.withColumn("near", near).withColumn("own_k", F.least(F.lit(k), F.size("near"))).withColumn(
        "kth", F.get("near", F.col("own_k") - 1))
    # On the neighbour's side the neighbour is the boundary; on the other side it is as far away.
    tied = F.col("kth.d") == 0
    radius = kth.select("feature", "key", "own_k",
                        F.when(F.col("kth.side") == 0, F.col("kth.v")).otherwise(F.col("x") - F.col("kth.d")).alias("lo"),
                        F.when(F.col("kth.side") == 1, F.col("kth.v")).otherwise(F.col("x") + F.col("kth.d")).alias("hi"),
                        F.when(tied, F.when(F.col("kth.side") == 0, F.col("kth.vu")).otherwise(F.col("u") - F.col("kth.du"))).alias("lo_u"),
                        F.when(tied, F.when(F.col("kth.side") == 1, F.col("kth.vu")).otherwise(F.col("u") + F.col("kth.du"))).alias("hi_u"))
    radius = ST._small(radius)
    inside = closer(points, radius).groupBy("feature").agg(F.avg(digamma("n")).alias("inside"))
    own = radius.groupBy("feature").agg(F.avg(digamma("own_k")).alias("own"))
    classes = sizes.groupBy("feature").agg(F.sum("size").alias("n"), F.sum(F.col("size") * digamma("size")).alias("s"))
    mi = digamma("n") + F.col("own") - F.col("s") / F.col("n") - F.col("inside")
    return classes.join(own, "feature").join(inside, "feature").select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


def _all_features(spark, cols, scores: DataFrame) -> DataFrame:
    return spark.createDataFrame([(c,) for c in cols], "feature string").join(scores, "feature", "left")


def against_class(df: DataFrame, cols, label: str, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    """``feature, mi`` (nats) of continuous columns against a class (S2, ``mutual_info_classif``)."""
    cols = list(cols)
    src = df.select(F.col(key).alias("key"), F.col(label).alias("label"), *jittered(df, cols, key, seed)).where("label IS NOT NULL")
    points = _long(src, cols, ["key", "label"]).where("x IS NOT NULL")
    return _all_features(df.sparkSession, cols, _by_class(points, k))


# --- neighbours in the plane ------------------------------------------------------------

def nearest(qx, qy, qk, px, py, pk, scale: float, k: int, limit):
    """``(distances, indexes)``: the ``k`` nearest points of each query with another key, closer than ``limit``.

    The distance is ``max(scale * |dx|, |dy|)``.  Points are looked at outward
    from the query in both coordinate orders at once; a query is done as soon as
    everything nearer in one of the two orders has been seen.  Index -1: none.
    """
    import numpy as np
    best = np.repeat(np.asarray(limit, float)[:, None], k, axis=1)
    index = np.full((len(qx), k), -1)
    by_y, by_x = np.argsort(py, kind="stable"), np.argsort(px, kind="stable")
    at_y, at_x = np.searchsorted(py[by_y], qy), np.searchsorted(px[by_x], qx)
    active, t = np.arange(len(qx)), 0
    while len(active):
        seen = []
        for order, at, p, q, unit in ((by_y, at_y, py, qy, 1.0), (by_x, at_x, px, qx, scale)):
            for place in (at[active] + t, at[active] - 1 - t):
                there = (place >= 0) & (place < len(order))
                i = np.where(there, order[np.clip(place, 0, max(len(order) - 1, 0))] if len(order) else 0, -1)
                gap = np.full(len(active), np.inf)
                gap[there] = np.abs(p[i[there]] - q[active[there]]) * unit
                seen.append(gap)
                d = np.full(len(active), np.inf)
                d[there] = np.maximum(np.abs(px[i[there]] - qx[active[there]]) * scale, np.abs(py[i[there]] - qy[active[there]]))
                d[there] = np.where(pk[i[there]] == qk[active[there]], np.inf, d[there])
                new = (d < best[active, -1]) & ~(index[active] == i[:, None]).any(axis=1)
                rows = active[new]
                best[rows, -1], index[rows, -1] = d[new], i[new]
                order_of = np.argsort(best[rows], axis=1, kind="stable")
                best[rows] = np.take_along_axis(best[rows], order_of, axis=1)
                index[rows] = np.take_along_axis(index[rows], order_of, axis=1)
        kth = best[active, -1]
        done = ((seen[0] >= kth) & (seen[1] >= kth)) | ((seen[2] >= kth) & (seen[3] >= kth))
        active, t = active[~done], t + 1
    return best, index


STRIP_ROWS = 4096         # rows of a cell, as far as MAX_CELLS allows
MAX_CELLS = 8192
CELL_SAMPLE = 32          # rows of a cell by which the cuts are placed
NEAR = "array<struct<d:double,vx:double,vy:double>>"


def cell_cuts(x, y, scale: float, cells: int) -> list[tuple]:
    """A tree of cuts ``(axis, place, left, right)`` into about ``cells`` cells; a leaf is ``(-1, 0.0, cell, 0)``.

    Every cut is in the widest gap among the middle points of the wider side
    (``x`` counts ``scale`` times), so a column of few values is cut between its
    values, and bands of one value along ``y``.  Points below ``place`` go left.
    """
    import numpy as np
    out: list[tuple] = [()]
    todo, leaves = [(0, np.arange(len(x)), cells)], 0
    while todo:
        at, rows, n = todo.pop()
        cut = None
        if n > 1 and len(rows) > 1:
            spans = [(np.ptp(v[rows]) * unit, axis) for axis, v, unit in ((0, x, scale), (1, y, 1.0))]
            span, axis = max(spans, key=lambda t: (t[0], -t[1]))
            if span > 0:
                v = (x, y)[axis][rows]
                inner = np.sort(v)[int(0.3 * (len(v) - 1)):int(0.7 * (len(v) - 1)) + 2]
                gap = np.argmax(np.diff(inner))
                place = (inner[gap] + inner[gap + 1]) / 2
                place = place if place > v.min() else v[v > v.min()].min()
                cut = (axis, float(place), v < place)
        if cut is None:
            out[at] = (-1, 0.0, leaves, 0)
            leaves += 1
            continue
        axis, place, low = cut
        out[at] = (axis, place, len(out), len(out) + 1)
        out += [(), ()]
        few = min(max(round(n * low.mean()), 1), n - 1)
        todo += [(len(out) - 1, rows[~low], n - few), (len(out) - 2, rows[low], few)]
    return out


def cells_reached(cuts: list[tuple], x0, x1, y0, y1):
    """``(row, cell)`` of all cells that the boxes from ``x0, y0`` to ``x1, y1`` (both included) meet."""
    import numpy as np
    axis, left, right = (np.array([c[i] for c in cuts], np.int64) for i in (0, 2, 3))
    place = np.array([c[1] for c in cuts], float)
    row, node = np.arange(len(x0)), np.zeros(len(x0), np.int64)
    rows, cells = [], []
    while len(row):
        leaf = axis[node] < 0
        rows.append(row[leaf])
        cells.append(left[node[leaf]])
        row, node = row[~leaf], node[~leaf]
        by_x = axis[node] == 0
        low = np.where(by_x, x0[row], y0[row]) < place[node]
        high = np.where(by_x, x1[row], y1[row]) >= place[node]
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([left[node[low]], right[node[high]]])
    return np.concatenate(rows or [row]), np.concatenate(cells or [node])


def _found(pdf, best, index, px, py):
    """The rows' neighbours as lists of ``(d, vx, vy)``."""
    return [[{"d": float(d), "vx": float(px[i]), "vy": float(py[i])} for d, i in zip(ds, ii) if i >= 0] for ds, ii in zip(best, index)]


def _plane_neighbours(points: DataFrame, scales: dict[str, float], k: int) -> DataFrame:
    """``feature, key, x, y, kth``: each row's k-th neighbour ``(d, vx, vy)`` (``points``: feature, key, x, y).

    The cuts between cells come from a hash sample of bounded size; every row is
    placed and searched, so the sample decides only how even the cells are.
    """
    import numpy as np
    import pandas as pd
    counts = {r["feature"]: r["n"] for r in points.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return points.select("feature", "key", "x", "y", F.lit(None).cast("struct<d:double,vx:double,vy:double>").alias("kth"))
    cells = {f: max(1, min(MAX_CELLS, -(-n // STRIP_ROWS))) for f, n in counts.items()}
    shares = F.create_map(*[F.lit(v) for f, n in counts.items() for v in (f, 1.0 if cells[f] == 1 else min(1.0, CELL_SAMPLE * cells[f] / n))])
    hashed = F.pmod(F.xxhash64("key", F.lit("cell")), F.lit(1 << 20)) < shares[F.col("feature")] * float(1 << 20)
    some = points.where(hashed & F.col("feature").isin([f for f in cells if cells[f] > 1])).select("feature", "x", "y").toPandas()
    some = some.sort_values(["feature", "x", "y"])
    cuts = {}
    for f, n in cells.items():
        mine = some[some["feature"] == f]
        cuts[f] = cell_cuts(mine["x"].to_numpy(), mine["y"].to_numpy(), scales[f], n)
    kind = points.schema["key"].dataType.simpleString()

    def place(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for f in pdf["feature"].unique():
                at = np.flatnonzero(pdf["feature"].to_numpy() == f)
                x, y = pdf["x"].to_numpy()[at], pdf["y"].to_numpy()[at]
                row, found = cells_reached(cuts[f], x, x, y, y)
                cell[at[row]] = found
            yield pdf.assign(cell=cell)

    placed = ST._small(points.select("feature", "key", "x", "y").mapInPandas(place, f"feature string, key {kind}, x double, y double, cell int"))

    def own(pdf):
        f = pdf["feature"].iloc[0]
        x, y, key = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["key"].to_numpy()
        best, index = nearest(x, y, key, x, y, key, scales[f], k, np.full(len(x), np.inf))
        # A little wider than the neighbourhood, against rounding.
        ry = best[:, -1] * (1 + 1e-9)
        rx = ry / scales[f] * (1 + 1e-9)
        row, cell = cells_reached(cuts[f], x - rx, x + rx, y - ry, y + ry)
        other = cell != pdf["cell"].iloc[0]
        row, cell = row[other], cell[other]
        order = np.argsort(row, kind="stable")
        ask = np.split(cell[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(x)))[:-1])
        return pd.DataFrame({"feature": f, "key": key, "x": x, "y": y, "near": _found(pdf, best, index, x, y), "r": best[:, -1], "ask": ask})

    mine = ST._small(placed.groupBy("feature", "cell").applyInPandas(
        own, f"feature string, key {kind}, x double, y double, near {NEAR}, r double, ask array<int>"))
    asked = mine.select("feature", "key", "x", "y", "r", F.explode("ask").alias("cell"))

    def others(queries, pdf):
        if not len(queries) or not len(pdf):
            return pd.DataFrame({"feature": [], "key": [], "more": []}, dtype=object)
        f = queries["feature"].iloc[0]
        px, py = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        best, index = nearest(queries["x"].to_numpy(), queries["y"].to_numpy(), queries["key"].to_numpy(), px, py, pdf["key"].to_numpy(),
                              scales[f], k, queries["r"].to_numpy())
        return pd.DataFrame({"feature": f, "key": queries["key"].to_numpy(), "more": _found(queries, best, index, px, py)})

    more = asked.groupBy("feature", "cell").cogroup(placed.groupBy("feature", "cell")).applyInPandas(
        others, f"feature string, key {kind}, more {NEAR}")
    more = more.groupBy("feature", "key").agg(F.flatten(F.collect_list("more")).alias("more"))      # k for each cell reached
    merged = mine.drop("ask").join(more, ["feature", "key"], "left").withColumn(
        "near", F.array_sort(F.concat("near", F.coalesce("more", F.array().cast(NEAR)))))
    return merged.select("feature", "key", "x", "y", F.get("near", F.lit(k - 1)).alias("kth"))


def _in_plane(points: DataFrame, scales: dict[str, float], k: int) -> DataFrame:
    points = ST._small(points.where(F.col("feature").isin(list(scales))))
    found = _plane_neighbours(points, scales, k).where("kth IS NOT NULL")
    scale = F.create_map(*[F.lit(v) for item in scales.items() for v in item])[F.col("feature")] if scales else F.lit(1.0)
    dx, dy = F.abs(F.col("kth.vx") - F.col("x")), F.abs(F.col("kth.vy") - F.col("y"))
    by_x = dx * scale >= dy
    # The coordinate that decides has the neighbour itself as its boundary.
    ends = ST._small(found.select("feature", "key", "x", "y", "kth", F.when(by_x, dx).otherwise(dy / scale).alias("rx"),
                                  F.when(by_x, dx * scale).otherwise(dy).alias("ry"), by_x.alias("by_x")))

    def boundaries(axis: str, own: Column) -> DataFrame:
        v, at, r = F.col(f"kth.v{axis}"), F.col(axis), F.col(f"r{axis}")
        return ends.select(F.concat(F.lit(f"{axis} "), F.col("feature")).alias("feature"), "key",
                           F.when(own & (v < at), v).otherwise(at - r).alias("lo"), F.when(own & (v > at), v).otherwise(at + r).alias("hi"))

    both = points.select(F.concat(F.lit("x "), F.col("feature")).alias("feature"), "x", "key").union(
        points.select(F.concat(F.lit("y "), F.col("feature")).alias("feature"), F.col("y").alias("x"), "key"))
    asked = boundaries("x", F.col("by_x")).union(boundaries("y", ~F.col("by_x")))
    mean = closer(both, asked).groupBy(F.substring("feature", 3, 1 << 20).alias("feature")).agg(
        F.sum(digamma("n")).alias("s"), (F.count(F.lit(1)) / 2).cast("long").alias("n"))
    mi = digamma("n") + digamma(F.lit(k)) - F.col("s") / F.col("n")
    return mean.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


def against_target(df: DataFrame, cols, target: str, key: str, k: int = 3, discrete=(), seed: int = 0) -> DataFrame:
    """``feature, mi`` (nats) of columns against a continuous target (S3, ``mutual_info_regression``).

    Columns listed in ``discrete`` are classes; the target's neighbours are then
    searched within them.
    """
    cols, discrete = list(cols), list(discrete)
    plain = [c for c in cols if c not in discrete]
    parts = []
    shifted = jittered(df, [*plain, target], key, seed)
    if plain:
        src = df.select(F.col(key).alias("key"), *shifted).withColumnRenamed(target, "y")
        points = _long(src, plain, ["key", "y"]).where("x IS NOT NULL AND y IS NOT NULL").select("feature", "key", "x", "y")
        both = [F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (*plain, target)]
        spread = df.agg(*[F.stddev_samp(F.when(ok & both[-1], F.col(c).cast("double"))) for c, ok in zip(plain, both)],
                        *[F.stddev_samp(F.when(ok & both[-1], F.col(target).cast("double"))) for ok in both[:-1]]).first()
        scales = {c: spread[len(plain) + i] / spread[i] for i, c in enumerate(plain) if spread[i] and spread[len(plain) + i]}
        parts.append(_in_plane(points, scales, k))
    if discrete:
        src = df.select(F.col(key).alias("key"), shifted[-1].alias("x"), *[F.col(c).cast("string").alias(c) for c in discrete]).where("x IS NOT NULL")
        named = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("label")) for c in discrete]))
        points = src.select("key", "x", named.alias("f")).select("key", "x", "f.*").where("label IS NOT NULL")
        parts.append(_by_class(points, k))
    scores = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return _all_features(df.sparkSession, cols, scores)
