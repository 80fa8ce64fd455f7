"""Per-key forecasts as grouped and windowed Spark jobs.

The reference fits one model per key in a serial driver loop.  Here every
key is handled at once: per-key sufficient statistics come from ``groupBy``
aggregates (partial aggregation, so a key with a third of the rows costs no
more than others) and order-dependent terms (differences, lags) from the
skew-safe indexed windows of :mod:`kestrel.operators.ordering`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalar import epoch_micros
from kestrel.operators.ordering import IDX, lags


def future_frame(df: DataFrame, key: str, ts: str, periods: int, step_seconds: int,
                 include_history: bool = True) -> DataFrame:
    """History plus ``periods`` future timestamps per key (R10):
    ``sequence(1, periods)`` exploded after the key's last timestamp."""
    last = df.groupBy(key).agg(F.max(ts).alias("_klast"))
    fut = last.select(key, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"), "_klast").select(
        key, (F.col("_klast") + F.make_dt_interval(secs=F.col("h") * F.lit(step_seconds))).alias(ts),
        F.lit(True).alias("is_future"))
    if not include_history:
        return fut
    hist = df.select(key, ts, F.lit(False).alias("is_future"))
    return hist.unionByName(fut)


def _days(ts_col, origin_col):
    return (epoch_micros(ts_col) - F.col(origin_col)) / F.lit(86400e6)


def trend_season_forecast(df: DataFrame, key: str, ts: str, y: str, periods: int = 30,
                          step_seconds: int = 3600, min_points: int = 2) -> DataFrame:
    """Linear trend + hour-of-day seasonality per key (R9, re-aimed Prophet).

    Per key: ``regr_slope``/``regr_intercept`` of y on days since the key's
    first sample; seasonal term = mean residual by hour.  Output: history
    and ``periods`` future steps with ``yhat``; keys with fewer than
    ``min_points`` samples are skipped.
    """
    base = df.select(key, ts, y).where(F.col(y).isNotNull())
    origin = base.groupBy(key).agg(F.min(epoch_micros(ts)).alias("_korig"),
                                   F.count(F.lit(1)).alias("_kn"))
    origin = origin.where(F.col("_kn") >= min_points)
    b = base.join(origin, key).withColumn("t", _days(ts, "_korig"))
    fit = b.groupBy(key).agg(F.regr_slope(y, "t").alias("slope"), F.regr_intercept(y, "t").alias("intercept"))
    fit = fit.fillna(0.0, ["slope"]).withColumn("intercept", F.coalesce("intercept", F.lit(0.0)))
    res = (b.join(fit, key).withColumn("r", F.col(y) - (F.col("intercept") + F.col("slope") * F.col("t")))
           .groupBy(key, F.hour(ts).alias("hour")).agg(F.avg("r").alias("season")))
    frame = future_frame(b.select(key, ts), key, ts, periods, step_seconds)
    out = (frame.join(origin.select(key, "_korig"), key).join(fit, key)
           .withColumn("hour", F.hour(ts)).join(res, [key, "hour"], "left")
           .withColumn("t", _days(ts, "_korig")))
    yhat = F.col("intercept") + F.col("slope") * F.col("t") + F.coalesce(F.col("season"), F.lit(0.0))
    return out.select(key, F.col(ts).alias("ds"), "is_future", yhat.alias("yhat"))


class Additive:
    """Terms of an additive forecast: line, hinges at changepoints, Fourier terms of a day and a week.

    ``t`` runs from 0 at a key's first sample to 1 at its last; changepoints lie
    evenly in the first ``covered`` of it.  ``priors`` are the scales to which
    terms are shrunk (none for the line), in units of the largest absolute value.
    """

    def __init__(self, changepoints: int = 5, daily: int = 3, weekly: int = 3, covered: float = 0.8,
                 hinge_prior: float = 0.05, season_prior: float = 10.0):
        self.hinges = [covered * j / changepoints for j in range(1, changepoints + 1)]
        self.waves = [(1.0, k) for k in range(1, daily + 1)] + [(7.0, k) for k in range(1, weekly + 1)]
        self.priors = [None, None] + [hinge_prior] * changepoints + [season_prior] * (2 * len(self.waves))

    def columns(self, t: F.Column, days: F.Column) -> list[F.Column]:
        """The terms as columns; ``days`` counts from 1970."""
        out = [F.lit(1.0), t] + [F.greatest(t - F.lit(h), F.lit(0.0)) for h in self.hinges]
        for period, k in self.waves:
            angle = F.lit(2 * np.pi * k / period) * days
            out += [F.sin(angle), F.cos(angle)]
        return out


def additive_sums(df: DataFrame, key: str, terms: list[F.Column], y: F.Column) -> DataFrame:
    """``key, sums``: the flattened matrix of products of terms and value, summed by key.

    Rows of an Arrow batch are multiplied out and added up by key without a
    loop over keys, then summed over batches and tasks with partial sums, so a
    key with most rows costs a row per batch.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    q = len(terms) + 1
    rows = df.select(F.col(key).alias("_kkey"), *[c.alias(f"x{i}") for i, c in enumerate([*terms, y])])
    kind = rows.schema["_kkey"].dataType.simpleString()

    def partial(it):
        for pdf in it:
            if not len(pdf):
                continue
            code, names = pd.factorize(pdf["_kkey"])
            order = np.argsort(code, kind="stable")
            x = pdf.iloc[order, 1:].to_numpy(dtype=float)
            begin = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            sums = np.add.reduceat((x[:, :, None] * x[:, None, :]).reshape(len(x), q * q), begin, axis=0)
            yield pd.DataFrame({"_kkey": names, "sums": list(sums)})

    return rows.mapInPandas(partial, f"_kkey {kind}, sums array<double>").groupBy(F.col("_kkey").alias(key)).agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def additive_forecast(df: DataFrame, key: str, ts: str, y: str, periods: int = 30, step_seconds: int = 3600,
                      model: Additive | None = None, min_points: int = 2) -> DataFrame:
    """Trend with changepoints plus daily and weekly seasons per key (R9, an additive regression).

    Each key's terms are fitted by one shrunken least squares solve from its
    sums (all keys of a batch solved together); the trend goes on beyond the
    last changepoint.  The penalty of a term is the variance of the scaled
    series over the square of its prior.  Output: history and ``periods`` future
    steps with ``yhat``, ``trend`` and ``season``; keys with fewer than
    ``min_points`` samples or a single time are skipped.
    """
    model = model or Additive()
    base = df.select(key, ts, F.col(y).cast("double").alias("_ky")).where(F.col("_ky").isNotNull() & ~F.isnan("_ky") & F.col(ts).isNotNull())
    at = epoch_micros(ts)
    ranges = base.groupBy(key).agg(F.min(at).alias("_ka"), F.max(at).alias("_kb"), F.max(F.abs("_ky")).alias("_kmax"), F.count(F.lit(1)).alias("_kn"))
    ranges = ranges.where((F.col("_kn") >= min_points) & (F.col("_kb") > F.col("_ka"))).withColumn(
        "_kmax", F.when(F.col("_kmax") > 0, F.col("_kmax")).otherwise(F.lit(1.0)))
    t, days = (at - F.col("_ka")) / (F.col("_kb") - F.col("_ka")), at / F.lit(86400e6)
    terms = model.columns(t, days)
    p, priors = len(terms), model.priors
    sums = additive_sums(base.join(ranges, key), key, terms, F.col("_ky") / F.col("_kmax"))
    kind = sums.schema[key].dataType.simpleString()

    def solve(it):
        for pdf in it:
            if not len(pdf):
                continue
            m = np.stack(pdf["sums"].to_list()).reshape(-1, p + 1, p + 1)
            n, mean = m[:, 0, 0], m[:, 0, p] / m[:, 0, 0]
            variance = np.maximum(m[:, p, p] / n - mean * mean, 0)
            ridge = np.array([0.0 if s is None else 1 / s ** 2 for s in priors])
            a = m[:, :p, :p] + np.einsum("k,j,ij->kij", variance + 1e-9, ridge, np.eye(p))
            beta = np.linalg.solve(a, m[:, :p, p:])[:, :, 0]
            yield pd.DataFrame({key: pdf[key], "beta": list(beta)})

    fitted = sums.mapInPandas(solve, f"{key} {kind}, beta array<double>")
    frame = future_frame(base.join(ranges.select(key), key).select(key, ts), key, ts, periods, step_seconds).join(ranges, key).join(fitted, key)
    parts = [F.get("beta", F.lit(i)) * c for i, c in enumerate(terms)]
    split = 2 + len(model.hinges)
    out = frame.select(key, F.col(ts).alias("ds"), "is_future", (sum(parts[1:split], parts[0]) * F.col("_kmax")).alias("trend"),
                       (sum(parts[split + 1:], parts[split]) * F.col("_kmax")).alias("season"))
    return out.withColumn("yhat", F.col("trend") + F.col("season"))


def _levinson_rows(g: np.ndarray, order: int) -> np.ndarray:
    """AR coefficients from autocovariances ``g[:, 0..order]`` of many series at once (Levinson-Durbin).

    A series without variance gets zeros; one that is exactly predictable keeps
    the coefficients found so far.
    """
    a = np.zeros((len(g), order))
    e = g[:, 0].copy()
    on = e > 0
    for k in range(order):
        acc = g[:, k + 1] - (a[:, :k] * g[:, k:0:-1]).sum(axis=1)
        ref = np.where(on, acc / np.where(on, e, 1.0), 0.0)
        prev = a[:, :k].copy()
        a[:, :k] = prev - ref[:, None] * prev[:, ::-1]
        a[:, k] = ref
        e = e * (1 - ref * ref)
        on &= e > 0
    return a


def _levinson(g: np.ndarray, order: int) -> np.ndarray:
    """The coefficients of one series."""
    return _levinson_rows(np.asarray(g, float)[None], order)[0]


def arima111_forecast(df: DataFrame, key: str, ts: str, tie: str, y: str, steps: int = 5,
                      ar_order: int = 5, min_points: int = 4) -> DataFrame:
    """ARIMA(1,1,1) per key by Hannan-Rissanen (R8, re-aimed statsmodels MLE).

    1. w = y - lag(y) per key (differences); lags 1..order+1 of w in one
       skew-safe indexed pass.
    2. Per-key autocovariances of w (sums) -> long AR(order) by
       Levinson-Durbin on the per-key table (all keys of a batch at once) ->
       residuals e.
    3. Per-key 2x2 normal equations of w_t on (w_{t-1}, e_{t-1}) -> phi, theta
       (phi clipped to (-0.99, 0.99); singular or short keys get 0, 0).
    4. Forecast y_{T+h} = y_T + w1 (1 - phi^h) / (1 - phi),
       w1 = phi w_T + theta e_T.
    Keys with fewer than ``min_points`` samples are skipped.
    """
    p = ar_order
    base = df.select(key, ts, tie, F.col(y).cast("double").alias("_ky")).where(F.col("_ky").isNotNull())
    counts = base.groupBy(key).agg(F.count(F.lit(1)).alias("_kn"))
    largest = int(counts.agg(F.max("_kn")).first()[0] or 0)      # one small job decides both passes
    base = base.join(counts.where(F.col("_kn") >= min_points), key)
    dif = lags(base, key, [ts, tie], ["_ky"], 1, largest=largest).withColumn("w", F.col("_ky") - F.col("_ky_lag1")).drop(IDX)
    lw = lags(dif, key, [ts, tie], ["w"], p + 1, largest=largest)
    g = lw.groupBy(key).agg(*[F.sum(F.col("w") * (F.col("w") if k == 0 else F.col(f"w_lag{k}"))).alias(f"g{k}")
                              for k in range(p + 1)])

    def ar(it):
        for pdf in it:
            coefs = _levinson_rows(np.nan_to_num(pdf[[f"g{k}" for k in range(p + 1)]].to_numpy(dtype=float)), p)
            out = pd.DataFrame(coefs, columns=[f"a{k}" for k in range(1, p + 1)])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    coef_schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"a{k} double" for k in range(1, p + 1))
    coefs = g.mapInPandas(ar, coef_schema)

    def resid(shift: int):
        wt = F.col("w") if shift == 0 else F.col(f"w_lag{shift}")
        pred = sum((F.coalesce(F.col(f"a{k}"), F.lit(0.0)) * F.coalesce(F.col(f"w_lag{k + shift}"), F.lit(0.0))
                    for k in range(1, p + 1)), F.lit(0.0))
        return wt - pred

    ee = lw.join(coefs, key).withColumn("e", resid(0)).withColumn("e1", resid(1))
    ok = F.col("w").isNotNull() & F.col("w_lag1").isNotNull()
    x1, x2, yy = F.col("w_lag1"), F.col("e1"), F.col("w")
    ne = ee.where(ok).groupBy(key).agg(
        F.sum(x1 * x1).alias("s11"), F.sum(x1 * x2).alias("s12"), F.sum(x2 * x2).alias("s22"),
        F.sum(x1 * yy).alias("s1y"), F.sum(x2 * yy).alias("s2y"), F.count(F.lit(1)).alias("m"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    good = (F.abs(det) > F.lit(1e-12)) & (F.col("m") >= 3)
    phi = F.when(good, (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det).otherwise(F.lit(0.0))
    theta = F.when(good, (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det).otherwise(F.lit(0.0))
    params = ne.select(key, F.greatest(F.least(phi, F.lit(0.99)), F.lit(-0.99)).alias("phi"), theta.alias("theta"))
    last = ee.groupBy(key).agg(F.max_by(F.struct(F.col("_ky").alias("yT"), F.coalesce("w", F.lit(0.0)).alias("wT"),
                                                 F.coalesce("e", F.lit(0.0)).alias("eT"), F.col(ts).alias("tsT")),
                                        F.struct(ts, tie)).alias("l"))
    fc = (last.join(params, key, "left").fillna(0.0, ["phi", "theta"])
          .select(key, "l.*", "phi", "theta", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")))
    w1 = F.col("phi") * F.col("wT") + F.col("theta") * F.col("eT")
    ph = F.col("phi")
    growth = F.when(F.abs(ph) < 1e-12, F.lit(1.0)).otherwise((1 - F.pow(ph, F.col("step"))) / (1 - ph))
    return fc.select(key, "step", "tsT", "yT", "phi", "theta", (F.col("yT") + w1 * growth).alias("forecast"))


# --- ARIMA(1,1,1) by conditional sum of squares -----------------------------------------------

CSS_BLOCK = 256                      # rows of a block, and blocks of a block of blocks
CSS_LIMIT, CSS_COARSE, CSS_FINE, CSS_ZOOMS = 0.95, 15, 9, 4
CSS_CLIP = 0.99


def css_step(zoom: int) -> float:
    """Distance of neighbouring candidates: the coarse grid's, then a quarter each time."""
    return 2 * CSS_LIMIT / (CSS_COARSE - 1) / 4 ** zoom


def css_candidates(phi: np.ndarray, theta: np.ndarray, zoom: int) -> tuple[np.ndarray, np.ndarray]:
    """``(series, candidates)`` of both coefficients: a grid over the square, or around the best so far."""
    n = CSS_FINE if zoom else CSS_COARSE
    off = css_step(zoom) * (np.arange(n) - n // 2) if zoom else -CSS_LIMIT + css_step(0) * np.arange(n)
    grid = [np.clip((x[:, None] if zoom else np.zeros((len(x), 1))) + off, -CSS_CLIP, CSS_CLIP) for x in (phi, theta)]
    return np.repeat(grid[0], n, axis=1), np.tile(grid[1], (1, n))


def css_blocks(w: np.ndarray, w1: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What a block does to the residual before it, for every candidate: ``(5, blocks, candidates)``.

    The residual ``e_t = w_t - phi w_{t-1} - theta e_{t-1}`` is an affine function
    ``a e + b`` of the residual e before the block, and the block's sum of
    squares a polynomial ``s0 + s1 e + s2 e^2``; the five are a, b, s0, s1, s2.
    Rows (columns of ``w``) are gone through once for all blocks; NaN pads short blocks.
    """
    a, b = np.ones(phi.shape), np.zeros(phi.shape)
    s0, s1, s2 = (np.zeros(phi.shape) for _ in range(3))
    for t in range(w.shape[1]):
        on = ~np.isnan(w[:, t])
        if not on.any():
            break
        b[on] = (w[on, t, None] - phi[on] * w1[on, t, None]) - theta[on] * b[on]
        a[on] = -theta[on] * a[on]
        s0[on] += b[on] * b[on]
        s1[on] += 2 * a[on] * b[on]
        s2[on] += a[on] * a[on]
    return np.stack([a, b, s0, s1, s2])


def css_compose(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Block ``x`` followed by block ``y`` as one block."""
    (a1, b1, p0, p1, p2), (a2, b2, q0, q1, q2) = x, y
    return np.stack([a2 * a1, a2 * b1 + b2, p0 + q0 + q1 * b1 + q2 * b1 * b1, p1 + q1 * a1 + 2 * q2 * a1 * b1, p2 + q2 * a1 * a1])


def arima111_css(df: DataFrame, key: str, ts: str, tie: str, y: str, steps: int = 5, min_points: int = 4,
                 block_rows: int = CSS_BLOCK) -> DataFrame:
    """ARIMA(1,1,1) per key by the conditional sum of squares (R8): ``key, step, phi, theta, sse, forecast``.

    A grid of (phi, theta) over the square, then grids around the best that
    are a quarter as wide each time, all keys at once.  Series are cut into blocks of
    ``block_rows`` rows; a block's effect is an affine map, so blocks are
    worked out independently and composed afterwards, blocks of blocks at a
    time, and a key with very many rows is spread over tasks.  Each grid costs
    one pass over the blocks and one composing job for each level of blocks.
    The residual before the first usable row is 0.  Null values are left out;
    keys with fewer than ``min_points`` values are skipped.
    """
    from kestrel.operators.ordering import with_global_index
    from kestrel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(y).cast("double").alias("y")).where(F.col("y").isNotNull())
    base = base.join(base.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select("k"), "k")
    lagged = lags(base, "k", ["ts", "tie"], ["y"], 2).drop(IDX)
    w, w1 = F.col("y") - F.col("y_lag1"), F.col("y_lag1") - F.col("y_lag2")
    rows = with_global_index(lagged.select("k", "ts", "tie", "y", w.alias("w"), w1.alias("w1")).where(F.col("w1").isNotNull()), ["k", "ts", "tie"])
    starts = rows.groupBy("k").agg(F.min(IDX).alias("start"), F.max_by(F.struct(F.col("y"), F.col("w")), F.col(IDX)).alias("last"))
    kind = rows.schema["k"].dataType.simpleString()
    blocks = (rows.join(starts.select("k", "start"), "k").withColumn("block", F.floor((F.col(IDX) - F.col("start")) / F.lit(block_rows)).cast("long"))
              .groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("at"), "w", "w1"))).alias("r"))       # block_rows entries
              .select("k", "block", F.col("r.w").alias("w"), F.col("r.w1").alias("w1")).checkpoint(eager=True))
    most = blocks.agg(F.max("block")).first()[0]
    best = starts.select("k", F.lit(0.0).alias("phi"), F.lit(0.0).alias("theta"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("e"))

    def padded(values) -> np.ndarray:
        size = max(len(v) for v in values)
        return np.stack([np.r_[np.asarray(v, float), np.full(size - len(v), np.nan)] for v in values])

    for zoom in range(CSS_ZOOMS + 1):
        def effects(it, zoom=zoom):
            for pdf in it:
                if len(pdf):
                    phi, theta = css_candidates(pdf["phi"].to_numpy(), pdf["theta"].to_numpy(), zoom)
                    out = css_blocks(padded(pdf["w"]), padded(pdf["w1"]), phi, theta)
                    yield pd.DataFrame({"k": pdf["k"], "block": pdf["block"], "phi": pdf["phi"], "theta": pdf["theta"],
                                        "f": list(out.transpose(1, 0, 2).reshape(len(pdf), -1))})

        def compose(pdf):
            pdf = pdf.sort_values("block")
            maps = np.stack(pdf["f"].to_list()).reshape(len(pdf), 5, -1)
            out = maps[0]
            for x in maps[1:]:                                             # block_rows of them at most
                out = css_compose(out, x)
            return pd.DataFrame({"k": pdf["k"].iloc[:1], "block": pdf["block"].iloc[:1] // block_rows, "phi": pdf["phi"].iloc[:1],
                                 "theta": pdf["theta"].iloc[:1], "f": [out.ravel()]})

        def choose(it, zoom=zoom):
            for pdf in it:
                if len(pdf):
                    phi, theta = css_candidates(pdf["phi"].to_numpy(), pdf["theta"].to_numpy(), zoom)
                    f = np.stack(pdf["f"].to_list()).reshape(len(pdf), 5, -1)
                    at, i = f[:, 2].argmin(axis=1), np.arange(len(pdf))
                    yield pd.DataFrame({"k": pdf["k"], "phi": phi[i, at], "theta": theta[i, at], "sse": f[i, 2, at], "e": f[i, 1, at]})

        schema = f"k {kind}, block long, phi double, theta double, f array<double>"
        done = blocks.join(best.select("k", "phi", "theta"), "k").mapInPandas(effects, schema)
        left = most or 0
        while left:                                                         # blocks, blocks of blocks, ...
            done = done.groupBy("k", F.floor(F.col("block") / F.lit(block_rows))).applyInPandas(compose, schema)
            left //= block_rows
        best = done.mapInPandas(choose, f"k {kind}, phi double, theta double, sse double, e double").checkpoint(eager=True)

    out = best.join(starts.select("k", "last"), "k").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    first = F.col("phi") * F.col("last.w") + F.col("theta") * F.col("e")
    growth = (1 - F.pow("phi", F.col("step"))) / (1 - F.col("phi"))
    return out.select(F.col("k").alias(key), "step", "phi", "theta", "sse", (F.col("last.y") + first * growth).alias("forecast"))


def last_step_micros(df: DataFrame, key: str, ts: str, tie: str, default_micros: int = 86_400_000_000) -> DataFrame:
    """(key, step_us): gap between the last two samples per key, one day when
    a key has a single sample (W6).  Two plain aggregates, no window."""
    us = epoch_micros(ts)
    last = df.groupBy(key).agg(F.max_by(F.struct(us.alias("u"), F.col(tie).alias("t")),
                                        F.struct(us, F.col(tie))).alias("l"))
    prev = (df.join(last, key).where(F.struct(us, F.col(tie)) < F.struct(F.col("l.u"), F.col("l.t")))
            .groupBy(key).agg(F.max(us).alias("p")))
    return last.join(prev, key, "left").select(
        key, F.coalesce(F.col("l.u") - F.col("p"), F.lit(default_micros)).cast("long").alias("step_us"))


def forecast_requests(df: DataFrame, key: str, ts: str, tie: str, resources: dict, steps: int = 5) -> DataFrame:
    """Per-key ARIMA(1,1,1) forecasts of several series (R8): for each
    resource ``{name: (series, usage, request)}`` the ``steps`` forecasts at
    ``last timestamp + h * last gap`` with the last usage, request and
    series value of the key.

    All series are stacked into one long table keyed by (key, resource), so
    one ARIMA pass fits every series of every key.
    """
    from functools import reduce

    from kestrel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    used = [key, ts, tie] + list(dict.fromkeys(c for r in resources.values() for c in r))
    # The series feed several per-key jobs: materialise the projected input
    # once (reliable checkpoint) instead of recomputing its lineage each time.
    df = df.select(*used).checkpoint(eager=True)
    gaps = last_step_micros(df, key, ts, tie)
    lastrow = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in used[3:]], F.col(ts)),
                                           F.struct(ts, tie)).alias("lr"))
    sep = "\u0001"
    long = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.concat_ws(sep, F.col(key).cast("string"), F.lit(name)).alias("_kser"), ts, tie,
                  F.col(series).cast("double").alias("_kval"))
        for name, (series, _, _) in resources.items()])
    fc = arima111_forecast(long, "_kser", ts, tie, "_kval", steps)
    key_type = dict(df.dtypes)[key]
    fc = fc.select(F.split("_kser", sep).getItem(0).cast(key_type).alias(key),
                   F.split("_kser", sep).getItem(1).alias("resource"), "step", "tsT", "forecast", "phi", "theta")

    def pick(pos: int):
        expr = None
        for name, cols in resources.items():
            cond = F.col("resource") == name
            val = F.col(f"lr.{cols[pos]}").cast("double")
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr

    return fc.join(gaps, key).join(lastrow, key).select(
        key, "resource", "step",
        F.timestamp_add("MICROSECOND", F.col("step_us") * F.col("step"), F.col("tsT")).alias("forecast_timestamp"),
        F.col("forecast").alias("forecasted_value"), pick(1).alias("last_usage"), pick(2).alias("last_request"),
        pick(0).alias("last_predicted"), F.col("tsT").alias("last_actual_timestamp"), "phi", "theta")
