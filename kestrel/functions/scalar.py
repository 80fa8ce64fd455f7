"""Column expressions (JVM-side, whole-stage codegen friendly).

Each helper returns a ``Column``; none of them is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1048576.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, decimals: int) -> Column:
    """Round half to even on the binary double: ``rint(x * 10^d) / 10^d``.

    The rule of numpy and pandas.  Plain IEEE operations on doubles, so every
    engine (Spark, DuckDB, numpy) gives the same bits, and NaN, infinities and
    numbers of any size pass through; ``F.round`` rounds the decimal string
    form instead and differs at ties such as 0.14275.
    """
    scale = float(10 ** decimals)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


# --- strings -----------------------------------------------------------------

def first_token_or(c, default: str = "N") -> Column:
    """First whitespace-separated token; null or empty gives ``default``."""
    tok = F.split(F.trim(_c(c)), r"\s+").getItem(0)
    return F.when(tok.isNull() | (tok == ""), F.lit(default)).otherwise(tok)


def first_char(c) -> Column:
    """First character."""
    return F.substring(_c(c), 1, 1)


def key_concat(*cols, sep: str = "_") -> Column:
    """String key from several columns; null parts print as 'None' like pandas."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("None")) for c in cols])


def fixed(c, decimals: int) -> Column:
    """Number printed with a fixed number of decimals (no grouping commas)."""
    return F.format_string(f"%.{decimals}f", _c(c))


def recommendation_text(cpu, mem, cpu_decimals: int = 4, mem_decimals: int = 2) -> Column:
    """'cpu: <x>, mem: <y>' (C4)."""
    return F.concat(F.lit("cpu: "), fixed(cpu, cpu_decimals), F.lit(", mem: "), fixed(mem, mem_decimals))


# --- calendar ----------------------------------------------------------------

def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (``timestamp_ntz``)
    value, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


def day_of_week_mon0(ts) -> Column:
    """pandas ``dt.dayofweek``: Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    return day_of_week_mon0(ts) >= 5


def to_naive_utc(ts) -> Column:
    """``dt.tz_localize(None)`` after conversion to UTC (B14): an instant
    (``timestamp``) becomes its UTC wall-clock ``timestamp_ntz``, whatever
    the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(ts)), epoch)


def calendar_features(ts) -> dict[str, Column]:
    """hour, dayofweek, quarter, month, year, dayofyear, dayofmonth, weekofyear."""
    t = _c(ts)
    return {
        "hour": F.hour(t), "dayofweek": F.weekday(t), "quarter": F.quarter(t),
        "month": F.month(t), "year": F.year(t), "dayofyear": F.dayofyear(t),
        "dayofmonth": F.dayofmonth(t), "weekofyear": F.weekofyear(t),
    }


# --- arithmetic --------------------------------------------------------------

def bytes_to_mib(c, decimals: int | None = 2) -> Column:
    """Bytes to MiB, optionally rounded."""
    v = _c(c).cast("double") / F.lit(MIB)
    return rnd(v, decimals) if decimals is not None else v


def ratio_or_zero(num, den, decimals: int | None = None) -> Column:
    """num/den, 0 where den == 0 (C11)."""
    v = F.when(_c(den) == 0, F.lit(0.0)).otherwise(_c(num) / _c(den))
    return rnd(v, decimals) if decimals is not None else v


def ratio_or_null(num, den) -> Column:
    """num/den, null where den == 0."""
    return F.try_divide(_c(num), _c(den))


def percent_reduction(current, predicted, decimals: int = 2) -> Column:
    """(current - predicted) / current * 100 (C15); null for current == 0."""
    return rnd(F.try_divide(_c(current) - _c(predicted), _c(current)) * 100.0, decimals)


def suggestion_text(current, predicted, unit: str = "", tol: float = 1e-6, rel: float = 1e-5) -> Column:
    """No change / Increase / Reduce text (C16); equal within ``tol + rel * abs(current)``."""
    cur, pred = _c(current), _c(predicted)
    return (F.when(F.abs(pred - cur) <= F.lit(tol) + F.lit(rel) * F.abs(cur), F.lit("No change"))
            .when(pred > cur, F.concat(F.lit("Increase to "), fixed(rnd(pred, 2), 2), F.lit(unit)))
            .otherwise(F.concat(F.lit("Reduce to "), fixed(rnd(pred, 2), 2), F.lit(unit))))


def under_provisioned(usage, request, factor: float = 1.2) -> Column:
    """usage > request * factor as 0/1 (C17)."""
    return (_c(usage) > _c(request) * F.lit(factor)).cast("int")


def clip_lower(c, lower: float = 0.0) -> Column:
    """clip(lower=...) keeping nulls."""
    return F.when(_c(c).isNull(), None).otherwise(F.greatest(_c(c), F.lit(lower)))


def zero_to(c, value: float = 0.001) -> Column:
    """Replace exact zero by a small constant."""
    return F.when(_c(c) == 0, F.lit(value)).otherwise(_c(c))


def cap(c, upper) -> Column:
    """where(x > upper, upper, x), nulls kept."""
    return F.when(_c(c) > upper, F.lit(upper)).otherwise(_c(c))


def round_half_even(c, decimals: int) -> Column:
    """numpy/pandas rounding rule (C20)."""
    return F.bround(_c(c), decimals)


def all_not_null(cols) -> Column:
    """Row mask: every listed column is non-null."""
    return reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in cols])


def all_zero(cols) -> Column:
    return reduce(lambda a, b: a & b, [_c(c) == 0 for c in cols])


def request_rule(pred, usage, factor: float = 1.2, decimals: int | None = None) -> Column:
    """Recommended request (R1): usage*f when pred < usage, else pred*f.

    A null prediction stays null (``greatest`` would silently use usage).
    """
    p, u = _c(pred), _c(usage)
    v = F.when(p.isNull(), F.lit(None).cast("double")).when(p < u, u * F.lit(factor)).otherwise(p * F.lit(factor))
    return rnd(v, decimals) if decimals is not None else v
