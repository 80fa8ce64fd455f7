"""Order-dependent operators that stay distributed.

pandas code leans on row position (``iloc`` slices, ``rolling`` and
``shift`` over a sorted frame, ``cumsum``).  In Spark a ``Window`` without
``partitionBy`` runs in a single task, and a window partitioned by a hot key
puts that whole key in one task.  The helpers here avoid both:

* ``with_global_index`` numbers rows 0..n-1 in a total order with a range
  shuffle (split by key ranges, so a hot key spreads over many partitions),
  a per-partition count (one row per partition) and a broadcast of the
  offsets, whose size is bounded by the partition count, not by the data.
* ``rolling`` computes "last k rows" frames in blocks of at most
  ``block_rows`` consecutive rows of the global order; the k-1 rows before a
  block are copied into it as a halo, so frames that cross a block border
  are still exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDX = "_kidx"
DEFAULT_BLOCK_ROWS = 1 << 20
# Largest window partition allowed in one task before the block/halo form is
# used.  Override with the session conf ``kestrel.window.maxTaskRows``.
DEFAULT_MAX_TASK_ROWS = 20_000_000


def max_task_rows(spark) -> int:
    return int(spark.conf.get("kestrel.window.maxTaskRows", str(DEFAULT_MAX_TASK_ROWS)))


def largest_partition(df: DataFrame, parts) -> int:
    """Row count of the biggest window partition (one small aggregate job)."""
    if parts:
        r = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_kc")).agg(F.max("_kc")).first()[0]
    else:
        r = df.count()
    return int(r or 0)


def _fits_one_task(df: DataFrame, parts, block_rows: int) -> bool:
    limit = min(max_task_rows(df.sparkSession), block_rows)
    return largest_partition(df, parts) <= limit


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


ROWS_PER_RANGE_PARTITION = 2_000_000


def range_partitions(df: DataFrame, rows: int | None = None) -> int:
    """Range-shuffle width: at least ``spark.sql.shuffle.partitions``, more
    when that would put over ~2M rows in a partition (AQE does not split
    range partitions by itself).  Costs one count unless ``rows`` is given."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count() if rows is None else rows
    return int(max(base, -(-rows // ROWS_PER_RANGE_PARTITION)))


def with_global_index(df: DataFrame, order_by, idx_col: str = IDX,
                      num_partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Add a 0-based position of each row in the total order ``order_by``.

    ``order_by`` must be a unique key (add a tie-break column); columns may be
    ``Column`` objects with ``desc()``.  The range-partitioned, sorted rows are
    written once as a reliable checkpoint (``spark.checkpoint.dir``): partition
    ids and positions are then fixed facts of the stored data, identical for
    the count branch, the main branch and any task retried after an executor
    loss.  Cost: one range shuffle, one write, a tiny aggregate; no
    single-task window.
    """
    from kestrel.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or range_partitions(df, rows)
    order = _cols(order_by)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    pid = F.spark_partition_id()
    tagged = ranged.withColumn("_kpid", pid).withColumn(
        "_kpos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
    counts = ranged.groupBy(pid.alias("_kpid")).agg(F.count(F.lit(1)).alias("_kcnt"))
    # One row per partition: a window over it is bounded by the partition count.
    offsets = counts.select(
        "_kpid",
        (F.sum("_kcnt").over(Window.orderBy("_kpid").rowsBetween(Window.unboundedPreceding, -1))).alias("_koff"))
    return (tagged.join(F.broadcast(offsets), "_kpid")
            .withColumn(idx_col, F.coalesce(F.col("_koff"), F.lit(0)) + F.col("_kpos"))
            .drop("_kpid", "_kpos", "_koff"))


def _with_halo(indexed: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Rows with their block ``_kblk``, and copies (``_khalo``) in every later
    block whose first rows look back at them, however many blocks that are."""
    at = F.col(IDX)
    block, last = F.floor(at / F.lit(block_rows)), F.floor((at + F.lit(halo)) / F.lit(block_rows))
    return (indexed.withColumn("_kown", block).withColumn("_kblk", F.explode(F.sequence(block, last)))
            .withColumn("_khalo", F.col("_kblk") > F.col("_kown")).drop("_kown"))


def rolling(df: DataFrame, partition_by, order_by, rows: int, aggs: dict[str, Column],
            block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Frame "current row and the ``rows - 1`` before it" within ``partition_by``.

    ``aggs`` maps output name to an aggregate ``Column`` (e.g.
    ``F.avg("cpuUsage")``) or to a function of the window spec (e.g.
    ``lambda w: F.round(F.avg("x").over(w), 4)``).  ``partition_by``
    may be empty for the global form.  Skew-safe: work is split into blocks of
    ``block_rows`` consecutive rows whatever the key distribution.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if _fits_one_task(df, parts, block_rows):
        # Size-checked fast path: every window partition fits one task.
        w = Window.partitionBy(*parts).orderBy(*_cols(order_by)).rowsBetween(-(rows - 1), 0)
        return df.select("*", *[(a(w) if callable(a) else a.over(w)).alias(name) for name, a in aggs.items()])
    order = _cols(parts) + _cols(order_by)
    halo = rows - 1
    both = _with_halo(with_global_index(df, order), block_rows, halo)
    w = Window.partitionBy(*(["_kblk"] + parts)).orderBy(IDX).rowsBetween(-halo, 0)
    out = both.select("*", *[(a(w) if callable(a) else a.over(w)).alias(name) for name, a in aggs.items()])
    return out.where(~F.col("_khalo")).drop("_kblk", "_khalo", IDX)


def shifted(df: DataFrame, partition_by, order_by, cols, offset: int = 1,
            suffix: str = "_lag1", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``shift(offset)`` of ``cols`` in the given order (W3), skew-safe."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if _fits_one_task(df, parts, block_rows):
        w = Window.partitionBy(*parts).orderBy(*_cols(order_by))
        return df.select("*", *[F.lag(c, offset).over(w).alias(f"{c}{suffix}") for c in cols])
    order = _cols(parts) + _cols(order_by)
    both = _with_halo(with_global_index(df, order), block_rows, offset)
    w = Window.partitionBy(*(["_kblk"] + parts)).orderBy(IDX)
    out = both.select("*", *[F.lag(c, offset).over(w).alias(f"{c}{suffix}") for c in cols])
    return out.where(~F.col("_khalo")).drop("_kblk", "_khalo", IDX)


def running_sum(df: DataFrame, order_by, col: str, out: str,
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Cumulative sum in a global order (W4) without a single-task window.

    Blocks have a fixed number of rows; inside a block a bounded window adds
    the running part.  Block totals (one row per block) are prefix-summed the
    same way: by a window while they fit one block, else in blocks of blocks.
    """
    rows = df.count()
    indexed = with_global_index(df, order_by, rows=rows).withColumn("_kblk", F.floor(F.col(IDX) / F.lit(block_rows)))
    totals = indexed.groupBy("_kblk").agg(F.sum(col).alias("_ktot"))
    if -(-rows // block_rows) <= block_rows:
        prefix = totals.select("_kblk", F.sum("_ktot").over(
            Window.orderBy("_kblk").rowsBetween(Window.unboundedPreceding, -1)).alias("_kpre"))
    else:
        upper = running_sum(totals.withColumnRenamed("_kblk", "_kid"), ["_kid"], "_ktot", "_kincl", block_rows)
        prefix = upper.select(F.col("_kid").alias("_kblk"), (F.col("_kincl") - F.col("_ktot")).alias("_kpre"))
    w = Window.partitionBy("_kblk").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    return (indexed.join(prefix, "_kblk")
            .withColumn(out, F.coalesce(F.col("_kpre"), F.lit(0.0)) + F.sum(col).over(w))
            .drop("_kblk", "_kpre", IDX))


def first_n(df: DataFrame, order_by, n: int | None = None, fraction: float | None = None,
            flag: str | None = None) -> DataFrame:
    """Rows whose position in ``order_by`` is below ``n`` (or ``int(count*fraction)``).

    Chronological split (P2) and ``tail`` (T7, with a descending order).  With
    ``flag`` all rows are kept and a boolean column marks the first part.
    """
    indexed = with_global_index(df, order_by)
    if n is None:
        total = df.count()
        n = int(total * fraction)
    cond = F.col(IDX) < F.lit(n)
    if flag:
        return indexed.withColumn(flag, cond).drop(IDX)
    return indexed.where(cond).drop(IDX)


def lags(df: DataFrame, partition_by, order_by, cols, max_lag: int,
         block_rows: int = DEFAULT_BLOCK_ROWS, largest: int | None = None) -> DataFrame:
    """``c_lag1 .. c_lag<max_lag>`` for each column in one indexed pass
    (halo of ``max_lag`` rows per block), skew-safe like :func:`rolling`.
    ``largest`` (rows of the biggest partition) skips the size-check job when
    the caller already knows it."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    fits = (largest <= min(max_task_rows(df.sparkSession), block_rows)) if largest is not None else \
        _fits_one_task(df, parts, block_rows)
    if fits:
        w = Window.partitionBy(*parts).orderBy(*_cols(order_by))
        return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in range(1, max_lag + 1)])
    order = _cols(parts) + _cols(order_by)
    both = _with_halo(with_global_index(df, order), block_rows, max_lag)
    w = Window.partitionBy(*(["_kblk"] + parts)).orderBy(IDX)
    exprs = [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in range(1, max_lag + 1)]
    out = both.select("*", *exprs)
    return out.where(~F.col("_khalo")).drop("_kblk", "_khalo")


def neighbours(df: DataFrame, partition_by, order_by, col: str, reach: int,
               block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``before`` and ``after``: arrays of ``col`` of up to ``reach`` rows on either side, nearest first.

    Skew-safe like :func:`rolling`: blocks of consecutive rows get ``reach``
    rows of the blocks on both sides as a halo.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if _fits_one_task(df, parts, block_rows):
        return df.select("*", *_both_sides(Window.partitionBy(*parts).orderBy(*_cols(order_by)), col, reach))
    at = F.col(IDX)
    first = F.greatest(F.floor((at - F.lit(reach)) / F.lit(block_rows)), F.lit(0))
    last = F.floor((at + F.lit(reach)) / F.lit(block_rows))
    both = (with_global_index(df, _cols(parts) + _cols(order_by)).withColumn("_kown", F.floor(at / F.lit(block_rows)))
            .withColumn("_kblk", F.explode(F.sequence(first, last))))
    out = both.select("*", *_both_sides(Window.partitionBy("_kblk", *parts).orderBy(IDX), col, reach))
    return out.where(F.col("_kblk") == F.col("_kown")).drop("_kblk", "_kown", IDX)


def _both_sides(w, col: str, reach: int) -> list[Column]:
    return [F.array_compact(F.array(*[f(col, t).over(w) for t in range(1, reach + 1)])).alias(name)
            for f, name in ((F.lag, "before"), (F.lead, "after"))]
