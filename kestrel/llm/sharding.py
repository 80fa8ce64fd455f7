"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Every (key, shard) pair has a pseudo-random number u in (0, 1) from
``xxhash64(key, shard)``; a record goes to the shard with the largest
``-weight / ln(u)``.  A shard's numbers do not depend on the other shards, so
adding one shard moves rows only into it and removing one moves only its own
rows; a shard gets rows in proportion to its weight.  All of it is DataFrame
expressions; nothing is shuffled to place a record.

Slots number the rows of a shard 0, 1, 2, ... without gaps.  A shard is cut
into hash groups by key, CRC and size, as many as its own rows need, so that
also a key with very many different texts is spread over groups of a bounded
number of rows; a group's first slot is the running sum of the smaller groups'
counts, so no task sorts a whole shard.

Edge cases: a null key is replaced by a hash of the text, so rows without a
key spread over all shards; null and empty texts have size 16; rows with
equal keys share a shard and get different slots; an empty table gives an
empty result; other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_GROUP = 10_000
ROW_OVERHEAD = 16


def record_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The id as text, or a hash of the text where the id is null."""
    return F.coalesce(F.concat(F.lit("id:"), F.col(doc_id).cast("string")),
                      F.concat(F.lit("text:"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string")))


def shard_score(key: Column, shard: Column, weight: Column) -> Column:
    """``-weight / ln(u)``; u from the upper 52 bits of the pair's hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 12).cast("double")
    return -weight / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number 0..len(weights)-1 of a key; of equal scores the lower shard wins.

    A shard of weight 0 gets no rows.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    scored = F.transform(F.array(*[F.lit(float(w)) for w in weights]),
                         lambda w, i: F.struct(F.when(w > 0, shard_score(key, i, w)).alias("score"), (-i).alias("back")))
    return (-F.array_max(scored)["back"]).cast("int")


def assign(df: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: its key, size in bytes, CRC of the text and shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = record_key(doc_id, text)
    return df.select(F.col(doc_id).alias("doc_id"), key.alias("key"),
                     (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
                     F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
                     rendezvous(key, weights).alias("shard"))


def with_groups(placed: DataFrame, shards: int, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Add ``grp``: groups of about ``rows_per_group`` rows (equal rows stay together) within each shard."""
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = F.array(*[F.lit(max(1, counts.get(s, 0) // rows_per_group)) for s in range(shards)])
    return placed.withColumn("grp", F.pmod(F.xxhash64(F.lit("slot"), "key", "text_crc32", "size"),
                                           F.get(groups, F.col("shard"))).cast("int"))


def with_slots(placed: DataFrame, shards: int, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Number the rows of each shard 0..n-1, in groups of about ``rows_per_group`` rows.

    Equal rows are counted before the shuffle, so a key with very many equal
    rows is one row in its group; at the end they are written out in blocks of
    ``rows_per_group``, which are spread over tasks.
    """
    whole = with_groups(placed, shards, rows_per_group)
    counted = whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("copies"))
    earlier = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = (whole.groupBy("shard", "grp").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    within = (Window.partitionBy("shard", "grp").orderBy("key", "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = (counted.withColumn("nth", F.coalesce(F.sum("copies").over(within), F.lit(0)))
                .join(starts, ["shard", "grp"])
                .withColumn("first", F.col("start") + F.col("nth")).withColumn("last", F.col("first") + F.col("copies") - 1))
    blocks = numbered.select(*placed.columns, "last", F.explode(F.sequence("first", "last", F.lit(rows_per_group).cast("long"))).alias("from"))
    return blocks.repartition("shard", "from").select(
        *placed.columns, F.explode(F.sequence("from", F.least("last", F.col("from") + rows_per_group - 1))).alias("slot"))


def shard_documents(df: DataFrame, shards: int = 40, weights: Sequence[float] | None = None,
                    doc_id: str = "doc_id", text: str = "text", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Place every row on a shard and number it there.

    ``weights`` (default: all 1) must have ``shards`` entries.  ``grown_shard``
    is the shard after one more of mean weight has been added.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards:
        raise ValueError("one weight per shard is needed")
    placed = assign(df, weights, doc_id, text)
    grown = rendezvous(F.col("key"), [*weights, sum(weights) / shards])
    return with_slots(placed, shards, rows_per_group).withColumn("grown_shard", grown)
