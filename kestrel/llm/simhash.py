"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64
values (seed 42) of the text's word shingles, repeats included.  Fingerprints
link at ``max_bits`` or fewer differing bits, and documents whose fingerprints
are connected by links share a component.

Let d(x, p) be the Hamming distance of a fingerprint x to a reference
fingerprint (pivot) p.  By the triangle inequality linked fingerprints differ
by at most ``max_bits`` in every d(., p).

* The distances to the zero fingerprint and to 32 pivots with one pair of bits
  set give the bit count of each pair, (d(x, 0) - d(x, p) + 2) / 2.  Each
  differing bit changes one of these 32 coordinates, so at most ``max_bits`` of
  them differ between linked fingerprints.  With the coordinates dealt to
  ``max_bits + 3`` groups, linked fingerprints agree on all coordinates of
  three groups at least: each choice of three groups is a key, and only
  fingerprints with an equal key meet.
* Where they meet, the distances to 32 scattered pivots are computed once for
  each fingerprint; a pair with a larger difference than ``max_bits`` in any
  of them is discarded, and what is left is verified bit by bit.
* Only a spanning forest of a meeting is emitted, never its pairs.

A key shared by more than ``max_meeting`` distinct fingerprints is found by
counting before the shuffle and split exactly: two fingerprints differ in at
most two bits if and only if they are both within one bit of a third, so each
fingerprint is sent to itself and to its single-bit neighbours, and at most 65
fingerprints can meet at one of them.  Flips of the bits that the key leaves
open are enough, since every link has a key that leaves all its differing bits
open.

Equal fingerprints are one row before any of this, whatever their number.

Edge cases: a text without words (null, empty, white space) has fingerprint
zero and is linked like any other; fewer words than a shingle count as one
shingle; null ids are allowed, the smallest non-null id names a component;
repeated rows share a component; an empty table gives an empty result; other
columns are not read by the search and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import row_key, small_batches, written
from kestrel.llm.components import components

SEED = 42
PAIR_PIVOTS = [3 << (2 * j) for j in range(32)]
MAX_MEETING = 1024
ROWS_AT_ONCE = 20_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scattered_pivots(n: int = 32) -> np.ndarray:
    """``n`` fixed reference fingerprints: XXH64 of 0, 1, ..., n - 1."""
    import xxhash
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of one text."""
    import xxhash
    words = (text or "").encode().translate(_LOWER).split()     # bytes.split: space and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(SEED)),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, 1 << 14):
        part = hashes[begin:begin + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, _kt, fp``: one row per document, ``fp`` as a signed 64-bit number, ``_kt`` the row's text key."""
    import pyarrow as pa
    small_batches(df.sparkSession)
    src = df.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text)[1], F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))],
                                             names=["doc_id", "_kt", "fp"])

    kind = df.schema[doc_id].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, _kt long, fp long")


def group_choices(max_bits: int) -> list[np.ndarray]:
    """The coordinates of each key: three of ``max_bits + 3`` groups."""
    groups = np.array_split(np.arange(len(PAIR_PIVOTS)), max_bits + 3)
    return [np.concatenate(chosen) for chosen in combinations(groups, 3)]


def meeting_keys(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """Keys (rows: fingerprints, columns: choices of groups) from the pivot distances."""
    to_zero = np.bitwise_count(prints).astype(np.int64)
    to_pairs = [np.bitwise_count(prints ^ np.uint64(p)).astype(np.int64) for p in PAIR_PIVOTS]
    coordinates = np.stack([(to_zero - d + 2) >> 1 for d in to_pairs], axis=1)
    keys = np.empty((len(prints), len(group_choices(max_bits))), np.int64)
    for k, chosen in enumerate(group_choices(max_bits)):
        packed = np.full(len(prints), k, np.int64)
        for j in chosen:
            packed = packed << 2 | coordinates[:, j]
        keys[:, k] = packed
    return keys


def _key_rows(max_bits: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            keys = meeting_keys(prints, max_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(prints))),
                 pa.array(np.repeat(prints.view(np.int64), keys.shape[1]))], names=["key", "choice", "fp"])
    return run


def linked_pairs(keys: np.ndarray, near: np.ndarray, prints: np.ndarray, max_bits: int,
                 pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints with equal (key, near), which must be sorted."""
    table = np.stack([np.bitwise_count(prints ^ p) for p in pivots], axis=1).astype(np.int8)
    order = np.lexsort((table[:, 0], near, keys))
    keys, near, prints, table = keys[order], near[order], prints[order], table[order]
    live, left, right = np.arange(len(prints)), [], []
    for step in range(1, len(prints)):
        live = live[live + step < len(prints)]
        other = live + step
        same = (keys[live] == keys[other]) & (near[live] == near[other]) & (table[other, 0] - table[live, 0] <= max_bits)
        live, other = live[same], other[same]
        if not len(live):
            break
        close = np.abs(table[live] - table[other]).max(axis=1) <= max_bits
        a, b = live[close], other[close]
        true = np.bitwise_count(prints[a] ^ prints[b]) <= max_bits
        left.append(order[a[true]])
        right.append(order[b[true]])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position connected to each of n positions."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    return label


def _gathered(batches: Iterator, rows: int) -> Iterator[list]:
    """Lists of consecutive batches with about ``rows`` rows, none of them empty."""
    part: list = []
    for batch in batches:
        if batch.num_rows:
            part.append(batch)
        if sum(b.num_rows for b in part) >= rows:
            yield part
            part = []
    if part:
        yield part


def _link(max_bits: int):
    """A mapInArrow body over rows sorted by (key, near): emits the edges of spanning forests."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = scattered_pivots()
        held = [np.empty(0, np.int64)] * 3

        def edges(rows):
            keys, near, prints = rows
            left, right = linked_pairs(keys, near, prints.view(np.uint64), max_bits, pivots)
            label = forest(len(keys), left, right)
            member = np.flatnonzero(label != np.arange(len(keys)))
            return pa.RecordBatch.from_arrays([pa.array(prints[label[member]]), pa.array(prints[member])], names=["a", "b"])

        for part in _gathered(batches, ROWS_AT_ONCE):
            rows = [np.concatenate([h, *(b.column(i).to_numpy() for b in part)]) for i, h in enumerate(held)]
            open_ = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])   # the last group may go on
            held = [r[open_:] for r in rows]
            if open_:
                yield edges([r[:open_] for r in rows])
        if len(held[0]):
            yield edges(held)
    return run


def _open_masks(max_bits: int) -> list[list[int]]:
    """For each choice of groups, no flip and the single flips of the bits its key leaves open."""
    masks = []
    for chosen in group_choices(max_bits):
        bits = [b for j in sorted(set(range(32)) - set(chosen.tolist())) for b in (2 * j, 2 * j + 1)]
        masks.append([0, *(1 << b if b < 63 else -(1 << 63) for b in bits)])
    return masks


def links(distinct: DataFrame, max_bits: int = 2, max_meeting: int = MAX_MEETING) -> DataFrame:
    """``a, b``: edges that connect the distinct fingerprints (column ``fp``) as all links do."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    rows = distinct.select("fp").mapInArrow(_key_rows(max_bits), "key long, choice int, fp long")
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_meeting).select("key")
    plain = rows.join(crowded, "key", "left_anti").select("key", F.lit(0).cast("long").alias("near"), "fp")
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for ms in _open_masks(max_bits)])
    split = (rows.join(crowded, "key", "left_semi")
             .select("key", "fp", F.explode(F.get(masks, F.col("choice"))).alias("mask"))
             .select("key", F.col("fp").bitwiseXOR(F.col("mask")).alias("near"), "fp"))
    met = plain.union(split).repartition("key", "near").sortWithinPartitions("key", "near", "fp")
    return met.mapInArrow(_link(max_bits), "a long, b long").distinct()


def with_components(df: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text",
                    max_meeting: int = MAX_MEETING) -> DataFrame:
    """``doc_id, _kt, fp, component, keep_id, keep_kt``, one row per document.

    ``component`` is the smallest id of the document's component, and
    (``keep_id``, ``keep_kt``) is the key of the one row that stands for it.
    """
    prints = written(fingerprints(df, shingle, doc_id, text), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_kt"))
    heads = written(prints.groupBy("fp").agg(first.alias("head")), "heads")
    roots = components(links(heads, max_bits, max_meeting)).withColumnRenamed("node", "fp")
    named = heads.join(roots, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    stands = named.groupBy("root").agg(F.min("head").alias("best"))
    lookup = named.join(stands, "root").select("fp", F.col("best.doc_id").alias("component"),
                                               F.col("best.doc_id").alias("keep_id"), F.col("best._kt").alias("keep_kt"))
    return prints.join(lookup, "fp")


def near_duplicates(df: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: fingerprints as 16 lower-case hex digits."""
    return with_components(df, shingle, max_bits, doc_id, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(df: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of ``df`` with one document of each component: the one with the smallest id.

    Of repeated rows one stays.
    """
    found = with_components(df, shingle, max_bits, doc_id, text)
    stays = found.select("keep_id", "keep_kt").distinct()
    stays = stays.select(F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("_kd"), F.col("keep_kt").alias("_kt"))
    rows = df.select(*row_key(doc_id, text), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    once = Window.partitionBy("_kd", "_kt").orderBy(F.lit(0))
    return (rows.join(stays, ["_kd", "_kt"], "left_semi").withColumn("_nth", F.row_number().over(once))
            .where("_nth = 1").select("_row.*"))
