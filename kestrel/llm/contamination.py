"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A benchmark item of m characters occurs in a document with at most e edits
(``e = floor(rate * m)``) only if both share ``m - q + 1 - q * e`` q-grams, and
the diagonals (position in the document minus position in the item) of these
shared q-grams differ by at most e.  So shared q-grams are counted in bands of
``2 * (e + 1)`` diagonals that overlap by half: every possible occurrence lies
whole in one of them.  Bands that reach the item's bound are verified by an
alignment restricted to the band (widened by e), which gives the place and the
number of edits.  Nothing that the bound admits is skipped, whatever the
length of the document or the number of its hits.

Characters are compared after ASCII letters are lower-cased and white space
(0x09 to 0x0D) is read as a space, one for one, so places are code points of
the original text.

An occurrence need not be whole: a document may hold only part of an item, or
an item of which a line was cut out.  Items longer than ``SEGMENT`` characters
are also indexed as segments of that length, one at every ``STEP`` characters,
and segments are found like items, with their own edit budget and bound.  A
part of an item with ``SEGMENT + STEP - 1`` or more characters in one piece
holds a whole segment wherever it begins.  Segments outside the whole
occurrences of their item are joined where they follow each other.

Items are few compared with documents: they are indexed in blocks of at most
``BLOCK_CHARS`` characters in all (segments counted), sent to the tasks, and every document is
held against every block.

Edge cases: null and empty documents match nothing; null items and items with
fewer than ``q`` characters match nothing; where the rate would allow so many
edits that the bound is below one shared q-gram, fewer edits are allowed;
repeated rows give repeated results; equal items match each under its own id;
empty tables give an empty result (or leave all documents); other columns are
kept by :func:`decontaminate` and not read by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import small_batches

Q = 10
RATE = 0.08
SEGMENT = 80
STEP = 40
BLOCK_CHARS = 4_000_000
CHARS_AT_ONCE = 1 << 21
BANDS_AT_ONCE = 512
MATCH = "array<struct<item:int,start:int,stop:int,edits:int>>"

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def folded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = codes < 128
    codes[low] = _FOLD[codes[low]]
    return codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, by doubling."""
    base = 0x9E3779B97F4A7C15
    size, acc, done, whole = 1, codes.astype(np.uint64) + np.uint64(1), 0, None
    power = base                                       # base ** size, modulo 2 ** 64
    while True:
        if q & size:
            if whole is None:
                whole = acc
            else:
                n = len(acc) - done
                whole = whole[:n] * np.uint64(power) + acc[done:]
            done += size
        if done == q:
            return whole
        acc = acc[:-size] * np.uint64(power) + acc[size:]
        power = power * power % (1 << 64)
        size *= 2


class Index:
    """q-grams of benchmark items, with each item's edit budget and least number of shared q-grams."""

    def __init__(self, items: list[str], q: int = Q, rate: float = RATE):
        self.q, self.codes = q, [folded(t) for t in items]
        m = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.maximum(np.minimum(np.floor(rate * m + 1e-9).astype(np.int64), (m - q) // q), 0)
        self.least = m - q + 1 - q * self.edits
        grams, owner, place = [], [], []
        for i, c in enumerate(self.codes):
            if len(c) >= q:
                h = gram_hashes(c, q)
                grams.append(h)
                owner.append(np.full(len(h), i, np.int64))
                place.append(np.arange(len(h), dtype=np.int64))
        self.empty = not grams
        if self.empty:
            return
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(len(self.grams) * 32))))
        self.may = np.zeros(1 << self.bits, np.bool_)
        self.may[self._slot(self.grams)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, place in the item, diagonal)`` of every q-gram that the codes share with an item."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.may[self._slot(hashes)])
        found = np.searchsorted(self.grams, hashes[at])
        found[found == len(self.grams)] = 0
        true = self.grams[found] == hashes[at]
        at, found = at[true], found[true]
        n = self.count[found]
        entry = np.repeat(self.first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.owner[entry], self.place[entry], np.repeat(at, n) - self.place[entry]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, first diagonal, last diagonal)`` of the bands with enough shared q-grams."""
        item, place, diagonal = self.hits(codes)
        if not len(item):
            return []
        step = self.edits[item] + 1
        shift = np.int64(max(map(len, self.codes)))          # diagonals can be negative
        band = (diagonal + shift) // step
        keys = np.concatenate([item << 40 | band + 1, item << 40 | band])     # bands b - 1 and b, of two steps each
        order = np.lexsort((np.concatenate([place, place]), keys))
        keys, place = keys[order], np.concatenate([place, place])[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (place[1:] != place[:-1]))   # a q-gram of the item counts once
        keys, n = np.unique(keys[fresh], return_counts=True)
        keys = keys[n >= self.least[keys >> 40]]
        out = []
        for key in keys.tolist():
            i, b = key >> 40, (key & (1 << 40) - 1) - 1
            s = int(self.edits[i]) + 1
            out.append((i, b * s - int(shift), (b + 2) * s - 1 - int(shift)))
        return out


def _exact(item: np.ndarray, codes: np.ndarray, low: int, high: int) -> int | None:
    """The first verbatim occurrence whose diagonal lies within ``low .. high``."""
    begin = max(0, low)
    raw, wanted = codes[begin:max(begin, high + len(item))].tobytes(), item.tobytes()
    at = raw.find(wanted)
    while at % 4 and at > 0:
        at = raw.find(wanted, at + 1)
    return None if at < 0 else begin + at // 4


def align(item: np.ndarray, texts: list[np.ndarray], lows: list[int], width: int, budget: int) -> list:
    """Place and edits of an item's best occurrence in each text, within a band of diagonals.

    The band of a text is ``low .. low + width - 1``, widened by ``budget`` on
    either side.  Each result is ``(start, stop, edits)``, or None if it needs
    over ``budget`` edits; of equally good ones the first by its end, then the
    shortest.  All bands of an item move through one dynamic program together.
    """
    width, m, n = width + 2 * budget, len(item), len(texts)
    low = np.array(lows, np.int32)[:, None] - np.int32(budget)
    size = np.array([len(t) for t in texts], np.int32)[:, None]
    window = np.full((n, m + width), -1, np.int64)
    for k, codes in enumerate(texts):
        first = int(low[k, 0])
        part = codes[max(0, first):max(0, first + m + width)]
        window[k, max(0, -first):max(0, -first) + len(part)] = part
    offset = np.arange(width, dtype=np.int32)[None, :]
    far = np.int32(1 << 29)
    begin = low + offset
    # cost[k, j]: item[:i] aligned with a stretch that ends before place low + i + j; origin: where it starts
    cost, origin = np.where((begin >= 0) & (begin <= size), np.int32(0), far), begin
    edge = np.full((n, 1), far, np.int32)
    for i in range(1, m + 1):
        here = window[:, i - 1:i - 1 + width]
        match = cost + (here != item[i - 1])
        drop = np.concatenate([cost[:, 1:] + 1, edge], axis=1)         # the item's character is missing
        match[here < 0] = far
        down = drop < match
        best = np.where(down, drop, match)
        start = np.where(down, np.concatenate([origin[:, 1:], edge], axis=1), origin)
        end = begin + i
        best[(end < 0) | (end > size)] = far
        run = np.minimum.accumulate(best - offset, axis=1) + offset    # extra characters in the text
        source = np.maximum.accumulate(np.where(best <= run, offset, 0), axis=1)
        cost, origin = run.astype(np.int32), np.take_along_axis(start, source, axis=1)
    out = []
    for k, j in enumerate(np.argmin(cost, axis=1).tolist()):
        edits = int(cost[k, j])
        out.append((int(origin[k, j]), int(low[k, 0]) + m + j, edits) if edits <= budget else None)
    return out


def best_of(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(item, start, stop, edits)``: of overlapping occurrences of an item the one with fewest edits."""
    kept: list[tuple[int, int, int, int]] = []
    for i, start, stop, edits in sorted(set(found), key=lambda f: (f[0], f[3], f[1], f[2])):
        if not any(k[0] == i and start < k[2] and k[1] < stop for k in kept):
            kept.append((i, start, stop, edits))
    return sorted(kept)


def search(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """The occurrences in each text; the q-grams of many texts are looked up together."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if index.empty:
        return out
    at, gap = 0, "\0" * index.q
    while at < len(texts):
        first, total = at, 0
        while at < len(texts) and (at == first or total < CHARS_AT_ONCE):
            total += len(texts[at] or "") + index.q
            at += 1
        joined = folded("".join((t or "") + gap for t in texts[first:at]))
        sizes = np.array([len(t or "") for t in texts[first:at]], np.int64)
        starts = np.cumsum(sizes + index.q) - sizes - index.q
        found: dict[int, list] = {}
        unsettled: dict[int, list] = {}
        for i, low, high in index.regions(joined):
            item, budget = index.codes[i], int(index.edits[i])
            # A band may reach into a neighbouring text; each text is aligned by itself.
            for k in range(max(0, int(np.searchsorted(starts, low - budget, "right")) - 1),
                           int(np.searchsorted(starts, high + budget + len(item), "right"))):
                begin = int(starts[k])
                codes = joined[begin:begin + int(sizes[k])]
                verbatim = _exact(item, codes, low - begin, high - begin)
                if verbatim is not None:
                    found.setdefault(k, []).append((i, verbatim, verbatim + len(item), 0))
                elif budget:
                    unsettled.setdefault(i, []).append((k, codes, low - begin))
        for i, bands in unsettled.items():
            for part in range(0, len(bands), BANDS_AT_ONCE):
                ks, codes, lows = zip(*bands[part:part + BANDS_AT_ONCE])
                budget = int(index.edits[i])
                for k, place in zip(ks, align(index.codes[i], list(codes), list(lows), 2 * (budget + 1), budget)):
                    if place:
                        found.setdefault(k, []).append((i, *place))
        for k, places in found.items():
            out[first + k] = best_of(places)
    return out


def distance(item: np.ndarray, codes: np.ndarray) -> int:
    """Edits between an item, or a part of one, and a stretch of text."""
    offset = np.arange(len(codes) + 1)
    row = offset
    for i, code in enumerate(item.tolist(), 1):
        best = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (codes != code)))
        row = np.minimum.accumulate(best - offset) + offset
    return int(row[-1])


class Passages:
    """Whole items and their segments in one index; ``parts`` has the item and first character of each segment."""

    def __init__(self, items: list[str], q: int = Q, rate: float = RATE):
        self.whole, self.parts, texts = len(items), [], list(items)
        for i, text in enumerate(items):
            last = len(text) - SEGMENT
            for begin in sorted({*range(0, last + 1, STEP), last}) if last > 0 else []:
                self.parts.append((i, begin))
                texts.append(text[begin:begin + SEGMENT])
        self.index = Index(texts, q, rate)

    def found(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """``(item, start, stop, edits)`` of the whole occurrences in each text, and of parts outside them."""
        return [self._joined(t, places) if places else [] for t, places in zip(texts, search(self.index, texts))]

    def _joined(self, text: str, places: list) -> list[tuple[int, int, int, int]]:
        out = [p for p in places if p[0] < self.whole]
        spans: dict[int, list] = {}
        for k, start, stop, edits in places:
            if k >= self.whole:
                i, begin = self.parts[k - self.whole]
                if not any(w[0] == i and start < w[2] and w[1] < stop for w in out):
                    spans.setdefault(i, []).append((start, stop, begin, edits))
        for i, segments in spans.items():
            chains: list[list] = []
            for start, stop, begin, edits in sorted(segments):
                last = chains[-1] if chains else None
                if last and start <= last[1] and begin > last[3]:      # the next segment of the same occurrence
                    chains[-1] = [last[0], max(stop, last[1]), last[2], begin, None]
                else:
                    chains.append([start, stop, begin, begin, edits])
            for start, stop, first, begin, edits in chains:
                if edits is None:
                    edits = distance(self.index.codes[i][first:begin + SEGMENT], folded(text[start:stop]))
                out.append((i, start, stop, edits))
        return sorted(out)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The items in blocks of about ``BLOCK_CHARS`` characters, one after the other."""
    src = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total * (1 + SEGMENT // STEP) // BLOCK_CHARS
    for b in range(n):
        part = src.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        yield [(r["id"], r["text"]) for r in part]


def _search_columns(df: DataFrame, passages: Passages, text: str, out: str, keep: list[str]) -> DataFrame:
    import pyarrow as pa
    small_batches(df.sparkSession)
    src = df.select(*keep, F.col(text).alias("_searched"))
    kind = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = passages.found(batch.column(len(keep)).to_pylist())
            rows = [[dict(zip(("item", "start", "stop", "edits"), f)) for f in fs] for fs in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(rows, kind)], names=[*keep, out])

    schema = T.StructType([*src.schema.fields[:len(keep)], T.StructField(out, T._parse_datatype_string(MATCH))])
    return src.mapInArrow(run, schema)


def matches(df: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, start, stop, edits``: every benchmark passage, whole or in part, found in a document."""
    result = None
    for block in _blocks(items, item_id, item_text):
        found = _search_columns(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                Passages([t for _, t in block], q, rate), "text", "found", ["doc_id"])
        ids = F.array(*[F.lit(i) for i, _ in block]) if block else F.array(F.lit(None))
        one = (found.where(F.size("found") > 0).select("doc_id", F.explode("found").alias("m"))
               .select("doc_id", F.get(ids, F.col("m.item")).cast(items.schema[item_id].dataType).alias("item_id"),
                       "m.start", "m.stop", "m.edits"))
        result = one if result is None else result.union(one)
    return result


def decontaminate(df: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark passage; all columns are kept."""
    names = df.columns
    rows = df.select(F.struct(*[F.col(c) for c in names]).alias("_row"))
    for block in _blocks(items, item_id, item_text):
        passages = Passages([t for _, t in block], q, rate)
        rows = rows.select("_row", F.col("_row").getField(text).alias("_text"))
        rows = _search_columns(rows, passages, "_text", "_found", ["_row"]).where(F.size("_found") == 0).select("_row")
    return rows.select("_row.*")
