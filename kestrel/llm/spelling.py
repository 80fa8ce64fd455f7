"""Spelling variants: words of a corpus grouped by one-edit neighbours, found with a bidirectional FM-index.

Words are the maximal letter runs of the texts, A-Z in lower case, and a
vocabulary holds the frequent ones.  An edit of a word lies in its first or in
its second half, so the other half stands unchanged at the same end of the
neighbour.  The search scheme follows from this: match one half exactly, then
go on across the other half allowing one error, once from either end
(:mod:`kestrel.llm.fm_index`).

The vocabulary is indexed in blocks.  A word is indexed under the beginnings
and under the ends that a neighbour's exact half can have (the neighbour may be
one code point shorter or longer: two lengths at most), and asked for in the
block of its own halves; so the work grows with the vocabulary.  A block that
a common half makes larger than twice ``block_words`` is split into pieces by
hash, and its queries too; each piece of queries meets each piece of the
index.  Nothing is left out.

A word's form is its neighbour with the largest count, if that is at least
``ratio`` times the word's own; with a ratio above 1 counts grow along the
chain of forms, so it ends.  Roots are found by pointer doubling, with the
tables written to the shared scratch folder between the rounds.

Edge cases: null and empty texts have no words; a null id counts as the empty
text before the colon; repeated rows count again; a word without neighbours is
its own root; ties of counts go to the smallest word in code-point order; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import discard, small_batches, written

# The letters of a word, and one run in how many loses a code point.
LETTERS = r"[A-Za-zÀ-ÿ]"
TYPO = 199
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
FLUSH = 200_000
QUERY_BATCH = 8192


def _count_words(least: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib
        # A run that is too short stays too short: code points are only deleted.
        runs = re.compile(LETTERS + "{%d,}" % max(least, 1))
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                begin = zlib.crc32(f"{who}:".encode() if who is not None else b":")
                for word, n in Counter(runs.findall(text)).items():
                    word = word.lower() if word.isascii() else word.translate(LOWER)
                    h = zlib.crc32(word.encode(), begin)
                    if h % TYPO == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()
    return run


def vocabulary(df: DataFrame, least_length: int = 6, least_count: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the words of all texts with their counts, from ``least_length`` code points and ``least_count`` on."""
    small_batches(df.sparkSession)
    src = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    counts = src.mapInArrow(_count_words(least_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(word: str = "word") -> Column:
    """``side, half, asks``: what a word is indexed under; ``asks`` marks its own two halves."""
    size = F.length(word)
    entries = []
    for side in (0, 1):
        own = F.floor(size / 2) if side == 0 else F.ceil(size / 2)
        lengths = [(F.floor(m / 2) if side == 0 else F.ceil(m / 2)) for m in (size - 1, size, size + 1)]
        for k, at in enumerate(lengths):
            half = F.substring(word, F.lit(1), at) if side == 0 else F.substring(word, size - at + 1, at)
            # The lengths rise by one at most once, so each differing one is listed once.
            listed = F.lit(True) if k == 1 else at != own
            entries.append(F.when(listed, F.struct(F.lit(side).alias("side"), half.alias("half"), F.lit(k == 1).alias("asks"))))
    return F.array_compact(F.array(*entries))


def _search(block):
    """One piece of a block: index its words, ask for those that ask."""
    import numpy as np
    import pandas as pd
    from kestrel.llm.fm_index import BidirectionalIndex
    side = int(block["side"].iloc[0])
    indexed = block[block["indexed"]].drop_duplicates("word")
    asking = block.loc[block["asks"], "word"].drop_duplicates().tolist()
    words, counts = indexed["word"].tolist(), indexed["n"].to_numpy()
    out = []
    if words and asking:
        index = BidirectionalIndex(words)
        for at in range(0, len(asking), QUERY_BATCH):
            part = asking[at:at + QUERY_BATCH]
            query, which = index.near(part, side)
            for q, w in zip(query.tolist(), which.tolist()):
                word, near = part[q], words[w]
                # What begins with the query's first half was found from the other end.
                if side == 0 or not near.startswith(word[:len(word) // 2]):
                    out.append((word, near, counts[w]))
    word, near, n = zip(*out) if out else ((), (), ())
    return pd.DataFrame({"word": np.array(word, object), "near": np.array(near, object), "near_n": np.array(n, np.int64)})


def near_pairs(words: DataFrame, block_words: int = 20_000) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words (``word, n``, distinct) at one edit, once."""
    total = words.count()
    blocks = max(1, -(-4 * total // block_words))
    entries = words.select("word", "n", F.explode(_halves()).alias("h")).select(
        "word", "n", "h.side", "h.asks", F.pmod(F.xxhash64("h.side", "h.half"), F.lit(blocks)).alias("block"))
    large = (entries.groupBy("side", "block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * block_words)
             .select("side", "block", F.ceil(F.col("size") / block_words).cast("int").alias("pieces")))
    # Four entries a word at most, so no more than half of the blocks can be large.
    placed = entries.join(large, ["side", "block"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    as_index = F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("indexed"), (F.col("asks") & (j == own)).alias("asks")))
    as_query = F.transform(F.filter(every, lambda i: F.col("asks") & (i != own)),
                           lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    pieces = placed.select("word", "n", "side", "block", F.explode(F.concat(as_index, as_query)).alias("p")).select(
        "word", "n", "side", "block", "p.i", "p.j", "p.indexed", "p.asks")
    # A piece is small in bytes and long in work, so tasks follow the number of blocks, not their size.
    spread = pieces.repartition(blocks, "side", "block", "i", "j")
    return spread.groupBy("side", "block", "i", "j").applyInPandas(_search, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain in ``links`` (``word, form``, without circles)."""
    now = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            return now.drop("moved")


def variants(words: DataFrame, ratio: int = 5, block_words: int = 20_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n`` of distinct words."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, block_words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    judged = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    near = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(near.where("form IS NOT NULL"))
    out = near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(words)
    return out
