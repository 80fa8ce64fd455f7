"""Repeated runs of lines, by a suffix array over line ids with distributed prefix doubling.

All documents together are one long sequence of line ids, cut at document ends
and at lines that occur only once anywhere (no repeated run holds those).  The
suffixes of this sequence are sorted by prefix doubling: with ranks of the
suffixes by their first 2^j lines, a suffix's rank by its first 2^(j+1) lines
is the rank of the pair (its own rank, the rank 2^j lines further on).  Each
round is a distributed sort of the distinct pairs; equal pairs are counted
once, so a line in a third of all places is one pair.

A run of lines is a duplicate if it has ``min_chars`` or more characters and
the same run begins earlier (in the order of ids, then of lines).  An interval
of suffixes that share their first n lines is the set of places of one such
run; its earliest place stays and the lines of the others go.  It is enough to
look at the shortest intervals that reach ``min_chars`` from either end: for
every place the shortest sufficient run that begins there and the shortest one
that ends there.  Each line of a longer repeated run lies in one of these, so
together they cover the maximal runs exactly, and doubling can stop at the
length of the longest of them.  A run of n lines is named by its length and
the ranks of its first and last 2^j <= n lines.

Blank lines are no part of the sequence; they never break a run and stay.

Edge cases: null texts stay null, empty ones empty; repeated rows (same id and
text) are one document and share a result, so they do not delete each other;
null ids sort first; a text may become empty when all its lines occurred
before; an empty table gives an empty result; all columns of the input are
kept and clash with nothing, except that ``count`` replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import discard, row_key, written

KEY = ["_kd", "_kt"]


def line_places(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_kd, _kt, doc_id, pos, nth, chars, h1, h2``: every line that is not blank.

    ``pos`` counts such lines, ``nth`` all lines of the document; ``h1, h2`` is
    a 128-bit hash of the line.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("nth"), x.alias("line"))),
                     lambda s: F.length(F.trim(s["line"])) > 0)
    rows = df.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.posexplode(lines).alias("pos", "s"))
    line = F.col("s.line")
    return rows.select(*KEY, "doc_id", "pos", F.col("s.nth").alias("nth"), F.length(line).alias("chars"),
                       F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


def ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Number distinct keys in their order, by a range shuffle; stored, so the numbers stay."""
    return written(keys.repartitionByRange(*by).sortWithinPartitions(*by)
                   .withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_places(places: DataFrame) -> DataFrame:
    """The places of lines that occur more than once, with ``r0``, the rank of the line, and ``run``.

    Places with an equal ``run`` in a document follow each other without a gap.
    """
    often = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    ids = ranked(often, ["h1", "h2"], "line-ids").withColumnRenamed("rank", "r0")
    found = places.join(ids, ["h1", "h2"]).drop("h1", "h2").distinct()
    order = Window.partitionBy(*KEY).orderBy("pos")
    return written(found.withColumn("run", F.col("pos") - F.row_number().over(order)), "places")


def windows(places: DataFrame, min_chars: int) -> DataFrame:
    """``_kd, _kt, doc_id, start, n``: shortest runs of ``min_chars`` characters from and to every place."""
    run = Window.partitionBy(*KEY, "run")
    after = F.sum("chars").over(run.orderBy("pos"))
    lines = places.select(*KEY, "doc_id", "run", "pos", "chars", after.alias("after")).withColumn("before", F.col("after") - F.col("chars"))
    ahead = run.orderBy("before").rangeBetween(0, min_chars - 1)
    back = run.orderBy("after").rangeBetween(-(min_chars - 1), 0)
    lines = (lines.withColumn("n_ahead", F.count(F.lit(1)).over(ahead)).withColumn("to", F.max("after").over(ahead))
             .withColumn("n_back", F.count(F.lit(1)).over(back)).withColumn("from", F.min("before").over(back)))
    both = F.array(F.when(F.col("to") - F.col("before") >= min_chars, F.struct(F.col("pos").alias("start"), F.col("n_ahead").alias("n"))),
                   F.when(F.col("after") - F.col("from") >= min_chars,
                          F.struct((F.col("pos") - F.col("n_back") + 1).cast("int").alias("start"), F.col("n_back").alias("n"))))
    runs = F.array_distinct(F.filter(both, lambda w: w.isNotNull()))
    return lines.select(*KEY, "doc_id", F.explode(runs).alias("w")).select(*KEY, "doc_id", "w.start", F.col("w.n").cast("int").alias("n"))


def suffix_ranks(places: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Add ``r1, r2, ...``: ranks of the suffixes by their first 2, 4, ... lines, up to ``longest`` lines.

    Suffixes that end before come first.  Ordering by the last column gives
    the suffix array.
    """
    level = 0
    while 2 << level <= longest:
        follow = Window.partitionBy(*KEY, "run").orderBy("pos")
        now, a = f"r{level + 1}", f"r{level}"
        paired = written(places.withColumn("_b", F.coalesce(F.lead(a, 1 << level).over(follow), F.lit(-1))), "pairs")
        pairs = paired.groupBy(F.col(a).alias("_a"), "_b").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        ranks = ranked(pairs, ["_a", "_b"], "ranks").withColumnRenamed("rank", now)
        last, places = places, written(paired.join(ranks.withColumnRenamed("_a", a), [a, "_b"]).drop("_b"), "places")
        for done in (last, paired):
            discard(done)
        level += 1
    return places, level


def named_windows(found: DataFrame, places: DataFrame, levels: int) -> DataFrame:
    """Add ``first, last``: ranks of the first and last 2^j lines of each run, 2^j <= n < 2^(j+1)."""
    ranks = places.select(*KEY, "pos", F.array(*[f"r{j}" for j in range(levels + 1)]).alias("ranks"))
    level = sum((F.when(F.col("n") >= (2 << j), 1).otherwise(0) for j in range(levels)), F.lit(0)).cast("int")
    sized = found.withColumn("level", level).withColumn("tail", F.col("start") + F.col("n") - F.expr("shiftleft(1, level)"))
    begin = sized.join(ranks.withColumnRenamed("pos", "start"), [*KEY, "start"]).withColumn("first", F.get("ranks", F.col("level"))).drop("ranks")
    end = begin.where("n > 1").join(ranks.withColumnRenamed("pos", "tail"), [*KEY, "tail"]).withColumn("last", F.get("ranks", F.col("level"))).drop("ranks")
    columns = [*KEY, "doc_id", "start", "n", "first", "last"]
    return begin.where("n = 1").withColumn("last", F.col("first")).select(*columns).union(end.select(*columns))


def duplicate_runs(df: DataFrame, min_chars: int = 30, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(runs, places)``: the runs of each later copy, and the places with their suffix ranks.

    Runs have ``_kd, _kt, doc_id, start, n`` and ``kept_id, kept_start``, the
    earliest place of the same run.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be positive")
    places = repeated_places(line_places(df, doc_id, text))
    found = written(windows(places, min_chars), "windows")
    longest = found.agg(F.max("n")).first()[0] or 1
    places, levels = suffix_ranks(places, longest)
    named = written(named_windows(found, places, levels), "named")
    discard(found)
    at = F.struct("doc_id", "_kt", "start")
    earliest = written(named.groupBy("n", "first", "last").agg(F.min(at).alias("kept"), F.count(F.lit(1)).alias("copies"))
                       .where("copies > 1"), "intervals")
    # A copy that begins inside the kept one would take its lines; the first copy after it goes.
    inside = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("_kt") == F.col("kept._kt")) & (F.col("start") < F.col("kept.start") + F.col("n"))
    later = named.join(earliest, ["n", "first", "last"]).where((at != F.col("kept")) & ~inside)
    return later.select(*KEY, "doc_id", "start", "n", F.col("kept.doc_id").alias("kept_id"),
                        F.col("kept.start").alias("kept_start")), places


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines numbered in ``gone``."""
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def drop_repeated_lines(df: DataFrame, min_chars: int = 30, doc_id: str = "doc_id", text: str = "text",
                        count: str | None = None) -> DataFrame:
    """``df`` with the lines of later copies cut out of ``text``; ``count`` names a column for their number."""
    runs, places = duplicate_runs(df, min_chars, doc_id, text)
    gone = runs.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    gone = (gone.join(places.select(*KEY, "pos", "nth"), [*KEY, "pos"]).groupBy(*KEY)
            .agg(F.collect_list("nth").alias("_gone")))
    kept = F.when(F.col("_gone").isNull(), F.col(f"_row.{text}")).otherwise(_without(F.col(f"_row.{text}"), F.col("_gone")))
    rows = df.select(*row_key(doc_id, text), F.struct(*[F.col(c) for c in df.columns]).alias("_row")).join(gone, KEY, "left")
    columns = [kept.alias(c) if c == text else F.col(f"_row.{c}") for c in df.columns if c != count]
    if count:
        columns.append(F.coalesce(F.size("_gone"), F.lit(0)).alias(count))
    return rows.select(*columns)
