"""Filter interaction audit: what every order of several filters removes, and exact Shapley shares.

A document fails some of ``m`` filters.  The documents that a coalition of
filters removes are those that fail at least one of them, so a table of the
removals of all ``2^m`` coalitions (32 for five filters) says everything about
every order: a step removes the coalition up to it less the coalition before
it.  Spark counts documents by part and by the set of filters they fail, and
tabulates the coalitions from these counts; nothing is applied 120 times.

Shapley shares come from the kernel-weighted least squares problem whose
shares must add up to what all filters remove.  Its normal equations do not
depend on the data: they are solved once in rational numbers
(:func:`shapley_matrix`), and the solution, a matrix of integers over ``m!``,
is applied to each part's table in whole numbers.

A text's duplicates are met by the SHA-256 of the text.  Rows of equal text
are counted by id before that hash is shuffled alone, so a text that a third
of all rows hold costs a row per task.

Edge cases: a null text is the empty text (no words, no code points); a null
part is the empty string; a null id has no smaller id and is smaller than
none, so such rows never fail the duplicate filter and make none fail it, and
no label is theirs; an id labelled more than once counts as marked if any of
its rows marks it; repeated rows count each, and as they share one id none is
the duplicate of the other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import text_of

# The filters' letters, the space class and the signs that filter D looks for.
LETTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DUPLICATE = LETTERS.index("E")


def solve(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """``x`` with ``a x = b`` by Gauss-Jordan elimination in rationals."""
    n = len(a)
    rows = [list(map(Fraction, a[i])) + list(map(Fraction, b[i])) for i in range(n)]
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[n:] for r in rows]


def shapley_matrix(m: int) -> list[list[Fraction]]:
    """``m`` x ``2^m``: the shares as a linear map of the coalition table (entry of the empty one: 0).

    Minimises ``sum_S k(S) (v(S) - sum_{i in S} share_i)^2`` over proper
    coalitions with ``k(S) = (m - 1) / (C(m, |S|) |S| (m - |S|))``, under
    ``sum share_i = v(all)``, by its normal equations with one multiplier.
    """
    full = (1 << m) - 1
    if m == 1:
        return [[Fraction(0), Fraction(1)]]
    a = [[Fraction(0)] * (m + 1) for _ in range(m + 1)]
    b = [[Fraction(0)] * (full + 1) for _ in range(m + 1)]
    for size in range(1, m):
        kernel = Fraction(m - 1, comb(m, size) * size * (m - size))
        for members in combinations(range(m), size):
            s = sum(1 << i for i in members)
            for i in members:
                b[i][s] += kernel
                for j in members:
                    a[i][j] += kernel
    for i in range(m):
        a[i][m] = a[m][i] = Fraction(1)
    b[m][full] = Fraction(1)
    return solve(a, b)[:m]


def failures(df: DataFrame, text: str = "text") -> Column:
    """Bits of the filters A to D that the text fails (bit 0: A)."""
    t = text_of(text)
    words = F.filter(F.split(t, SPACES, -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(t) - F.length(F.translate(t, CAPITALS, ""))
    fails = (n < 100, distinct * F.lit(100) < n * F.lit(80), capitals * F.lit(100) > F.length(t) * F.lit(10), t.rlike(SIGNS))
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def failure_counts(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail (at most 32 rows a part)."""
    src = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                    F.unhex(F.sha2(text_of(text), 256)).alias("same"), failures(df, text).alias("mask"))
    docs = src.groupBy("same", "mask", "part", "id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = docs.join(marks, "id", "left")
    no = F.lit(False)
    cells = marked.groupBy("same", "mask", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    lowest = docs.groupBy("same").agg(F.min("id").alias("lowest"))
    kept = F.when(F.col("first.id") == F.col("lowest"), F.col("first.n")).otherwise(0) + F.col("without_id")
    split = cells.join(lowest, "same").select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), kept.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << DUPLICATE)).alias("mask"), (F.col("n") - kept).alias("n")))).alias("s"))
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"))


MEASURES = ("n", "good", "toxic")


def coalition_table(counts: DataFrame, m: int = len(LETTERS)) -> DataFrame:
    """``part, total, n, good, toxic``: arrays of what each of the ``2^m`` coalitions removes, by its bits."""
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = each.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in MEASURES])
    table = sums.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(
        F.struct("coalition", *MEASURES))).alias("_table"))                        # 2^m entries
    return table.select("part", "total", *[F.col("_table")[c].alias(c) for c in MEASURES])


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every step of every order of the filters, from the counts by failed filters."""
    m = len(letters)
    whole = [[int(x * factorial(m)) for x in row] for row in shapley_matrix(m)]
    if any(x * factorial(m) != y for row, ints in zip(shapley_matrix(m), whole) for x, y in zip(row, ints)):
        raise ArithmeticError("shares are not whole over all orders")
    table = coalition_table(counts, m)
    shares = F.array(*[F.aggregate(F.zip_with("n", F.array(*[F.lit(x) for x in row]), lambda v, x: v * x),
                                   F.lit(0).cast("long"), lambda a, x: a + x) for row in whole])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    step = table.withColumn("shares", shares).withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(m))))

    bits = F.array(*[F.lit(1 << k) for k in range(m)])

    def bit(at: Column) -> Column:
        return F.get(bits, F.instr(F.lit(letters), F.substring("filter_order", at, F.lit(1))) - 1)

    before = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(m)), F.lit(1), F.col("step") - 1), F.lit(0), lambda a, i: a + bit(i))
    step = step.withColumn("own", bit(F.col("step"))).withColumn("before", before)

    def lost(c: str) -> Column:
        return F.get(c, F.col("before") + F.col("own")) - F.get(c, F.col("before"))

    everyone = (1 << m) - 1
    place = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    return step.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("total") - F.get("n", F.col("before") + F.col("own"))).alias("kept"), lost("n").alias("removed"),
        (F.get("n", F.col("own")) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(everyone)) - F.get("n", F.lit(everyone) - F.col("own"))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", place).alias("shapley"))


AUDIT_SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
                 min(doc_id) OVER (PARTITION BY t) AS lowest FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN words.doc_id > lowest THEN 'E' ELSE '' END AS failed
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
docs AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE length(o) < 5 AND NOT contains(o, letter)),
steps AS (SELECT o, step, substr(o, CAST(step AS INTEGER), 1) AS f, substr(o, 1, CAST(step AS INTEGER) - 1) AS earlier
          FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
applied AS (
  SELECT part, o, step, f, n, good, toxic, contains(failed, f) AS hit, failed = f AS alone,
         translate(failed, earlier, '') <> failed AS gone
  FROM docs, steps),
summed AS (
  SELECT part, o, step, f, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM applied GROUP BY part, o, step, f)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed"""
