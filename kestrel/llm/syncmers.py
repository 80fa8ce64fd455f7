"""Document fingerprints from closed syncmers.

A text is a sequence of units: its words, and for texts of few words also its
characters.  Every pair of neighbouring units has a hash; a k-mer is ``k``
consecutive units with its ``k - 1`` pairs, and it is a closed syncmer if the
smallest of its pair hashes is the first or the last of them.  Whether a k-mer
is chosen depends on its own units only, so equal passages give equal anchors
wherever they stand, and anchors with their positions can be matched between
texts.

The fingerprint holds all anchors of a text, each at its first position; none
is dropped, however long the text is.  The likeness of two fingerprints
matches equal anchors, takes the difference of their positions, and counts the
matches whose offset occurs more than once: a passage that moved as a whole
still counts, a chance match does not.  It is twice that number over the
numbers of anchors on both sides (1 for equal texts).  Word k-mers have
``WORD_K`` words, texts of fewer than ``FEW_WORDS`` words also have character k-mers of
``CHAR_K`` characters, and a text shorter than one k-mer of either kind has one
anchor, the hash of the whole text.  Two texts are compared by words and by
characters as far as both have such anchors; the greater likeness counts.

All of it is DataFrame functions.  Words are what stands between characters
0x20 and 0x09 to 0x0D.  :func:`anchors` gives 64-bit anchors; fingerprints
keep 31 bits of them, so two texts of ``n`` anchors each share one by chance
with a probability of about ``n^2 / 2^31``, and chance matches need a common
offset to count.

Edge cases: null counts as the empty text; two empty texts have likeness 1;
equal texts have equal fingerprints; positions from 2^25 on are counted modulo
2^25; rows are ordered by id (nulls first), then by a hash of the text, and
repeated rows count as one document whose results all copies get; the only
document follows itself; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import row_key, text_of
from kestrel.operators.ordering import with_global_index

WORD_K = 5
CHAR_K = 9
FEW_WORDS = 24
KINDS = {"words": WORD_K, "chars": CHAR_K}
# An anchor in a fingerprint: 31 bits of hash, one bit for the side in a comparison, 25 bits of position.
POSITION_BITS = 25
POSITION = (1 << POSITION_BITS) - 1
ANCHOR = 0x7FFFFFFF


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def with_pairs(df: DataFrame, text: str, prefix: str = "_") -> DataFrame:
    """Add ``<prefix>words`` and ``<prefix>chars``: hashes of neighbouring units (none of a kind that the text does not use)."""
    df = df.withColumn(f"{prefix}words", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    characters = F.when(F.size(f"{prefix}words") < FEW_WORDS, F.split(F.col(text), "")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(f"{prefix}chars", F.transform(characters, lambda c: F.xxhash64(c)))
    for kind in KINDS:
        at = f"{prefix}{kind}"
        n = F.greatest(F.size(at) - 1, F.lit(0))
        df = df.withColumn(at, F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda a, b: F.xxhash64(a, b)))
    return df


def syncmers(pairs: str, k: int) -> Column:
    """For each k-mer its 64-bit hash if it is a closed syncmer, else null."""
    kmers = F.slice(pairs, 1, F.greatest(F.size(pairs) - (k - 2), F.lit(0)))

    def choose(first: Column, at: Column) -> Column:
        inner = [F.get(pairs, at + j) for j in range(1, k - 2)]
        last = F.get(pairs, at + (k - 2))
        # Every other pair and the last one cover all units of the k-mer.
        return F.when(F.least(first, last) <= F.least(*inner), F.xxhash64(first, *inner[1::2], last))
    return F.transform(kmers, choose)


def whole(text: str) -> Column:
    """The anchor of a text that is shorter than a k-mer."""
    return F.xxhash64(F.lit("whole"), F.col(text))


def anchors(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind, position, anchor``: the anchors of every text; positions count its words or characters from 0."""
    found = with_pairs(df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), "text")
    for kind, k in KINDS.items():
        found = found.withColumn(f"_{kind}", syncmers(f"_{kind}", k))
    none = ~F.exists("_words", lambda a: a.isNotNull()) & ~F.exists("_chars", lambda a: a.isNotNull())
    found = found.withColumn("_chars", F.when(none, F.array(whole("text"))).otherwise(F.col("_chars")))
    both = [F.transform(f"_{kind}", _placed(kind)) for kind in KINDS]
    return (found.select("doc_id", F.explode(F.concat(*both)).alias("a")).select("doc_id", "a.*").where(F.col("anchor").isNotNull()))


def _placed(kind: str):
    return lambda a, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), a.alias("anchor"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``<out>_words`` and ``<out>_chars``: packed anchors (hash, then position), ascending, each hash once."""
    df = with_pairs(df, text)
    for kind, k in KINDS.items():
        packed = F.transform(syncmers(f"_{kind}", k), lambda a, i: F.shiftleft(a.bitwiseAND(F.lit(ANCHOR)), POSITION_BITS + 1).bitwiseOR(
            i.cast("long").bitwiseAND(F.lit(POSITION))))
        df = df.withColumn(f"_{kind}", F.sort_array(F.array_compact(packed)))
    only = F.array(F.shiftleft(whole(text).bitwiseAND(F.lit(ANCHOR)), POSITION_BITS + 1))
    df = df.withColumn("_chars", F.when((F.size("_words") == 0) & (F.size("_chars") == 0), only).otherwise(F.col("_chars")))
    for kind in KINDS:
        df = df.withColumn(f"{out}_{kind}", F.filter(f"_{kind}", _first_of(f"_{kind}")))
    return df.drop(*[f"_{kind}" for kind in KINDS])


def _first_of(name: str):
    """Keeps an anchor's first position: the packed anchors are sorted by hash, then position."""
    return lambda x, i: (i == 0) | (F.shiftright(x, POSITION_BITS + 1) != F.shiftright(F.get(name, i - 1), POSITION_BITS + 1))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``, the likeness of the fingerprints ``a`` and ``b``."""
    for kind in KINDS:
        left, right = f"{a}_{kind}", f"{b}_{kind}"
        # Equal hashes meet after sorting; each side has a hash once, so at most two are equal.
        df = df.withColumn("_both", F.sort_array(F.concat(left, F.transform(right, lambda x: x.bitwiseOR(F.lit(1 << POSITION_BITS))))))
        n = F.greatest(F.size("_both") - 1, F.lit(0))
        offset = F.zip_with(F.slice("_both", 1, n), F.slice("_both", 2, n), lambda x, y: F.when(
            F.shiftright(x, POSITION_BITS + 1) == F.shiftright(y, POSITION_BITS + 1),
            y.bitwiseAND(F.lit(POSITION)) - x.bitwiseAND(F.lit(POSITION))))
        df = df.withColumn("_offsets", F.sort_array(F.array_compact(offset)))
        common = F.size(F.filter("_offsets", lambda o, i: (o == F.get("_offsets", i - 1)) | (o == F.get("_offsets", i + 1))))
        matched = F.greatest(common, F.least(F.size("_offsets"), F.lit(1)))
        df = df.withColumn(f"_like_{kind}", F.when((F.size(left) > 0) & (F.size(right) > 0), 2 * matched / (F.size(left) + F.size(right)))
                           .otherwise(F.lit(0.0))).drop("_both", "_offsets")
    return df.withColumn(out, F.greatest("_like_words", "_like_chars")).drop("_like_words", "_like_chars")


def shown(name: str) -> Column:
    """A fingerprint as text: hash and position of each anchor in hexadecimal, words and characters divided by a bar."""
    parts = [F.array_join(F.transform(f"{name}_{kind}", lambda x: F.concat_ws(
        ":", F.hex(F.shiftright(x, POSITION_BITS + 1)), F.hex(x.bitwiseAND(F.lit(POSITION))))), ",") for kind in KINDS]
    return F.lower(F.concat_ws("|", *parts))


def followers(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_kd, _kt, prev_kd, prev_kt, prev_chars``: which document each one follows.

    Ordered by id and text hash over narrow rows (no texts); the first
    document follows the last.
    """
    kd, kt = row_key(doc_id, text)
    narrow = df.select(F.col(doc_id).alias("doc_id"), kd, kt, F.length(text_of(text)).alias("chars")).distinct()
    ranked = with_global_index(narrow, ["doc_id", "_kt"], "_at")
    n = ranked.count()
    before = ranked.select(((F.col("_at") + 1) % F.lit(max(n, 1))).alias("_at"), F.col("_kd").alias("prev_kd"),
                           F.col("_kt").alias("prev_kt"), F.col("chars").alias("prev_chars"))
    return ranked.select("_at", "_kd", "_kt").join(before, "_at").drop("_at")


def edited_likeness(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and the text whose last quarter is replaced from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id``.
    Texts are shuffled once (the exchange serves both sides of the join); what
    moves to the document before is its anchors and the beginning it needs.
    Repeated rows are told apart from their copies by row keys alone.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), text_of(text).alias("text"))
    # One row of each key: the copies are equal, so any one will do.
    once = (rows.join(followers(df, doc_id, text), ["_kd", "_kt"]).groupBy("_kd", "_kt").agg(
        *[F.first(c).alias(c) for c in ("prev_kd", "prev_kt", "prev_chars", "text", "doc_id")]))
    heads = with_fingerprint(once, "text", "next").select(
        F.col("prev_kd").alias("_kd"), F.col("prev_kt").alias("_kt"),
        F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"),
        "next_words", "next_chars", F.col("doc_id").alias("next_id"))
    joined = rows.join(heads, ["_kd", "_kt"])
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    both = with_fingerprint(joined.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(kept, "head")).drop("head"), "text", "own")
    both = with_fingerprint(both.drop("text"), "edited", "new")
    done = with_likeness(with_likeness(both, "own", "new", "near_edited"), "own", "next", "near_next")
    return done.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
                       shown("own").alias("fingerprint"), shown("new").alias("edited_fingerprint"), "near_edited", "near_next", "next_id")
