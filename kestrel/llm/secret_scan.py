"""Secret scan: three fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assignments to secret names, access keys and hexadecimal
strings.  What they match is the labelled sample of random strings.  The
labelled sample of ordinary identifiers is all other tokens of ``SAMPLE_TOKEN``
or more characters of the same corpus, each weighted by the number of binary
digits of its count (a token that holds digits has to occur twice to count, as
a random string hardly does), and names with dates and numbers made by a rule
(:func:`numbered_names`), which are a tenth of the sample: a corpus without such
names would else take every digit for a sign of randomness.  Transitions
between neighbouring characters are counted over all documents for either
sample, smoothed toward the shares of single characters, and kept as the
logarithm of the ratio of the two transition probabilities.  A token of
``min_token`` or more characters outside the pattern matches is a further span
if the sum of its ratios, plus the logarithm of the prior odds, is positive;
UUIDs are identifiers by their form and no spans.

Everything is DataFrame functions.  Positions come from the lengths of the
pieces between matches; the ratio table has 128 x 128 entries whatever the
input.  Tokens are counted before the shuffle, so a token in very many
documents costs one row per task.

Spans are counted in code points, ends are exclusive.  Edge cases: null and
empty texts have no spans and the hash of the empty text; with no labelled
sample on either side no span is added; repeated rows give repeated results;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import text_of

# The base patterns, their kinds in order, and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NAMES = ("passw", "secret", "token", "apikey", "api_key")      # every match holds one of these
ASSIGN_VALUE = 12
# A longest run of the least length is the same as a longest run of any length that reaches it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX_LENGTH = 16
HEX = r"[0-9a-f]{%d,}" % HEX_LENGTH

TOKEN_CLASS = r"[A-Za-z0-9+/_=-]"
ADDED = "random"
SAMPLE_TOKEN = 12
WIDTH = 128                      # ASCII; no sample holds other characters
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
NAMES = ("release", "build", "chapter", "section", "page", "invoice", "report", "version", "user", "item", "test", "image", "figure",
         "table", "backup", "order")
NAMES_SHARE = 9                  # corpus transitions for each one of the names made by the rule


def token_pattern(least: int) -> str:
    """Runs of ``least`` or more token characters; the look behind spares a try at every character of a shorter run."""
    return "(?<!%s)%s{%d,}" % (TOKEN_CLASS, TOKEN_CLASS, least)


def numbered_names() -> list[str]:
    """Ordinary identifiers with dates and numbers: every name with six dates, parts and ids, joined by ``_`` or ``-``."""
    out = []
    for name in NAMES:
        for k in range(6):
            for sep in "_-":
                out += [f"{name}{sep}{2004 + 4 * k}{sep}{1 + 5 * k % 12:02d}{sep}{1 + 11 * k % 28:02d}",
                        f"{name}{k + 1}{sep}part{3 * k + 2}{sep}notes", f"{name}{sep}id{sep}{10007 * (k + 1)}"]
    return out


def running_sum(numbers: Column, size: Column) -> Column:
    """Sums of the first 1, 2, ..., ``size`` entries of an array of that size.

    Each round adds the entry 1, 2, 4, ... places before, so there are log2(size)
    rounds; the array of the round before is a lambda's argument, computed once.
    """
    rounds = F.when(size > 1, F.transform(F.sequence(F.lit(1), F.length(F.bin(size - 1))), lambda k: F.pow(F.lit(2), k - 1).cast("int")))
    return F.aggregate(F.coalesce(rounds, F.array().cast("array<int>")), numbers, lambda sums, by: F.zip_with(
        sums, F.concat(F.array_repeat(F.lit(0), by), F.slice(sums, 1, size - by)), lambda a, b: a + b))


def matches(text: str, pattern: str, may: Column) -> Column:
    """All matches, in order.  ``may`` is a cheap test that holds for every text with a match."""
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def located(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add ``name array<struct<start, stop>>`` and ``name_gaps``, the pieces between the matches ``name_found``."""
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{n}_gaps": F.when(F.size(f"{n}_found") > 0, F.split(text, p, -1)).otherwise(none) for n, p in patterns.items()})

    def spans(gaps: str, found: str) -> Column:
        ends = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(running_sum(ends, F.size(found)), found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("stop")))
    return df.withColumns({n: spans(f"{n}_gaps", f"{n}_found") for n in patterns})


def blanked(text: str, name: str) -> Column:
    """The text with the matches of ``name`` overwritten by as many spaces."""
    parts = F.transform(f"{name}_gaps", lambda g, i: F.concat(g, F.repeat(F.lit(" "), F.coalesce(F.length(F.get(f"{name}_found", i)), F.lit(0)))))
    return F.when(F.size(f"{name}_found") > 0, F.array_join(parts, "")).otherwise(F.col(text))


def base_spans(df: DataFrame, text: str = "text", least: int = SAMPLE_TOKEN) -> DataFrame:
    """Add the base spans (``assign``, ``access``, ``hex``), the matched ``values``, ``rest``, the text
    with all pattern matches blanked, and ``tokens``, the tokens of ``least`` or more characters in it.

    Access keys and hexadecimal strings lie inside such tokens of the text, so only texts with a token
    that holds one are searched for them; without any match the tokens of the text are those of the rest.
    """
    lower = F.lower(F.col(text))
    named = F.lit(False)
    for n in ASSIGN_NAMES:
        named = named | F.contains(lower, F.lit(n))
    df = df.withColumns({"_named": named, "_runs": F.regexp_extract_all(text, F.lit(token_pattern(min(least, HEX_LENGTH))), F.lit(0))})
    df = df.withColumns({"_access": F.exists("_runs", lambda t: F.contains(t, F.lit("AKIA"))),
                         "_hex": F.exists("_runs", lambda t: (F.length(t) >= HEX_LENGTH) & t.rlike(HEX))})
    df = df.withColumns({"assign_found": matches(text, ASSIGN, F.col("_named")), "access_found": matches(text, ACCESS, F.col("_access")),
                         "hex_found": matches(text, HEX, F.col("_hex"))})
    df = df.withColumn("_values", F.when(F.size("assign_found") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
                       .otherwise(F.array().cast("array<string>")))
    df = located(df, text, {"assign": ASSIGN, "access": ACCESS, "hex": HEX})
    rest = df.withColumn("rest", blanked(text, "assign"))
    for name, pattern in (("access", ACCESS), ("hex", HEX)):
        rest = rest.withColumn("rest", F.when(F.size(f"{name}_found") > 0, _blank_again(pattern)).otherwise(F.col("rest")))
    any_found = F.size("assign_found") + F.size("access_found") + F.size("hex_found") > 0
    tokens = F.when(any_found, F.regexp_extract_all("rest", F.lit(token_pattern(least)), F.lit(0))).otherwise(
        F.filter("_runs", lambda t: F.length(t) >= least) if least > HEX_LENGTH else F.col("_runs"))
    long = F.filter("_values", lambda v: F.length(v) >= ASSIGN_VALUE)
    kept = F.filter("assign", lambda s, i: F.length(F.get("_values", i)) >= ASSIGN_VALUE)
    rest = rest.withColumns({"tokens": tokens, "values": F.concat(long, "access_found", "hex_found"), "assign": kept})
    return rest.drop("_named", "_runs", "_access", "_hex", "_values", *[f"{k}_{x}" for k in KINDS for x in ("found", "gaps")])


def _blank_again(pattern: str) -> Column:
    """Blank what is left of a pattern's matches in ``rest``, keeping its length."""
    gaps, found = F.split("rest", pattern, -1), F.regexp_extract_all("rest", F.lit(pattern), F.lit(0))
    return F.concat_ws("", F.flatten(F.zip_with(
        gaps, found, lambda g, m: F.array(g, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0)))))))


def _bigrams(token: Column) -> Column:
    """Index of each pair of neighbouring ASCII characters in the ratio table."""
    codes = F.array(F.transform(F.split(token, ""), lambda c: F.ascii(c)))            # bound by a lambda, so computed once
    return F.get(F.transform(codes, lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.size(c)),
                                                         lambda a, b: a * WIDTH + b)), 0)


def transition_counts(scanned: DataFrame, least: int = SAMPLE_TOKEN) -> DataFrame:
    """``pair, random, ordinary``: weighted transitions in either labelled sample, over all rows."""
    tokens = F.filter("tokens", lambda t: F.length(t) >= least)
    labelled = scanned.select(F.explode(F.concat(
        F.transform("values", lambda v: F.struct(F.lit(1).alias("label"), v.alias("token"))),
        F.transform(tokens, lambda t: F.struct(F.lit(0).alias("label"), t.alias("token"))))).alias("s"))
    distinct = labelled.groupBy("s.label", "s.token").agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("label") == 1, F.lit(1)).otherwise(F.length(F.bin("n")) - F.col("token").rlike("[0-9]").cast("int"))
    pairs = distinct.select("label", weight.alias("w"), F.explode(_bigrams(F.col("token"))).alias("pair")).where("w > 0")
    return pairs.groupBy("pair").agg(F.sum(F.col("label") * F.col("w")).alias("random"), F.sum((1 - F.col("label")) * F.col("w")).alias("ordinary"))


def log_ratios(counts: DataFrame) -> list[float] | None:
    """The 128 x 128 log ratios of transition probabilities (random over ordinary).

    Characters that neither sample holds have ratio 0.  None without a sample
    of the corpus on both sides.
    """
    import numpy as np
    table = np.zeros((2, WIDTH * WIDTH))
    for r in counts.where(F.col("pair").between(0, WIDTH * WIDTH - 1)).collect():     # at most 16,384 rows
        table[0, r["pair"]], table[1, r["pair"]] = r["random"], r["ordinary"]
    if not table[0].any() or not table[1].any():
        return None
    made = np.zeros(WIDTH * WIDTH)
    for name in numbered_names():
        np.add.at(made, [ord(a) * WIDTH + ord(b) for a, b in zip(name, name[1:])], 1)
    table[1] += made * max(1, int(table[1].sum()) // (NAMES_SHARE * int(made.sum())))
    both = table.reshape(2, WIDTH, WIDTH)
    seen = both.any(axis=(0, 1)) | both.any(axis=(0, 2))
    size = seen.sum()
    single = (both.sum(axis=1) + 1) / (both.sum(axis=(1, 2)) + size)[:, None]         # shares of second characters
    p = (both + size * single[:, None, :]) / (both.sum(axis=2, keepdims=True) + size)
    ratio = np.log(p[0] / p[1]) * np.outer(seen, seen)
    return ratio.ravel().tolist()


def log_odds(token: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of a token's transitions."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return F.aggregate(_bigrams(token), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(table, i), F.lit(0.0)))


def scan(df: DataFrame, min_token: int = SAMPLE_TOKEN, prior: float = 0.001, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, assign, access, hex, random``: the spans of each kind in every text."""
    import math
    src = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    scanned = base_spans(src, least=min(min_token, SAMPLE_TOKEN))
    ratios = log_ratios(transition_counts(scanned))
    if ratios is None:
        empty = F.array().cast("array<struct<start:int,stop:int>>")
        return scanned.select("doc_id", *KINDS, empty.alias(ADDED))
    bar = math.log(prior / (1 - prior))
    hit = F.transform("tokens", lambda t: (F.length(t) >= min_token) & (log_odds(t, ratios) + bar > 0) & ~t.rlike(UUID))
    hits = scanned.withColumn("hit", hit).withColumn("token_found", F.when(F.exists("hit", lambda h: h), F.col("tokens"))
                                                     .otherwise(F.array().cast("array<string>")))
    found = located(hits, "rest", {"token": token_pattern(min(min_token, SAMPLE_TOKEN))})
    marked = F.zip_with("token", "hit", lambda s, h: F.struct(s.alias("span"), h.alias("hit")))
    return found.select("doc_id", *KINDS, F.transform(F.filter(marked, lambda s: s["hit"]), lambda s: s["span"]).alias(ADDED))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of some kinds by start, then kind as listed, comma-joined."""
    def named(nth: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"),
                                                    s["stop"].alias("stop"), F.lit(kind).alias("kind")))
    parts = [named(nth, kind) for nth, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(found: DataFrame) -> DataFrame:
    """One row per document: numbers of base spans, a hash of them, and all spans."""
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, ADDED)).alias("spans"))
