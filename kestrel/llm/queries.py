"""The operators applied to the driver's tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import contamination, filter_audit, line_dedup, pii, quality, secret_scan, secret_sql, sentencepiece_codec, sharding, simhash, spelling, syncmers, token_counts, toxicity
from kestrel.llm.common import documents, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; positives from labels of ids whose CRC modulo 3 is not 1."""
    part = toxicity.fold(F.col("doc_id"), 3)
    scored = quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), chosen=part != 1)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by streaming Viterbi, decoded again and compared with the text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sentencepiece_codec.encode_checked(docs).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; fitted on labels of ids whose CRC modulo 4 is not 2."""
    docs, part = documents(spark, sf_dir), toxicity.fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), chosen=part != 2)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_sentences", "worst_start", "worst_stop", "worst_score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: pattern matches, and tokens that the Markov models take for random."""
    return secret_scan.report(secret_scan.scan(documents(spark, sf_dir), min_token=12, prior=0.001))


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of all documents and of their edited texts, compared."""
    return syncmers.edited_likeness(documents(spark, sf_dir))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents over 3-word shingles, linked at 2 or fewer differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated line runs of 30 or more characters."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, min_chars=30, count="n_deleted")


def op8_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents, with up to 8 edits in 100 characters."""
    return contamination.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards of equal weight, by rendezvous hashing of doc_id."""
    out = sharding.shard_documents(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), "grown_shard")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and the longest prefix within 4,096 tokens, from prefix counts."""
    return token_counts.count_tokens(documents(spark, sf_dir), limit=4096)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base patterns, and further candidates that the trained classifier accepts."""
    found = pii.candidates(documents(spark, sf_dir))
    return pii.report(pii.judged(found, pii.fit(found)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents (6 code points, 5 occurrences or more), their near words, forms and roots."""
    words = spelling.vocabulary(documents(spark, sf_dir), least_length=6, least_count=5)
    return spelling.variants(words, ratio=5)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents: every step of all 120 orders, by language, with Shapley shares."""
    return filter_audit.audit(filter_audit.failure_counts(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sentencepiece_codec": op2_sentencepiece_codec,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_syncmer_fingerprints": op5_syncmer_fingerprints,
    "op6_simhash_components": op6_simhash_components,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_passages": op8_benchmark_passages,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_token_counts": op10_token_counts,
    "op11_personal_data": op11_personal_data,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op13_filter_audit": filter_audit.AUDIT_SQL,
    "op4_secret_scan": secret_sql.scan_sql(min_token=12, prior=0.001),
    # Every run of lines whose first or last line is needed to reach 30 characters, compared as whole text.
    "op7_line_dedup": """
WITH all_lines AS (
  SELECT doc_id, line, nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)),
lines AS (
  SELECT doc_id, line, nth, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS pos
  FROM all_lines WHERE trim(line) <> ''),
runs AS (
  SELECT a.doc_id, a.pos AS s, e.pos AS e, string_agg(m.line, chr(10) ORDER BY m.pos) AS run
  FROM lines a JOIN lines e ON e.doc_id = a.doc_id AND e.pos BETWEEN a.pos AND a.pos + 29
  JOIN lines m ON m.doc_id = a.doc_id AND m.pos BETWEEN a.pos AND e.pos
  GROUP BY a.doc_id, a.pos, e.pos, a.n, e.n HAVING sum(m.n) >= 30 AND (sum(m.n) - a.n < 30 OR sum(m.n) - e.n < 30)),
ranked AS (SELECT *, row_number() OVER w AS copy, first_value(doc_id) OVER w AS kept_id, first_value(e) OVER w AS kept_e
  FROM runs WINDOW w AS (PARTITION BY run ORDER BY doc_id, s)),
gone AS (SELECT DISTINCT l.doc_id, l.nth FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.s AND r.e
  WHERE r.copy > 1 AND NOT (r.doc_id = r.kept_id AND r.s <= r.kept_e)),
kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.nth) FILTER (WHERE g.nth IS NULL) AS text, CAST(count(g.nth) AS INTEGER) AS n_deleted
  FROM all_lines a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.nth = a.nth GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
