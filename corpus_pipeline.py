"""Text pipeline over ``documents``: each stage gets what the one before kept.

toxicity         documents whose toxicity reaches 0.3 go
line_dedup       later copies of repeated line runs are cut out of the texts
simhash          one document of each group of near-duplicates stays
decontamination  documents with benchmark passages go
sentencepiece    texts become piece ids, checked by decoding them again

All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import contamination, line_dedup, sentencepiece_codec, simhash, toxicity
from kestrel.llm.common import discard, documents, table, written

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels that op3 learns from, and keep documents below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), chosen=toxicity.fold(F.col("doc_id"), 4) != 2)
    return toxicity.drop_toxic(docs, model, TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated line runs of 30 or more characters; ``n_chars`` follows the text."""
    left = line_dedup.drop_repeated_lines(docs, min_chars=30)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of 3 words, fingerprints linked at 2 or fewer differing bits."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``ids``, ``n_ids`` and ``restored`` to the documents."""
    return sentencepiece_codec.encode_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", to_pieces),
]

# Fitted models, fingerprints and Viterbi searches are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage kept is written once for the next."""
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            last, docs = before, written(docs, name)
            if last is not None:
                discard(last)
            before = docs
    return docs
