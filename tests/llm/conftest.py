import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, rows):
    """``(doc_id, text)`` pairs as a table shaped like ``documents``."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns that clash with names used inside."""
    rnd = random.Random(7)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (None, "a text without an id and some words"), (None, None),
            (5, "one text twice, with the same id\nsecond line of some length, thirty and more"),
            (5, "one text twice, with the same id\nsecond line of some length, thirty and more"),
            (6, "one text twice, with the same id\nsecond line of some length, thirty and more"),
            (7, "x" * 30_000), (8, "▁ ▁퟿\U0001f389 \x00 end")]
    df = frame(spark, rows)
    for name in ("score", "fp", "ids", "_row", "_kt", "_kd", "key", "component", "label", "found", "row", "shard", "rest", "part"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
