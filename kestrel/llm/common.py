"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import shared_scratch_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The copy lives in the folder that ``spark.checkpoint.dir`` names, so it
    survives the loss of any executor and cuts the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_scratch_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(table: DataFrame) -> None:
    """Remove the files of a :func:`written` table that nothing unwritten depends on any more."""
    path = getattr(table, "_written_at", None)
    if path:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``(_kd, _kt)``: stable identity of a document row.

    Rows that agree in both id and text share one key and get one common
    result.  Null ids are the string ``''`` here, so keys join by plain
    equality.
    """
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_kd"),
            F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text)).alias("_kt")]


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python tasks in batches of at most ``BATCH_ROWS`` rows.

    Spark's default of 10,000 rows is meant for narrow rows; with texts each
    batch (held by the JVM and by Python) would take a large part of a small
    executor.  The session's own setting stays if it is smaller.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
