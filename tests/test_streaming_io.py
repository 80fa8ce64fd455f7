"""Streaming projection and file round trips."""

import os
import tempfile

from pyspark.sql import functions as F

from kestrel.sources import files as IO
from kestrel.sources.fixtures import view
from kestrel.streaming import recommend as ST

from .conftest import SF_SMALL


def test_stream_matches_batch(spark):
    scratch = tempfile.mkdtemp(prefix="kestrel-stream-")
    src = os.path.join(scratch, "src")
    m = view(spark, SF_SMALL, "metrics")
    m.repartition(3).write.parquet(src)
    stream = ST.stream_metrics(spark, src, m.schema, max_files_per_trigger=1)
    q = ST.start_to_parquet(ST.per_row_recommendations(stream), os.path.join(scratch, "out"),
                            os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "out"))
    exp = ST.per_row_recommendations(m)
    assert got.count() == exp.count()
    assert got.exceptAll(exp.select(*got.columns)).count() == 0


def test_csv_and_jsonl_roundtrip(spark):
    m = view(spark, SF_SMALL, "metrics")
    back = IO.roundtrip(m, "jsonl", "t-jsonl", schema=m.schema)
    assert back.exceptAll(m).count() == 0 and back.count() == m.count()
    p = view(spark, SF_SMALL, "people")
    back = IO.roundtrip(p, "csv", "t-csv", schema=p.schema)
    assert back.exceptAll(p).count() == 0
    assert IO.select_existing(m, ["key", "nope"]).columns == ["key"]
    assert F is not None
