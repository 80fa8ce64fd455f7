import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import contamination, pieces, queries, sentencepiece_codec, toxicity
from tests.llm.test_classifiers import corpus, naive_score
from tests.llm.test_contamination import least_edits
from tests.llm.test_lines import brute
from tests.llm.test_simhash import components, print_of


@pytest.fixture(scope="module")
def sf_dir(spark, make, tmp_path_factory):
    rnd = random.Random(11)
    rows = corpus(160, 5)
    items = ["a benchmark passage number %d with quite some words to tell it apart" % i for i in range(3)]
    texts = [t for _, t, _, _ in rows]
    texts[20] += "\n" + items[0]
    texts[21] = items[1].replace("quite", "qite") + " " + texts[21]
    for k in (30, 31, 32):
        texts[k] = texts[29]
    shared = "one line that several documents share, word for word"
    for k in range(40, 46):
        texts[k] += "\n" + shared
    texts[50], texts[51] = None, ""
    texts[60] = texts[59] + " end"
    path = str(tmp_path_factory.mktemp("sf"))
    make(list(enumerate(texts))).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows if rnd.random() < 0.8], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_run_equals_brute_force(spark, sf_dir):
    path, texts, items = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), chosen=toxicity.fold(F.col("doc_id"), 4) != 2)
    kept = [(i, t) for i, t in enumerate(texts) if naive_score(model, t) < 0.3]
    left = brute([t for _, t in kept], 30)
    kept = [(i, t) for (i, _), (t, _) in zip(kept, left)]
    roots = components([print_of(t) for _, t in kept])
    kept = [kept[k] for k in range(len(kept)) if roots[k] == k]
    plain = lambda t: contamination.folded(t or "").tolist()
    index = contamination.Index(items)
    kept = [(i, t) for i, t in kept if not any(least_edits(plain(x), plain(t)) <= e for x, e in zip(items, index.edits))]
    codec = sentencepiece_codec.Codec(pieces.load(pieces.read_model()))
    want = {i: (t or "", np.frombuffer(codec.encode(t), np.int32).tolist()) for i, t in kept}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: (r.text, r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.restored for r in got)
    assert 20 not in want and 21 not in want and not {30, 31, 32} & set(want)


def test_stages_keep_the_columns(spark, sf_dir, odd):
    path = sf_dir[0]
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, odd, path).columns == odd.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, path).count() == odd.count() and last(spark, docs.limit(0), path).count() == 0


def test_every_operator_has_its_query():
    import __spark_entry__
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and set(queries.ORACLES) <= set(queries.QUERIES)
