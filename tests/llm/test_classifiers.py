import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import quality, toxicity

TOXIC_WORDS = ["zorgal", "zorgen", "blatt"]


def corpus(n, seed=1):
    """``(id, text, quality, toxic)``; a toxic document has one or more toxic sentences among others."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ta", "ri", "no", "the", "un", "es", "lo"]) for _ in range(rnd.randint(1, 3))) for _ in range(150)]
    out = []
    for i in range(n):
        sentences = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 15))]
        good, toxic = int(rnd.random() < 0.7), int(rnd.random() < 0.3)
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                k = rnd.randrange(len(sentences))
                sentences[k] += " " + rnd.choice(TOXIC_WORDS) + rnd.choice(["", "ia", "os"])
        text = ". ".join(sentences) + "."
        if not good:
            text = rnd.choice([text.upper().replace(" ", "!! "), text.replace(" ", "*** "), " | ".join(text.split()),
                               (sentences[0] + ".\n") * 12]) if not toxic else text.replace(" ", "*** ")
        out.append((i, text, good, toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark, make):
    rows = corpus(900)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2 or i % 3] + [(None, 1, 1), (901, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, make([(i, t) for i, t, _, _ in rows]), labels


def test_fold_is_the_crc_of_the_id(spark):
    got = spark.range(50).select("id", toxicity.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def naive_score(model, text):
    """The noisy-or of the sentences, word by word."""
    weight, none = dict(zip(model.features, model.weights)), 1.0
    low = toxicity.lowered(text or "")[1:-1]
    for a, b in toxicity.sentence_bounds(text or ""):
        odds = model.bias + sum(weight.get(f, 0.0) for f in toxicity.sentence_features(low[a:b]))
        none *= 1 - 1 / (1 + np.exp(-odds))
    return 1 - none


def test_toxicity_is_learned_from_document_labels(tables):
    rows, docs, labels = tables
    part = toxicity.fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, labels, chosen=part != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == bool(t) for i, _, _, t in held)
    assert right / len(held) > 0.96
    for i, text, _, _ in rows[:150]:
        assert abs(got[i].score - naive_score(model, text)) < 1e-9
    places = toxicity.locate(docs, model).collect()
    text_of = {i: t for i, t, _, _ in rows}
    assert all(r.sentence == text_of[r.doc_id][r.start:r.stop] for r in places)
    blamed = sum(any(w in r.sentence.lower() for w in TOXIC_WORDS) for r in places)
    assert blamed / len(places) > 0.97


def test_sampling_bound_and_weights(tables):
    _, _, labels = tables
    sample = toxicity.training_sample(labels, "toxic", F.lit(True), 50).collect()
    assert sum(r.label for r in sample) == 50 and len(sample) == 100
    n = labels.where("toxic is not null and doc_id is not null").count()
    assert abs(sum(r.weight for r in sample) - n) < 1e-6


def test_toxicity_odd_rows(tables, odd, empty):
    _, docs, labels = tables
    model = toxicity.fit(docs, labels)
    out = toxicity.score(odd.drop("score"), model)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 1e-6
    alone = toxicity.fit(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs, alone).agg(F.min("score")).first()[0] > 0.99


def test_quality_from_positives_and_unlabelled_texts(tables):
    rows, docs, labels = tables
    part = toxicity.fold(F.col("doc_id"), 3)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, chosen=part != 1).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum((got[i] >= 0.5) == bool(q) for i, _, q, _ in held)
    assert right / len(held) > 0.9
    assert all(0 <= s <= 1 for s in got.values())


def test_negative_labels_are_not_used(tables):
    _, docs, labels = tables
    ids = quality.trusted_ids(labels, "quality", F.lit(True), 10_000)
    assert ids.join(labels, "doc_id").where("quality <> 1").count() == 0
    assert quality.trusted_ids(labels, "quality", F.lit(True), 17).count() == 17


def test_prior_is_near_the_truth(tables, spark):
    rows, docs, labels = tables
    table = quality.features(docs).cache()
    model = quality.fit(table, quality.trusted_ids(labels, "quality", F.lit(True), 10_000))
    truth = sum(q for _, _, q, _ in rows) / len(rows)
    assert abs(model.class_prior - truth) < 0.2
    table.unpersist()


def test_quality_odd_rows(tables, odd, empty, make):
    _, docs, labels = tables
    assert quality.classify(odd, labels).count() == odd.count()
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.text_features(None).sum() == 0 and np.isfinite(quality.text_features("x" * 10)).all()


def plain_risk(model, x, part, prior, w):
    """The non-negative unbiased risk with its ridge, row by row."""
    z = np.clip((np.hstack([x, np.ones((len(x), 1))]) - model.mean) * model.scale, -8, 8) @ w
    loss = lambda v: np.logaddexp(0, -v).mean()
    ridge = np.full(len(w), model.l2)
    ridge[-1] = 0
    second = loss(-z[part == 0]) - prior * loss(-z[part == 1])
    return prior * loss(z[part == 1]) + max(0.0, second) + (ridge * w * w).sum() / 2, second


@pytest.mark.parametrize("prior, share", [(0.3, 0.5), (0.6, 0.6), (0.97, 0.2)])
def test_newton_steps_minimise_the_non_negative_risk(spark, prior, share):
    """Steps only lower the plain risk, and end where no direction lowers it; with a prior far too high the second term is clipped."""
    rng = np.random.default_rng(4)
    n, d = 600, quality.N_FEATURES
    good = rng.random(n) < share
    x = (rng.normal(size=(n, d)) + good[:, None] * (np.arange(d) < 3) * 1.5).astype(np.float32)
    positives = (rng.normal(size=(80, d)) + (np.arange(d) < 3) * 1.5).astype(np.float32)
    x, part = np.vstack([x, positives]), np.r_[np.zeros(n, int), np.ones(80, int)]
    table = spark.createDataFrame([(v.tobytes(), int(k)) for v, k in zip(x, part)], "x binary, part int").repartition(3)
    model = quality.Fit(table)
    value, clipped = plain_risk(model, x, part, prior, model.w)[0], False
    for _ in range(25):
        if not model.step(prior):
            break
        risk, second = plain_risk(model, x, part, prior, model.w)
        assert risk < value
        value, clipped = risk, clipped or second < 0
    assert clipped or prior < 0.9
    around = [plain_risk(model, x, part, prior, model.w + 0.02 * v / np.linalg.norm(v))[0] for v in rng.normal(size=(200, d + 1))]
    assert min(around) > value - 2e-3
