"""Toxicity by multiple-instance learning: sentences judged, only documents labelled.

A document is a bag of sentences.  A sentence with features x is toxic with
probability ``sigmoid(b + w . x)``; a document is toxic if any sentence is
(noisy-or): ``1 - prod(1 - p)``.  ``w >= 0`` and ``b`` maximise the likelihood
of the document labels, so the blame for a labelled document is shared out
among its sentences and the sentences can be judged afterwards
(:func:`locate`).

Features of a sentence are the beginnings of its words (3 to 6 characters) and
its whole words, lower-cased.  They are counted over the training documents
with Spark; the ``max_features`` that tell toxic documents best (G statistic,
toward toxic) become the model's features.  Training uses at most
``max_docs`` documents of either class, those with the smallest hash of the id,
weighted to the class sizes; the bound is a parameter and keeps what is fitted
on the driver to a few dozen megabytes.  Scoring reads every whole text.

Edge cases: null and empty texts are one sentence without features; without
training documents of both classes every probability is the share of toxic
ones (0 without any); null labels are left out; an id labelled more than once
counts once for each label row; repeated rows give repeated results; an empty
table gives an empty result; other columns are kept by :func:`score`, except
those named like its results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import small_batches

PREFIXES = (3, 4, 5, 6)
_ENDS = re.compile(r"[.!?\n]")
_NOT_LETTER = re.compile(r"[\W\d_]")


def lowered(text: str) -> str:
    """Lower case, one character for each, with spaces for all but letters, and a space at either end."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return f" {_NOT_LETTER.sub(' ', low)} "


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Places of the sentences: what stands between full stops, exclamation or question marks and line ends.

    Empty stretches are no sentences; a text of nothing else is one sentence.
    """
    bounds, begin = [], 0
    for m in _ENDS.finditer(text):
        if m.start() > begin:
            bounds.append((begin, m.end()))
        begin = m.end()
    if begin < len(text):
        bounds.append((begin, len(text)))
    return bounds or [(0, len(text))]


def sentence_features(sentence: str) -> set[str]:
    """`` abc`` for a word beginning, `` word `` for a whole word."""
    out = set()
    for w in sentence.split():
        out.add(f" {w} ")
        for n in PREFIXES:
            if len(w) >= n:
                out.add(" " + w[:n])
    return out


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for i, f in enumerate(self.features):
            a.add_word(f, (i, len(f)))
        if self.features:
            a.make_automaton()
        return a if self.features else None

    def sentences(self, text: str | None, found) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Bounds and log-odds of each sentence; ``found`` is :meth:`automaton`."""
        text = text or ""
        bounds = sentence_bounds(text)
        odds = np.full(len(bounds), self.bias)
        hits = [(end + 1 - size, i) for end, (i, size) in found.iter(lowered(text))] if found else []
        if hits:
            # A hit begins at the space before its word, one place right of where it stands in the text.
            at, which = np.array(hits).T
            where = np.searchsorted([b for b, _ in bounds], at, "right") - 1
            pairs = np.unique(where.astype(np.int64) * len(self.features) + which)
            np.add.at(odds, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return bounds, odds


def noisy_or(odds: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, odds).sum()))


def fold(doc_id: Column, n: int) -> Column:
    """Remainder of the CRC of the id's text."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % n


def training_sample(labels: DataFrame, label: str, chosen: Column, max_docs: int, doc_id: str = "doc_id") -> DataFrame:
    """``id, label, weight``: at most ``max_docs`` ids of either class, with weights that restore the class sizes."""
    rows = labels.where(chosen & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [rows.where(F.col("label") == c).orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(max_docs)
             .withColumn("weight", F.lit(max(1.0, n / max_docs))) for c, n in sorted(total.items()) if c in (0, 1)]
    if not parts:
        return rows.withColumn("weight", F.lit(1.0))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _count_features(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update(sentence_features(lowered(text or "")))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()),
                                          pa.array([counts[0][k] for k in keys], pa.int64())], names=["feature", "n1", "n0"])


def choose_features(sample: DataFrame, n1: int, n0: int, max_features: int, least_docs: int = 3) -> list[str]:
    """The features that speak most for toxic documents (``sample``: text, label)."""
    counts = (sample.mapInArrow(_count_features, "feature string, n1 long, n0 long")
              .groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    share = (a + b) / (n1 + n0 + 1)
    g = a * F.log(a / (share * (n1 + 0.5))) + b * F.log(b / (share * (n0 + 0.5)))
    best = (counts.where((F.col("n1") >= least_docs) & (F.col("n1") * n0 > F.col("n0") * n1))
            .orderBy(g.desc(), "feature").limit(max_features))
    return [r["feature"] for r in best.select("feature").collect()]


def _bags(features: list[str]):
    """Sentences of the sampled documents as lists of feature numbers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: i for i, f in enumerate(features)}
        for batch in batches:
            bags = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                low = lowered(text)[1:-1]
                bags.append([sorted(number[f] for f in sentence_features(low[a:b]) if f in number)
                             for a, b in sentence_bounds(text)])
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.list_(pa.int32()))), batch.column(1), batch.column(2)],
                                             names=["bag", "label", "weight"])
    return run


def fit_bags(bags: list[list[list[int]]], labels: np.ndarray, weights: np.ndarray, n_features: int,
             steps: int = 300, l1: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by projected Adam on the noisy-or likelihood (deterministic).

    ``l1`` (default: half a document's share) keeps features out that a few documents alone speak for.
    """
    l1 = 0.5 / len(bags) if l1 is None else l1
    sizes = np.array([len(b) for b in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    per = np.array([len(s) for b in bags for s in b])
    row = np.repeat(np.arange(len(doc)), per)
    col = np.fromiter((f for b in bags for s in b for f in s), np.int64, per.sum())
    positive, weights = labels.astype(bool), weights / weights.sum()
    w, bias = np.zeros(n_features), -np.log(max(1.0, sizes.mean())) - 3.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        odds = bias + np.bincount(row, w[col], len(doc))
        p = 1 / (1 + np.exp(-odds))
        none = np.bincount(doc, np.logaddexp(0, odds), len(bags))          # -log of "no sentence is toxic"
        pull = np.where(positive, -1 / np.expm1(np.maximum(none, 1e-12)), 1.0) * weights
        g = pull[doc] * p
        grad = np.append(np.bincount(col, g[row], n_features) + l1, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, bias = np.maximum(0, w - step[:-1]), bias - step[-1]
    return w, float(bias)


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", chosen: Column | None = None, max_docs: int = 4000,
        max_features: int = 1024, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn a model from the documents whose label row satisfies ``chosen`` (default: all)."""
    small_batches(df.sparkSession)
    chosen = F.lit(True) if chosen is None else chosen
    ids = training_sample(labels, label, chosen, max_docs, doc_id)                  # at most 2 * max_docs rows
    sample = (df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
              .join(F.broadcast(ids), "id").select("text", "label", "weight"))
    have = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    if not n1 or not n0:
        return Model([], np.zeros(0), 50.0 if n1 else -50.0)
    features = choose_features(sample, n1, n0, max_features)
    rows = sample.mapInArrow(_bags(features), "bag array<array<int>>, label int, weight double").toArrow()
    if not rows.num_rows:
        return Model([], np.zeros(0), -50.0)
    order = np.lexsort((rows["bag"].combine_chunks().value_lengths().to_numpy(), rows["label"].to_numpy()))
    rows = rows.take(order)
    w, bias = fit_bags(rows["bag"].to_pylist(), rows["label"].to_numpy(), rows["weight"].to_numpy(), len(features))
    kept = np.flatnonzero(w > 0.05)
    return Model([features[i] for i in kept], w[kept], bias)


RESULTS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.IntegerType()),
                        T.StructField("worst_start", T.IntegerType()), T.StructField("worst_stop", T.IntegerType()),
                        T.StructField("worst_score", T.DoubleType())])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with the probability of each text and its most toxic sentence (code points, end exclusive)."""
    import pyarrow as pa
    small_batches(df.sparkSession)
    keep = df.drop(*[f.name for f in RESULTS if f.name != text])
    if text not in keep.columns:
        raise ValueError(f"no column {text}")
    place = keep.columns.index(text)
    schema = T.StructType([*keep.schema.fields, *RESULTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            rows = []
            for t in batch.column(place).to_pylist():
                bounds, odds = model.sentences(t, found)
                k = int(np.argmax(odds))
                rows.append((noisy_or(odds), len(bounds), *bounds[k], noisy_or(odds[k:k + 1])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=schema.names)

    return keep.mapInArrow(run, schema)


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose probability is below ``threshold``, with all their columns."""
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(text).alias("_text"))
    return score(rows, model, "_text").where(F.col("score") < threshold).select("_row.*")


def locate(df: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, stop, score, sentence``: every sentence whose own probability reaches ``threshold``."""
    import pyarrow as pa
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = df.schema[doc_id].dataType.simpleString()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            who, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                bounds, odds = model.sentences(t, found)
                for (a, b), o in zip(bounds, odds.tolist()):
                    p = 1 / (1 + float(np.exp(-o)))
                    if p >= threshold:
                        who.append(k)
                        rows.append((a, b, p, (t or "")[a:b]))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who, pa.int32())), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string())],
                names=["doc_id", "start", "stop", "score", "sentence"])

    return src.mapInArrow(run, f"doc_id {kind}, start int, stop int, score double, sentence string")
