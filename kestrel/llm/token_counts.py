"""Exact token counts of every prefix of a text, for a SentencePiece BPE vocabulary.

BPE has a prefix property: the last token of a text's encoding ends an
encoding of the text before it, and a sequence of tokens is an encoding if and
only if each neighbouring pair of tokens is (encoding the pair's text gives
that pair).  So for the prefix of i characters exactly one piece t ends it
such that t fits behind the last token of the prefix of i - len(t) characters,
and the count is that prefix's count plus one.  One pass over a text gives the
count at every prefix; how many tokens a cut text has, or where to cut for a
budget, is then a lookup and nothing is encoded again.

Counts equal those of the sentencepiece library (no begin or end tokens; its
default treatment of special strings, which it reads as ordinary text).
Characters outside the vocabulary count one token per UTF-8 byte.  Texts fall
into units that no piece crosses (:mod:`kestrel.llm.pieces`); a unit's counts
are kept and reused within a task.

Edge cases: null and empty texts have no tokens; prefixes are counted in code
points and the longest prefix within a budget is meant even where a shorter
one already exceeds it (a longer text can have fewer tokens); repeated rows
give repeated results; an empty table gives an empty result; only the key and
text columns are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import pieces as P
from kestrel.llm.common import small_batches


class PrefixCounter:
    """Token counts at every prefix, by dynamic programming over one vocabulary."""

    def __init__(self, vocabulary: P.Pieces, memo: int = 800_000):
        self.v = vocabulary
        self.fits: dict[tuple[str, str], bool] = {}      # whether two pieces stay apart
        self.ends = ahocorasick.Automaton()              # yields the pieces that end at each character
        for piece in vocabulary.ids:
            if len(self.merge(piece)) == 1:              # others occur in no encoding
                self.ends.add_word(piece, piece)
        self.ends.make_automaton()
        self.units = P.Memo(self._unit_bytes, memo)

    def merge(self, text: str) -> list[str]:
        """BPE: merge the neighbours whose joined piece has the best score, leftmost first."""
        parts, scores = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: str, right: str) -> bool:
        got = self.merge(left + right) == [left, right]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left, right] = got
        return got

    def unit_counts(self, unit: str) -> array:
        """Tokens of the first 1, 2, ... characters of a unit."""
        fits, fit = self.fits.get, self._fit
        counts, last = array("i", [0]), [""]
        for at, piece in self.ends.iter(unit):
            while len(last) <= at:                       # no piece ends here: one byte piece for each byte
                counts.append(counts[-1] + len(unit[len(last) - 1].encode()))
                last.append(unit[len(last) - 1])
            if len(last) > at + 1:
                continue                                 # settled by a longer piece
            begin = at + 1 - len(piece)
            if begin:
                left = last[begin]
                ok = fits((left, piece))
                if not (fit(left, piece) if ok is None else ok):
                    continue
            counts.append(counts[begin] + 1)
            last.append(piece)
        while len(last) <= len(unit):
            counts.append(counts[-1] + len(unit[len(last) - 1].encode()))
            last.append(unit[len(last) - 1])
        return counts[1:]

    def _unit_bytes(self, unit: str) -> bytes:
        return self.unit_counts(unit).tobytes()

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of the first 0, 1, ..., n code points of a text."""
        if not text:
            return np.zeros(1, np.int32)
        shown = text.replace(" ", P.SPACE)
        skip = 0
        if self.v.dummy_prefix:
            shown, skip = P.SPACE + shown, 1
        blocks = list(map(self.units.__getitem__, self.v.unit.findall(shown)))
        counts = np.frombuffer(b"".join(blocks), np.int32)
        sizes = np.fromiter(map(len, blocks), np.int64, len(blocks)) >> 2
        totals = counts[np.cumsum(sizes) - 1]
        counts = counts + np.repeat(np.cumsum(totals) - totals, sizes)
        return np.concatenate(([0], counts[skip:])).astype(np.int32)


def fit_chars(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _tasks(model: bytes, answer):
    """A mapInArrow body over (id, text) batches; ``answer`` turns counts into columns."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(P.load(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *answer(counter, texts)],
                                             names=[str(i) for i in range(1 + answer.width)])
    return run


def _id_and_text(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _id_type(df: DataFrame, doc_id: str) -> str:
    return df.schema[doc_id].dataType.simpleString()


def prefix_table(df: DataFrame, model_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, prefix_tokens array<int>``: entry i has the tokens of the first i code points."""
    import pyarrow as pa
    src = _id_and_text(df, doc_id, text)

    def answer(counter, texts):
        return [pa.array([counter.prefix_counts(t) for t in texts], pa.list_(pa.int32()))]
    answer.width = 1
    return src.mapInArrow(_tasks(P.read_model(model_path), answer), f"doc_id {_id_type(df, doc_id)}, prefix_tokens array<int>")


def tokens_of_prefix(table: DataFrame, n_chars) -> DataFrame:
    """Tokens of each text cut to ``n_chars`` code points (or its whole length), from the prefix table."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return table.withColumn("n_tokens", F.element_at("prefix_tokens", F.least(n, F.size("prefix_tokens") - 1).cast("int") + 1))


def count_tokens(df: DataFrame, limit: int = 4096, model_path: str | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per row: bytes, tokens, whether they exceed ``limit``, and where to cut for it.

    All four come from the prefix counts of the text, which stay in the task;
    :func:`prefix_table` returns them.
    """
    import pyarrow as pa
    src = _id_and_text(df, doc_id, text)

    def answer(counter, texts):
        n_bytes, n_tokens, cut = [], [], []
        for t in texts:
            counts = counter.prefix_counts(t)
            n_bytes.append(len(t.encode()))
            n_tokens.append(int(counts[-1]))
            cut.append(fit_chars(counts, limit))
        over = [n > limit for n in n_tokens]
        return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()),
                pa.array(cut, pa.int64())]
    answer.width = 4
    return src.mapInArrow(_tasks(P.read_model(model_path), answer),
                          f"doc_id {_id_type(df, doc_id)}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
