"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The encoding of a text is the segmentation into pieces with the largest sum of
scores stored in the model.  The search moves over the text once.  It keeps
the best scores of the last ``max_chars`` boundaries only (a piece cannot reach
further back) and the backpointers since the last committed boundary; whenever
the paths of all these boundaries run through one common boundary, everything
before it is final, its ids are committed and the state before it is dropped.
Texts also fall into units that no piece crosses
(:mod:`kestrel.llm.pieces`); a unit border is such a common boundary from the
start, so ids of short units are kept and reused within a task.

Of equal sums the segmentation whose last piece is longer wins, from the end
of the text backwards, as in the sentencepiece library's unigram search.
Characters outside the vocabulary become one byte piece for each UTF-8 byte.
A literal U+2581, which stands for the space inside pieces, is also written as
bytes, so decoding restores every text exactly.

Edge cases: null and empty texts have no ids and decode to the empty text;
repeated rows give repeated results; an empty table gives an empty result; all
other columns pass through, except one already named like the result, which
is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm import pieces as P
from kestrel.llm.common import small_batches

ROWS_AT_ONCE = 256


class Codec:
    """Viterbi encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: P.Pieces, memo: int = 800_000):
        self.v = vocabulary
        self.unknown = min(vocabulary.scores.values()) - 10.0
        self.ends = ahocorasick.Automaton()          # yields the pieces that end at each character, longest first
        for piece, i in vocabulary.ids.items():
            self.ends.add_word(piece, (len(piece), vocabulary.scores[piece], i))
        self.ends.make_automaton()
        self.units = P.Memo(lambda unit: self.encode_unit(unit).tobytes(), memo)

    def _bytes_of(self, char: str) -> list[int]:
        return [self.v.byte_ids[b] for b in char.encode()]

    def encode_unit(self, unit: str) -> array:
        """Ids of one unit of any length, with state bounded as described above."""
        known, window = self.v.ids, self.v.max_chars
        ids = array("i")
        base = 0                                     # characters before the last committed boundary
        best, back, token = [0.0], [0], [-1]         # of the boundaries since then
        found = self.ends.iter(unit)
        at, piece = next(found, (len(unit), None))
        for end in range(1, len(unit) + 1):
            top, source, chosen = float("-inf"), 0, -1
            while at == end - 1:
                size, score, i = piece
                begin = end - size - base
                if best[begin] + score > top:
                    top, source, chosen = best[begin] + score, begin, i
                at, piece = next(found, (len(unit), None))
            if unit[end - 1] not in known and best[-1] + self.unknown > top:
                top, source, chosen = best[-1] + self.unknown, len(best) - 1, -1
            best.append(top)
            back.append(source)
            token.append(chosen)
            if len(best) > 8 * window:
                common = self._common(back, window)
                if common:
                    self._commit(ids, unit, base, back, token, common)
                    base += common
                    best = [s - best[common] for s in best[common:]]
                    back = [max(0, b - common) for b in back[common:]]
                    token = token[common:]
        self._commit(ids, unit, base, back, token, len(best) - 1)
        return ids

    @staticmethod
    def _common(back: list[int], window: int) -> int:
        """The last boundary on the paths of all of the last ``window`` boundaries."""
        live = set(range(len(back) - window, len(back)))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last])
        return live.pop()

    def _commit(self, ids: array, unit: str, base: int, back: list[int], token: list[int], end: int) -> None:
        path = []
        while end:
            path.append((token[end], end))
            end = back[end]
        for i, stop in reversed(path):
            if i < 0:
                ids.extend(self._bytes_of(unit[base + stop - 1]))
            else:
                ids.append(i)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as consecutive 32-bit integers."""
        if not text:
            return b""
        blocks = []
        for k, part in enumerate(text.split(P.SPACE)):
            shown = part.replace(" ", P.SPACE)
            if k:
                blocks.append(array("i", self._bytes_of(P.SPACE)).tobytes())
            elif self.v.dummy_prefix:
                shown = P.SPACE + shown
            blocks.extend(map(self.units.__getitem__, self.v.unit.findall(shown)))
        return b"".join(blocks)

    def decode(self, ids) -> str:
        """The text of a sequence of ids; byte sequences that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.v.texts.__getitem__, ids))
        if self.v.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    small_batches(df.sparkSession)
    kept = df.drop(name) if name in df.columns else df
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, model_path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a column ``out array<int>`` of the ids of each text."""
    import pyarrow as pa
    model = P.read_model(model_path)
    kept, schema = _with(df, out, T.ArrayType(T.IntegerType()))
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(P.load(model))
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                blocks = [codec.encode(t) for t in batch.column(place).to_pylist()]
                stops = [0]
                for b in blocks:
                    stops.append(stops[-1] + len(b) // 4)
                flat = pa.Array.from_buffers(pa.int32(), stops[-1], [None, pa.py_buffer(b"".join(blocks))])
                ids = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with a column ``out string`` of the text of each list of ids (null: empty)."""
    import pyarrow as pa
    model = P.read_model(model_path)
    kept, schema = _with(df, out, T.StringType())
    place = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = P.load(model)
        codec = Codec.__new__(Codec)                 # decoding needs the piece texts only
        codec.v = vocabulary
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                lists = batch.column(place)
                flat, stops = lists.flatten().to_numpy(zero_copy_only=False).tolist(), [0]
                for n in lists.value_lengths().fill_null(0).to_pylist():
                    stops.append(stops[-1] + n)
                texts = pa.array([codec.decode(flat[a:b]) for a, b in zip(stops, stops[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return kept.mapInArrow(run, schema)


def encode_checked(df: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, their number ``n_ids``, and whether they decode to the very text."""
    others = [c for c in df.columns if c not in ("ids", "n_ids", "restored", text)]
    whole = F.coalesce(F.col(text), F.lit(""))
    src = df.select(F.struct(F.lit(0), *[F.col(c) for c in others]).alias("_row"), whole.alias("_text"), F.xxhash64(whole).alias("_hash"))
    coded = decode(encode(src, model_path, "_text", "ids").drop("_text"), model_path, "ids", "_text")
    return coded.select(*[F.col(f"_row.{c}") for c in others], F.col("_text").alias(text), "ids", F.size("ids").alias("n_ids"),
                        (F.xxhash64("_text") == F.col("_hash")).alias("restored"))
