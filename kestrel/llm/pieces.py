"""SentencePiece vocabularies as plain tables, and how texts fall into independent units.

A unit is a run of characters that no piece of the vocabulary can cross the
border of, so every segmentation of a text is the concatenation of
segmentations of its units.  The borders follow from the pieces alone:

* before a run of spaces (pieces hold spaces only at their beginning),
* around characters that occur in no piece of several characters,
* around runs of punctuation, for those marks that pieces never join to
  letters.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

SPACE = "▁"


@dataclass
class Pieces:
    """Pieces of a model: ``ids`` and ``scores`` by text, ``byte_ids`` by byte value."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[bytes]                # of every id, as UTF-8, spaces as they are written
    max_chars: int
    dummy_prefix: bool = True
    unit: re.Pattern = field(default=None)

    def __post_init__(self):
        self.unit = unit_pattern(self.ids)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    """The model file; half a megabyte for 32,000 pieces, sent to the tasks as it is."""
    with open(path or default_path(), "rb") as f:
        return f.read()


def load(model: bytes) -> Pieces:
    """Read the pieces of a model with identity normalisation and byte fallback."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, scores, texts, byte_ids = {}, {}, [], [-1] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            ids[p], scores[p] = i, sp.get_score(i)
            texts.append(p.replace(SPACE, " ").encode())
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces; texts outside its alphabet have no exact encoding")
    return Pieces(ids, scores, byte_ids, texts, max(map(len, ids)))


def unit_pattern(pieces) -> re.Pattern:
    """A pattern whose consecutive matches are the units of a text."""
    bodies = [p.lstrip(SPACE) for p in pieces]
    if any(SPACE in body for body in bodies):
        raise ValueError("a piece has a space after other characters")
    joined = {c for p, body in zip(pieces, bodies) if len(p) > 1 for c in body}
    free = {c for c in joined if unicodedata.category(c)[0] not in "LM"}
    while mixed := {c for body in bodies if not free.issuperset(body) for c in body if c in free}:
        free -= mixed
    alone = "".join(sorted({c for c in map(chr, range(128)) if c not in joined} - {" "}))
    s, f, a = SPACE, re.escape("".join(sorted(free))), re.escape(alone)
    return re.compile(f"{s}*[^{s}{f}{a}]+" + (f"|{s}*[{f}]+" if f else "") + (f"|[{a}]" if a else "") + f"|{s}+")


class Memo(dict):
    """Results by unit, filled on demand; emptied when it holds ``cap`` of them."""

    def __init__(self, compute, cap: int = 800_000):
        super().__init__()
        self.compute, self.cap = compute, cap

    def __missing__(self, unit):
        got = self.compute(unit)
        if len(unit) <= 64:           # long units are rare and would hold much memory
            if len(self) >= self.cap:
                self.clear()
            self[unit] = got
        return got
