import random

import numpy as np
import pytest
import sentencepiece

from kestrel.llm import pieces, sentencepiece_codec, token_counts

ALPHABET = "abcdefghijklmnop  \n.,'\"-_éñüçßабв日本🎉\t0123456789AEIOUST</>"


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def texts(n, size, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_every_prefix_count_equals_the_library(model, library):
    counter = token_counts.PrefixCounter(pieces.load(model))
    spaces = [" " * k + "the" + " " * j for k in (1, 2, 7, 11, 15, 16, 23, 40) for j in (0, 1, 7, 31)]
    for text in texts(150, 30, 1) + spaces + ["<s>hi</s> <unk>", "<0x0A>", "\x00a", "▁x", "a▁▁b", "don't I'm __init__"]:
        counts = counter.prefix_counts(text)
        assert counts.tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_counts_survive_a_full_memo(model, library):
    counter = token_counts.PrefixCounter(pieces.load(model), memo=3)
    for text in texts(30, 60, 2):
        assert counter.prefix_counts(text)[-1] == len(library.encode(text))


def test_longest_prefix_within_a_budget(model, library):
    counter = token_counts.PrefixCounter(pieces.load(model))
    for text in texts(40, 40, 3):
        cut = token_counts.fit_chars(counter.prefix_counts(text), 5)
        assert cut == max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 5)


def test_count_tokens_table(make, odd, empty, library):
    rows = texts(40, 80, 4)
    got = {r.doc_id: r for r in token_counts.count_tokens(make(list(enumerate(rows))), limit=9).collect()}
    for i, t in enumerate(rows):
        n = len(library.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 9)
    strange = token_counts.count_tokens(odd).collect()
    assert len(strange) == odd.count()
    for r in odd.select("doc_id", "text").where("doc_id = 4").collect():
        assert [s.n_tokens for s in strange if s.doc_id == 4] == [len(library.encode(r.text))]
    assert {s.n_tokens for s in strange if s.doc_id in (1, 2)} == {0}
    assert token_counts.count_tokens(empty).count() == 0


def test_prefix_table_answers_truncation(make, library):
    table = token_counts.prefix_table(make([(1, "some words here"), (2, None)]))
    got = {r.doc_id: r.n_tokens for r in token_counts.tokens_of_prefix(table, 7).collect()}
    assert got == {1: len(library.encode("some wo")), 2: 0}


def best_by_full_table(v, shown, unknown):
    best, back = [0.0] + [float("-inf")] * len(shown), [0] * (len(shown) + 1)
    for end in range(1, len(shown) + 1):
        for begin in range(max(0, end - v.max_chars), end):
            s = v.scores.get(shown[begin:end], unknown if end - begin == 1 else None)
            if s is not None and best[begin] + s > best[end]:
                best[end], back[end] = best[begin] + s, begin
    ids, end = [], len(shown)
    while end:
        p = shown[back[end]:end]
        ids[:0] = [v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()]
        end = back[end]
    return ids


def test_streaming_search_equals_the_full_table(model):
    codec = sentencepiece_codec.Codec(pieces.load(model))
    rnd = random.Random(5)
    long = ["".join(rnd.choice("abcdeth") for _ in range(3000)), "x" * 2000 + "ab" * 500, "日本" * 400]
    for text in texts(120, 40, 6) + long:
        if pieces.SPACE not in text and text:
            shown = pieces.SPACE + text.replace(" ", pieces.SPACE)
            assert np.frombuffer(codec.encode(text), np.int32).tolist() == best_by_full_table(codec.v, shown, codec.unknown)


def test_search_equals_the_library_on_short_texts(model):
    # The same pieces and scores declared as a unigram model (2 -> 1 in the trainer settings).
    at = model.index(b"\x12\x06tok_v0\x18\x02") + 9
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model[:at] + b"\x01" + model[at + 1:])
    codec = sentencepiece_codec.Codec(pieces.load(model))
    for text in texts(200, 25, 8):
        if not set(text) & set("\n\t"):
            assert np.frombuffer(codec.encode(text), np.int32).tolist() == unigram.encode(text), text


def test_round_trip(make, odd, empty):
    rows = texts(60, 200, 9) + ["", None, "▁", " ▁ a▁", "  two  spaces  "]
    got = sentencepiece_codec.encode_checked(make(list(enumerate(rows)))).collect()
    assert all(r.restored for r in got) and {r.doc_id: r.text for r in got} == {i: t or "" for i, t in enumerate(rows)}
    strange = sentencepiece_codec.encode_checked(odd)
    assert all(r.restored and r["_row"] == "clash" and r.n_ids == len(r.ids) for r in strange.collect())
    assert sentencepiece_codec.encode_checked(empty).count() == 0
