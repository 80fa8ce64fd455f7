import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.llm import spelling
from kestrel.llm.fm_index import BidirectionalIndex, suffix_order


def one_edit(word, letters):
    """All texts at exactly one edit."""
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def brute_counts(rows, least_length=6, least_count=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def brute_variants(counts, ratio=5):
    letters = set("".join(counts))
    out = {}
    for w, n in counts.items():
        near = [x for x in one_edit(w, letters) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=40, unique=True))
def test_both_searches_find_every_neighbour_once(words):
    index = BidirectionalIndex(words)
    for side in (0, 1):
        got = [(words[q], words[w]) for q, w in zip(*map(list, index.near(words, side)))]
        assert len(got) == len(set(got))
        want = set()
        for a in words:
            for b in one_edit(a, "abé") & set(words):
                h = len(a) // 2
                if (b.startswith(a[:h]) if side == 0 else b.endswith(a[h:])):
                    # the exact half leaves the one edit to the other half
                    rest = (a[h:], b[h:]) if side == 0 else (a[:h], b[:len(b) - len(a) + h] if len(b) >= len(a) - h else None)
                    if rest[1] is not None and (rest[0] == rest[1] or rest[1] in one_edit(rest[0], "abé")):
                        want.add((a, b))
        assert set(got) == want


def test_queries_need_not_be_indexed():
    index = BidirectionalIndex(["kestrel", "falcon"])
    asked = ["kestral", "falkon", "kestrel", "kestrzl", "\U0001f389"]
    assert {tuple(map(int, p)) for p in zip(*index.near(asked, 0))} == {(0, 0), (1, 1), (3, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=60))
def test_suffix_order(values):
    import numpy as np
    text = np.array([*values, 0])
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())


def corpus(seed=3, docs=60):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdéß") for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    rows = []
    for k in range(docs):
        words = []
        for _ in range(120):
            w = stems[min(int(rnd.expovariate(0.15)), 39)]
            if rnd.random() < 0.15:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("abcd") + w[at:], w[:at] + "d" + w[at + 1:]])
            words.append(rnd.choice([w, w.upper() if rnd.random() < 0.1 else w, w.capitalize()]))
        rows.append((k, rnd.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows + [(None, rows[0][1]), (5, None), (6, ""), (7, rows[7][1]), (7, rows[7][1]), (8, "×÷" * 9 + " ZZZÉZZZ" * 6)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_vocabulary_equals_brute_force(make, rows):
    got = {r.word: r.n for r in spelling.vocabulary(make(rows)).collect()}
    assert got == brute_counts(rows) and got


@pytest.mark.parametrize("block_words", [20_000, 7])
def test_variants_equal_brute_force(spark, make, rows, block_words):
    counts = brute_counts(rows, 4, 1)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in spelling.variants(words, block_words=block_words).collect()}
    want = brute_variants(counts)
    assert got == want
    assert any(w[0] for w in want.values()) and any(w[0] and w[1] != w[0] for w in want.values())


def test_a_common_half_is_split(spark):
    rnd = random.Random(4)
    words = sorted({"prefix" + "".join(rnd.choice("xyz") for _ in range(6)) for _ in range(250)})
    counts = {w: rnd.choice([1, 6, 40, 300]) for w in words}
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n]
           for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), block_words=20).collect()}
    assert got == brute_variants(counts)


def test_odd_and_empty_tables(odd, empty):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    got = {r.word: r.n for r in spelling.variants(spelling.vocabulary(odd, 3, 1)).collect()}
    assert got == brute_counts([(r.doc_id, r.text) for r in odd.collect()], 3, 1)
