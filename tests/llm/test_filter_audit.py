import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from kestrel.llm import filter_audit


def failed(rows):
    """``(part, set of failed letters, id)`` of each row."""
    first, out = {}, []
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            f.add("C")
        if re.search(r"[#$%&*|]", text):
            f.add("D")
        if i is not None and i > first[text]:
            f.add("E")
        out.append((lang or "", f, i))
    return out


def brute(rows, good, toxic):
    """Apply all filters of all orders one after the other."""
    docs, out = failed(rows), {}
    for part in {p for p, _, _ in docs}:
        mine = [(f, i) for p, f, i in docs if p == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if letter in f]
                left = [(f, i) for f, i in left if letter not in f]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for f, _ in mine) - len(gone), sum(f == {letter} for f, _ in mine),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def cases():
    plain = " ".join(f"w{k}" for k in range(120))
    texts = [plain, plain.upper(), plain + " #", " ".join(["same word"] * 80), "SHORT", None, "", plain, plain + " #", "\xa0 a\x0bb\x0cc | A",
             " ".join(f"word{k % 99}" for k in range(100)), " ".join(["W"] * 100), "é" * 9 + "A", "é" * 8 + "A", "x" * 50_000]
    rows = [(k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts)]
    return rows + [(k + 40, t, "en") for k, t in enumerate(texts)] + [(40, plain, "en"), (None, plain, "en"), (None, plain, "en"), (7, "other", "de")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, mask string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(50)] + [(1, 1, 1), (None, 1, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_every_step_equals_applying_the_filters(tables):
    rows, docs, labels = tables
    good = {k for k in range(50) if k % 3 == 0} | {1}
    toxic = {k for k in range(50) if k % 4 == 0} | {1}
    want = brute(rows, good, toxic)
    got = filter_audit.audit(filter_audit.failure_counts(docs, labels)).collect()
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_empty_and_odd_tables(odd, empty, tables):
    labels = tables[2]
    assert filter_audit.audit(filter_audit.failure_counts(empty, labels)).count() == 0
    got = filter_audit.audit(filter_audit.failure_counts(odd, labels.limit(0)))
    assert got.count() == 600 and got.agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("m", [1, 2, 3, 5, 6])
def test_least_squares_give_the_shapley_weights(m):
    matrix = filter_audit.shapley_matrix(m)
    for i, row in enumerate(matrix):
        for s, x in enumerate(row):
            size = bin(s).count("1")
            if s >> i & 1:
                want = Fraction(factorial(size - 1) * factorial(m - size), factorial(m))
            else:
                want = -Fraction(factorial(size) * factorial(m - size - 1), factorial(m)) if s else Fraction(0)
            assert x == want
