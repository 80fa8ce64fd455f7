import random

import numpy as np

from kestrel.llm import contamination as C


def least_edits(item, text):
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def words(rnd, n):
    return " ".join("".join(rnd.choice(["ta", "ri", "no", "the", "un", "es"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def edited(rnd, text, n):
    s = list(text)
    for _ in range(n):
        p = rnd.randrange(len(s))
        how = rnd.random()
        if how < 0.4:
            s[p] = rnd.choice("abcdefg")
        elif how < 0.7 and len(s) > 1:
            del s[p]
        else:
            s.insert(p, rnd.choice("abc "))
    return "".join(s)


def test_found_if_and_only_if_within_the_budget():
    rnd = random.Random(1)
    items = [words(rnd, rnd.randint(6, 30)) for _ in range(12)]
    index = C.Index(items)
    plain = lambda t: C.folded(t).tolist()
    texts, owners = [], []
    for _ in range(90):
        k = rnd.randrange(len(items))
        passage = edited(rnd, items[k], rnd.randint(0, max(1, int(0.12 * len(items[k])))))
        left, right = words(rnd, rnd.randint(0, 12)), words(rnd, rnd.randint(0, 12))
        texts.append(rnd.choice([passage, left + passage + right, left + passage, passage.upper() + right]))
        owners.append(k)
    found = C.search(index, texts)
    hits = 0
    for text, k, got in zip(texts, owners, found):
        edits = least_edits(plain(items[k]), plain(text))
        mine = [m for m in got if m[0] == k]
        assert bool(mine) == (edits <= index.edits[k])
        if mine:
            hits += 1
            _, start, stop, reported = min(mine, key=lambda m: m[3])
            assert reported == edits
            span = plain(text)[start:stop]
            assert least_edits(plain(items[k]), span) <= edits <= max(len(span), len(items[k]))
    assert 20 < hits < 90


def test_gram_hashes_are_polynomials():
    codes = np.arange(50, dtype=np.uint32) * 7 % 11
    for q in (1, 2, 3, 5, 10, 12, 16):
        want = []
        for i in range(len(codes) - q + 1):
            h = 0
            for c in codes[i:i + q]:
                h = (h * 0x9E3779B97F4A7C15 + int(c) + 1) % (1 << 64)
            want.append(h)
        assert C.gram_hashes(codes, q).tolist() == want


def test_texts_searched_together_do_not_leak_into_each_other():
    rnd = random.Random(4)
    item = words(rnd, 40)
    half = len(item) // 2
    assert C.search(C.Index([item]), [item[:half], item[half:], None, "", item]) == [[], [], [], [], [(0, 0, len(item), 0)]]


def test_tables(spark, make, odd, empty):
    rnd = random.Random(2)
    items = [words(rnd, 20), None, "short", words(rnd, 25)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make([(1, words(rnd, 50)), (2, "x " + items[0] + " y"), (2, "x " + items[0] + " y"), (None, items[3]), (4, "short")])
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.stop, r.edits) for r in C.matches(docs, bench).collect())
    n = len(items[0])
    assert got == [(0, 3, 0, len(items[3]), 0), (2, 0, 2, 2 + n, 0), (2, 0, 2, 2 + n, 0)]
    left = C.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 4]
    assert C.decontaminate(odd, bench).count() == odd.count() and C.matches(odd, bench).count() == 0
    assert C.decontaminate(empty, bench).count() == 0
    assert C.decontaminate(docs, bench.limit(0)).count() == 5 and C.matches(docs, bench.limit(0)).count() == 0


def test_many_items_are_searched_in_blocks(spark, make, monkeypatch):
    rnd = random.Random(3)
    items = [words(rnd, 20) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(C, "BLOCK_CHARS", 300)
    docs = make([(i, t) for i, t in enumerate(items)])
    assert {(r.doc_id, r.item_id) for r in C.matches(docs, bench).collect()} >= {(i, i) for i in range(12)}
    assert C.decontaminate(docs, bench).count() == 0


def test_items_that_lost_a_line_are_found(spark, make):
    from kestrel.llm import line_dedup
    rnd = random.Random(6)
    lines = [words(rnd, 9), words(rnd, 20), words(rnd, 22)]
    item = "\n".join(lines)
    bench = spark.createDataFrame([(5, item), (6, words(rnd, 30))], "item_id long, text string")
    plain = [words(rnd, 60) for _ in range(6)]
    # The first line stands in a clean document before, so line dedup cuts it out of the next ones.
    docs = make([(0, plain[0] + "\n" + lines[0]), (1, plain[1] + "\n" + item + " " + plain[2]), (2, plain[3]),
                 (3, plain[4] + " " + item[len(lines[0]) // 2:] + " " + plain[5])])
    left = line_dedup.drop_repeated_lines(docs, 30)
    assert lines[0] not in {r.doc_id: r.text for r in left.collect()}[1]
    assert {r.doc_id for r in C.decontaminate(left, bench).collect()} == {0, 2}
    found = C.matches(left, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 5), (3, 5)}
    texts = {r.doc_id: r.text for r in left.collect()}
    for r in found:
        part = texts[r.doc_id][r.start:r.stop]
        assert len(part) >= C.SEGMENT and least_edits(part, item) <= r.edits <= 0.1 * len(part)


def test_any_long_piece_of_an_item_holds_a_segment():
    rnd = random.Random(8)
    item = words(rnd, 70)
    passages, n = C.Passages([item]), C.SEGMENT + C.STEP - 1
    pieces = [item[at:at + n] for at in range(0, len(item) - n, 7)]
    assert all(passages.found([words(rnd, 10) + p + words(rnd, 10) for p in pieces]))
    assert passages.found([item, item[:40], None]) == [[(0, 0, len(item), 0)], [], []]
    assert C.distance(C.folded("kitten"), C.folded("sitting")) == 3
