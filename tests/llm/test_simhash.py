import random
import re

import numpy as np
import xxhash

from kestrel.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def near_texts(n, seed):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 200))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(rnd.choice(base))
        if rnd.random() < 0.7:
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append(rnd.choice([" ", "\n", "\x0b "]).join(t).upper() if rnd.random() < 0.2 else " ".join(t))
    return out


def test_components_equal_brute_force(make):
    texts = near_texts(240, 1) + [None, "", " \t", "One", "one", "a b c"]
    prints = [print_of(t) for t in texts]
    roots = components(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(make(list(enumerate(texts)))).collect()}
    for i in range(len(texts)):
        assert (got[i].fingerprint, got[i].component_id) == (format(prints[i], "016x"), roots[i])


def linked(spark, prints, bits, meeting):
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    edges = simhash.links(df, bits, meeting).collect()
    root = {int(np.uint64(p).view(np.int64)): int(np.uint64(p).view(np.int64)) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for e in edges:
        root[find(e.b)] = find(e.a)
    return [find(int(np.uint64(p).view(np.int64))) for p in prints]


def test_crowded_keys_are_split_exactly(spark):
    rnd = random.Random(2)
    prints = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rnd.randint(0, 5)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    for bits in (0, 1, 2):
        want = components(prints, bits)
        for meeting in (2, 8, 1024):
            got = linked(spark, prints, bits, meeting)
            same = lambda c: [[c[i] == c[j] for j in range(i)] for i in range(len(c))]
            assert same(got) == same(want)


def test_one_document_of_each_group_stays(make, odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns
    assert sum(r.text == "x" * 30_000 for r in rows) == 1
    assert sum(bool(r.text) and r.text.startswith("one text") for r in rows) == 1
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
