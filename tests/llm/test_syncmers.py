import hashlib
import random
from collections import Counter

import pytest

from kestrel.llm import syncmers


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    return [rnd.choice([" ", "\n", "\t "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


def brute_likeness(a, b):
    """From ``{kind: {hash: first position}}`` of both texts."""
    best = 0.0
    for kind in ("words", "chars"):
        if a[kind] and b[kind]:
            offsets = Counter(b[kind][h] - p for h, p in a[kind].items() if h in b[kind])
            shared = sum(n for n in offsets.values() if n > 1)
            best = max(best, 2 * max(shared, min(1, len(offsets))) / (len(a[kind]) + len(b[kind])))
    return best


def fingerprints(spark, rows):
    """Anchors of each text from the rule, with Spark's hash of units only."""
    import re
    units = {}
    kinds = []
    for t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        kinds.append({"words": w, "chars": list(t) if len(w) < syncmers.FEW_WORDS else []})
        units.update({x: None for k in kinds[-1].values() for x in k})
    names = list(units)
    hashed = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").orderBy("i").selectExpr("xxhash64(x)").collect()]
    units = dict(zip(names, hashed))
    pairs = sorted({(units[a], units[b]) for k in kinds for seq in k.values() for a, b in zip(seq, seq[1:])})
    pair_hash = dict(zip(pairs, [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").orderBy("i")
                                 .selectExpr("xxhash64(a, b)").collect()]))
    kmers, out = {}, []
    for k in kinds:
        mine = {}
        for kind, seq in k.items():
            size = syncmers.KINDS[kind]
            p = [pair_hash[units[a], units[b]] for a, b in zip(seq, seq[1:])]
            mine[kind] = [(i, tuple(p[i:i + size - 1:2]) + (() if (size - 1) % 2 else (p[i + size - 2],))) for i in range(len(p) - size + 2)
                          if min(p[i], p[i + size - 2]) <= min(p[i + 1:i + size - 2])]
            kmers.update({c: None for _, c in mine[kind]})
        out.append(mine)
    return out


def parsed(text):
    out = {}
    for kind, part in zip(("words", "chars"), text.split("|")):
        out[kind] = {int(h, 16): int(p, 16) for h, p in (x.split(":") for x in part.split(",") if x)}
    return out


def sample():
    rows = texts(50, 1) + [None, "", "é🎉ñ", "one long word" * 60, "x" * 400, "漢字かな交じり文" * 40, "a b c d", "a b c d e f g h i j"]
    rows[7] = rows[3]
    rows += [" ".join(f"r{k % 12}" for k in range(200)), " ".join(f"r{k % 12}" for k in range(190))]
    return rows


@pytest.fixture(scope="module")
def compared(make):
    rows = sample()
    ids = [i * 3 for i in range(len(rows))]
    return rows, ids, {r.doc_id: r for r in syncmers.edited_likeness(make(list(zip(ids, rows)))).collect()}


def test_edited_texts_and_likeness_equal_brute_force(compared):
    rows, ids, got = compared
    for k, t in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)] or ""
        m = len(t) // 4
        edited = t[:len(t) - m] + after[:m]
        r = got[ids[k]]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, following = parsed(r.fingerprint), parsed(r.edited_fingerprint), parsed(got[ids[(k + 1) % len(rows)]].fingerprint)
        assert abs(r.near_edited - brute_likeness(own, new)) < 1e-12 and abs(r.near_next - brute_likeness(own, following)) < 1e-12
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        if len(t.split()) > 80 and k < 50:
            assert r.near_edited > 0.6 and r.near_next < 0.2
    assert got[ids[7]].fingerprint == got[ids[3]].fingerprint


def test_fingerprints_hold_every_anchor_of_the_rule(spark, make, compared):
    rows, ids, got = compared
    for t, i, mine in zip(rows, ids, fingerprints(spark, [t or "" for t in rows])):
        shown = parsed(got[i].fingerprint)
        for kind, found in mine.items():
            first = {}
            for position, kmer in found:
                first.setdefault(kmer, position)
            if kind == "words" or any(mine.values()):
                assert sorted(first.values()) == sorted(shown[kind].values()), t
    assert all(len(parsed(got[i].fingerprint)["chars"]) == 1 for i, t in zip(ids, rows) if len(t or "") < syncmers.CHAR_K)


def test_changes_in_long_texts_and_texts_without_spaces(make):
    rnd = random.Random(9)
    long = [f"v{rnd.randrange(3000)}" for _ in range(12_000)]
    other = list(long)
    for k in range(10):
        other[1000 * k + 77] = "changed"
    shifted = long[:6000] + ["inserted"] + long[6000:]
    plain = "".join(rnd.choice("abcdefghij") for _ in range(2000))
    rows = [" ".join(long), " ".join(other), " ".join(shifted), plain, plain[:-10] + "0123456789", "".join(rnd.choice("klmnopqrst") for _ in range(2000))]
    got = {r.doc_id: r for r in syncmers.edited_likeness(make(list(enumerate(rows)))).collect()}
    assert 0.98 < got[0].near_next < 1 and got[0].fingerprint != got[1].fingerprint
    assert 0.97 < got[1].near_next < 1                           # shifted by one word from the middle on
    assert 0.97 < got[3].near_next < 1
    assert 0.8 < got[3].near_edited < 0.9                        # its last quarter becomes a repetition of the first
    assert got[4].near_next < 0.05


def test_anchors_do_not_depend_on_context(make):
    rnd = random.Random(2)
    passage = " ".join(f"p{rnd.randrange(1000)}" for _ in range(60))
    a, b = "before it " * 5 + passage, "something else " * 9 + passage + " after"
    got = syncmers.anchors(make([(1, a), (2, b), (3, "short"), (4, None)])).collect()
    one = {(r.position - 10, r.anchor) for r in got if r.doc_id == 1 and r.position >= 10}
    two = {(r.position - 18, r.anchor) for r in got if r.doc_id == 2 and 18 <= r.position <= 18 + 60 - syncmers.WORD_K}
    assert len(one) > 15 and one == two
    assert max(abs(r.anchor) for r in got) > 2 ** 40             # 64-bit hashes
    assert [(r.kind, r.position) for r in got if r.doc_id in (3, 4)] == [("chars", 0)] * 2


def test_closed_syncmer_rule(make):
    text = " ".join(f"v{i * 37 % 91}" for i in range(80))
    pairs = syncmers.with_pairs(make([(1, text)]), "text")
    r = pairs.select("_words", syncmers.syncmers("_words", 5).alias("found")).first()
    for i, anchor in enumerate(r.found):
        window = r._words[i:i + 4]
        assert (anchor is not None) == (min(window) in (window[0], window[-1]))
    assert len(r.found) == 80 - syncmers.WORD_K + 1


def test_odd_rows_and_native(odd, empty, make):
    out = syncmers.edited_likeness(odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert len({(r.fingerprint, r.edited_sha256) for r in rows if r.doc_id == 5}) == 1
    assert "Python" not in out._jdf.queryExecution().toString()
    assert syncmers.edited_likeness(empty).count() == 0
    only = syncmers.edited_likeness(make([(1, "just one text of eight words in all")])).collect()
    assert len(only) == 1
