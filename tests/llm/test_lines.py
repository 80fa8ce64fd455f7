import random

from kestrel.llm import line_dedup


def brute(docs, least):
    """Lines left in each document; runs of any length, compared as tuples."""
    seen, out = {}, []
    parts = []
    for d, text in enumerate(docs):
        lines = (text or "").split("\n")
        parts.append((lines, [k for k, x in enumerate(lines) if x.strip(" ")]))
    for d, (lines, at) in enumerate(parts):
        for s in range(len(at)):
            for e in range(s, len(at)):
                run = tuple(lines[k] for k in at[s:e + 1])
                if sum(map(len, run)) >= least:
                    seen.setdefault(run, (d, s, e))
    for d, (lines, at) in enumerate(parts):
        gone = set()
        for s in range(len(at)):
            for e in range(s, len(at)):
                run = tuple(lines[k] for k in at[s:e + 1])
                if sum(map(len, run)) >= least and seen[run] != (d, s, e) and not (seen[run][0] == d and s <= seen[run][2]):
                    gone.update(at[s:e + 1])
        out.append((None if docs[d] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def random_docs(seed, n):
    rnd = random.Random(seed)
    pool = ["a", "bb", "ccc", "", " ", "dddd", "eeeeee", "ffffffffff", "g" * 14, "h" * 20]
    docs = []
    for _ in range(n):
        if docs and rnd.random() < 0.3:
            docs.append(rnd.choice(docs) + rnd.choice(["", "\na", "\nzz%d" % len(docs)]))
        else:
            docs.append("\n".join(rnd.choice(pool) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(rnd.randint(0, 12))))
    return docs


def test_deleted_lines_equal_brute_force(make):
    for least in (12, 1):
        docs = random_docs(least, 60) + [None, ""]
        want = brute(docs, least)
        rows = list(enumerate(docs))         # equal texts differ in id
        got = {r.doc_id: (r.text, r.n) for r in line_dedup.drop_repeated_lines(make(rows), least, count="n").collect()}
        assert got == dict(enumerate(want))


def test_ranks_are_a_suffix_array(make):
    docs = random_docs(5, 25)
    places = line_dedup.repeated_places(line_dedup.line_places(make(list(enumerate(docs)))))
    ranked, levels = line_dedup.suffix_ranks(places, 8)
    assert levels == 3
    rows = ranked.orderBy("doc_id", "run", "pos").collect()
    runs = {}
    for r in rows:
        runs.setdefault((r.doc_id, r.run), []).append(r)
    suffixes = [(tuple(x.r0 for x in run[i:i + 8]), run[i].r3) for run in runs.values() for i in range(len(run))]
    by_rank = sorted(suffixes, key=lambda s: s[1])
    assert [s[0] for s in by_rank] == sorted(s[0] for s in suffixes)
    assert len({s[1] for s in suffixes}) == len({s[0] for s in suffixes})


def test_odd_rows(odd, empty):
    out = line_dedup.drop_repeated_lines(odd, 30)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 5] == [r.text for r in odd.collect() if r.doc_id == 5]
    assert [r.text for r in rows if r.doc_id == 6] == [""]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_overlapping_copies_leave_the_kept_one_whole(make):
    """Equal lines of ten characters: lines 1 to 3 stay, copies that begin inside them are passed over."""
    line = "0123456789"
    docs = ["\n".join([line] * n) for n in (5, 6, 8)]
    for doc, left in zip(docs, (5, 3, 3)):
        (row,) = line_dedup.drop_repeated_lines(make([(1, doc)]), 30, count="n").collect()
        assert row.text == "\n".join([line] * left) and row.n == doc.count("\n") + 1 - left
    both = line_dedup.drop_repeated_lines(make([(1, docs[0]), (2, docs[0])]), 30, count="n").orderBy("doc_id").collect()
    assert [r.n for r in both] == [0, 5]
    assert brute([docs[0], docs[0]], 30) == [(docs[0], 0), ("", 5)]
