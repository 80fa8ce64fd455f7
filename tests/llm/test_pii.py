import hashlib
import random
import re

import numpy as np
import pytest

from kestrel.llm import pii


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    """The base patterns as regular expressions, with their checks."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def pieces(seed, n, longest=30):
    rnd = random.Random(seed)
    parts = ["a", "b.c", "@", "@", "x@y.z", ".", "1", "23", "255", "256", "0300", "4539148803436467", "+", "+1", " ", "-", "(", ")", "é",
             "4539 1488 0343 6467", "192.168.0.1", "%", "٣", "🎉", "[at]", " at ", " dot ", "[dot]", "::1", "fe80:", "\n", "+1 (212) 555-0101"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_base_spans_equal_brute_force():
    for t in pieces(1, 15_000):
        assert pii.base_spans(t) == brute(t), t


def test_candidates_hold_the_base_spans_and_overlap_nothing():
    for t in pieces(2, 3000):
        found = pii.proposed(t)
        assert sorted(s[:3] for s in found if s[3]) == sorted(brute(t))
        for k, a, b, base in found:
            assert 0 <= a < b <= len(t)
            assert base or not any(x < b and a < y for _, x, y in brute(t))


def test_very_long_runs_take_linear_time():
    for t in ("1" * 300_000, "1." * 200_000, "a@" * 150_000, "+1 " * 100_000, "4" * 99_999 + "@", "ab:" * 100_000, "x at y dot " * 30_000):
        pii.examined(t)


def check_digit(rnd, n=16, first="4"):
    body = first + "".join(rnd.choice("0123456789") for _ in range(n - 1 - len(first)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def corpus(n=500, seed=5):
    """Rows, and the planted spans beyond the base patterns (true ones and decoys)."""
    rnd = random.Random(seed)
    rows, true, false = [], [], []

    def word():
        return "".join(rnd.choice(["ta", "ri", "no", "the", "un", "es", "lo"]) for _ in range(rnd.randint(1, 4)))

    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            good = check_digit(rnd)
            kind = rnd.randrange(8)
            near = rnd.random() < 0.5
            plant = [f"{word()}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com",
                     ".".join(str(rnd.randint(1, 254)) for _ in range(4)), good, f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}",
                     f"{word()} [at] mail{rnd.randint(1, 9)} [dot] com", check_digit(rnd, 15, "37"),
                     good[:-1] + str((int(good[-1]) + 5) % 10), "9" + "0" * 15][kind]
            at = rnd.randrange(len(words))
            words[at] += (" " + rnd.choice(["mail", "ip", "card", "phone", "contact", "visa"][kind % 4::4] or ["contact"]) if near and kind < 6 else "") + " " + plant
            if kind in (4, 5):
                true.append((i, plant))
            if kind >= 6:
                false.append((i, plant))
        rows.append((i, " ".join(words)))
    return rows, true, false


@pytest.fixture(scope="module")
def trained(make):
    rows, true, false = corpus()
    found = pii.candidates(make(rows))
    return rows, true, false, found, pii.fit(found)


def test_classifier_finds_planted_forms_and_leaves_decoys(trained):
    rows, true, false, found, model = trained
    texts = dict(rows)
    got = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start:s.stop]) for s in r.spans if not s.base and s.score >= 0.5]
           for r in pii.judged(found, model).collect()}
    hit = sum(any(p.endswith(x) or x.endswith(p) for _, x in got[i]) for i, p in true)
    assert true and hit >= 0.9 * len(true)
    wrong = sum(any(x == p for _, x in got[i]) for i, p in false)
    assert false and wrong <= 0.05 * len(false)
    planted = {i for i, _ in true} | {i for i, _ in false}
    assert not any(v for i, v in got.items() if i not in planted)


def test_report_equals_brute_force(trained):
    rows, _, _, found, model = trained
    texts = dict(rows)
    for r in pii.report(pii.judged(found, model)).collect():
        want = sorted(brute(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(shown) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_em_recovers_how_labelers_vote():
    rnd = np.random.default_rng(0)
    truth = rnd.random(20_000) < 0.3
    right, says = [0.95, 0.8, 0.7, 0.9], [0.9, 0.6, 0.8, 0.3]
    votes = np.stack([np.where(rnd.random(len(truth)) < s, np.where(rnd.random(len(truth)) < r, 1, -1) * np.where(truth, 1, -1), 0)
                      for r, s in zip(right, says)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p, prior = pii.reliabilities(patterns, n.astype(float), anchor=0)
    assert abs(prior - truth.mean()) < 0.02
    for k, r in enumerate(right):
        assert abs(p[1, k, 2] - r) < 0.03 and abs(p[0, k, 0] - r) < 0.03


def test_redaction_replaces_what_the_report_lists(make, trained):
    rows, _, _, found, model = trained
    texts = dict(rows)
    clean = {r.doc_id: r.text for r in pii.redact(make(rows + [(9999, None)]), model).collect()}
    assert clean.pop(9999) is None
    for r in pii.report(pii.judged(found, model)).collect():
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in r.spans.split(",") if s)
        out, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                out += texts[r.doc_id][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert clean[r.doc_id] == out + texts[r.doc_id][at:]


def test_odd_and_empty_tables(odd, empty):
    found = pii.candidates(odd)
    got = pii.report(pii.judged(found, pii.fit(found))).collect()
    assert len(got) == odd.count() and all(r.spans == "" and r.n_email == 0 for r in got)
    none = pii.candidates(empty)
    assert pii.report(pii.judged(none, pii.fit(none))).count() == 0
