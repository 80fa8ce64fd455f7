"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates of four kinds (email, ip, card, phone) are proposed in every whole
text: what the base patterns match, and looser forms (addresses spelled with
``at`` and ``dot``, IPv6, card numbers inside longer digit runs or with
13 to 15 digits, runs that fail the check digit, phones without a plus sign or with
digits after them).

Labelers of three families vote +1, -1 or abstain on each candidate: regular
expressions and check digits on the span, gazetteers (domain endings, issuer
prefixes, calling codes, address ranges), and the words around it.  Nobody labels
anything by hand.  Votes are counted by pattern over all documents (at most
``3^8`` patterns a kind, whatever the corpus), and expectation-maximisation on
these counts estimates how each labeler votes on true and on false candidates,
and so the probability of every pattern.  A logistic classifier over the form and the
surroundings of the span is trained on these probabilities; it decides about
the candidates outside the base patterns.  Base spans always stay.

The classifier is fitted on at most ``max_rows`` distinct feature rows, chosen
by hash and weighted by their counts; the EM counts and the search cover
everything.  Candidates are written once, next to the ids, so every text is
read once.

Spans are counted in code points, ends are exclusive; candidates that overlap
a base span or an earlier candidate of their kind are dropped.  Edge cases:
null and empty texts have no spans; without any candidate the model accepts
nothing; repeated rows give repeated results; a null id stays null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import small_batches, written

# The kinds in order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser forms; every quantifier is bounded, so a text is scanned in linear time.
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\x20?(?:[\[({<]\x20?at\x20?[\])}>]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[\[({<]\x20?dot\x20?[\])}>]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}", re.I)
SPELLED_SIGN = re.compile(r"[\[({<]\x20?(?:at|dot)\x20?[\])}>]|\x20dot\x20", re.I)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
PLAIN_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,5}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?!\.?[0-9A-Za-z-])")
PLUS_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4}(?!\.?[0-9])")

# Gazetteers.
ENDINGS = frozenset("com org net edu gov mil int info biz io co me app dev eu uk de fr es it nl be at ch pl pt se no dk fi cz ie us ca mx br ar cl "
                    "au nz jp cn in kr ru za".split())
MAIL_HOSTS = ("mail", "gmail", "hotmail", "outlook", "yahoo", "gmx", "proton", "icloud", "post", "smtp", "web")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54",
           "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "36", "38", "30", "35", "60", "62", "64", "65")
NEAR = {
    EMAIL: frozenset("mail email e-mail contact contacto kontakt courriel correo write escribe schreib adresse address reply".split()),
    IP: frozenset("ip ipv server host login from address adresse client peer dns gateway connexion verbindung".split()),
    CARD: frozenset("card karte carte tarjeta visa mastercard amex credit debit kreditkarte payment pago paiement cvv expires iban konto".split()),
    PHONE: frozenset("phone tel telephone call fax mobile cell handy telefon téléphone teléfono móvil portable llame ruf appelez whatsapp sms".split()),
}
AGAINST = frozenset("version release build isbn issn doi section figure fig page pages order invoice serial part chapter rfc price total sku "
                    "ratio score table equation id number numéro nummer número".split())


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    values[-2::-2] = [v * 2 - 9 * (v > 4) for v in values[-2::-2]]
    return sum(values) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, stop)`` of the base patterns' matches that pass their checks."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        tail = EMAIL_HOST.match(text, at + 1)
        # A match holds one @; its name part reaches back to the last other sign, or to the match before.
        name = len(text[done:at]) - len(text[done:at].rstrip(EMAIL_LOCAL))
        if tail and name:
            out.append((EMAIL, at - name, tail.end()))
        done = tail.end() if tail and name else at + 1
        at = text.find("@", max(done, at + 1))
    if not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        for run in DOTTED.finditer(text):
            if run.group().count(".") >= 3:
                groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run.group())]
                for k in range(0, len(groups) - 3, 4):                     # numbers of four parts, one after the other
                    part = groups[k:k + 4]
                    if all(b - a < 4 or not run.group()[a:b - 3].strip("0") for a, b in part) and all(int(run.group()[max(a, b - 3):b]) <= 255 for a, b in part):
                        out.append((IP, run.start() + part[0][0], run.start() + part[3][1]))
    for run in CARD_RUN.finditer(text):
        if run.end() - run.start() >= 16:
            digits = digits_of(run.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, run.start(), run.end()))
    if "+" in text:
        for run in PHONE_RUN.finditer(text):
            if 8 <= len(digits_of(run.group())) <= 15:
                out.append((PHONE, run.start(), run.end()))
    return out


def looser_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Further candidates, base spans among them."""
    if SPELLED_SIGN.search(text):
        for m in SPELLED.finditer(text):
            if not m.group().lower().count(" at ") or re.search(r"dot", m.group(), re.I):
                yield EMAIL, m.start(), m.end()
    if text.count(":") >= 2:
        for m in IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m.group())
            except ValueError:
                continue
            yield IP, m.start(), m.end()
    if not any(c in text for c in "0123456789"):
        return
    for run in CARD_RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        n = len(digits_of(run.group()))
        if 13 <= n <= 19:
            yield CARD, run.start(), run.end()
        elif n > 19:
            parts = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer("[0-9]+", run.group())]
            k = 0
            while k < len(parts):
                a, b = parts[k]
                four = parts[k:k + 4]
                if 13 <= b - a <= 19:
                    yield CARD, a, b
                elif len(four) == 4 and all(y - x == 4 for x, y in four) and luhn(digits_of(text[a:four[3][1]])):
                    yield CARD, a, four[3][1]
                    k += 3
                k += 1
    for m in PLAIN_PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            yield PHONE, m.start(), m.end()
    if "+" in text:
        for m in PLUS_PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                yield PHONE, m.start(), m.end()


def proposed(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, stop, base)``: base spans, and candidates that overlap none of them nor an earlier one of their kind."""
    from bisect import bisect_left
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    reach, top = [], 0
    for _, b in taken:
        top = max(top, b)
        reach.append(top)
    out = [(*s, True) for s in base]
    last = {}
    for kind, a, b in sorted(set(looser_spans(text)), key=lambda s: (s[0], s[1], -s[2])):
        k = bisect_left(taken, (b,))                     # base spans that begin before b
        if a >= last.get(kind, 0) and not (k and reach[k - 1] > a):
            out.append((kind, a, b, False))
            last[kind] = b
    return sorted(out)


WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Span:
    """A candidate with what labelers and features look at: its text and up to 48 characters on either side."""

    def __init__(self, text: str, kind: int, start: int, stop: int, company: bool):
        self.kind, self.text, self.company = kind, text[start:stop], company
        self.digits = digits_of(self.text)
        self.before, self.after = text[max(0, start - 48):start], text[stop:stop + 48]
        self.left = [w.lower() for w in WORD.findall(self.before)][-5:]
        self.right = [w.lower() for w in WORD.findall(self.after)][:2]
        self.edge = self.before[-1:], self.after[:1]


def _checked(s: Span) -> int:
    """Form and check digit of the span itself."""
    if s.kind == EMAIL:
        host = s.text.rpartition("@")[2]
        return 1 if "@" in s.text and len(host.rpartition(".")[2]) > 1 else 0
    if s.kind == IP:
        return 1
    if s.kind == CARD:
        return 1 if luhn(s.digits) else -1
    return 1 if s.text[0] == "+" and 8 <= len(s.digits) <= 15 else (0 if 9 <= len(s.digits) <= 13 else -1)


def _bordered(s: Span) -> int:
    """Against parts of a longer word, name or number; standing alone says nothing."""
    inside = any(c.isalnum() or c in "_/=@#" for c in s.edge if c) or s.before[-2:-1].isdigit() and s.edge[0] in ".,:-"
    return -1 if inside else 0


def _varied(s: Span) -> int:
    """Against stand-ins: one digit repeated, or digits in their order."""
    d = s.digits
    if s.kind == EMAIL:
        return -1 if re.search(r"\b(?:noreply|no-reply|user|name|foo|test)@", s.text, re.I) else 0
    return -1 if len(d) > 5 and (len(set(d)) <= 2 or d in "01234567890123456789") else 0


def _listed(s: Span) -> int:
    """Domain ending, address range, issuer prefix or calling code."""
    if s.kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9]+", s.text.rstrip(")]}> "))[-1].lower() in ENDINGS else -1
    if s.kind == IP:
        try:
            a = ipaddress.ip_address(".".join(str(int(p)) for p in s.text.split(".")) if "." in s.text else s.text)
        except ValueError:
            return -1
        return -1 if a.is_unspecified or a.is_loopback or str(a).startswith("0.") else 1
    if s.kind == CARD:
        return 0 if s.digits.startswith(ISSUERS) else -1       # other long numbers begin so too
    if s.text[0] == "+" or s.digits.startswith("00"):
        return 1 if s.digits.lstrip("0").startswith(CALLING) else -1
    return 0


def _host(s: Span) -> int:
    """The usual make-up: a mail host's name, the usual length of a card or of a phone number."""
    if s.kind == EMAIL:
        return 1 if any(h in s.text.lower() for h in MAIL_HOSTS) else 0
    if s.kind == CARD:
        return 0 if len(s.digits) in (15, 16) else -1
    if s.kind == PHONE:
        return 1 if 10 <= len(s.digits) <= 12 else 0
    return 0


def _named(s: Span) -> int:
    """A word of the kind stands nearby."""
    return 1 if any(w in NEAR[s.kind] for w in (*s.left, *s.right)) else 0


def _numbered(s: Span) -> int:
    """A word or sign of other numbers stands right before or after it."""
    return -1 if any(w in AGAINST for w in s.left[-2:]) or s.before.rstrip()[-1:] in ("$", "€", "£", "§") or s.after.lstrip()[:1] in ("%", "€") else 0


def _accompanied(s: Span) -> int:
    """Another candidate of another kind stands within 100 characters."""
    return 1 if s.company else 0


LABELERS = {"checked": _checked, "bordered": _bordered, "varied": _varied, "listed": _listed, "host": _host,
            "named": _named, "numbered": _numbered, "accompanied": _accompanied}
FEATURES = 1 << 12


def features(s: Span) -> list[int]:
    """Numbers of the span's features: form, size, check digit and what stands around it."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[^0-9A-Za-z]", lambda m: " " if m.group().isspace() else m.group(), re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", s.text[:200]))))
    names = [f"shape {shape[:40]}", f"digits {min(len(s.digits), 24)}", f"luhn {luhn(s.digits) if s.kind == CARD else ''}",
             f"first {s.digits[:1]}", f"long {len(s.text).bit_length()}", "edge %s %s" % tuple(
                 "" if not c else "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c for c in s.edge)]
    names += [f"checked {_checked(s)}", f"listed {_listed(s)}", f"near {_named(s)}", f"against {_numbered(s)}"]
    names += [f"left {w}" for w in s.left[-3:]] + [f"right {w}" for w in s.right[:1]]
    return sorted({zlib.crc32(f"{s.kind} {n}".encode()) % FEATURES for n in names})


def examined(text: str) -> list[tuple[int, int, int, bool, list[int], list[int]]]:
    """``(kind, start, stop, base, votes, features)`` of all candidates of a text."""
    found = proposed(text)
    if not found:
        return []
    order = sorted(found, key=lambda s: (s[1], s[2]))
    company = {}
    for (k1, a1, b1, _), (k2, a2, b2, _) in zip(order, order[1:]):
        if k1 != k2 and a2 - b1 <= 100:
            company[k1, a1, b1] = company[k2, a2, b2] = True
    out = []
    for kind, a, b, base in found:
        s = Span(text, kind, a, b, (kind, a, b) in company)
        out.append((kind, a, b, base, [vote(s) for vote in LABELERS.values()], features(s)))
    return out


SPANS = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>,features:array<int>>>"


def _arrow_spans(rows: list):
    import pyarrow as pa
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()),
                               ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))
    names = ("kind", "start", "stop", "base", "votes", "features")
    return pa.array([[dict(zip(names, s)) for s in r] for r in rows], kind)


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: the candidates of every text with votes and features, written once."""
    import pyarrow as pa
    small_batches(df.sparkSession)
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _arrow_spans([examined(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    return written(src.mapInArrow(run, f"doc_id {kind}, spans {SPANS}"), "candidates")


@dataclass
class Model:
    """Probabilities of cast votes by kind (class, labeler, vote + 1; 1 for abstaining), shares of true candidates, classifier weights."""

    votes: dict[int, np.ndarray] = field(default_factory=dict)
    prior: dict[int, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -50.0

    def belief(self, kind: int, patterns: np.ndarray) -> np.ndarray:
        """Probability of being true for each row of votes."""
        p = self.votes[kind]
        labeler = np.arange(patterns.shape[1])
        logs = np.log(p[:, labeler, patterns + 1]).sum(axis=2) + np.log([[1 - self.prior[kind]], [self.prior[kind]]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def odds(self, numbers: list[int]) -> float:
        return self.bias + float(self.weights[numbers].sum())


# Before any data a vote is right four times as often as wrong.  Abstaining says nothing.
BELIEVED = np.array([[0.8, 0.0, 0.2], [0.2, 0.0, 0.8]])


def reliabilities(patterns: np.ndarray, n: np.ndarray, anchor: float = 0.5, rounds: int = 500) -> tuple[np.ndarray, float]:
    """EM over vote patterns with counts: probabilities of a cast vote by ``(class, labeler, vote + 1)``, and the share of true ones.

    What is believed of a labeler counts as 10 votes and as ``anchor`` times
    those it casts.  Without an anchor a kind that only one labeler judges
    either way is not identified: its candidates could all be of one class,
    the labeler being wrong as often as it takes.
    """
    def shares(votes: np.ndarray) -> np.ndarray:
        p = votes / votes.sum(axis=2, keepdims=True)
        p[:, :, 1] = 1.0
        return p

    labelers = patterns.shape[1]
    believed = BELIEVED[:, None, :] * (10 + anchor / 2 * ((patterns != 0) * n[:, None]).sum(axis=0))[None, :, None]
    model = Model({0: shares(believed)}, {0: 0.5})
    before = None
    for _ in range(rounds):
        true = model.belief(0, patterns)
        both = np.stack([(1 - true) * n, true * n])
        votes = np.array([[[c[patterns[:, k] == v].sum() if v else 0.0 for v in (-1, 0, 1)] for k in range(labelers)] for c in both])
        model = Model({0: shares(votes + believed)}, {0: float((both[1].sum() + 1) / (n.sum() + 2))})
        if before is not None and np.abs(true - before).max() < 1e-9:
            break
        before = true
    return model.votes[0], model.prior[0]


def fit_logistic(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model for soft targets, by Adam steps over all rows (deterministic)."""
    per = np.array([len(r) for r in rows])
    row, col = np.repeat(np.arange(len(rows)), per), np.fromiter((f for r in rows for f in r), np.int64, per.sum())
    weight = weight / weight.sum()
    w, bias = np.zeros(FEATURES), 0.0
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(rows)), -50, 50)))
        pull = (p - target) * weight
        grad = np.append(np.bincount(col, pull[row], FEATURES) + l2 * w, pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(found: DataFrame, max_rows: int = 20_000) -> Model:
    """Reliabilities from all candidates, and the classifier they teach (``found``: :func:`candidates`).

    What is collected: vote patterns (bounded by their number) and at most
    ``max_rows`` distinct pairs of votes and features.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    counted = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    if not counted:
        return Model()
    model = Model()
    for kind in sorted({r["kind"] for r in counted}):
        mine = [r for r in counted if r["kind"] == kind]
        model.votes[kind], model.prior[kind] = reliabilities(np.array([r["votes"] for r in mine]), np.array([float(r["n"]) for r in mine]))
    rows = (spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(max_rows).collect())
    truth = np.array([model.belief(r["kind"], np.array([r["votes"]]))[0] for r in rows])
    # Repetitions count, but the ten thousandth copy teaches less than the second.
    model.weights, model.bias = fit_logistic([r["features"] for r in rows], truth, np.sqrt([float(r["n"]) for r in rows]))
    return model


def judged(found: DataFrame, model: Model) -> DataFrame:
    """``doc_id, spans``: every candidate as ``kind, start, stop, base, score``, the score from the classifier."""
    import pyarrow as pa
    kind = found.schema["doc_id"].dataType.simpleString()
    out = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{**{k: s[k] for k in ("kind", "start", "stop", "base")}, "score": float(1 / (1 + np.exp(-np.clip(model.odds(s["features"]), -700, 700))))}
                     for s in spans] for spans in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out)], names=["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:int,start:int,stop:int,base:boolean,score:double>>")


def accepted(spans: str = "spans", threshold: float = 0.5) -> Column:
    """Base spans, and the others whose score reaches the threshold, by kind and start."""
    return F.array_sort(F.filter(spans, lambda s: s["base"] | (s["score"] >= threshold)))


def report(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: base counts and hash, and all accepted spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = found.select("doc_id", accepted(threshold=threshold).alias("spans")).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def redact(df: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` with every accepted span of its texts replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``.

    Of overlapping spans the first one gives the name.  Null texts stay null.
    """
    import pyarrow as pa
    small_batches(df.sparkSession)
    place = df.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        spans = [s for s in examined(t) if s[3] or 1 / (1 + np.exp(-np.clip(model.odds(s[5]), -700, 700))) >= threshold]
        for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], s[0])):
            if a >= at:
                out += [t[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([clean(t) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
