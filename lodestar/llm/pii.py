"""Personal data by candidate gradient boosting.

Generators of high recall propose spans that may overlap: the base patterns
and wider ones (numbers in groups, mixed strings of 20 characters and more, addresses spelled out,
account numbers, hexadecimal groups). Boosted trees judge each candidate by
its format and its context, an isotonic map turns their margin into a
probability, and of the candidates over their kind's calibrated threshold those
of highest probability are taken without overlap. Base spans always stay; a
secret may hold base spans, no other added span may touch one.

The trees learn from examples that rules write (kinds of personal data against
time stamps, check sums of files, order numbers, versions, dates, prices,
measures and words, each in a context), with fixed seeds; nothing is learned
from the documents. Three disjoint sets of examples fit the trees, calibrate
map and thresholds, and report precision and recall. A candidate counts as
right only if its kind is right. Numbers of 12 to 19 digits are `card` where
the check sum is right, else `account`.

Patterns are matched in time linear in the text: each starts only where its
first run of characters starts.

Defined cases: a null text counts as empty (no spans) and stays null when
redacted; texts of any length are read whole; spans count code points, the end
exclusive; of candidates of equal probability the longer, then the earlier is
taken; repeated rows give repeated results; other columns may have any name
(`find` does not carry them, `redact` does); an empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.boosting import Boosted, Calibrated, threshold

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret")
Span = tuple[int, int]

#: What the base patterns are made of.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the check sum of the digits is a multiple of ten."""
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: the run of local characters before each @ sign, then
    the domain after it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((start, last))
        at = text.find("@", at + 1)
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each base kind in order of start."""
    found: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if ANY_DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(map(_byte, m.group().split(".")))]
        found["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


ANY_DIGIT = re.compile(r"[0-9]")
#: Wider generators: name, kind they propose, pattern. Counts that end are the
#: formats' own: digits of cards and numbering plans, labels of host names,
#: groups of addresses and account numbers.
GENERATORS = (
    ("group", "card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])")),
    ("call", "phone", re.compile(r"(?<![0-9+(])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,8}){1,4}(?![0-9])")),
    ("plus", "phone", re.compile(r"\+ ?\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9])")),
    ("quad", "ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}")),
    ("spelled", "email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?| \. |\.)[A-Za-z0-9-]{1,63}){1,4}")),
    ("iban", "account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("parts", "account", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("mixed", "secret", re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}")),
)
#: What written secrets of 20 to 20000 characters are made of.
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"
NAMES = (*BASE_KINDS, *(g[0] for g in GENERATORS))
#: Words that tell in a context, by what they speak for.
CONTEXT = {
    "contact": {"phone", "tel", "telephone", "call", "mobile", "fax", "email", "mail", "contact", "reach", "dial", "ring", "whatsapp", "hotline"},
    "network": {"host", "server", "ip", "address", "ping", "mac", "gateway", "dns"},
    "money": {"card", "visa", "mastercard", "account", "iban", "bank", "pay", "payment", "ssn", "social", "security", "credit", "debit", "passport"},
    "secret": {"token", "key", "password", "passwd", "secret", "apikey", "api", "auth", "bearer", "credential", "credentials"},
    "hash": {"commit", "sha", "md", "hash", "digest", "checksum", "revision", "rev", "etag", "blob", "object", "uuid", "guid", "fingerprint"},
    "time": {"date", "time", "updated", "created", "timestamp", "utc", "posted", "modified", "published"},
    "number": {"version", "v", "release", "license", "licence", "isbn", "issn", "page", "pages", "pp", "section", "chapter", "figure", "table", "order", "invoice", "ticket", "tracking", "item", "part", "model", "serial", "id", "total", "price", "population", "build", "pi", "score", "size"},
    "weak": {"in", "on", "at", "since", "from", "until", "about", "between", "year", "years", "no", "number", "is", "the", "my", "me", "us"},
}
WORDS_BEFORE = re.compile(r"[A-Za-z]+")


DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?![0-9])")
STAMP = re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01])[0-9]{4}(?:[0-9]{2}|[0-9]{5})?(?![0-9])")
HEX = frozenset("0123456789abcdefABCDEF")
Candidate = tuple[str, str, int, int]


def propose(text: str, base: dict[str, list[Span]]) -> list[Candidate]:
    """Candidates (generator, kind, start, end): base spans and wider ones that
    may stand beside them."""
    found = [(k, k, s, e) for k in BASE_KINDS for s, e in base[k]]
    fixed = _Stretches(sorted((s, e) for _, _, s, e in found))
    digit = ANY_DIGIT.search(text) is not None
    for name, kind, pattern in GENERATORS:
        if name == "spelled" and not ("[" in text or "(" in text) or name != "spelled" and not digit:
            continue
        for m in pattern.finditer(text):
            if name == "mixed":
                if not (ANY_DIGIT.search(m.group()) and WORDS_BEFORE.search(m.group()) and fixed.within(*m.span())):
                    continue
            elif fixed.meets(*m.span()) or name == "call" and not 7 <= len(_digits(m.group())) <= 15:
                continue
            found.append((name, "account" if name == "group" and not luhn(_digits(m.group())) else kind, *m.span()))
    return found


def features(text: str, name: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    digits = _digits(span)
    letters = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before, after = text[max(0, start - 40) : start], text[end : end + 2]
    words = [w.lower() for w in WORDS_BEFORE.findall(before)[-4:]]
    counts = {c: span.count(c) for c in "@.:-() +/="}
    hexes = sum(c in HEX for c in span)
    values = np.array([span.count(c) for c in sorted(set(span))], float)  # in an order that no process changes
    values = values / max(1, len(span))
    head, next_one = before[-1:], after[:1]
    return [
        len(span), len(digits), letters, len(groups), max(groups), min(groups), groups[0], groups[-1],
        *counts.values(),
        hexes / max(1, len(span)), float(-(values * np.log2(values)).sum()), float(12 <= len(digits) <= 19 and luhn(digits)),
        float(len(digits) >= 8 and len(set(digits)) <= 2), float(head in "\"'="  and head != ""), float(head in "$€£#" and head != ""), float(head in ".,:" and head != ""), float(head.isalnum()), float(next_one in "%$€" and next_one != ""),
        float(next_one == ":"), float(DATE.match(span) is not None), float(STAMP.match(span) is not None), float(hexes == len(span) and len(span) in (32, 40, 64)), float(letters > 0 and span.upper() != span != span.lower()), float(max(map(len, re.split("[-_/+=]", span)))),
        *(float(any(w in known for w in words)) for known in CONTEXT.values()),
        float(bool(words) and any(words[-1] in known for known in CONTEXT.values())),
        *(float(name == n) for n in NAMES),
    ]


class Writer:
    """Writes texts with one thing in each: (text, start, end, kind), the kind
    None where it is nothing personal."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def letters(self, k: int) -> str:
        return "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def word(self) -> str:
        return self.letters(self.rng.randint(1, 9))

    def hexes(self, k: int) -> str:
        found = "".join(self.rng.choice("0123456789abcdef") for _ in range(k))
        return found.upper() if self.rng.random() < 0.2 else found

    def mixed(self, k: int) -> str:
        return "".join(self.rng.choices(MIXED, k=k))

    def spaced(self, number: str, sep: str) -> str:
        return sep.join(number[i : i + 4] for i in range(0, len(number), 4))

    def grouped(self, *sizes: int, seps: str = " -.") -> str:
        return self.rng.choice(seps).join(self.digits(n) for n in sizes)

    def length(self) -> int:
        """20 to 20000, as many of each order of magnitude."""
        return int(20 * 1000 ** self.rng.random())

    def personal(self) -> tuple[str, str, tuple[str, ...]]:
        """Kind, body and the contexts ("" is none) in which it is personal."""
        r = self.rng
        body = lambda n: next(x + c for x in [self.digits(n - 1)] for c in "0123456789" if luhn(x + c))
        return r.choice([
            lambda: ("email", f"{self.word()}.{self.word()}{self.digits(r.randint(0, 3))}@{self.word()}.{r.choice(['com', 'org', 'example.com', 'de'])}", ("contact", "")),
            lambda: ("email", f"{self.word()} {r.choice(['[at]', '(at)', '[ at ]'])} {self.word()} {r.choice(['[dot]', '(dot)', '.'])} {r.choice(['com', 'org', 'net'])}", ("contact", "")),
            lambda: ("ip", ".".join(str(r.randint(0, 255)) for _ in range(4)), ("network", "")),
            lambda: ("ip", ":".join(self.hexes(r.randint(2, 4)) for _ in range(8)), ("network", "")),
            lambda: ("card", self.spaced(body(r.choice([13, 15, 16, 16, 16])), r.choice(["", "", " ", "-"])), ("money", "")),
            lambda: ("account", self.spaced(self.digits(16), r.choice(["", "", " ", "-"])), ("money", "", "weak")),
            lambda: ("account", self.digits(r.randint(12, 18)), ("money",)),
            lambda: ("account", f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{self.digits(2)} {self.spaced(self.digits(16), ' ')} {self.digits(2)}", ("money", "")),
            lambda: ("account", f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}", ("money", "")),
            lambda: ("phone", f"+{r.randint(1, 99)} ({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", ("contact", "")),
            lambda: ("phone", f"+{r.randint(1, 99)}{r.choice(' -.')}{self.grouped(3, 3, 4)}", ("contact", "")),
            lambda: ("phone", f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", ("contact", "")),
            lambda: ("phone", self.grouped(*r.choice([(3, 3, 4), (3, 4), (2, 3, 3, 3), (4, 3, 4), (3, 3, 2, 2), (2, 2, 2, 2, 2), (4, 4), (3, 7), (4, 6)]), seps=" -./"), ("contact",)),
            lambda: ("phone", self.grouped(3, 3, 4, seps="-."), ("contact", "", "weak")),
            lambda: ("secret", self.hexes(r.choice([32, 40, 64, r.randint(20, 80)])), ("secret",)),
            lambda: ("secret", r.choice(["sk-", "ghp_", "xoxb-", "pk_", "AKIA", ""]) + self.mixed(r.randint(20, 60)), ("secret", "")),
            lambda: ("secret", self.mixed(self.length()), ("secret", "")),
            lambda: ("secret", self.hexes(self.length()), ("secret",)),
            lambda: ("secret", self.hexes(100 + self.length()), ("secret", "")),
        ])()

    def other(self) -> tuple[None, str, tuple[str, ...]]:
        """The same of what is nothing personal."""
        r = self.rng
        day = lambda sep: f"{r.randint(1900, 2030)}{sep}{r.randint(1, 12):02d}{sep}{r.randint(1, 28):02d}"
        clock = lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"
        return (None, *r.choice([
            lambda: (".".join(str(r.randint(0, 20)) for _ in range(r.randint(2, 3))), ("number", "")),
            lambda: (day(r.choice("-/.")), ("time", "weak", "")),
            lambda: (f"{day('-')}{r.choice([' ', 'T'])}{clock()}", ("time", "weak", "")),
            lambda: (f"{r.randint(1, 28):02d}{r.choice('./')}{r.randint(1, 12):02d}{r.choice('./')}{r.randint(1900, 2030)}", ("time", "weak", "")),
            lambda: (f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)} {clock()}", ("time", "weak", "")),
            lambda: (clock(), ("time", "weak", "")),
            lambda: (day("") + f"{r.randint(0, 235959):06d}", ("time", "weak", "")),
            lambda: (f"{r.randint(1, 999)}.{self.digits(3)}.{self.digits(3)}", ("number", "")),
            lambda: (f"{r.randint(10, 999)}-{r.randint(10, 9999)}", ("number", "weak", "")),
            lambda: (f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", ("number", "weak", "")),
            lambda: (f"{r.randint(10, 999)}/{r.randint(10, 999)}", ("number", "")),
            lambda: (f"{r.randint(0, 9)}.{self.digits(r.randint(12, 18))}", ("number", "")),
            lambda: (r.choice("123456789") + "0" * r.randint(11, 17), ("number", "")),
            lambda: (" ".join(str(r.randint(10, 999)) for _ in range(r.randint(2, 5))), ("number", "weak", "")),
            lambda: ("-".join(self.letters(r.randint(4, 8)) for _ in range(4)) + f"-{r.randint(1, 99)}", ("",)),
            lambda: (f"978-{r.randint(0, 9)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}", ("number", "")),
            lambda: (f"{self.letters(6)}/{self.letters(7)}/{self.letters(8)}/{r.randint(1, 99)}", ("",)),
            lambda: (r.choice("-_/").join(self.word() for _ in range(r.randint(30, 200))) + f"-{r.randint(1, 99)}", ("",)),
            lambda: (self.grouped(*r.choice([(3, 3, 4), (4, 3, 4), (3, 4), (4, 4), (2, 3, 3)])), ("number",)),
            lambda: (self.spaced(self.digits(r.randint(12, 16)), r.choice(["", " ", "-"])), ("number",)),
            lambda: (f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}", ("number",)),
            lambda: (self.hexes(r.choice([32, 40, 64])), ("hash", "hash", "")),
            lambda: (f"{self.hexes(8)}-{self.hexes(4)}-{self.hexes(4)}-{self.hexes(4)}-{self.hexes(12)}", ("hash", "number", "")),
        ])())

    def text(self) -> tuple[str, int, int, str | None]:
        r = self.rng
        kind, body, contexts = self.personal() if r.random() < 0.5 else self.other()
        if kind == "account" and body[0].isdigit() and len(d := _digits(body)) >= 12 and luhn(d):
            kind = "card"
        context = r.choice(contexts)
        before = " ".join(self.word() for _ in range(r.randint(0, 4)))
        before += " " * bool(before)
        if context:
            before += r.choice(sorted(CONTEXT[context]))
            if r.random() < 0.4:
                before += "".join(" " + r.choice(sorted(CONTEXT["weak"])) for _ in range(r.randint(1, 2)))
            before += r.choice([" ", " ", " ", ": ", ". "] + [" = ", " = \"", "='"] * (context in ("secret", "hash")))
        elif kind is None and r.random() < 0.1:
            before += r.choice("$€£#")
        text = before + body + r.choice(["", "\"", ".", ",", "!!", "***"]) + " " + self.word()
        return text, len(before), len(before) + len(body), kind


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the wider candidates of n written texts, whether each is
    personal and of its kind, and the kinds. Base spans need no judgement."""
    writer = Writer(seed)
    rows, right, kinds = [], [], []
    for _ in range(n):
        text, start, end, truth = writer.text()
        for name, kind, s, e in propose(text, base_spans(text)):
            if name not in BASE_KINDS:
                rows.append(features(text, name, s, e))
                right.append(float(kind == truth and min(e, end) - max(s, start) >= 0.8 * max(e - s, end - start)))
                kinds.append(kind)
    return np.array(rows, float), np.array(right), np.array(kinds)


class Judge:
    """Boosted trees, calibration and the threshold of each kind."""

    def __init__(self, examples: int = 6000, precision: float = 0.95):
        x, y, _ = _examples(examples, 7)
        self.trees = Boosted().fit(x, y)
        x, y, kinds = _examples(examples, 8)
        margin = self.trees.margin(x)
        self.calibrated = Calibrated(margin, y)
        p = self.calibrated(margin)
        self.least = {k: max(0.5, threshold(p[kinds == k], y[kinds == k], precision)) for k in KINDS}  # likelier than not at least

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        return self.calibrated(self.trees.margin(np.array(rows, float))) if rows else np.zeros(0)


@functools.cache
def judge() -> Judge:
    return Judge()


def report(examples: int = 6000, seed: int = 9) -> dict[str, tuple[int, float, float]]:
    """By kind: things, precision and recall of added spans on written examples
    that neither trees nor thresholds have seen. Texts in which a base pattern
    finds something are left out, as the trees decide nothing there."""
    writer, model = Writer(seed), judge()
    seen = [x for x in (writer.text() for _ in range(examples)) if not any(base_spans(x[0]).values())]
    things, taken, right = ({k: 0 for k in KINDS} for _ in range(3))
    for (_, start, end, truth), (_, spans) in zip(seen, _found([t for t, *_ in seen], model), strict=True):
        if truth:
            things[truth] += 1
        for kind, s, e in spans:
            taken[kind] += 1
            right[kind] += kind == truth and min(e, end) - max(s, start) >= 0.8 * max(e - s, end - start)
    return {k: (things[k], right[k] / max(1, taken[k]), right[k] / max(1, things[k])) for k in KINDS}


def choose(candidates: list[Candidate], p: np.ndarray, least: dict[str, float]) -> list[tuple[str, int, int]]:
    """Base spans, and accepted candidates that overlap none taken before."""
    chosen = [c[1:] for c in candidates if c[0] in BASE_KINDS]
    added = _Stretches([])
    order = sorted((i for i, c in enumerate(candidates) if p[i] >= least[c[1]] and c[0] not in BASE_KINDS), key=lambda i: (-p[i], candidates[i][2] - candidates[i][3], candidates[i][2]))
    for i in order:
        _, kind, s, e = candidates[i]
        if not added.meets(s, e):
            added.add(s, e)
            chosen.append((kind, s, e))
    return sorted(chosen, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


class _Stretches:
    """Disjoint stretches of a text in order."""

    def __init__(self, spans: list[Span]):
        """Rising spans; overlapping ones become one stretch."""
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in spans:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> None:
        """One that meets none."""
        at = bisect.bisect_left(self.starts, s)
        self.starts.insert(at, s)
        self.ends.insert(at, e)

    def meets(self, s: int, e: int) -> bool:
        at = bisect.bisect_right(self.ends, s)
        return at < len(self.starts) and self.starts[at] < e

    def within(self, s: int, e: int) -> bool:
        """Whether all that meet s to e lie inside it."""
        first, after = bisect.bisect_right(self.ends, s), bisect.bisect_left(self.starts, e)
        return first >= after or (self.starts[first] >= s and self.ends[after - 1] <= e)


def _found(texts: list[str], model: Judge) -> Iterator[tuple[dict[str, list[Span]], list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text; candidates are judged together."""
    bases = [base_spans(t) for t in texts]
    proposed = [propose(t, b) for t, b in zip(texts, bases, strict=True)]
    p = model.probabilities([features(t, c[0], c[2], c[3]) for t, cs in zip(texts, proposed, strict=True) for c in cs])
    at = 0
    for base, cs in zip(bases, proposed, strict=True):
        yield base, choose(cs, p[at : at + len(cs)], model.least)
        at += len(cs)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256
    (base spans) and spans (all of them)."""
    sent = df.sparkSession.sparkContext.broadcast(judge())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts: list[list[int]] = [[] for _ in BASE_KINDS]
                digests, spans = [], []
                for base, chosen in _found([t or "" for t in part.column(1).to_pylist()], sent.value):
                    for k, c in zip(BASE_KINDS, counts, strict=True):
                        c.append(len(base[k]))
                    digests.append(hashlib.sha256(_joined([(k, s, e) for k in BASE_KINDS for s, e in base[k]]).encode()).hexdigest())
                    spans.append(_joined(chosen))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = f"id {kept.schema['id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return kept.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, as [KIND]."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with spans masked; `length_col`, if there, is
    counted anew for texts that are not null."""
    sent = df.sparkSession.sparkContext.broadcast(judge())
    names = df.columns
    at_text = names.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(at_text).to_pylist()
                new = [None if t is None else masked(t, spans) for t, (_, spans) in zip(texts, _found([t or "" for t in texts], sent.value), strict=True)]
                columns = part.columns
                columns[at_text] = pa.array(new, columns[at_text].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = df.mapInArrow(run, df.schema)
    if length_col and length_col in names:
        counted = F.coalesce(F.char_length(F.col(f"`{text_col}`")).cast(df.schema[length_col].dataType), F.col(f"`{length_col}`"))
        out = out.withColumn(length_col, counted)
    return out
