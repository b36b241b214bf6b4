"""Personal data in whole texts: base patterns, and a semi-Markov conditional random field.

Base patterns (email, ip, card, phone) are matched leftmost and without overlaps, each kind on
its own; a match that fails its check is dropped and not retried. Each matcher is linear in the
text: it works inside maximal runs of the characters that its pattern can hold.

The field looks at windows of tokens around digits, ``@`` and spelled-out at signs. Candidate
segments of 1 to ``LONGEST`` tokens carry features of the whole span (digit count, checksum,
separators, shape, the word before), and a dynamic programme over segments and labels chooses
boundaries and types together. Its weights come from likelihood training on generated
sentences (seeded, made here), with the forward-backward sums of the same programme. What it
finds beside the base spans is added: digits in groups without a plus sign, obfuscated email
addresses. Base spans always stay; a found span that touches one is not added.

Defined results: null text is the empty text and has no span; repeated rows are scanned as
often as they come; other columns are ignored; an empty table gives an empty result; offsets
are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, slices

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.I)


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", free)


def _ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at, i = [m.start()], 0
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield "ip", at[i], at[i + 4] - 1
            i += 4


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind as listed, then start."""
    out = list(_emails(text)) if "@" in text else []
    if "." in text:
        out += _ips(text)
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PLUS.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Tokens and windows ---------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9@._%+()\[\]-]*[A-Za-z0-9)\]]|\S")
_AT_WORDS = {"[at]", "(at)", "at", "[dot]", "(dot)", "dot"}
_CUES = {"tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "mail": "email", "email": "email", "e-mail": "email", "contact": "email", "card": "card", "visa": "card", "mastercard": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip"}
#: Text on each side of a sign that a window may take in, and the gap that parts two windows.
_AROUND = 80


def windows(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of tokens around signs of personal data, one context token on each side."""
    spots = [m.start() for m in _SIGN.finditer(text)]
    i = 0
    while i < len(spots):
        j = i
        while j + 1 < len(spots) and spots[j + 1] - spots[j] <= _AROUND:
            j += 1
        a, b = max(0, spots[i] - _AROUND), min(len(text), spots[j] + _AROUND)
        tokens = [(m[0], a + m.start(), a + m.end()) for m in _TOKEN.finditer(text[a:b])]
        marked = [k for k, t in enumerate(tokens) if any(c.isdigit() or c == "@" for c in t[0]) or t[0].lower() in _AT_WORDS]
        k = 0
        while k < len(marked):
            e = k
            while e + 1 < len(marked) and marked[e + 1] - marked[e] <= 2:
                e += 1
            run = tokens[max(0, marked[k] - 1) : marked[e] + 2]
            joined = "".join(t for t, *_ in run)
            if sum(c.isdigit() for c in joined) >= 4 or "@" in joined or any(t[0].lower() in ("[at]", "(at)") for t in run):
                yield run
            k = e + 1
        i = j + 1


# The field ------------------------------------------------------------------------------

_CLOSED = re.compile(r"[0-9 ().+-]+")
_SPELLED = re.compile(r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[\w-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]+)+", re.I)
LABELS = ("", *KINDS)


def span_features(text: str, tokens: list[tuple[str, int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j (exclusive) of a window in ``text``."""
    span = text[tokens[i][1] : tokens[j - 1][2]]
    digits = _digits(span)
    n, closed = len(digits), bool(_CLOSED.fullmatch(span))
    before = tokens[i - 1][0].lower().rstrip(":.") if i else ""
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    out = [f"tokens{j - i}", f"closed{closed}", f"digits{n if closed else min(n, 1)}", f"plus{span[0] == '+'}", f"cue{_CUES.get(before, '')}"]
    out.append("groups" + "-".join(map(str, groups[:6])) if closed else "open")
    out.append(f"seps{''.join(sorted(set(span) & set(' .()-/:,')))}" if closed else "letters")
    if closed and 13 <= n <= 19:
        out.append(f"luhn{luhn(digits)}")
    if span.count(".") == 3 and all(p.isdecimal() and int(p[:4]) <= 255 for p in span.split(".")):
        out.append("quad")
    if _SPELLED.fullmatch(span):
        out.append("spelled")
    if "\n" in span:
        out.append("line")
    if closed and (n == 10 and groups in ([3, 3, 4],) or n == 11 and groups == [1, 3, 3, 4]):
        out.append("dialled")
    return out


def _eligible(tokens: list[tuple[str, int, int]], i: int, j: int) -> bool:
    return all(any(c.isalnum() for c in tokens[k][0]) for k in (i, j - 1))


class Field:
    """Label weights by feature, and between the labels of neighbouring segments."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, follow: np.ndarray):
        self.number, self.weights, self.follow = number, weights, follow

    def segments(self, text: str, tokens: list[tuple[str, int, int]]) -> dict[tuple[int, int], list[int]]:
        number, out = self.number, {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
                if j == i + 1 or _eligible(tokens, i, j):
                    out[i, j] = [number[f] for f in span_features(text, tokens, i, j) if f in number]
        return out

    def scores(self, found: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], np.ndarray]:
        """A score for each segment and label; other text is one token long."""
        out = {}
        for (i, j), f in found.items():
            s = self.weights[f].sum(0)
            if j > i + 1:
                s[0] = -np.inf
            out[i, j] = s
        return out

    def best(self, text: str, tokens: list[tuple[str, int, int]]) -> list[Span]:
        """The most probable segmentation's labelled spans."""
        scores, n = self.scores(self.segments(text, tokens)), len(tokens)
        top = np.full((n + 1, len(LABELS)), -np.inf)
        back: dict[tuple[int, int], tuple[int, int]] = {}
        top[0, 0] = 0
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                if (i, j) not in scores:
                    continue
                step = top[i][:, None] + self.follow + scores[i, j][None]
                source = step.argmax(0)
                value = step[source, np.arange(len(LABELS))]
                for y in np.flatnonzero(value > top[j]):
                    top[j, y] = value[y]
                    back[j, int(y)] = i, int(source[y])
        out, j, y = [], n, int(top[n].argmax())
        while j > 0:
            i, prior = back[j, y]
            if y:
                out.append((LABELS[y], tokens[i][1], tokens[j - 1][2]))
            j, y = i, prior
        return out[::-1]


def _lse(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = np.maximum(x.max(axis=axis), -1e30)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _sentences(count: int) -> list[tuple[str, list[Span]]]:
    """Generated training sentences with their true spans; seeded."""
    r = random.Random(20_260)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = r.choice("3456") + num(r.choice((12, 14, 14, 14)))
        d = head + next(c for c in "0123456789" if luhn(head + c))
        s = r.choice(("", "", " ", "-", "."))
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c, s = num(3), num(3), num(4), r.choice("- .")
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"1-{a}-{b}-{c}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"+{num(11)}", f"({a}){b}-{c}"))

    def email() -> str:
        at, dot = r.choice((("@", "."), ("@", "."), (" [at] ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", ".")))
        return f"{word()}.{num(2)}{at}{word()}{num(1)}{dot}{r.choice(('com', 'org', 'net'))}"

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    hexed = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    other = (lambda: num(4), lambda: num(r.randint(5, 12)), lambda: num(16), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(3)}.{num(2)}", hexed, lambda: word() + num(3), lambda: f"{num(3)}-{num(3)}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}", lambda: f"{num(1)} {num(2)} {num(3)}", lambda: f"{num(4)}-{num(4)}-{num(4)}", lambda: f"{word()} at {word()}{num(4)}", lambda: f"@{word()}{num(4)}")
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    cues = {k: [c for c, of in _CUES.items() if of == k] for k in KINDS}
    out = []
    for i in range(count):
        text, spans = word(), []
        for _ in range(r.choice((1, 1, 2))):
            kind = KINDS[i % 4] if r.random() < 0.55 else None
            text += " " + (r.choice(cues[kind]) if kind and r.random() < 0.2 else word()) + " "
            value = make[kind]() if kind else r.choice(other)()
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
        out.append((text + r.choice((" ", ". ", ", ")) + word(), spans))
    return out


@cache
def train(count: int = 260, rounds: int = 30, decay: float = 2e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps; expectations by forward and backward sums."""
    data, number = [], {}
    for text, spans in _sentences(count):
        tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
        true = {(a, b): k for k, a, b in spans}
        segments, gold, j = {}, [], 0
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
                if j == i + 1 or _eligible(tokens, i, j):
                    segments[i, j] = [number.setdefault(f, len(number)) for f in span_features(text, tokens, i, j)]
        i = 0
        while i < len(tokens):
            end = next((j for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1) if (tokens[i][1], tokens[j - 1][2]) in true), 0)
            gold.append((i, end or i + 1, LABELS.index(true[tokens[i][1], tokens[end - 1][2]]) if end else 0))
            i = end or i + 1
        data.append((len(tokens), segments, gold))
    k = len(LABELS)
    field = Field(number, np.zeros((len(number), k)), np.zeros((k, k)))
    squares, squares2 = np.full_like(field.weights, 1e-6), np.full_like(field.follow, 1e-6)
    for _ in range(rounds):
        slope, slope2 = -decay * len(data) / 10 * field.weights, -decay * field.follow
        for n, segments, gold in data:
            scores = field.scores(segments)
            ahead, behind = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
            ahead[0, 0], behind[n] = 0, 0
            for j in range(1, n + 1):
                terms = [_lse(ahead[i][:, None] + field.follow) + scores[i, j] for i in range(max(0, j - LONGEST), j) if (i, j) in scores]
                ahead[j] = _lse(np.array(terms))
            for i in range(n - 1, -1, -1):
                terms = [_lse(field.follow + (scores[i, j] + behind[j])[None], axis=1) for j in range(i + 1, min(i + LONGEST, n) + 1) if (i, j) in scores]
                behind[i] = _lse(np.array(terms))
            total = _lse(ahead[n])
            for (i, j), s in scores.items():
                p = np.exp(ahead[i][:, None] + field.follow + (s + behind[j])[None] - total)
                slope2 -= p
                slope[segments[i, j]] -= p.sum(0)
            prior = 0
            for i, j, y in gold:
                slope[segments[i, j], y] += 1
                slope2[prior, y] += 1
                prior = y
        squares += slope**2
        squares2 += slope2**2
        field.weights += 0.5 * slope / np.sqrt(squares)
        field.follow += 0.2 * slope2 / np.sqrt(squares2)
    return field


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by kind as listed, then start."""
    if not _SIGN.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    found: dict[tuple[int, int], str] = {}
    for window in windows(text):
        for kind, a, b in field.best(text, window):
            if not any(x < b and a < y for x, y in taken):
                found.setdefault((a, b), kind)
    added: list[Span] = []
    last = -1
    for (a, b), kind in sorted(found.items()):
        if a >= last:
            added.append((kind, a, b))
            last = b
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    names = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = spans_of(text or "", field)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*rows, strict=True))])

    kind = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with the same columns, its texts masked and ``n_chars`` theirs, where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, "text"):
            masked = [None if t is None else mask(t, spans_of(t, field)[1]) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


_SQL_LUHN = "list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse({d})[i + 1] AS INTEGER) ELSE (2 * CAST(reverse({d})[i + 1] AS INTEGER)) % 10 + (2 * CAST(reverse({d})[i + 1] AS INTEGER)) // 10 END)) % 10 = 0"
_SQL_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
#: The counts of base spans alone, for DuckDB.
BASE_SQL = rf"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
 CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0)) AS BIGINT) AS n_ip,
 CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: {_SQL_DIGITS}), lambda x: length(x) BETWEEN 13 AND 19 AND {_SQL_LUHN.format(d="x")})) AS BIGINT) AS n_card,
 CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_SQL_DIGITS}) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
