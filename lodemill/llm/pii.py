"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every kind has a pattern, a validator (Luhn for payment cards, mod-97 for IBANs, digit counts,
byte ranges, the spread of a secret's characters) and a base score; context words within a window
raise it. Spans whose score reaches the threshold are kept. The four base kinds reach it without
context, so they are found by pattern and validator alone; the others need a checksum or a
context word.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodemill.llm.common import map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "national_phone", "secret")
KINDS = BASE_KINDS + MORE_KINDS
#: Score from which a span is kept, what a context word adds, and the characters around a span that are looked at.
THRESHOLD, CONTEXT_ADDS, WINDOW = 0.5, 0.35, 48

BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.3, "national_phone": 0.3, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "national_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential"),
}

#: The part of an address from the sign on; what stands before it is taken from the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A number fails wherever in its digits it is begun, so one start is enough.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20]?|[0-9]{3,4}[-\x20])[0-9]{3}[-\x20][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_HINT = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of an IBAN, without spaces, hold."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _is_ip(found: str) -> bool:
    return all(map(_byte, found.split(".")))


def _is_card(found: str) -> bool:
    digits = _digits(found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(found: str) -> bool:
    return 9 <= len(_digits(found)) <= 15


def _is_iban(found: str) -> bool:
    return 15 <= len(plain := found.replace(" ", "")) <= 34 and mod97(plain)


def _is_secret(found: str) -> bool:
    """Letters and digits, spread as evenly as random ones are: 3 bits a character at least."""
    if not re.search("[A-Za-z]", found) or not re.search("[0-9]", found):
        return False
    return sum(n * math.log2(len(found) / n) for n in Counter(found).values()) >= 3 * len(found)


_RULES = {"ip": (_IP, _is_ip), "card": (_CARD, _is_card), "phone": (_PHONE, _is_phone), "iban": (_IBAN, _is_iban), "ssn": (_SSN, None), "national_phone": (_NATIONAL, None), "secret": (_SECRET, _is_secret)}


def _valid(kind: str, text: str) -> Iterator[tuple[int, int]]:
    pattern, valid = _RULES[kind]
    return (m.span() for m in pattern.finditer(text) if valid is None or valid(m.group()))


class Taken:
    """Parts of a text that spans cover, in order and apart from each other."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)  # the first part that ends after a
        return k == len(self.starts) or self.starts[k] >= b


def context_score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start].lower() + "\n" + text[end : end + WINDOW].lower()
    hit = any(re.search(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", near) for w in CONTEXT[kind])
    return min(1.0, BASE_SCORE[kind] + CONTEXT_ADDS * hit)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Kept spans (kind, start, end, score), by kind and then by start; ends are exclusive."""
    if not text or not _HINT.search(text):
        return []
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for kind in BASE_KINDS[1:]:
        if kind != "phone" or "+" in text:
            out += [(kind, a, b) for a, b in _valid(kind, text)]
    taken = Taken(out)
    for kind in MORE_KINDS:  # what has been found already isn't found again
        spans = [(kind, a, b) for a, b in _valid(kind, text) if taken.free(a, b)]
        if spans:
            out += spans
            taken = Taken(out)
    scored = [(k, a, b, context_score(k, text, a, b)) for k, a, b in out]
    return [s for s in scored if s[3] >= THRESHOLD]


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", details: bool = True) -> DataFrame:
    """Personal data in each whole text.

    Returns ``id_col``, counts of the base kinds, ``base_sha256`` (of the base spans as text),
    ``spans`` (all spans as text), ``n_secret``, ``n_spans`` (of all kinds) and, with ``details``, ``found``: kind, start, end and score of
    each. A null or empty text has none. Rows are independent of each other and of other columns.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in f if s[0] in BASE_KINDS] for f in found]
            columns = {id_col: batch.column(0)}
            for k in BASE_KINDS:
                columns[f"n_{k}"] = pa.array([sum(s[0] == k for s in f) for f in found], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            columns["spans"] = pa.array([joined(f) for f in found], pa.string())
            columns["n_secret"] = pa.array([sum(s[0] == "secret" for s in f) for f in found], pa.int64())
            columns["n_spans"] = pa.array([len(f) for f in found], pa.int64())
            if details:
                columns["found"] = pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], shape)
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, " + "".join(f"n_{k} long, " for k in BASE_KINDS) + "base_sha256 string, spans string, n_secret long, n_spans long"
    return map_arrow(docs.select(id_col, text_col), run, schema + (", found array<struct<kind:string,start:int,end:int,score:double>>" if details else ""))
