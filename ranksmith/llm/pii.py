"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over a text once and stops at anchors: at-signs, plus signs,
digits, URL schemes and identifier cues. From an anchor a local parser expands to the
boundaries of an e-mail address, network address, card, phone, URL with credentials, account
number or secret, and validates it. The parsers for e-mail, ip, card and phone give the
leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)        parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                         12 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                    9 to 15 digits

and a match that fails its test is consumed and dropped. Cues, in any case, add the kinds url
(with credentials), account and secret. A secret's value must look generated: a digit and a
letter, or letters of both cases and one of !@#$%^&*?~, and MIN_BITS bits of entropy a
character, closing punctuation apart. An account number needs a label (`no`, a colon) before 6
digits or more, or else 9 digits; dates and spans of years are none; an IBAN must pass its check
sum. Positions are code points, ends exclusive. One pass, no shuffle.

Null and empty texts have no spans. Repeated rows are each searched; null ids are kept; other
columns are ignored by find_spans and kept by redact. Work is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = 4
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+@[^\s/?#]+[^\s]*")
_ACCOUNT = re.compile(r"((?: ?(?:no|nr|number|nummer|num)\b\.?)?[ :#=]{1,3})([A-Z]{0,2}[0-9][A-Z0-9 -]{4,32}[0-9])(?![A-Za-z0-9])", re.I)
_DATES = re.compile(r"(?:19|20)[0-9]{2}[ /-]+(?:19|20)[0-9]{2}$|[0-9]{4}-[0-9]{2}-[0-9]{2}$|[0-9]{2}-[0-9]{2}-[0-9]{4}$")
_IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']? ?[:=] ?[\"']?([^\s\"']{8,})")
MIN_BITS = 2.5

#: Cues, written in lower case; texts are searched in lower case.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn", "social security")
IBAN_CUES = ("iban",)
SECRET_CUES = ("api_key", "apikey", "api-key", "secret_key", "access_key", "secret", "password", "passwd", "token")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for tag, cues in (("s", SECRET_CUES), ("a", ACCOUNT_CUES), ("i", IBAN_CUES), ("u", SCHEMES)):
        for cue in cues:
            a.add_word(cue, (tag, len(cue)))
    a.make_automaton()
    return a


_SHARED: list[ahocorasick.Automaton] = []


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_A_TO_Z = {c: c + 32 for c in range(0x41, 0x5B)}


def _lower(text: str) -> str:
    """In lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_A_TO_Z)


def _generated(value: str) -> bool:
    """Whether a value looks like a key or a password rather than a word of the language."""
    digit, upper, lower = (any(f(c) for c in value) for f in (str.isdigit, str.isupper, str.islower))
    if not (digit and (upper or lower) or upper and lower and any(c in "!@#$%^&*?~" for c in value)):
        return False
    n = Counter(value)
    return -sum(k / len(value) * math.log2(k / len(value)) for k in n.values()) >= MIN_BITS


def _starts_word(text: str, at: int) -> bool:
    """Whether a cue at `at` is the start of a word, or of a part of a camel-case name."""
    return not at or not text[at - 1].isalnum() or text[at - 1].islower() and text[at].isupper()


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order; kind indexes KINDS."""
    if not _SHARED:
        _SHARED.append(_automaton())
    out: list[tuple[int, int, int]] = []
    mail = ip = card = phone = 0  # where each kind's search goes on
    taken = -1  # end of the last added span
    for at, (what, n) in _SHARED[0].iter(_lower(text)):
        if what == "d":
            if at >= card:
                m = _CARD.match(text, at)
                card = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        out.append((at, 2, card))
            if at >= ip:
                ip = _DIGITS.match(text, at).end()
                if text[ip : ip + 1] == "." and (m := _IP.match(text, at)):
                    ip = m.end()
                    if all(len(x) < 4 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                        out.append((at, 1, ip))
        elif what == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail = m.end()
                out.append((start, 0, mail))
        elif what == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, 3, phone))
        else:
            start = at - n + 1
            if not _starts_word(text, start) or at < taken:
                continue
            if what == "u":
                if m := _USERINFO.match(text, at + 1):
                    out.append((start, 4, taken := m.end()))
            elif what == "s":
                if (m := _SECRET.match(text, at + 1)) and len(value := m[1].rstrip(".,;:!?)")) >= 8 and _generated(value):
                    out.append((m.start(1), 6, taken := m.start(1) + len(value)))
            elif m := _IBAN.match(text, at + 1):
                if _iban_ok(m[1]):
                    out.append((m.start(1), 5, taken := m.end(1)))
            elif what == "a" and (m := _ACCOUNT.match(text, at + 1)) and not _DATES.match(m[2]):
                if sum(c.isdigit() for c in m[2]) >= (6 if m[1].strip(" ") else 9):
                    out.append((m.start(2), 5, taken := m.end(2)))
    return sorted(set(out))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's tag."""
    parts, last = [], 0
    i = 0
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        parts += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


SPANS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, the digest of their spans, all spans."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            tidy()
            for text in b.column(1):
                found = scan(text.as_py() or "")
                base = [x for x in found if x[1] < BASE_KINDS]
                for k in range(BASE_KINDS):
                    n[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with personal data in text_col replaced by tags; a null text stays null."""

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text_col)
            tidy()
            texts = [None if (t := x.as_py()) is None else redacted(t, scan(t)) for x in b.column(i)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(i).type) if j == i else c for j, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return find_spans(docs)
