"""Search text -> Query: terms with values, and the last valid sort token. Nothing is an error
but a refused qualifier (P0-P3, P18, O1, O2)."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_CHARS, MAX_TERMS, MAX_VALUE = 1024, 32, 256
REFUSED = frozenset({"tag", "created", "updated", "is", "has", "no"})
FIELDS = {
    "white": "white", "black": "black", "player": "player", "event": "event", "tournament": "event", "annotator": "annotator",
    "round": "round", "result": "result", "eco": "eco", "date": "date", "moves": "moves", "elo": "elo", "whiteelo": "white_elo",
    "blackelo": "black_elo", "timecontrol": "tc", "tc": "tc",
}
COMPARABLE = frozenset({"eco", "date", "moves", "elo", "white_elo", "black_elo"})
SORT_KEYS = {
    k.lower(): v
    for k, v in {
        "number": "number", "white": "white", "black": "black", "whiteElo": "white_elo", "blackElo": "black_elo", "result": "result",
        "moves": "moves", "eco": "eco", "tournament": "event", "event": "event", "date": "date", "pgndate": "date", "round": "round",
        "annotator": "annotator",
    }.items()
}
DESCENDING = frozenset({"date", "moves"})
#: Typed results that stand for a stored one.
RESULTS = {"draw": "1/2-1/2", "½": "1/2-1/2", "½-½": "1/2-1/2", "1/2": "1/2-1/2", "unknown": "*"}


class UnsupportedQualifier(ValueError):
    """A qualifier that this data can't answer."""


class BadRequest(ValueError):
    """A parameter that can't be read; the message names it."""


@dataclass(frozen=True)
class Value:
    """op is '' (plain), '<', '<=', '>', '>=' or '..'."""

    op: str
    low: str
    high: str = ""


@dataclass(frozen=True)
class Term:
    field: str  # '' for a bare word
    values: tuple[Value, ...]
    negated: bool = False


@dataclass
class Query:
    terms: list[Term] = field(default_factory=list)
    sort: tuple[str, bool] | None = None  # key, descending


def sort_key(text: str) -> tuple[str, bool] | None:
    """(key, descending) of `key`, `key-asc` or `key-desc`; None if there is no such key."""
    name, _, way = text.strip().lower().partition("-")
    key = SORT_KEYS.get(name)
    if key is None or way not in ("", "asc", "desc"):
        return None
    return key, way == "desc" or way == "" and key in DESCENDING


def _tokens(text: str):
    """(negated, qualifier or '', raw values, quoted) of each token."""
    i, n = 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
            continue
        negated = text[i] == "-" and i + 1 < n and not text[i + 1].isspace()
        i += negated
        j = i
        while j < n and text[j].isascii() and text[j].isalpha():
            j += 1
        name = text[i:j] if j > i and j < n and text[j] == ":" else ""
        at = j + 1 if name else i
        parts, cur, inside, quoted = [], [], False, at < n and text[at] == '"'
        while at < n and (inside or not text[at].isspace()):
            c = text[at]
            if c == '"':
                inside = not inside
            elif c == "," and name and not inside:
                parts.append("".join(cur))
                cur = []
            else:
                cur.append(c)
            at += 1
        parts.append("".join(cur))
        yield negated, name, parts, quoted
        i = at


def _value(fld: str, text: str) -> Value | None:
    if fld not in COMPARABLE:
        return Value("", RESULTS.get(text.lower(), text) if fld == "result" else text)
    for op in (">=", "<=", ">", "<"):
        if text.startswith(op):
            return Value(op, text[len(op) :].strip())
    low, dots, high = text.partition("..")
    if dots:
        low, high = (x.strip() if x.strip() != "*" else "" for x in (low, high))
        if not low and not high:
            return None
        return Value("..", low, high) if low and high else Value(">=", low) if low else Value("<=", high)
    return Value("", text)


def parse(text: str) -> Query:
    q = Query()
    for negated, name, parts, quoted in _tokens(text[:MAX_CHARS]):
        low = name.lower()
        if low in REFUSED:
            raise UnsupportedQualifier(low)
        if low == "sort":
            key = sort_key(parts[0]) if len(parts) == 1 else None
            if key and not negated:
                q.sort = key
            continue
        fld = FIELDS.get(low, "")
        if not fld:  # an unknown qualifier is part of the word
            word = (f"{name}:" if name else "") + ",".join(parts)
            if not name and not quoted and word.startswith("#"):
                word = word[1:]
            parts = [word]
        values = tuple(v for p in parts if (t := p.strip()[:MAX_VALUE]) and (v := _value(fld, t)))
        if values and len(q.terms) < MAX_TERMS:
            q.terms.append(Term(fld, values, negated))
    return q
