"""Query -> one Column over resolved records (P4-P20). Catalyst does the rest: the dimensions a
query needs are told by needs(), and everything is two-valued, so negation is plain `~`."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import Query, Term, Value

#: Columns of each field, by which a search knows the dimensions to join.
NAMES = {"": ("white", "black", "event", "annotator"), "white": ("white",), "black": ("black",), "player": ("white", "black"), "event": ("event",), "annotator": ("annotator",), "tc": ("tc",)}
#: Fields that texts and analyses have too; date and moves are fields of games and analyses.
SHARED, DATED = frozenset({"", "event", "annotator"}), frozenset({"date", "moves"})
TC_BITS = {"normal": 0, "blitz": 0x20, "rapid": 0x40, "correspondence": 0x80, "corr": 0x80}
_DATE = re.compile(r"(\d{4})(?:[-./](\d{1,2})(?:[-./](\d{1,2}))?)?$")


def needs(q: Query) -> set[str]:
    return {c for t in q.terms for c in NAMES.get(t.field, ())} | ({q.sort[0]} & {"white", "black", "event", "annotator"} if q.sort else set())


def typed_date(text: str) -> str | None:
    """2024-3 -> 2024.03; None if it isn't a date."""
    m = _DATE.match(text)
    if not m or (m[2] and not 1 <= int(m[2]) <= 12) or (m[3] and not 1 <= int(m[3]) <= 31):
        return None
    return ".".join([m[1], *(f"{int(x):02d}" for x in m.groups()[1:] if x)])


def _has(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


def _integer(text: str) -> int | None:
    return max(-(1 << 31), min((1 << 31) - 1, int(text))) if re.fullmatch(r"[+-]?\d+", text) else None


def _number(c: Column, v: Value) -> Column:
    low = _integer(v.low)
    high = _integer(v.high) if v.op == ".." else low
    if low is None or high is None:
        return F.lit(False)
    return {"": c == low, "<": c < low, "<=": c <= low, ">": c > low, ">=": c >= low, "..": c.between(low, high)}[v.op]


def _covering(c: Column, v: Value, low: str, high: str) -> Column:
    """Text comparison in which a bound covers all that starts with it."""
    return {"<": c < low, "<=": c <= low + "~", ">": c > low + "~", ">=": c >= low, "..": (c >= low) & (c <= high + "~")}[v.op]


def _date(v: Value) -> Column:
    c = F.col("date_text")
    low = typed_date(v.low)
    if v.op == "":
        return F.startswith(c, F.lit(low)) if low else F.contains(c, F.lit(v.low))
    high = typed_date(v.high) if v.op == ".." else low
    if low is None or high is None:
        return F.lit(False)
    return ~F.contains(F.substring(c, 1, max(len(low), len(high))), F.lit("?")) & _covering(c, v, low, high)


def _test(fld: str, v: Value) -> Column:
    if fld in NAMES and fld != "tc":
        return reduce(or_, (_has(c, v.low) for c in NAMES[fld]))
    if fld == "round":
        return F.contains(F.col("round_text"), F.lit(v.low))
    if fld == "result":
        return F.col("result") == v.low
    if fld == "eco":
        c = F.coalesce(F.col("eco"), F.lit(""))
        low, high = v.low.upper(), v.high.upper()
        return (c != "") & (F.startswith(c, F.lit(low)) if v.op == "" else _covering(c, v, low, high))
    if fld == "date":
        return _date(v)
    if fld == "moves":
        return _number(F.col("moves"), v)
    if fld == "elo":
        return reduce(or_, ((F.col(c) > 0) & _number(F.col(c), v) for c in ("white_elo", "black_elo")))
    if fld in ("white_elo", "black_elo"):
        return (F.col(fld) > 0) & _number(F.col(fld), v)
    bits = TC_BITS.get(v.low.lower())
    if bits is None:
        return F.lit(False)
    return (F.col("tc").bitwiseAND(F.lit(bits)) != 0) if bits else F.col("tc") == 0


def _term(t: Term) -> Column:
    hit = F.coalesce(reduce(or_, (_test(t.field, v) for v in t.values)), F.lit(False))
    return ~hit if t.negated else hit


def predicate(q: Query) -> Column:
    """All terms hold; a term on a field that a kind lacks leaves the kind out, negated or not."""
    parts = [_term(t) for t in q.terms]
    fields = {t.field for t in q.terms}
    if fields - SHARED - DATED:
        parts.insert(0, F.col("kind") == "game")
    elif fields & DATED:
        parts.insert(0, F.col("kind") != "text")
    return reduce(and_, parts, F.lit(True)) if parts else F.lit(True)
