"""Piece patterns and material over lines of positions.

A position's pieces are 12 bitboards wp wn wb wr wq wk bp bn bb br bq bk (bit 0 is a1). A
pattern compiles to one Column; runs of consecutive plies are found by gaps and islands; the
masks of a game (all squares ever held, least and most of each kind) sort out games first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grammar import BadRequest

KINDS = "pnbrqk"
#: Counts of a mask row end here: as many or more.
MOST = 15
BOARDS = tuple(s + k for s in "wb" for k in KINDS)
_PIECES = re.compile(r"([PNBRQKpnbrqk])([a-h][1-8])$")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _square(text: str) -> int:
    return ord(text[0]) - 97 + 8 * (int(text[1]) - 1)


def _flip(bits: int, files: bool) -> int:
    out = 0
    for s in range(64):
        if bits >> s & 1:
            out |= 1 << (s ^ 7 if files else s ^ 56)
    return out


@dataclass(frozen=True)
class Pattern:
    look: dict = field(default_factory=dict)  # board -> squares that must hold it
    any_of: dict = field(default_factory=dict)
    exclude: dict = field(default_factory=dict)
    no_white: int = 0
    no_black: int = 0

    def mirrored(self, files: bool) -> Pattern:
        """By files, or by ranks with the colours swapped."""
        turn = lambda m: {(k if files else ("b" if k[0] == "w" else "w") + k[1]): _flip(v, files) for k, v in m.items()}
        w, b = _flip(self.no_white, files), _flip(self.no_black, files)
        return Pattern(turn(self.look), turn(self.any_of), turn(self.exclude), *((w, b) if files else (b, w)))


def pieces(text: str, name: str) -> dict[str, int]:
    """`Kg1,pe4` -> squares of each board."""
    out: dict[str, int] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = _PIECES.match(part)
        if not m:
            raise BadRequest(name)
        board = ("w" if m[1].isupper() else "b") + m[1].lower()
        out[board] = out.get(board, 0) | 1 << _square(m[2])
    return out


def squares(text: str, name: str) -> int:
    out = 0
    for part in filter(None, (p.strip() for p in text.split(","))):
        if not re.match(r"[a-h][1-8]$", part):
            raise BadRequest(name)
        out |= 1 << _square(part)
    return out


def material(text: str) -> dict[str, tuple[int, int]]:
    """`Q0,q0,R1..2,p..4` -> range of each board; unnamed ones are free."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.match(r"([PNBRQpnbrq])(?:(\d+)?(\.\.)(\d+)?|(\d+))$", part)
        if not m:
            raise BadRequest("material")
        low, high = (int(m[5]), int(m[5])) if m[5] else (int(m[2] or 0), int(m[4] or 16))
        if low > high or high > 16:
            raise BadRequest("material")
        out[("w" if m[1].isupper() else "b") + m[1].lower()] = (low, high)
    return out


def variants(p: Pattern, mirror: str) -> list[Pattern]:
    found = [p]
    if mirror in ("horizontal", "both"):
        found += [x.mirrored(True) for x in found]
    if mirror in ("vertical", "both"):
        found += [x.mirrored(False) for x in found]
    if mirror not in ("none", "horizontal", "vertical", "both"):
        raise BadRequest("mirror")
    return [x for i, x in enumerate(found) if x not in found[:i]]


def _on(board: str, bits: int) -> Column:
    return F.col(board).bitwiseAND(F.lit(_signed(bits)))


def _side(side: str) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.col(side + k) for k in KINDS))


def holds(p: Pattern) -> Column:
    parts = [_on(b, s) == _signed(s) for b, s in p.look.items()]
    parts += [_on(b, s) == 0 for b, s in p.exclude.items()]
    if p.no_white:
        parts.append(_side("w").bitwiseAND(F.lit(_signed(p.no_white))) == 0)
    if p.no_black:
        parts.append(_side("b").bitwiseAND(F.lit(_signed(p.no_black))) == 0)
    if p.any_of:
        parts.append(reduce(or_, (_on(b, s) != 0 for b, s in p.any_of.items())))
    return reduce(and_, parts, F.lit(True))


def matches(patterns: list[Pattern], ranges: dict[str, tuple[int, int]]) -> Column:
    """The material, which never mirrors, and any of the variants."""
    m = [F.bit_count(b).between(*r) for b, r in ranges.items()]
    return reduce(and_, m, reduce(or_, (holds(p) for p in patterns)))


def first_run(plies: DataFrame, hit: Column, length: int = 1, first: int = 1, last: int = 1 << 30, move_number: Column | None = None) -> DataFrame:
    """(number, ply): where the first stretch of `length` consecutive plies on which hit holds
    begins, its move numbers within [first, last]."""
    n = move_number if move_number is not None else (F.floor(F.col("ply") / 2) + 1)
    good = plies.where(hit & n.between(first, last)).select("number", "ply")
    island = F.col("ply") - F.row_number().over(Window.partitionBy("number").orderBy("ply"))
    runs = good.withColumn("_i", island).groupBy("number", "_i").agg(F.min("ply").alias("ply"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= length).groupBy("number").agg(F.min("ply").cast("int").alias("ply"))


def masks(plies: DataFrame) -> DataFrame:
    """One row a game: union of each board over its line, least and most of each kind, 15 being
    15 or more."""
    aggs = []
    for b in BOARDS:
        aggs += [F.bit_or(b).alias(b), *(F.least(f(F.bit_count(b)), F.lit(MOST)).cast("tinyint").alias(f"{n}_{b}") for n, f in (("least", F.min), ("most", F.max)))]
    return plies.groupBy("number").agg(*aggs)


def possible(patterns: list[Pattern], ranges: dict[str, tuple[int, int]]) -> Column:
    """False only for games no position of which can match."""
    one = []
    for p in patterns:
        parts = [_on(b, s) == _signed(s) for b, s in p.look.items()]
        if p.any_of:
            parts.append(reduce(or_, (_on(b, s) != 0 for b, s in p.any_of.items())))
        one.append(reduce(and_, parts, F.lit(True)))
    m = [(F.col(f"least_{b}") <= hi) & (F.col(f"most_{b}") >= min(lo, MOST)) for b, (lo, hi) in ranges.items()]
    return reduce(and_, m, reduce(or_, one))


def search(plies: DataFrame, look="", no_white="", no_black="", any_of="", exclude="", material_text="", mirror="none", first=1, last=1 << 30, length=1, game_masks: DataFrame | None = None) -> DataFrame:
    p = Pattern(pieces(look, "look"), pieces(any_of, "or"), pieces(exclude, "exclude"), squares(no_white, "nowhite"), squares(no_black, "noblack"))
    ps, ranges = variants(p, mirror), material(material_text)
    if game_masks is not None:
        plies = plies.join(game_masks.where(possible(ps, ranges)).select("number"), "number", "left_semi")
    return first_run(plies, matches(ps, ranges), length, first, last, F.col("move_number") if "move_number" in plies.columns else None)


def structure() -> Column:
    """A hash of what only a pawn move or a capture changes: each side's pawns, and its pieces by
    kind. Equal structures have equal hashes; an answer compares positions too."""
    return F.xxhash64("wp", "bp", *(F.bit_count(side + kind) for kind in "nbrq" for side in "wb"))
