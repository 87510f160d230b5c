"""Private-use code points of chess fonts as Unicode signs (S16), and language codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that stand for a sign, and the sign.
SIGNS = {
    "\ue000": "⯹",
    "\ue001": "⮺",
    "\ue002": "⮻",
    "\ue004": "⩱",
    "\ue007": "⩲",
    "\ue008": "⯽",
    "\ue009": "∞",
    "\ue00a": "±",
    "\ue00c": "⌓",
    "\ue00d": "△",
    "\ue00e": "⟪",
    "\ue00f": "⟫",
    "\ue010": "×",
    "\ue012": "↑",
    "\ue013": "→",
    "\ue017": "⇆",
    "\ue018": "⇔",
    "\ue019": "⇗",
    "\ue01a": "∓",
    "\ue01d": "⨀",
    "\ue01e": "⊞",
    "\ue01f": "⊥",
    "\ue021": "□",
    "\ue023": "○",
    "\ue024": "♔",
    "\ue025": "♕",
    "\ue026": "♖",
    "\ue027": "♗",
    "\ue028": "♘",
    "\ue029": "♙",
    "\ue02e": "⩱",
    "\ue02f": "⩲",
}
#: Fixed value: asks for a diagram and is not shown.
DIAGRAM = "\ue005"
# The letters that the signs were, next to a Cyrillic letter.
LETTERS = {"\ue004": "і", "\ue02e": "і", "\ue007": "І", "\ue02f": "І", "\ue008": "ю", "\ue009": "ч"}
# Words of a layout between runs of marks, and what they stand for.
LAYOUT = {"startbracket": "(", "endbracket": ")", "startsquare": "[", "endsquare": "]", "startfen": "[FEN ", "endfen": "]", "linkstart": "", "linkend": ""}
MARK = "\ue02d"

# Language numbers and their codes.
LANGUAGES = {0: "en", 1: "de", 2: "fr", 3: "es", 4: "it", 5: "nl", 6: "pt", 7: "any", 12: "pl", 18: "el"}

_LETTER = r"[\x{400}-\x{4ff}&&\p{IsAlphabetic}]"
_SMALL = r"[\x{400}-\x{4ff}&&\p{IsLowercase}]"
#: Noncharacters: hold a letter's place until all neighbours have been looked at.
_HELD = {letter: chr(0xFDD0 + i) for i, letter in enumerate(dict.fromkeys([*LETTERS.values(), "Ч"]))}
_FENCE = "\ufddf"


def layout_read(c: Column, mark: str = MARK, least: int = 1) -> Column:
    """Words of a layout between runs of at least `least` marks as the brackets they stand for
    (mark @ and 2 in a PGN comment). Only the start of a run is tried, and runs are taken whole,
    so a long one is read once; unknown words stay with their marks."""
    run = f"{mark}{{{least},}}+"
    c = F.regexp_replace(c, f"(?i)(?<!{mark}){run}({'|'.join(LAYOUT)}){run}", f"{_FENCE}$1{_FENCE}")
    return reduce(lambda x, kv: F.regexp_replace(x, f"(?i){_FENCE}{kv[0]}{_FENCE}", kv[1].replace("[", r"\[")), LAYOUT.items(), c)


def signs_read(c: Column) -> Column:
    """Text with its signs: letters first, by the neighbours as stored; then layout, then the
    rest one by one. Unknown code points stay."""
    for sign, letter in LETTERS.items():
        c = F.regexp_replace(c, f"(?<={_LETTER}){sign}|{sign}(?={_LETTER})", _HELD[letter])
    c = F.regexp_replace(c, rf"(?<![\p{{IsAlphabetic}}\p{{N}}])×(?={_SMALL}{{2}})", _HELD["Ч"])
    one = SIGNS | {held: letter for letter, held in _HELD.items()}
    return F.translate(layout_read(c), "".join(one) + DIAGRAM, "".join(one.values()))


def language_code(n: Column) -> Column:
    """ISO 639-1 of a language number, `any`, `cb-<nation>` from 256 on, else `cb-l<number>`."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    other = F.when(n >= 0x100, F.concat(F.lit("cb-"), (n - 0x100).cast("string"))).otherwise(F.concat(F.lit("cb-l"), n.cast("string")))
    return F.coalesce(F.try_element_at(known, n.cast("int")), other)


def language_number(code: Column) -> Column:
    """The number of an ISO 639-1 code in any case; null for others."""
    known = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() if v != "any" for x in (v, k)))
    return F.try_element_at(known, F.lower(code))
