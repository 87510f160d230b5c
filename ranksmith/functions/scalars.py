"""Scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_text(y: Column, m: Column, d: Column) -> Column:
    """YYYY.MM.DD with ? for unknown parts."""
    part = lambda c, n: F.when(c > 0, F.lpad(c.cast("string"), n, "0")).otherwise("?" * n)
    return F.concat_ws(".", part(y, 4), part(m, 2), part(d, 2))


def packed_date(c: Column) -> tuple[Column, Column, Column]:
    """(y, m, d) of a packed date: day in bits 0-4, month in 5-8, year in 9-20."""
    return F.shiftright(c, 9).bitwiseAND(F.lit(0xFFF)), F.shiftright(c, 5).bitwiseAND(F.lit(15)), c.bitwiseAND(F.lit(31))


def round_text(r: Column, sub: Column) -> Column:
    return F.when(r <= 0, "").when(sub > 0, F.concat(r.cast("string"), F.lit("("), sub.cast("string"), F.lit(")"))).otherwise(r.cast("string"))


def eco_text(c: Column) -> Column:
    """A00..E99 of the stored code (128 times the opening's number plus one, plus a sub-code);
    null if there is none or the field holds a start position."""
    n = F.floor(c / 128).cast("int") - 1
    letter = F.chr((F.lit(65) + F.floor(n / 100)).cast("long"))
    return F.when((c >= 128) & (c <= 64127), F.concat(letter, F.lpad((n % 100).cast("string"), 2, "0")))


def result_text(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c.isin("1-0", "0-1", "1/2-1/2", "0-0"), c).when(c.isin("1/2", "½-½"), "1/2-1/2").otherwise("*")


def rating(c: Column) -> Column:
    n = F.regexp_extract(c, r"^\s*(\d{1,4})\s*$", 1).try_cast("int")
    return F.coalesce(n, F.lit(0))


def pgn_date(c: Column, part: str) -> Column:
    i = ("y", "m", "d").index(part)
    n = F.regexp_extract(c, r"^\s*(\d{4}|\?{1,4})(?:[./-](\d{1,2}|\?{1,2}))?(?:[./-](\d{1,2}|\?{1,2}))?\s*$", i + 1).try_cast("int")
    most = (4095, 12, 31)[i]
    return F.when(n.between(1, most), n).otherwise(0)


def pgn_round(c: Column, sub: bool = False) -> Column:
    n = F.regexp_extract(c, r"^\s*(\d{1,4})(?:[.(](\d{1,4}))?", 2 if sub else 1).try_cast("int")
    return F.coalesce(n, F.lit(0))


def time_control_bits(tag: Column) -> Column:
    """0 normal, 0x20 blitz, 0x40 rapid, 0x80 correspondence, by the tag's first period: its
    seconds and 60 times its increment, at most 600 blitz, under 3600 rapid."""
    t = F.trim(tag)
    form = r"^\*?(?:(\d{1,9})/)?(\d{1,9})(?:\+(\d{1,9}))?$"
    first = F.element_at(F.split(t, ":"), 1)
    read = first.rlike(form)
    n = lambda i: F.regexp_extract(first, form, i).try_cast("long")
    moves, base, inc = n(1), n(2), F.coalesce(n(3), F.lit(0))
    total = base + 60 * inc
    slow = ((moves > 0) & (F.try_divide(base, moves) >= 3600)) | (inc >= 3600)
    fast = F.when(F.coalesce(slow, F.lit(False)), 0x80).when(moves.isNull() & (total > 0) & (total <= 600) | moves.isNotNull() & (total > 0) & (total <= 600), 0x20).when((total > 0) & (total < 3600), 0x40)
    return F.coalesce(F.when(t == "-", 0x80).when(read, fast), F.lit(0))


def split_name(c: Column) -> tuple[Column, Column]:
    """(last, first) of `Last, First`."""
    at = F.instr(c, ",")
    return F.trim(F.when(at > 0, F.left(c, at - 1)).otherwise(c)), F.trim(F.when(at > 0, F.substr(c, at + 1)).otherwise(F.lit("")))


def unknown(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).isin("", "?", "-")


def clean_comment(c: Column) -> Column:
    """Braces become parentheses, controls spaces, runs of spaces one."""
    return F.trim(F.regexp_replace(F.translate(c, "{}", "()"), r"[\x00-\x20\x7f]+", " "))


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/", "-_"), F.lit("="))


def percent_encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def move_code(uci: Column) -> Column:
    """A move in 14 bits: from, to, and the promotion (queen, rook, bishop, knight as 0 to 3);
    0 is no move."""
    at = lambda i: F.ascii(F.substring(uci, i, 1)) - 97 + 8 * (F.ascii(F.substring(uci, i + 1, 1)) - 49)
    promotion = F.greatest(F.instr(F.lit("qrbn"), F.substring(uci, 5, 1)) - 1, F.lit(0))
    return F.when(uci.isNull(), 0).otherwise(at(1) + 64 * at(3) + 4096 * promotion).cast("int")


def _byte(raw: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int")


def time_spent(raw: Column) -> tuple[Column, Column, Column]:
    """(hours, minutes, seconds) of a four-byte record: an unused byte, seconds, minutes, hours;
    nulls if it is of another length or holds no time."""
    valid = (F.octet_length(raw) == 4) & (_byte(raw, 1) < 60) & (_byte(raw, 2) < 60)
    return tuple(F.when(valid, _byte(raw, i)) for i in (3, 2, 1))


def profile_value(flag: Column, value: Column) -> Column:
    """An entry of an evaluation profile: centipawns (flag 0) as they are, a mate in n plies
    (flag 1) as 30000 less n with its side's sign, 32767 for none."""
    mate = F.when(value > 0, 30000 - value).when(value < 0, -30000 - value)
    return F.coalesce(F.when(flag == 0, value).when(flag == 1, mate), F.lit(32767)).cast("int")


def mate_in_moves(flag: Column, value: Column) -> Column:
    """Moves to mate of an entry in plies, signed; null if it holds no mate."""
    return F.when((flag == 1) & (value != 0), F.signum(value) * F.ceil(F.abs(value) / 2)).cast("int")


def digests(raw: Column) -> tuple[Column, Column]:
    """(CRC-32, SHA-256 in hex) of bytes."""
    return F.crc32(raw), F.sha2(raw, 256)
