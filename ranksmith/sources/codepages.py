"""Legacy single-byte text (S15): UTF-8 where it is valid, else a code page, told from the
letters where none is named. Runs on Arrow batches: the JVM's decode() refuses these pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

PAGES = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257")


def cyrillic(raw: bytes) -> bool:
    """Whether high bytes stand together as Cyrillic words do: in Western text an accented
    letter is mostly alone among ASCII letters."""
    together = alone = 0
    run = 0
    for b in [*raw, 0x20]:
        if b >= 0xC0:
            run += 1
            continue
        if run == 1:
            alone += 1
        elif run > 1:
            together += run
        run = 0
    return together > 2 * alone


def decode(raw: bytes | None, page: str | None = None) -> str | None:
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(page or ("cp1251" if cyrillic(raw) else "cp1252"), "replace")


@pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode)
