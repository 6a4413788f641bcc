"""Bytes to text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# With one of these begins every letter of two or three UTF-8 bytes that was read as Windows-1252.
MISREAD = "ÃÂâ"
_MARK = "\ufeff"


def repair(text: str) -> str:
    """Without a byte order mark, UTF-8 read as Windows-1252 undone where that gives valid text, composed form (NFC).

    Undoing covers that one misreading only; other damage stays.
    """
    text = text.removeprefix(_MARK)
    if not set(MISREAD).isdisjoint(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return unicodedata.normalize("NFC", text)


def _detected(data: bytes) -> str | None:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(data).best()
    return None if best is None else str(best)


def decode_bytes(data: bytes, hint: str | None = None) -> str:
    """By the hinted encoding, else strict UTF-8, else a detected one, else UTF-8 with replacements."""
    for encoding in filter(None, (hint, "utf-8")):
        try:
            return repair(data.decode(encoding))
        except (LookupError, UnicodeDecodeError):
            continue
    found = _detected(data)
    return repair(data.decode("utf-8", errors="replace") if found is None else found)


#: Characters that composing never changes when no others are among them: Latin, Greek, Cyrillic, punctuation, currency, kana, ideographs, Hangul.
_STABLE = r"\x{0}-\x{2FF}\x{388}-\x{3CE}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"


def needs_repair(text: Column) -> Column:
    """Whether ``repair`` may change valid text: it holds a misread letter, or a character that is not known to stay."""
    return text.rlike(rf"[{MISREAD}]|[^{_STABLE}]")


def decoded(rows: DataFrame, data: str, out: str, hint: str | None = None) -> DataFrame:
    """``rows`` with the text ``out`` of the bytes ``data``; null gives null.

    Rows of valid UTF-8 that nothing has to be repaired in are decoded natively;
    only the others go to Python, in a branch of the plan of their own, as a
    condition around a Python function would not keep rows from it.
    """

    @F.pandas_udf("string")
    def slowly(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, hints in parts:
            yield pd.Series([None if b is None else decode_bytes(bytes(b), h if isinstance(h, str) else None) for b, h in zip(raw, hints)], dtype=object)

    plain = F.try_validate_utf8(F.col(data).cast("string")) if hint is None else F.when(F.col(hint).isNull(), F.try_validate_utf8(F.col(data).cast("string")))
    simple = F.col(data).isNull() | (plain.isNotNull() & ~F.coalesce(needs_repair(plain), F.lit(True)))
    fast = rows.where(simple).withColumn(out, F.col(data).cast("string"))
    slow = rows.where(~simple).withColumn(out, slowly(F.col(data), F.col(hint) if hint else F.lit(None).cast("string")))
    return fast.unionByName(slow)
