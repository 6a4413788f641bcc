"""Typed values found in texts by pattern: addresses, links, account numbers, amounts, phone numbers.

What has a check digit that fails is kept and marked invalid; what cannot be
checked and looks wrong is not found at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import canonical

# Patterns by type.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "url": r"https?://[^\s<>\"')\]]+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "amount": r"\b(?:CHF|EUR|USD|GBP) ?[0-9][0-9'.,]*[0-9]\b",
    "phone": r"\+[0-9]{2}(?: ?[0-9]{2,4}){3,5}\b",
}


def found(text: Column, kind: str) -> Column:
    """All values of a type in a text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def extract(docs: DataFrame, key: str, body: str) -> DataFrame:
    """``key, type, value, canonical, valid`` of every distinct value in every text; null and empty texts give no row."""
    each = F.array(*[F.struct(F.lit(kind).alias("type"), F.array_distinct(found(F.col(body), kind)).alias("found")) for kind in PATTERNS])
    rows = docs.where(F.length(body) > 0).select(key, F.explode(each).alias("e")).select(key, F.col("e.type").alias("type"), F.explode("e.found").alias("value"))
    kind, value = F.col("type"), F.col("value")
    clean = (
        F.when(kind == "email", canonical.email(value)).when(kind == "iban", canonical.iban(value)).when(kind == "amount", canonical.amount(value).amount).when(kind == "phone", canonical.phone(value)).otherwise(value)
    )
    return rows.select(key, "type", "value", clean.alias("canonical"), F.when(kind == "iban", canonical.iban_valid(value)).alias("valid"))
