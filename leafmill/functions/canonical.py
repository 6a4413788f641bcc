"""Canonical forms of typed values as native column expressions.

All take null to null, and text that is no such value to what is documented.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col, strip

# Written currency symbols and their codes, longest first. They count at the beginning or the end of an amount.
CURRENCIES = (("SFr.", "CHF"), ("SFr", "CHF"), ("Fr.", "CHF"), ("Fr", "CHF"), ("€", "EUR"), ("£", "GBP"), ("$", "USD"), ("¥", "JPY"))


def iban(raw: Column | str) -> Column:
    """Upper case without blanks and hyphens."""
    return F.upper(F.regexp_replace(col(raw), r"[\s-]", ""))


def iban_valid(raw: Column | str) -> Column:
    """Whether the check digits hold (remainder 1 modulo 97)."""
    clean = iban(raw)
    turned = F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.aggregate(F.split(F.array_join(digits, ""), ""), F.lit(0), lambda acc, d: (acc * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97)
    return F.when(clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), rest == 1).otherwise(F.lit(False))


def email(raw: Column | str) -> Column:
    """Domain in lower case; without an @ the whole."""
    clean = strip(raw)
    at = F.instr(clean, "@")
    return F.when(at > 0, F.concat(F.substr(clean, F.lit(1), at), F.lower(F.substr(clean, at + 1, F.length(clean))))).otherwise(F.lower(clean))


def phone(raw: Column | str) -> Column:
    """Digits, with a leading plus if there is one."""
    clean = strip(raw)
    return F.concat(F.when(clean.startswith("+"), "+").otherwise(""), F.regexp_replace(clean, r"\P{Nd}", ""))


def amount(raw: Column | str) -> Column:
    """``struct<amount, currency>``; amount a decimal written with a point.

    Apostrophes group; of comma and point the last is the decimal mark; a lone
    comma is one before at most two digits, else it groups; a lone point stays.
    A sign may stand before or after the currency.
    """
    clean = strip(raw)
    negative = clean.rlike("^[-−–]") | clean.rlike("[-−–] ?[0-9]")
    code = F.regexp_extract(clean, r"(?:^|[^A-Z])([A-Z]{2,4})(?:[^A-Za-z]|$)", 1)
    shown = "|".join(re.escape(sign) + ("(?![A-Za-z])" if sign[-1].isalpha() else "") for sign, _ in CURRENCIES)
    first, last = (F.regexp_extract(clean, shape, 1) for shape in (rf"^[-−–]?\s*({shown})", rf"(?<![A-Za-z])({shown})\s*$"))
    sign_of = F.when(first != "", first).otherwise(last)
    symbol = F.create_map(*[F.lit(x) for pair in CURRENCIES for x in pair])[sign_of]
    body = F.regexp_replace(clean, r"\.[-–—]+$", ".00")
    body = F.regexp_replace(body, r"^[^0-9]+|[^0-9]+$", "")
    body = F.regexp_replace(body, r"['’\s]", "")
    comma, point = F.locate(",", F.reverse(body)), F.locate(".", F.reverse(body))
    plain = (
        F.when((comma > 0) & (point > 0) & (comma < point), F.translate(F.translate(body, ".", ""), ",", "."))
        .when((comma > 0) & (point > 0), F.translate(body, ",", ""))
        .when((comma > 0) & (comma <= 3), F.concat(F.translate(F.substr(body, F.lit(1), F.length(body) - comma), ",", ""), F.lit("."), F.substr(body, F.length(body) - comma + 2, F.lit(9))))
        .when(comma > 0, F.translate(body, ",", ""))
        .otherwise(body)
    )
    plain = F.regexp_replace(plain, r"\.$", "")
    value = F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(F.when(negative, "-").otherwise(""), plain))
    return F.struct(value.alias("amount"), F.coalesce(symbol, F.when(code != "", code)).alias("currency"))


def iso8601(raw: Column | str) -> Column:
    """ISO dates and datetimes unchanged, day-month-year with points or slashes turned, else the trimmed text."""
    clean = strip(raw)
    shape = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    turned = F.concat_ws("-", F.regexp_extract(clean, shape, 3), F.lpad(F.regexp_extract(clean, shape, 2), 2, "0"), F.lpad(F.regexp_extract(clean, shape, 1), 2, "0"))
    return F.when(clean.rlike(r"^\d{4}-\d\d-\d\d([T ].*)?$"), clean).when(clean.rlike(shape), turned).otherwise(clean)


def fingerprint(raw: Column | str) -> Column:
    """``struct<value, standard, valid>`` of a key fingerprint: 40 or 64 hexadecimal digits."""
    clean = F.regexp_replace(F.upper(F.regexp_replace(col(raw), r"[\s:]", "")), "^0X", "")
    hexa = clean.rlike("^[0-9A-F]+$")
    standard = F.when(hexa & (F.length(clean) == 40), "openpgp-v4").when(hexa & (F.length(clean) == 64), "openpgp-v6")
    return F.struct(F.when(standard.isNotNull(), clean).otherwise(strip(raw)).alias("value"), standard.alias("standard"), standard.isNotNull().alias("valid"))


def utc_seconds(raw: Column | str) -> Column:
    """An ISO datetime at a precision of seconds in UTC, ``…Z``; one without offset counts as UTC."""
    clean = strip(raw)
    stamp = F.coalesce(F.try_to_timestamp(F.when(clean.rlike(r"(Z|[+-]\d\d:?\d\d)$"), clean).otherwise(F.concat(clean, F.lit("Z")))))
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown_utc(raw: Column | str) -> Column:
    """An ISO datetime for display, ``2024-05-06 05:08 UTC``; moved to UTC first, so the label is true. Other text gives null."""
    return F.concat(F.translate(F.substring(utc_seconds(raw), 1, 16), "T", " "), F.lit(" UTC"))
