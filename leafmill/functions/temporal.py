"""Date phrases of queries, and dates of documents."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col

# The phrases of each period, English and German, in order of precedence.
PHRASES = {
    "last month": "last month|previous month|vorigen monat|letzten monat|letztem monat|vergangenen monat",
    "this month": "this month|diesen monat|diesem monat|dieses monat|laufenden monat|aktuellen monat",
    "last week": "last week|previous week|vorige woche|letzte woche|letzten woche|letzter woche",
    "this week": "this week|dieser woche|diese woche|diesem woche",
    "last year": "last year|previous year|letztes jahr|letzten jahr|letztem jahr|vergangenen jahr|vergangenes jahr",
    "this year": "this year|dieses jahr|diesen jahr|diesem jahr",
    "yesterday": "yesterday|gestern",
    "today": "today|heute",
    "recently": "recent|recently|lately|zuletzt|jüngst|kürzlich|neulich|in letzter zeit",
}
#: Days back that "recently" means.
RECENT = 30


def _period(name: str, day: date) -> tuple[date, date]:
    """The closed range of days of a period, seen from ``day``: a past one is whole, the present one ends on the day."""
    unit = name.split(" ")[-1]
    if unit in ("today", "yesterday", "recently"):
        back = timedelta(days={"today": 0, "yesterday": 1, "recently": RECENT}[unit])
        return day - back, day if unit == "recently" else day - back
    begin = {"month": day.replace(day=1), "week": day - timedelta(days=day.weekday()), "year": day.replace(month=1, day=1)}[unit]
    if name.startswith("this"):
        return begin, day
    end = begin - timedelta(days=1)
    return {"month": end.replace(day=1), "week": end - timedelta(days=6), "year": end.replace(month=1, day=1)}[unit], end


_COMPILED = [(re.compile("|".join(rf"\b{re.sub(' ', r'\\s+', p)}\b" for p in phrases.split("|"))), name) for name, phrases in PHRASES.items()]


def date_window(query: str, as_of: date) -> tuple[date, date] | None:
    """The closed range of days that the first period named in a query means on ``as_of``, or None."""
    lower = (query or "").lower()
    return next((_period(name, as_of) for pattern, name in _COMPILED if pattern.search(lower)), None)


def doc_date(written: Column | str) -> Column:
    """The local calendar day of a document's date, if that is written in an ISO form.

    Forms are ``2024-05-06…`` and ``2024-W19-1…`` with anything behind, and
    ``20240506``, ``2024W191``, ``2024-W19`` (its Monday), alone or before a time.
    Others, impossible days and null give null.
    """
    raw = col(written)
    part = lambda shape, i: F.regexp_extract(raw, shape, i)
    time = r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?"
    basic, plain = rf"^(\d{{4}})(\d\d)(\d\d){time}$", r"^(\d{4})-(\d\d)-(\d\d)"
    week_day, week_basic = r"^(\d{4})-W(\d\d)-([1-7])", rf"^(\d{{4}})(?:W(\d\d)([1-7])?|-W(\d\d)){time}$"
    join = lambda shape: F.concat_ws("-", part(shape, 1), part(shape, 2), part(shape, 3)).try_cast("date")

    def of_week(year: Column, week: Column, day: Column) -> Column:
        fourth = F.concat(year, F.lit("-01-04")).try_cast("date")
        found = F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week - 1) * 7 + day - 1).cast("int"))
        # Not every year has a week 53.
        return F.when(F.weekofyear(found) == week, found)

    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(1))
    either = F.when(part(week_basic, 2) != "", part(week_basic, 2)).otherwise(part(week_basic, 4))
    return (
        F.when(raw.rlike(plain), join(plain))
        .when(raw.rlike(week_day), of_week(part(week_day, 1), number(part(week_day, 2)), number(part(week_day, 3))))
        .when(raw.rlike(basic), join(basic))
        .when(raw.rlike(week_basic), of_week(part(week_basic, 1), number(either), number(part(week_basic, 3))))
    )


def in_window(day: Column | str, window: tuple[date, date]) -> Column:
    """Whether a day lies in a closed range; an unknown day does not."""
    return F.coalesce(col(day).between(F.lit(window[0]), F.lit(window[1])), F.lit(False))
