"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators import timestamps
from leafmill.session import table

KEPT_DICTIONARY = "leafmill.timestamps.dictionary"


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every written date of ``store_docs`` and ``hits`` as one instant in UTC.

    Where the session names a dictionary that is kept (``leafmill.timestamps.dictionary``),
    what earlier runs have parsed is looked up there and only new texts are parsed and added.
    """
    rows = timestamps.dated_rows({
        "store_docs": (table(spark, sf, "store_docs"), "row_id", "date", "tz_hint"),
        "hits": (table(spark, sf, "hits"), "hit_id", "date", None),
    })
    kept = spark.conf.get(KEPT_DICTIONARY, None)
    found = timestamps.normalise(rows, timestamps.TimestampDictionary(spark, kept) if kept else None)
    return found.selectExpr("src AS tab", "row_key", "utc")


def queries() -> dict:
    return {"p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    return {}
