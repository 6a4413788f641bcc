"""Finding files by the words of their paths in listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text


def listing_lines(docs: DataFrame, path: str, body: str) -> DataFrame:
    """``path, line``: every non-blank line of every listing, trimmed, front matter included."""
    lines = F.explode(F.split(body, "\\R"))
    return docs.select(F.col(path).alias("path"), lines.alias("line")).select("path", text.strip("line").alias("line")).where("line <> ''")


def locate(docs: DataFrame, path: str, body: str, term: str, k: int = 20, folder: str | None = None) -> DataFrame:
    """``drive, path, score`` of the listed paths that match a term best.

    A blank term finds nothing.  A path listed twice on a drive counts once.
    Order: score, drive, path.
    """
    if folder:
        docs = docs.where(text.has_prefix(path, [folder]))
    word = term.strip()
    lines = listing_lines(docs, path, body)
    found = lines.select(text.drive_id("path").alias("drive"), F.col("line").alias("path"), text.path_score("line", F.lit(word)).alias("score"))
    found = found.where((F.col("score") > 0) & F.lit(word != "")).dropDuplicates(["drive", "path"])
    return found.orderBy(F.desc("score"), "drive", "path").limit(k)
