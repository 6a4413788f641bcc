"""Reciprocal rank fusion, and hybrid search made of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.operators.ranking import rank_rows

RRF_K = 60


def rrf(lists: DataFrame, group: str | None = None) -> DataFrame:
    """Fuse ranked lists (list_no, rank, path, score) per ``group``.

    Returns ``[group,] rank, path, score, rrf``; ``score`` is the largest raw
    score of the path, not the fused one; ties keep the order of first sight.
    A path that a list holds twice counts twice.  Null paths are left out.
    """
    keys = [group] if group else []
    fused = (
        lists.where(F.col("path").isNotNull())
        .groupBy(*keys, "path")
        .agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.max("score").alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
        .withColumn("rrf", F.round("rrf", 9))
    )
    order = [F.desc("rrf"), F.asc("first.list_no"), F.asc("first.rank"), F.asc("path")]
    return rank_rows(fused, keys, order).select(*keys, "rank", "path", "score", "rrf")


def as_list(ranked: DataFrame, number: int) -> DataFrame:
    """One ranked list (rank, path, score) with its number."""
    return ranked.select(F.lit(number).alias("list_no"), "rank", "path", "score")


def fuse(*ranked: DataFrame, k: int | None = None) -> DataFrame:
    """Fuse several ranked lists of one query, the best ``k``."""
    fused = rrf(reduce(DataFrame.unionByName, [as_list(r, i) for i, r in enumerate(ranked)]))
    return fused.where(F.col("rank") <= k) if k else fused


def two_stage(variants: DataFrame, dense: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Fuse the lists of query variants (variant, rank, path, score), then the result with the dense list, per ``group``."""
    keys = [group] if group else []
    first = rrf(variants.withColumnRenamed("variant", "list_no"), group)
    both = first.select(*keys, F.lit(0).alias("list_no"), "rank", "path", "score").unionByName(dense.select(*keys, F.lit(1).alias("list_no"), "rank", "path", "score"))
    return rrf(both, group).where(F.col("rank") <= k)


def ranked(scored: DataFrame, path: str = "path") -> DataFrame:
    """``rank, path, score`` of a bounded list of scored paths."""
    order = Window.orderBy(F.desc("score"), F.asc(path))
    return scored.withColumn("rank", F.row_number().over(order)).select("rank", F.col(path).alias("path"), "score")


def relevance_note(top_score: float | None, dense_took_part: bool, low_dense: float = 0.5, low_bm25: float = 1.0) -> str | None:
    """A warning when the best hit is weak."""
    if top_score is None:
        return "no hits"
    return "low relevance" if top_score < (low_dense if dense_took_part else low_bm25) else None
