"""Registered queries of the llm operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import chunking, leakage, mailtext, names, neighbours, shapes, tokenizer
from leafmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every body of more than 2,000 characters."""
    return chunking.split_oversized(table(spark, sf, "store_docs"), "row_id", "body")


def p1_embed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """EmbedStore rows (path, chunk number, length) of every body."""
    rows = chunking.embed_rows(table(spark, sf, "store_docs"), "rel_path", "body")
    return rows.select("rel_path", "chunk_idx", F.length("chunk").alias("n_chars"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return names.variant_pairs(names.store_spellings(table(spark, sf, "store_docs")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that a mail's sender newly wrote."""
    return mailtext.newly_written(table(spark, sf, "store_docs"))


def p4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Doc.tokens of the newly written lines of each mail."""
    return mailtext.authored_tokens(table(spark, sf, "store_docs"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors of which one is among the 10 most similar to the other."""
    return neighbours.similar_pairs(table(spark, sf, "chunk_vectors"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids by the public vocabulary byte_bpe_50k."""
    return tokenizer.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that reproduce evaluation passages, with the items."""
    found = leakage.leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which more than half is keywords, bare links, names or tags."""
    return shapes.spam_pages(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_embed_rows": p1_embed_rows, "p2_found": p2_found, "p4_found": p4_found, "p4_tokens": p4_tokens, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}


_PLACES = "list_max(list_filter(range(2, 502), lambda k: {0}))"
#: The pieces of p1_found one after the other; place k of the window w stands for the end s + 1499 + k.
_PIECES = f"""
WITH RECURSIVE r AS (
 SELECT row_id, body AS t, length(body) AS n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s FROM store_docs WHERE length(body) > 2000
 UNION ALL
 SELECT row_id, t, n, i + 1, s + 1299 + coalesce(
  {_PLACES.format("substr(w, k - 1, 2) = chr(10) || chr(10)")},
  {_PLACES.format("substr(w, k, 1) = chr(10)")},
  {_PLACES.format("substr(w, k, 1) = ' ' AND contains('.!?', substr(w, k - 1, 1))")},
  {_PLACES.format("substr(w, k, 1) = ' '")}, 501)
 FROM (SELECT row_id, t, n, i, s, substr(t, s + 1500, 501) AS w FROM r WHERE n - s > 2000)
),
pieces AS (SELECT row_id, i AS chunk_idx, s AS char_from, CASE WHEN n - s <= 2000 THEN n ELSE lead(s) OVER (PARTITION BY row_id ORDER BY i) + 200 END AS char_to FROM r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PIECES + " SELECT * FROM pieces",
        "p1_embed_rows": _PIECES
        + """
SELECT rel_path, 0 AS chunk_idx, length(body) AS n_chars FROM store_docs WHERE length(body) BETWEEN 1 AND 2000
UNION ALL SELECT rel_path, chunk_idx, char_to - char_from FROM pieces JOIN store_docs USING (row_id)""",
    }
