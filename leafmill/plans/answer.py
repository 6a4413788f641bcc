"""From a question to ranked hits and the context of an answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import expansion, stem, temporal, text
from leafmill.operators import bm25, dense, fusion

Tables = tuple[DataFrame, DataFrame, DataFrame]
BODY_SHOWN = 500
SYSTEM_PROMPT = "Answer from the numbered sources only, name their numbers in brackets, and say so if they do not hold the answer."


def variants_table(spark, variants: list[list[str]]) -> DataFrame:
    """``query, term`` of query variants, each word with its stems, as the index has them."""
    rows = {(i, v) for i, words in enumerate(variants) for w in words for v in stem.variants(w)}
    return spark.createDataFrame(sorted(rows), "query int, term string")


def _word_lists(docs: DataFrame, index: bm25.Index | Tables, variants: list[list[str]], window: tuple[date, date] | None, pool: int) -> DataFrame:
    """``list_no, rank, path, score`` of the best documents of each variant, under a date phrase ranked as such."""
    terms = variants_table(docs.sparkSession, variants)
    post, stats, known = index.of_terms(terms) if isinstance(index, bm25.Index) else index
    scored = bm25.score(post, terms, stats, known)
    if window is None:
        return bm25.top_k(scored, pool).select(F.col("query").alias("list_no"), "rank", F.col("doc").alias("path"), "score")
    dated = docs.groupBy(F.col("rel_path").alias("doc")).agg(F.max(temporal.doc_date("date")).alias("day"))
    lists = [bm25.temporal_rank(dated, scored.where(F.col("query") == i), window, pool).select(F.lit(i).alias("list_no"), "rank", F.col("doc").alias("path"), "score") for i in range(len(variants))]
    return reduce(DataFrame.unionByName, lists)  # one per variant, three at most


def hybrid(
    docs: DataFrame,
    index: bm25.Index | Tables,
    question: str,
    k: int,
    as_of: date,
    vectors: DataFrame | None = None,
    embed: Callable[[list[str]], np.ndarray] | None = None,
    ask: Callable[[str], str] | None = None,
) -> tuple[DataFrame, dict]:
    """(``rank, path, score, rrf``, trace): word lists of all query variants fused, then fused with the vector list.

    Under a date phrase a word list holds the documents of the period (all, if
    none is in it): matching ones first, then the latest, then the best.  Without
    vectors or embedder, if it fails or finds nothing, words alone rank; the
    trace names the reason.  ``docs`` has rel_path (its key) and date; ``index``
    is a stored index by rel_path, or its three tables.
    """
    spark = docs.sparkSession
    variants, imagined, reason = expansion.expand(question, ask)
    window = temporal.date_window(question, as_of)
    trace = {"expansion": reason, "variants": len(variants), "dense": None, "window": window}
    if not any(variants):
        return spark.createDataFrame([], "rank int, path string, score double, rrf double"), trace | {"dense": "empty_query"}
    pool = max(dense.POOL_FACTOR * k, dense.POOL_LEAST)
    words = fusion.rrf(_word_lists(docs, index, variants, window, pool))
    alone = words.where(F.col("rank") <= k)
    if vectors is None or embed is None:
        return alone, trace | {"dense": "no_embed_store" if vectors is None else "no_endpoint"}
    try:
        asked = np.asarray(embed([t for t in (question, imagined) if t]), np.float64)
    except Exception as error:  # whatever a given model raises
        return alone, trace | {"dense": f"embed_failed: {error}"}
    asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
    dates = docs.groupBy("rel_path").agg(F.max(temporal.doc_date("date")).alias("day"))
    near = dense.search(vectors, "chunk_idx", "rel_path", "vec", asked.mean(axis=0).tolist(), k, dates, window)
    return fusion.fuse(words, fusion.ranked(near, "rel_path"), k=k), trace


def answer(
    docs: DataFrame,
    index: bm25.Index,
    question: str,
    k: int,
    as_of: date,
    generate: Callable[[str, str], Iterator[str]] | None = None,
    **search,
) -> tuple[DataFrame, str, str]:
    """(hits with snippets, prompt, answer) of a question: search, context, and the words of a given model.

    ``generate`` takes the system prompt and the prompt and yields server-sent
    event lines; without it, and without hits, the answer is empty.
    """
    hits, _ = hybrid(docs, index, question, k, as_of, **search)
    hits = with_snippets(hits, docs, question)
    source = context(hits, docs).first().context  # k heads of bodies
    prompt = f"{source}\n\nQuestion: {question}"
    said = "".join(stream_answer(generate(SYSTEM_PROMPT, prompt))) if generate and source else ""
    return hits, prompt, said


def context(hits: DataFrame, docs: DataFrame, chars: int = BODY_SHOWN) -> DataFrame:
    """One row ``context``: numbered sources in rank order with the head of their bodies."""
    joined = hits.join(docs.select(F.col("rel_path").alias("path"), "title", "body"), "path", "left")
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", "path"), F.lit("\n"), F.substring(F.coalesce(text.strip("body"), F.lit("")), 1, chars)
    )
    parts = joined.select("rank", block.alias("block"))
    return parts.agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "block"))).getField("block"), "\n\n").alias("context"))  # k rows


def with_snippets(hits: DataFrame, docs: DataFrame, question: str) -> DataFrame:
    """``rank, path, score, date, snippet`` of hits."""
    terms = list(dict.fromkeys(v for w in expansion.words(question) for v in stem.variants(w)))
    words = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    one = docs.withColumn("__n", F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("mtime_ns")))).where("__n = 1")
    return hits.join(one.select(F.col("rel_path").alias("path"), "date", "body"), "path", "left").select("rank", "path", "score", "date", text.snippet("body", words).alias("snippet"))


def as_json(hits: DataFrame) -> DataFrame:
    """One row ``json``: the hits (rank, path, score, date, snippet) in order as a JSON array, as other programs read them."""
    record = F.struct("path", "score", F.coalesce("date", F.lit("")).alias("date"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", record.alias("r")))), lambda x: x.r)
    return hits.agg(F.to_json(ordered).alias("json"))  # k rows


def as_text(hits: DataFrame) -> DataFrame:
    """``rank, line``: the hits as people read them, the snippet on a line of its own."""
    head = F.concat(F.lpad(F.format_string("%.2f", "score"), 6, " "), F.lit("  "), "path", F.when(F.col("date") != "", F.concat(F.lit("  ("), "date", F.lit(")"))).otherwise(""))
    return hits.select("rank", F.concat(head, F.when(F.col("snippet") != "", F.concat(F.lit("\n       "), "snippet")).otherwise("")).alias("line")).orderBy("rank")


def stream_answer(chunks: Iterator[str]) -> Iterator[str]:
    """Pieces of a model's answer from server-sent event lines, end marks removed."""
    for line in chunks:
        data = line.removeprefix("data:").strip()
        if not line.startswith("data:") or data == "[DONE]":
            continue
        try:
            piece = json.loads(data)["choices"][0].get("delta", {}).get("content") or ""
        except (ValueError, KeyError, IndexError):
            continue
        if clean := re.sub(expansion.END_MARK, "", piece):
            yield clean
