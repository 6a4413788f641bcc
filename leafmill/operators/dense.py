"""Exact search in vectors by cosine, chunks pooled to files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import temporal

BATCH = 32
HALVINGS = 24
#: Query vectors that are sent to all rows at once; bounds what is collected and broadcast (8 MB of 64 numbers each) and the scores of a task.
SEARCH_BLOCK, ROWS_AT_ONCE = 16_384, 1_024
OVERSAMPLE, POOL_FACTOR, POOL_LEAST = 3, 20, 200


def usable(vec: Column | str, dims: int) -> Column:
    """Whether a vector has ``dims`` finite numbers, not all zero."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    good = (F.size(vec) == dims) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def norm(vec: Column | str) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def unit(vec: Column | str) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(vec)
    return F.transform(vec, lambda v: F.when(length > 0, v.cast("double") / length).otherwise(v.cast("double")))


def dot(vec: Column | str, query: list[float]) -> Column:
    """Inner product with a constant vector."""
    constant = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vec, constant, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)


def pool(vectors: DataFrame, vec: str) -> DataFrame:
    """One row ``vec``: the mean of the unit vectors, at unit length unless it is zero."""
    parts = vectors.select(F.posexplode(unit(vec)).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    mean = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("vec"))  # as many entries as a vector has
    return mean.select(unit("vec").alias("vec"))


def top_k(vectors: DataFrame, key: str, vec: str, query: list[float], k: int) -> DataFrame:
    """``key, score`` of the ``k`` vectors closest to the query; ties by the smaller key, zero vectors left out."""
    length = float(np.linalg.norm(query)) or 1.0
    scored = vectors.select(key, F.try_divide(dot(vec, [x / length for x in query]), norm(vec)).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block: int = SEARCH_BLOCK) -> DataFrame:
    """``query, rank, id, score``: the ``k`` closest vectors of each query vector, itself left out; ties by the smaller id.

    Queries are sent to the rows in blocks of at most ``block``; each task keeps
    the best of its rows, and only those are shuffled.
    """
    number = queries.count()
    blocks = max(1, -(-number // block) * 2)
    hit = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vec).collect()  # half a block on average
        if not part and hit is not None:
            continue
        ids = np.array([r[0] for r in part], np.int64)
        q = np.array([r[1] for r in part], np.float64).reshape(len(part), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, x_q = shared.value
            for rows in batches:
                if not len(own) or not rows.num_rows:
                    continue
                ids_of = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                whole = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids_of), -1)
                whole = whole / np.linalg.norm(whole, axis=1, keepdims=True)
                for low in range(0, len(ids_of), ROWS_AT_ONCE):
                    rid = ids_of[low : low + ROWS_AT_ONCE]
                    s = np.round(x_q @ whole[low : low + ROWS_AT_ONCE].T, 6)
                    s[own[:, None] == rid[None, :]] = -np.inf
                    # What is as good as the k-th is kept, as ties are decided over all rows.
                    least = np.partition(s, len(rid) - k, axis=1)[:, len(rid) - k] if k < len(rid) else np.full(len(own), -np.inf)
                    a, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(rid[c]), pa.array(s[a, c])], names=["query", "id", "score"])

        found = vectors.select(F.col(key).cast("bigint").alias("k"), vec).mapInArrow(run, "query bigint, id bigint, score double")
        hit = found if hit is None else hit.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def pool_size(k: int, rows: int) -> int:
    """Chunks to fetch so that enough files are left after pooling."""
    return min(max(POOL_FACTOR * k, POOL_LEAST) * OVERSAMPLE, rows)


def file_scores(chunks: DataFrame, path: str) -> DataFrame:
    """``path, score``: the best score among a file's chunks."""
    return chunks.groupBy(path).agg(F.max("score").alias("score"))


def search(vectors: DataFrame, key: str, path: str, vec: str, query: list[float], k: int, dates: DataFrame | None = None, window: tuple[date, date] | None = None) -> DataFrame:
    """``path, score``: nearest chunks, pooled to files, then filtered by date.

    The date filter comes after the pooling, so it may leave fewer than ``k``;
    files without a date are left out under it.
    """
    rows = pool_size(k, 2**31 - 1)
    near = top_k(vectors.select(F.struct(key, path).alias("id"), vec), "id", vec, query, rows).select(F.col(f"id.{path}").alias(path), "score")
    files = file_scores(near, path)
    if window is not None:
        files = files.join(dates.where(temporal.in_window("day", window)).select(path, "day"), path)
    return files.orderBy(F.desc("score"), F.asc(path)).limit(k)


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed hashed word counts. It carries no meaning beyond shared words."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1.0 if h >> 16 & 1 else -1.0
        return out

    return embed


def embed_one(text: str, embed: Callable[[list[str]], np.ndarray], depth: int = HALVINGS) -> np.ndarray | None:
    """The vector of a text; one that the model refuses is halved and the halves' mean taken. None if even single characters fail."""
    try:
        return embed([text])[0]
    except Exception:
        if len(text) < 2 or depth == 0:
            return None
        half = len(text) // 2
        parts = [v for v in (embed_one(t, embed, depth - 1) for t in (text[:half], text[half:])) if v is not None]
        return np.mean(parts, axis=0) if parts else None


def embed_texts(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray], batch: int = BATCH, tries: int = 1, pause: float = 1.0) -> DataFrame:
    """``key, vec``: unit vectors of texts by a given model, in batches within each task.

    A batch that fails is tried again, up to ``tries`` times in all, after a
    pause that doubles, then taken apart text by text; a text that fails whole is
    left out, so a later run finds it missing and tries again.  Null texts are
    left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1).to_pylist()
            keep, vectors = [], []
            for low in range(0, len(texts), batch):
                part = texts[low : low + batch]
                got = None
                for attempt in range(tries):
                    try:
                        got = list(embed(part))
                        break
                    except Exception:  # whatever a given model raises
                        if attempt + 1 < tries:
                            time.sleep(pause * 2**attempt)
                if got is None:
                    got = [embed_one(t, embed) for t in part]
                for i, v in enumerate(got):
                    if v is not None:
                        length = float(np.linalg.norm(v))
                        keep.append(low + i)
                        vectors.append((np.asarray(v, np.float32) / length if length else np.asarray(v, np.float32)).tolist())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(vectors, pa.list_(pa.float32()))], names=["k", "vec"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return rows.mapInArrow(run, f"k {kind}, vec array<float>").withColumnRenamed("k", key)


def missing_chunks(chunks: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """Chunks (rel_path, mtime_ns, chunk_idx, …) that the store has no vector of this model for.

    Compared chunk by chunk, so a file of which only some chunks were stored is
    completed.
    """
    return chunks.join(store.where(F.col("model") == model).select("rel_path", "mtime_ns", "chunk_idx"), ["rel_path", "mtime_ns", "chunk_idx"], "left_anti")
