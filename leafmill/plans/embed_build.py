"""Building the vector store: chunks with their heads, only what is missing, in the model's batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import dense
from leafmill.session import exists, written

VERSION = 1
SCHEMA = "rel_path string, mtime_ns long, chunk_idx int, vec array<float>, model string"


class EmbedStore:
    """Vectors by model, with a version that is checked on load; another version counts as empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> DataFrame:
        """The stored vectors; a store that is there but cannot be read raises."""
        stored = exists(self.spark, f"{self.path}/version/_SUCCESS") and exists(self.spark, f"{self.path}/vectors")
        if stored and self.spark.read.schema("version int").parquet(f"{self.path}/version").first()[0] == VERSION:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/vectors")
        return self.spark.createDataFrame([], SCHEMA)

    def append(self, vectors: DataFrame) -> None:
        vectors.write.mode("append").partitionBy("model").parquet(f"{self.path}/vectors")
        self.spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version")


def chunks(docs: DataFrame, window: int = 2000, overlap: int = 200) -> DataFrame:
    """``rel_path, mtime_ns, chunk_idx, chunk``: windows of the body, each behind the document's head; without a body the head alone."""
    head = text.chunk_prefix("title", "tags", "entities", "participants")
    starts = text.window_starts("body", window, overlap)
    starts = F.when(F.size(starts) > 0, starts).otherwise(F.array(F.lit(0)))
    rows = docs.select("rel_path", "mtime_ns", "body", head.alias("head"), F.posexplode(starts).alias("chunk_idx", "start"))
    part = F.substr("body", F.col("start") + 1, F.lit(window))
    whole = F.concat_ws("\n", F.when(F.col("head") != "", F.col("head")), F.when(part != "", part))
    return rows.select("rel_path", "mtime_ns", "chunk_idx", whole.alias("chunk")).where("chunk <> ''")


def build(docs: DataFrame, store: EmbedStore, model: str, embed: Callable[[list[str]], np.ndarray], skipped: list[str] | None = None, parts: int = 1) -> int:
    """Embed and append the chunks that the store lacks for ``model``; returns how many were missing.

    Documents in skipped folders are left out.  The chunks are embedded in so
    many parts, each kept when it is done; a run that broke off is completed by
    the next, as what is missing is decided chunk by chunk.
    """
    scope = chunks(docs.where(~text.has_prefix("rel_path", skipped or [])))
    # Written once, as it is counted, embedded part by part and compared with a store that grows meanwhile.
    missing = written(dense.missing_chunks(scope, store.load(), model).withColumn("part", F.pmod(F.xxhash64("rel_path"), F.lit(parts)).cast("int")), "missing-chunks")
    count = missing.count()
    for part in range(parts if count else 0):
        # Each part is appended when it is done, so a run that breaks off keeps what it has.
        keyed = missing.where(F.col("part") == part).select(F.to_json(F.struct("rel_path", "mtime_ns", "chunk_idx")).alias("k"), "chunk")
        vectors = dense.embed_texts(keyed, "k", "chunk", embed)
        parsed = vectors.select(F.from_json("k", "rel_path string, mtime_ns long, chunk_idx int").alias("k"), "vec")
        store.append(parsed.select("k.*", "vec", F.lit(model).alias("model")))
    return count


def live(store: EmbedStore, docs: DataFrame, model: str) -> DataFrame:
    """The store's vectors of a model that belong to current documents, each once."""
    current = docs.select("rel_path", "mtime_ns").distinct()
    return store.load().where(F.col("model") == model).join(current, ["rel_path", "mtime_ns"], "left_semi").dropDuplicates(["rel_path", "mtime_ns", "chunk_idx"])
