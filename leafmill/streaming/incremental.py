"""Keeping the index and the amendments up to date with Structured Streaming.

Tables on plain Parquet are kept in parts by a hash of their key.  A batch writes
new versions of the parts that it touches, and then a snapshot of which version
of each part is current, so readers never see half a version and a batch that is
run again after a failure gives the same.  What neither the current nor the
previous snapshot names is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from leafmill.functions import text
from leafmill.operators import amendments as am
from leafmill.operators import bm25
from leafmill.session import exists, fresh_path, written

PARTS = 64
_SNAPSHOT = "part int, version long, parts int"


class Versioned:
    """A table of versions of parts ``<path>/v<batch>/part=<part>`` with snapshots ``<path>/pointer/batch=<batch>``.

    ``key`` is the column by whose hash rows lie in ``parts``; without it the
    table is one part.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, parts: int = PARTS) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.parts = parts if key else 1

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int") if self.key else F.lit(0)

    def _snapshots(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/pointer"):
            return []
        return sorted(r[0] for r in self.spark.read.schema(_SNAPSHOT + ", batch long").parquet(f"{self.path}/pointer").select("batch").distinct().collect())  # two at most, see ``write``

    def version(self) -> int | None:
        """The latest batch, or None before the first."""
        return next(reversed(self._snapshots()), None)

    def _current(self, before: int | None) -> dict[int, int]:
        batches = [b for b in self._snapshots() if before is None or b < before]
        if not batches:
            return {}
        rows = self.spark.read.schema(_SNAPSHOT).parquet(f"{self.path}/pointer/batch={batches[-1]}").collect()  # one row per part
        return {r.part: r.version for r in rows if r.part >= 0}

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The current version, or the newest one older than ``before``, of all or some parts; empty if there is none."""
        paths = [f"{self.path}/v{v}/part={p}" for p, v in sorted(self._current(before).items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int, touched: list[int] | None = None) -> None:
        """``rows`` become all that the ``touched`` parts (all, if not given) hold from this batch on."""
        placed = rows.withColumn("part", self.part_of())
        target = f"{self.path}/v{version}"
        if self.key:
            placed = placed.repartition(self.parts if touched is None else max(1, len(touched)), "part")
        placed.write.mode("overwrite").partitionBy("part").parquet(target)
        current = self._current(before=version)
        for part in range(self.parts) if touched is None else touched:
            # A part without rows has no folder.
            if exists(self.spark, f"{target}/part={part}"):
                current[part] = version
            else:
                current.pop(part, None)
        # The first row stands for the batch itself, as no part may have rows.
        snapshot = self.spark.createDataFrame([(-1, version, self.parts), *((p, v, self.parts) for p, v in current.items())], _SNAPSHOT)
        snapshot.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/batch={version}")
        self._clean(version)

    def upsert(self, fresh: DataFrame, version: int, keys: DataFrame | None = None) -> list[int]:
        """Rows of ``fresh`` in place of those with the same key (with ``keys``, of those keys); returns the parts touched, which alone are written."""
        keys = fresh.select(self.key) if keys is None else keys
        touched = sorted(r[0] for r in keys.select(self.part_of().alias("part")).distinct().collect())  # ``parts`` at most
        kept = self.read(version, touched).join(keys, self.key, "left_anti")
        self.write(kept.unionByName(fresh), version, touched)
        return touched

    def _clean(self, version: int) -> None:
        """Delete what neither this snapshot nor the one before it names."""
        snapshots = [b for b in self._snapshots() if b <= version]
        system = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        keep = {(p, v) for b in snapshots[-2:] for p, v in self._current(b + 1).items()}
        for batch in snapshots[:-2]:
            for part, v in self._current(batch + 1).items():
                if (part, v) not in keep:
                    system.delete(path(f"{self.path}/v{v}/part={part}"), True)
            system.delete(path(f"{self.path}/pointer/batch={batch}"), True)


class TokenIndex:
    """Tokens by path with counts that follow each batch: documents per term and part, documents and tokens per part."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        path = path.rstrip("/")
        self.tokens = Versioned(spark, path, "rel_path string, mtime_ns long, tokens array<string>", "rel_path", parts)
        self.terms = Versioned(spark, f"{path}-terms", "owner int, term string, df long", "owner", parts)
        self.sizes = Versioned(spark, f"{path}-sizes", "owner int, n_docs long, n_tokens long")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Replace the tokens of the paths in a batch (rel_path, mtime_ns, body): the latest row of a path wins."""
        order = Window.partitionBy("rel_path").orderBy(F.desc("mtime_ns"), F.desc(F.xxhash64("body")))
        latest = batch.where(F.col("rel_path").isNotNull()).withColumn("__rn", F.row_number().over(order)).where("__rn = 1")
        fresh = written(latest.select("rel_path", "mtime_ns", text.tokenize("body").alias("tokens")), "token-batch")
        touched = self.tokens.upsert(fresh, batch_id)
        # Counts of the touched parts are made anew, those of the others stay.
        stored = self.tokens.read(parts=touched).withColumn("owner", self.tokens.part_of())
        tokenized = stored.select("owner", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))).alias("tokens"))
        counts = tokenized.select("owner", F.explode("tokens").alias("term")).groupBy("owner", "term").agg(F.count("*").alias("df"))
        sizes = tokenized.groupBy("owner").agg(F.count("*").alias("n_docs"), F.sum(F.size("tokens")).alias("n_tokens"))
        gone = self.tokens.spark.createDataFrame([(t,) for t in touched], "owner int")
        self.terms.upsert(counts, batch_id, gone)
        self.sizes.write(self.sizes.read(before=batch_id).join(gone, "owner", "left_anti").unionByName(sizes), batch_id)

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, corpus statistics, term statistics); the statistics come from the kept counts."""
        post = bm25.postings_grouped(bm25.tokens_of(self.tokens.read(), "rel_path", F.col("tokens")))
        stats = self.sizes.read().agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("n_tokens") / F.sum("n_docs")).alias("avg_len"))
        return post, stats, bm25.term_stats_of(self.terms.read().groupBy("term").agg(F.sum("df").alias("df")), stats)


def run_index(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder of Parquet files of documents and keep ``rel_path, mtime_ns, tokens`` of each path, and the counts of a ``TokenIndex``."""
    index = TokenIndex(spark, target)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(index.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_of(store: Versioned) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, corpus statistics, term statistics) of the tokens stored at a ``TokenIndex``'s path."""
    return TokenIndex(store.spark, store.path).tables()


def apply_batch(docs: DataFrame, pending: Versioned, claims: Versioned, batch: DataFrame, batch_id: int, amended: Versioned | None = None) -> None:
    """Resolve a batch of amendments and those still pending: resolved ones change claims and documents, the rest waits for its document.

    ``claims`` holds what each producer asserts; ``amended`` the documents
    (row_id, tags, entities) that records were applied to, as they are now.
    """
    waiting = pending.read(before=batch_id)
    everything = waiting.unionByName(batch.select(*waiting.columns)).dropDuplicates(["amend_id"])
    resolved = written(am.resolve(everything, docs), "amendments-resolved")
    if amended is not None:
        touched = resolved.where(F.col("doc").isNotNull()).select(F.col("doc").alias("row_id")).distinct()
        before = amended.read(before=batch_id)
        fields = ["row_id", "tags", "entities"]
        own = docs.select(*fields).join(touched, "row_id", "left_semi").join(before.select("row_id"), "row_id", "left_anti").unionByName(before.join(touched, "row_id", "left_semi").select(*fields))
        fresh = written(am.apply_all(own, resolved, claims.read(before=batch_id)).select(*fields), "amended-batch")
        amended.upsert(fresh, batch_id)
    named = written(resolved.where(F.col("doc").isNotNull()).select("doc").distinct(), "amended-docs")
    claims.upsert(am.current_claims(claims.read(before=batch_id).join(named, "doc", "left_semi"), resolved), batch_id, named)
    pending.write(resolved.where(F.col("doc").isNull()).select(*waiting.columns), batch_id)


def run_amendments(spark: SparkSession, source: str, schema: str, docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder of amendments; see ``apply_batch``. Late documents are found because pending records are tried again with every batch."""
    pending = Versioned(spark, f"{target}/pending", schema)
    claims = Versioned(spark, f"{target}/claims", "doc long, producer string, field string, value string", "doc")
    amended = None
    if {"tags", "entities"} <= set(docs.columns):
        amended = Versioned(spark, f"{target}/amended", f"row_id long, tags array<string>, entities {docs.schema['entities'].dataType.simpleString()}", "row_id")
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, n: apply_batch(docs, pending, claims, batch, n, amended)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_windows(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming counts per UTC day and type; days are closed ``delay`` after their end."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Events of a stream, repeats of a key within the delay left out."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def counted_by_day(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``day, event_type, n`` of a table's files, read as a stream until none is left.

    Each batch writes the windows that it changed; the latest count of a window
    is its largest.
    """
    target, checkpoint = fresh_path(spark, "day-counts"), fresh_path(spark, "day-counts-checkpoint")
    stream = spark.readStream.schema(schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    rows.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    shape = "day string, event_type string, n long"
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{target}/batch=-1")  # a table without files has no batch
    return spark.read.schema(shape).parquet(target).groupBy("day", "event_type").agg(F.max("n").alias("n"))
