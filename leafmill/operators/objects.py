"""Stored originals, who produced what from them, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import hashing


def new_objects(incoming: DataFrame, content: str, stored: DataFrame) -> DataFrame:
    """``sha256, shard, content`` of contents that the store does not hold; equal contents once. Null content is left out."""
    hashed = incoming.where(F.col(content).isNotNull()).select(hashing.sha256(content).alias("sha256"), F.col(content).alias("content"))
    fresh = hashed.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")
    return fresh.select("sha256", F.substring("sha256", 1, 2).alias("shard"), "content")


def write_objects(fresh: DataFrame, path: str) -> None:
    """Append new objects, a folder per first two digits."""
    fresh.write.mode("append").partitionBy("shard").parquet(path)


def producers(rows: DataFrame) -> DataFrame:
    """``object_sha, producers``: each producer once per message, sorted by message; ``rows``: object_sha, plugin, message, source_sha."""
    one = rows.groupBy("object_sha", "message").agg(F.min(F.struct("plugin", "source_sha")).alias("p"))
    return one.groupBy("object_sha").agg(F.sort_array(F.collect_list(F.struct("message", "p.plugin", "p.source_sha"))).alias("producers"))


def producer_counts(rows: DataFrame) -> DataFrame:
    """``object_sha, n, first_message``: how many messages each object comes from; no list is made, however many there are."""
    return rows.groupBy("object_sha").agg(F.countDistinct("message").alias("n"), F.min("message").alias("first_message"))


def add_producer(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Producer rows with new ones; of one source the latest given wins."""
    both = rows.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy("object_sha", "source_sha").orderBy(F.desc("__new"), "message", "plugin")
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__new", "__rn")


def remove_producer(rows: DataFrame, message: str) -> DataFrame:
    """Producer rows without those of a message."""
    return rows.where(F.col("message").isNull() | (F.col("message") != message))


def plan_remove(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """``object_sha, action, n_left`` when messages are deleted: rewrite the list of producers, or delete the object with the last.

    Objects that none of the messages produced are not in the plan.
    """
    marked = rows.join(messages.select("message", F.lit(True).alias("gone")), "message", "left")
    kept = marked.groupBy("object_sha").agg(F.count(F.when(F.col("gone").isNull(), 1)).alias("n_left"), F.count("gone").alias("n_gone"))
    return kept.where("n_gone > 0").select("object_sha", F.when(F.col("n_left") == 0, "delete").otherwise("rewrite").alias("action"), "n_left")


def plan_collect(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """``sha256`` of stored objects that nothing produced from is left of."""
    return stored.select("sha256").distinct().join(rows.where(F.col("object_sha").isNotNull()).select(F.col("object_sha").alias("sha256")), "sha256", "left_anti")


def link_names(rows: DataFrame) -> DataFrame:
    """``folder, sha256, name``: a link per content; where another content has the name, eight digits go before the extension.

    The smallest SHA-256 keeps the plain name, so the result does not depend on order.
    """
    one = rows.groupBy("folder", "sha256").agg(F.min("name").alias("name"))
    # Joined by the whole row, so a name that many contents share makes no hot key.
    plain = one.groupBy("folder", "name").agg(F.min("sha256").alias("sha256")).withColumn("plain", F.lit(True))
    dot = F.length("name") - F.instr(F.reverse("name"), ".") + 1
    has = (F.instr(F.reverse("name"), ".") > 0) & (dot > 1)
    suffix = F.concat(F.lit("_"), F.substring("sha256", 1, 8))
    other = F.when(has, F.concat(F.substr("name", F.lit(1), dot - 1), suffix, F.substr("name", dot, F.length("name")))).otherwise(F.concat("name", suffix))
    marked = one.join(plain, ["folder", "name", "sha256"], "left")
    return marked.select("folder", "sha256", F.when(F.col("plain"), F.col("name")).otherwise(other).alias("name"))


def canonical_index(links: DataFrame) -> DataFrame:
    """``sha256, path``: the content that each link leads to, by its target's last two parts; of several links the smallest path."""
    sha = F.concat(F.element_at(F.split("target", "/"), -2), F.element_at(F.split("target", "/"), -1))
    valid = links.where(F.size(F.split("target", "/")) >= 2).withColumn("sha256", sha).where(F.length("sha256") == 64)
    return valid.groupBy("sha256").agg(F.min("path").alias("path"))


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted keys (body_sha, extractor, model, version) with ``entities``, null where nothing is cached."""
    return wanted.join(cache.select("body_sha", "extractor", "model", "version", "entities"), ["body_sha", "extractor", "model", "version"], "left")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries: one per key, the new one wins, other models and versions stay."""
    keys = ["body_sha", "extractor", "model", "version"]
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("cached_at"))
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__new", "__rn")
