"""Documents with their metadata: validation, threads, chat days, incremental change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import temporal, text

# Metadata that every document must have.
REQUIRED = ("source", "date", "tags", "sha256", "processor", "processor_version")


def findings(docs: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, level, check`` of every rule that a document's metadata breaks.

    Chat days (a thread without a message) need no SHA-256 and may have a bare
    day as date; all others need a date with its offset.  Null metadata breaks
    the rule that it be present, not the rules on its form.
    """
    chat_day = F.col("thread_id").isNotNull() & F.col("message_id").isNull()
    missing = lambda c: F.col(c).isNull()
    zoned = F.col("date").rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$")
    day = F.col("date").rlike(r"^\d{4}-\d\d-\d\d$")
    upper = F.exists("participants", lambda p: p.address != F.lower(p.address))
    rules: list[tuple[str, str, Column]] = [("fail", f"missing_{c}", missing(c) if c != "sha256" else missing(c) & ~chat_day) for c in REQUIRED]
    rules += [
        ("fail", "message_without_thread", F.col("message_id").isNotNull() & missing("thread_id")),
        ("fail", "message_without_participants", F.col("message_id").isNotNull() & (missing("participants") | (F.size("participants") == 0))),
        ("fail", "sha256_form", ~F.col("sha256").rlike("^[0-9a-f]{64}$")),
        ("warn", "date_without_zone", ~zoned & ~(chat_day & day)),
        ("warn", "thread_id_form", ~F.col("thread_id").rlike("^[0-9a-f]{16}$")),
        ("warn", "address_not_lower_case", upper),
        ("warn", "version_form", ~F.col("processor_version").rlike(r"^\d+\.\d+(\.\d+)?$")),
    ]
    marks = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("check"))) for level, name, broken in rules])
    return docs.select(key, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("f")).select(key, "f.level", "f.check")


# Scalar fields of a head that every producer may write; others carry the producer's name and an underscore before theirs.
COMMON_SCALARS = ("source", "date", "processor", "processor_version", "sha256", "url_sha256", "status", "subject", "project", "thread_id", "message_id", "key_id")


def head_findings(docs: DataFrame, key: str = "rel_path", head: str = "head") -> DataFrame:
    """``key, level, check`` of every rule that a document's head (JSON) breaks as it is written.

    Required fields are there, but for the SHA-256 of chat days and of social
    profiles that have one of their address; tags are a list; scalars that are
    neither common nor named after the document's source are warned of.  A head
    that is null or no object breaks only the rule that it be one.
    """
    names = F.json_object_keys(head)
    has = lambda c: F.array_contains(names, c)
    source = F.get_json_object(head, "$.source")
    exempt = (has("thread_id") & ~has("message_id")) | ((source == "social") & has("url_sha256"))
    rules = [(F.coalesce(~has(c) & (~F.coalesce(exempt, F.lit(False)) if c == "sha256" else F.lit(True)), F.lit(False)), "fail", f"missing_{c}") for c in REQUIRED]
    rules.append((names.isNull(), "fail", "no_head"))
    marks = F.array(*[F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(name).alias("check"))) for broken, level, name in rules])
    missing = docs.select(key, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("f")).select(key, "f.level", "f.check")
    # A value's kind shows in the first character of its JSON, as read with the values kept as they are written.
    kept = F.variant_get(F.try_parse_json(head), "$", "map<string, variant>")
    fields = docs.where(names.isNotNull()).select(key, source.alias("__source"), F.explode(kept).alias("name", "value")).withColumn("json", F.to_json("value"))
    nested = F.col("json").rlike(r"^\s*[\[{]") | F.coalesce(F.col("json") == "null", F.lit(True))
    foreign = ~nested & ~F.col("name").isin(*COMMON_SCALARS) & ~F.coalesce(F.col("name").startswith(F.concat("__source", F.lit("_"))), F.lit(False)) & (F.col("name") != "tags")
    check = F.when((F.col("name") == "tags") & ~F.col("json").rlike(r"^\s*\["), F.struct(F.lit("fail").alias("level"), F.lit("tags_no_list").alias("check"))).when(foreign, F.struct(F.lit("warn").alias("level"), F.concat(F.lit("unregistered_"), "name").alias("check")))
    return missing.unionByName(fields.withColumn("f", check).where("f IS NOT NULL").select(key, "f.level", "f.check"))


def thread_summary(docs: DataFrame) -> DataFrame:
    """Per thread: messages, first and last day, distinct addresses. Rows without a thread are left out."""
    rows = docs.where(F.col("thread_id").isNotNull()).select("thread_id", "row_id", temporal.doc_date("date").alias("day"), F.transform("participants", lambda p: F.lower(p.address)).alias("who"))
    base = rows.groupBy("thread_id").agg(F.countDistinct("row_id").alias("n_messages"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    people = rows.select("thread_id", F.explode("who").alias("address")).groupBy("thread_id").agg(F.countDistinct("address").alias("n_addresses"))
    return base.join(people, "thread_id", "left").withColumn("n_addresses", F.coalesce("n_addresses", F.lit(0)))


def directions(docs: DataFrame, owners: list[str]) -> DataFrame:
    """``row_id, direction``: ``out`` if a sender is one of the owner's addresses, else ``in``; documents without participants are left out."""
    own = [o.lower() for o in owners]
    sent = F.exists("participants", lambda p: (p.role == "from") & F.coalesce(F.lower(p.address).isin(own), F.lit(False)))
    return docs.where(F.size("participants") > 0).select("row_id", F.when(sent, "out").otherwise("in").alias("direction"))


def invalid_by_type(docs: DataFrame) -> DataFrame:
    """``type, n`` of entities marked invalid; a missing type is ``unknown``."""
    each = docs.select(F.explode("entities").alias("e")).where(F.col("e.valid") == F.lit(False))
    return each.groupBy(F.coalesce("e.type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def shared_values(docs: DataFrame, kind: str, key: str = "row_id") -> DataFrame:
    """``value, n_docs, first_doc, last_doc`` of the values of an entity type that several documents hold."""
    each = docs.select(key, F.explode(text.live_entities("entities")).alias("e")).where((F.col("e.type") == kind) & F.col("e.value").isNotNull())
    return each.groupBy(F.col("e.value").alias("value")).agg(F.countDistinct(key).alias("n_docs"), F.min(key).alias("first_doc"), F.max(key).alias("last_doc")).where("n_docs > 1")


def chat_lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """``key, time, sender, text, key_id`` of the lines of chat days."""
    shape = r"^\[(\d\d:\d\d)\] ([^:]+): (.*?)(?:\s*<!-- key_id: (\w+) -->)?\s*$"
    lines = docs.select(key, F.explode(F.split(body, "\n")).alias("line")).where(F.col("line").rlike(shape))
    part = lambda i: F.regexp_extract("line", shape, i)
    return lines.select(key, part(1).alias("time"), part(2).alias("sender"), part(3).alias("text"), F.when(part(4) != "", part(4)).alias("key_id"))


def merge_manifest(known: DataFrame, new: DataFrame) -> DataFrame:
    """Chat messages (key_id, timestamp, …) with new ones added, each key once, the known one kept."""
    both = known.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy("key_id").orderBy("__new", "timestamp")
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__new", "__rn")


def newest_versions(docs: DataFrame) -> DataFrame:
    """One row per path: the greatest modification time, then the latest delivery, then the largest id."""
    order = Window.partitionBy("rel_path").orderBy(F.desc("mtime_ns"), F.desc("ingested_at"), F.desc("row_id"))
    return docs.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rel_path, change``: added, deleted or changed (modification time or hash), of snapshots with one row per path."""
    old = before.select("rel_path", F.col("mtime_ns").alias("m0"), F.col("sha256").alias("s0"), F.lit(True).alias("was"))
    new = after.select("rel_path", F.col("mtime_ns").alias("m1"), F.col("sha256").alias("s1"), F.lit(True).alias("is"))
    both = old.join(new, "rel_path", "full")
    changed = ~(F.col("m0").eqNullSafe(F.col("m1")) & F.col("s0").eqNullSafe(F.col("s1")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(changed, "changed")
    return both.select("rel_path", kind.alias("change")).where("change IS NOT NULL")


def to_process(before: DataFrame | None, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``after`` that were added or changed, ``rel_path`` of those deleted) since ``before``; without it all of ``after`` and none.

    A path that was renamed is deleted under its old name and added under the new.
    """
    if before is None:
        return after, after.select("rel_path").limit(0)
    changes = snapshot_diff(before, after)
    return after.join(changes.where("change <> 'deleted'").select("rel_path"), "rel_path", "left_semi"), changes.where("change = 'deleted'").select("rel_path")


def to_rebuild(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents whose (path, modification time) the index does not have."""
    return docs.join(indexed.select("rel_path", "mtime_ns"), ["rel_path", "mtime_ns"], "left_anti")


def managed(docs: DataFrame, processor: str, current: str | None = None) -> DataFrame:
    """Documents made by a processor; with ``current`` only those of another version of it."""
    rows = docs.where(F.col("processor") == processor)
    return rows.where(~F.col("processor_version").eqNullSafe(F.lit(current))) if current is not None else rows


def index_health(docs: DataFrame, indexed: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: paths in the store, in the word index and in the vector store, and how many are not indexed."""
    stored = docs.select("rel_path").distinct()
    missing = stored.join(indexed.select("rel_path"), "rel_path", "left_anti")
    one = lambda df, name: df.agg(F.countDistinct("rel_path").alias(name))
    return one(stored, "n_docs").crossJoin(one(indexed, "n_indexed")).crossJoin(one(vectors, "n_embedded")).crossJoin(one(missing, "n_stale"))  # one row each


def scanned_pages(pages: DataFrame, threshold: int = 100) -> DataFrame:
    """``doc, n_pages, total_chars`` of documents whose pages hold less text than ``threshold``; null pages count as empty."""
    sizes = pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.sum(F.coalesce(F.length(text.strip("page")), F.lit(0))).alias("total_chars"))
    return sizes.where(F.col("total_chars") < threshold)


def day_counts(events: DataFrame, ts: str = "ts", zone: str = "UTC") -> DataFrame:
    """``day, event_type, n``: events per local calendar day of a zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts).cast("timestamp_ntz")) if zone != "UTC" else F.col(ts)
    return events.groupBy(local.cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


def concurrent_keys(runs: DataFrame, *keys: str) -> DataFrame:
    """Keys under which more than one run is recorded, with their number."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
