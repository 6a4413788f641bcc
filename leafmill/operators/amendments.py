"""Metadata amended by several producers, with attribution and retraction.

An amendment names a document by one key, asserts tags and entities, and is kept
with a hash that does not depend on time.  Applying is a join and a union per
document; a value is retracted when its producer stops asserting it and no other
producer still does.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import col


def record_hash(key: dict, fields: dict, emitted_by: str, mode: str | None = None) -> str:
    """SHA-1 of the canonical JSON of what a record asserts; ``mode`` counts only when it is ``set``."""
    content = {"key": key, "fields": fields, "emitted_by": emitted_by}
    if mode == "set":
        content["mode"] = mode
    return hashlib.sha1(json.dumps(content, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def assertion_hash() -> Column:
    """The same purpose as a native expression over an amendments table: equal records hash equally at any time."""
    mode = F.when(F.col("mode") == "set", F.lit("set")).otherwise(F.lit(""))
    return F.sha1(F.to_json(F.struct("doc_key", "fields", "emitted_by", mode.alias("mode"))))


#: Fields that a producer asserts as sets.
SET_FIELDS = ("tags", "entities")
# Modes of a record that states all that its producer asserts, and of one that takes back what it names.
SET_MODES, TAKE_BACK = ("set", "replace"), "retract"


def emit(queue: DataFrame, new: DataFrame, declarative: bool = False) -> DataFrame:
    """The queue with new records (amend_id, doc_key, fields, emitted_by, emitted_at), each kind of record once.

    A record equal to one in the queue, whenever it was made, is not added
    again; of equal new ones the one with the smallest id is.  A declarative
    record states all that its producer asserts and may assert nothing, an
    additive one must.  Records without a key, without fields or without a
    producer raise.
    """
    present = lambda c: F.coalesce(c != "", F.lit(False))
    keyed = present(F.col("doc_key.message_id")) | present(F.col("doc_key.sha256")) | present(F.col("doc_key.path"))
    asserting = F.col("fields").isNotNull() if declarative else F.coalesce(F.size("fields.tags"), F.lit(0)) + F.coalesce(F.size("fields.entities"), F.lit(0)) > 0
    refused = new.where(~(keyed & F.coalesce(asserting, F.lit(False)) & present(F.col("emitted_by")))).limit(1).collect()  # one row at most
    if refused:
        raise ValueError(f"a record needs a key, fields and a producer: {refused[0]}")
    hashed = new.withColumn("mode", F.lit("set" if declarative else "add")).withColumn("hash", assertion_hash())
    one = hashed.withColumn("__rn", F.row_number().over(Window.partitionBy("hash").orderBy("amend_id"))).where("__rn = 1").drop("__rn")
    known = queue.select(assertion_hash().alias("hash")).distinct()
    return queue.unionByName(one.join(known, "hash", "left_anti").select(*queue.columns))


def document_key(key: Column | str) -> Column:
    """``struct<kind, value>``: the first of message id, SHA-256 and path that is present; null if none is.

    A key that is present but matches nothing does not fall through to the next.
    """
    key = col(key)
    present = lambda c: c.isNotNull() & (c != "")
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    return (
        F.when(present(key.message_id), pair("message_id", key.message_id)).when(present(key.sha256), pair("sha256", key.sha256)).when(present(key.path), pair("path", key.path))
    )


def key_index(docs: DataFrame, doc: str = "row_id") -> DataFrame:
    """``kind, value, doc``: which document each key names; of several the one with the largest path, then the largest id."""
    each = docs.select(doc, "rel_path", F.explode(F.create_map(F.lit("message_id"), "message_id", F.lit("sha256"), "sha256", F.lit("path"), "rel_path")).alias("kind", "value"))
    each = each.where(F.col("value").isNotNull() & (F.col("value") != ""))
    return each.groupBy("kind", "value").agg(F.max(F.struct("rel_path", doc)).alias("best")).select("kind", "value", F.col(f"best.{doc}").alias("doc"))


def resolve(amendments: DataFrame, docs: DataFrame, doc: str = "row_id") -> DataFrame:
    """``amendments`` with ``doc``, the document each names, or null: those stay pending until it appears."""
    keyed = amendments.withColumn("__key", document_key("doc_key"))
    index = key_index(docs, doc)
    return keyed.join(index, (F.col("__key.kind") == index.kind) & (F.col("__key.value") == index.value), "left").drop("kind", "value", "__key")


def merge_tags(existing: Column | str, new: Column | str) -> Column:
    """Sorted union without repeats and nulls."""
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(col(existing), none), F.coalesce(col(new), none))
    return F.array_sort(F.filter(both, lambda t: t.isNotNull()))


def entity_key(entity: Column) -> Column:
    """What makes two entities the same: scope (``body`` if null), type and value."""
    return F.struct(F.coalesce(entity.scope, F.lit("body")).alias("scope"), entity.type.alias("type"), entity.value.alias("value"))


def merge_entities(existing: Column | str, new: Column | str, kind: str) -> Column:
    """Existing entities, then the new ones whose key is not among them; the first of a key wins."""
    none = F.array().cast(kind)
    both = F.concat(F.coalesce(col(existing), none), F.coalesce(col(new), none))
    keys = F.transform(both, entity_key)
    places = F.transform(F.array_distinct(keys), lambda k: F.array_position(keys, k))
    return F.transform(places, lambda p: F.get(both, (p - 1).cast("int")))


def claims(resolved: DataFrame) -> DataFrame:
    """``doc, producer, field, value`` asserted by applied records, each once."""
    tags = resolved.select("doc", F.col("emitted_by").alias("producer"), F.lit("tags").alias("field"), F.explode("fields.tags").alias("value"))
    entity = F.explode("fields.entities").alias("e")
    ents = resolved.select("doc", F.col("emitted_by").alias("producer"), F.lit("entities").alias("field"), entity).select(
        "doc", "producer", "field", F.concat_ws("\u001f", F.coalesce("e.scope", F.lit("body")), "e.type", "e.value").alias("value")
    )
    return tags.unionByName(ents).where(F.col("doc").isNotNull() & F.col("value").isNotNull()).distinct()


def latest_sets(resolved: DataFrame) -> DataFrame:
    """The last record of each producer for each document, by time then hash: what it asserts now."""
    order = Window.partitionBy("doc", "emitted_by").orderBy(F.desc("emitted_at"), F.desc("hash"))
    marked = resolved.where(F.col("doc").isNotNull()).withColumn("hash", assertion_hash()).withColumn("rn", F.row_number().over(order))
    return marked.where("rn = 1").drop("rn")


def retractable(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc, producer, field, value`` that a producer asserted before and no longer does, and that no other still asserts.

    Both tables are claims.  Only fields that the producer's new record has at
    all are retracted from.
    """
    named = after.select("doc", "producer", "field").distinct()
    dropped = before.join(named, ["doc", "producer", "field"], "left_semi").join(after, ["doc", "producer", "field", "value"], "left_anti")
    return dropped.join(after.select("doc", "field", "value").distinct(), ["doc", "field", "value"], "left_anti").select("doc", "producer", "field", "value")


def apply(docs: DataFrame, resolved: DataFrame, doc: str = "row_id", tags: str = "tags", entities: str = "entities") -> DataFrame:
    """Documents with the tags and entities of their records merged in.

    Records of a document are taken in the order of producer, then hash, not of
    time.  Documents without records stay as they are.
    """
    kind = docs.schema[entities].dataType.simpleString()
    hashed = resolved.where(F.col("doc").isNotNull()).withColumn("hash", assertion_hash())
    # Repeats go before a document's values are gathered, so what is gathered is as small as the result.
    new_tags = hashed.select("doc", F.explode("fields.tags").alias("tag")).where(F.col("tag").isNotNull()).distinct().groupBy("doc").agg(F.collect_list("tag").alias("__tags"))
    each = hashed.select("doc", "emitted_by", "hash", F.posexplode("fields.entities").alias("place", "entity"))
    each = each.withColumn("key", entity_key(F.col("entity"))).withColumn("first", F.struct("emitted_by", "hash", "place"))
    one = each.groupBy("doc", "key").agg(F.min("first").alias("first"), F.min_by("entity", "first").alias("entity"))
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("first", "key.scope", "key.type", "key.value", "entity"))), lambda e: e.entity)
    new_ents = one.groupBy("doc").agg(gathered.alias("__entities"))
    records = hashed.select("doc").distinct().join(new_tags, "doc", "left").join(new_ents, "doc", "left")
    joined = docs.join(records, docs[doc] == records.doc, "left")
    touched = F.col("doc").isNotNull()
    return (
        joined.withColumn(tags, F.when(touched, merge_tags(tags, "__tags")).otherwise(F.col(tags)))
        .withColumn(entities, F.when(touched, merge_entities(entities, "__entities", kind)).otherwise(F.col(entities)))
        .drop("doc", "__tags", "__entities")
    )


def _field_claims(resolved: DataFrame) -> DataFrame:
    """``doc, producer, field, value, mode, at`` of every value that a record names; ``at`` orders a producer's records."""
    rows = resolved.where(F.col("doc").isNotNull()).withColumn("at", F.struct(F.coalesce("emitted_at", F.lit("")).alias("time"), assertion_hash().alias("hash")))
    base = ["doc", F.col("emitted_by").alias("producer"), "mode", "at"]
    tags = rows.select(*base, F.lit("tags").alias("field"), F.explode("fields.tags").alias("value"))
    ents = rows.select(*base, F.lit("entities").alias("field"), F.explode("fields.entities").alias("e")).withColumn("value", _entity_value(F.col("e"))).drop("e")
    return tags.unionByName(ents).where(F.col("value").isNotNull())


def _entity_value(entity: Column) -> Column:
    return F.concat_ws("\u001f", F.coalesce(entity.scope, F.lit("body")), entity.type, entity.value)


def current_claims(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    """``doc, producer, field, value`` that each producer asserts after a run; ``stored`` are the claims before it.

    A declarative record (mode ``set`` or ``replace``) replaces what its
    producer asserted in the fields that it has, additive records after it add
    to that, and a record of mode ``retract`` takes back what it names.  Records
    of a producer count in the order of time, then hash.
    """
    rows = resolved.where(F.col("doc").isNotNull()).withColumn("at", F.struct(F.coalesce("emitted_at", F.lit("")).alias("time"), assertion_hash().alias("hash")))
    states = rows.where(F.col("mode").isin(*SET_MODES)).select("doc", F.col("emitted_by").alias("producer"), "at", F.explode(F.array(*[F.when(F.col(f"fields.{f}").isNotNull(), F.lit(f)) for f in SET_FIELDS])).alias("field"))
    last_set = states.where(F.col("field").isNotNull()).groupBy("doc", "producer", "field").agg(F.max("at").alias("set_at"))
    keys = ["doc", "producer", "field"]
    named = _field_claims(resolved)
    given = named.where(F.col("mode") != TAKE_BACK).groupBy(*keys, "value").agg(F.max("at").alias("given_at"))
    taken = named.where(F.col("mode") == TAKE_BACK).groupBy(*keys, "value").agg(F.max("at").alias("taken_at"))
    before = stored.select(*keys, "value").distinct().withColumn("was", F.lit(True))
    every = before.join(given, [*keys, "value"], "full").join(taken, [*keys, "value"], "left").join(last_set, keys, "left")
    stays = F.when(F.col("given_at").isNotNull(), F.col("set_at").isNull() | (F.col("given_at") >= F.col("set_at"))).otherwise(F.col("set_at").isNull())
    kept = F.col("taken_at").isNull() | F.coalesce(F.col("given_at") > F.col("taken_at"), F.lit(False))
    return every.where(stays & kept).select(*keys, "value")


def apply_all(docs: DataFrame, resolved: DataFrame, stored: DataFrame | None = None, doc: str = "row_id", tags: str = "tags", entities: str = "entities") -> DataFrame:
    """Documents with the tags and entities of all their records merged in, and what no producer asserts any more taken out.

    A value is taken out if a producer asserted it, before the run (``stored``
    claims) or in it, does so no longer after its declarative or retracting
    records, and no other producer does.  Values that no record ever asserted
    stay, as do documents without records.
    """
    claims_before = stored if stored is not None else docs.sparkSession.createDataFrame([], f"doc {docs.schema[doc].dataType.simpleString()}, producer string, field string, value string")
    asserting = resolved.where(F.coalesce(F.col("mode") != TAKE_BACK, F.lit(True)))
    merged = apply(docs, asserting, doc, tags, entities)
    after = current_claims(claims_before, resolved).select("doc", "field", "value").distinct()
    named = _field_claims(resolved)
    touched = named.select("doc").union(resolved.where(F.col("doc").isNotNull()).select("doc")).distinct()
    ever = claims_before.join(touched, "doc", "left_semi").select("doc", "field", "value").union(named.where(F.col("mode") != TAKE_BACK).select("doc", "field", "value")).distinct()
    gone = ever.join(after, ["doc", "field", "value"], "left_anti")
    lists = gone.groupBy("doc").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("value"))).alias(f"__gone_{f}") for f in SET_FIELDS])
    joined = merged.join(lists, merged[doc] == lists.doc, "left")
    none = F.array().cast("array<string>")
    without = lambda values, dropped, key: F.when(F.size(dropped) > 0, F.filter(values, lambda v: ~F.array_contains(F.coalesce(dropped, none), key(v)))).otherwise(values)
    return (
        joined.withColumn(tags, without(F.col(tags), F.col("__gone_tags"), lambda v: v))
        .withColumn(entities, without(F.col(entities), F.col("__gone_entities"), _entity_value))
        .drop("doc", "__gone_tags", "__gone_entities")
    )


def apply_counts(resolved: DataFrame, applied: DataFrame) -> DataFrame:
    """One row ``applied, pending``: records that can be applied now (not yet in ``applied``: doc, hash) and that wait for a document."""
    hashed = resolved.withColumn("hash", assertion_hash())
    fresh = hashed.where(F.col("doc").isNotNull()).join(applied.select("doc", "hash"), ["doc", "hash"], "left_anti")
    return fresh.agg(F.count("*").alias("applied")).crossJoin(hashed.where(F.col("doc").isNull()).agg(F.count("*").alias("pending")))  # one row each


def queue_by_emitter(amendments: DataFrame) -> DataFrame:
    """``emitted_by, n`` with a row of the total, where ``emitted_by`` is null."""
    return amendments.where(F.col("emitted_by").isNotNull()).rollup("emitted_by").agg(F.count("*").alias("n"))
