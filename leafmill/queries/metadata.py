"""Queries of canonical values, amendments, objects, validation, threads and incremental change, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import canonical, entities, hashing, text
from leafmill.operators import amendments as am
from leafmill.operators import documents as dm
from leafmill.operators import objects as ob
from leafmill.queries.retrieval import DAY_SQL
from leafmill.session import table
from leafmill.sources import blocks, markdown
from leafmill.streaming import incremental

SPLIT = "2023-01-01 00:00:00"
OWNER = "thomas.noristetal@kontor.example"
CURRENT = "0.11.3"

#: Literal inputs of the canonicalisers: (kind, raw).
LITERALS = [
    ("iban", "CH93 0076 2011 6238 5295 7"), ("iban", "de89-3704-0044-0532-0130-00"), ("iban", "CH93 0076 2011 6238 5295 8"),
    ("amount", "CHF 1'234.50"), ("amount", "-EUR 1.234,50"), ("amount", "Fr. 20.-"), ("amount", "12,5 €"), ("amount", "1,234 USD"), ("amount", "SFr. 5"), ("amount", "$ -7.10"), ("amount", "nothing"),
    ("email", " Anna.Muster@Example.ORG "), ("email", "NOAT"), ("phone", "+41 (0)79 123-45 67"), ("phone", "044/123 45 67"),
    ("iso8601", "2024-05-06"), ("iso8601", "2024-05-06T07:08:09+02:00"), ("iso8601", "6.5.2024"), ("iso8601", "16/11/2024"), ("iso8601", "soon"),
    ("fingerprint", "0xABCD EF01 2345 6789 ABCD EF01 2345 6789 ABCD EF01"), ("fingerprint", "xyz"),
]


def canonical_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(LITERALS, "kind string, raw string")
    money, key = canonical.amount("raw"), canonical.fingerprint("raw")
    value = (
        F.when(F.col("kind") == "iban", F.concat(canonical.iban("raw"), F.when(canonical.iban_valid("raw"), "+").otherwise("-")))
        .when(F.col("kind") == "amount", F.concat_ws(" ", F.coalesce(money.amount, F.lit("?")), F.coalesce(money.currency, F.lit("?"))))
        .when(F.col("kind") == "email", canonical.email("raw"))
        .when(F.col("kind") == "phone", canonical.phone("raw"))
        .when(F.col("kind") == "iso8601", canonical.iso8601("raw"))
        .otherwise(F.concat_ws(" ", key.value, F.coalesce(key.standard, F.lit("none"))))
    )
    return rows.select("kind", "raw", value.alias("value"))


_EXPECTED = [
    "CH9300762011623852957+", "DE89370400440532013000+", "CH9300762011623852958-",
    "1234.50 CHF", "-1234.50 EUR", "20.00 CHF", "12.5 EUR", "1234 USD", "5 CHF", "-7.10 USD", "? ?",
    "Anna.Muster@example.org", "noat", "+410791234567", "0441234567",
    "2024-05-06", "2024-05-06T07:08:09+02:00", "2024-05-06", "2024-11-16", "soon",
    "ABCDEF0123456789ABCDEF0123456789ABCDEF01 openpgp-v4", "xyz none",
]


def entity_amounts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "store_docs").select("row_id", F.posexplode("entities").alias("place", "e")).where("e.type = 'amount'")
    money = canonical.amount("e.value")
    return e.select("row_id", F.col("place").cast("bigint").alias("place"), money.amount.alias("amount"), money.currency.alias("currency"))


def amount_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Currencies count at the beginning or the end of an amount, not within a word."""
    raw = ["Frankfurt 5 EUR", "Freitag 12.50 USD", "Fr 7", "7 Fr.", "-SFr. 3.20", "€ 4", "4€", "12 Franken", "EUR 1'000.-", "USD 1,5"]
    money = canonical.amount("raw")
    return spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", money.amount.alias("amount"), money.currency.alias("currency"))


def canon_emails(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "store_docs").select(F.explode("participants").alias("p")).where("p.address IS NOT NULL")
    return p.groupBy(canonical.email("p.address").alias("address")).agg(F.count("*").alias("n"))


def canon_references(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "store_docs").select("row_id", F.explode("entities").alias("e")).where("e.type = 'reference'")
    return e.groupBy(canonical.iban("e.value").alias("value"), canonical.phone("e.value").alias("digits")).agg(F.count("*").alias("n"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", hashing.sha256("text").alias("sha256"), hashing.git_blob_sha1("text").alias("blob"), hashing.object_path(hashing.sha256("text")).alias("place"))


def thread_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "store_docs").where("message_id IS NOT NULL").select("row_id", text.thread_id("message_id").alias("own_thread"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return am.resolve(table(spark, sf, "amendments"), table(spark, sf, "store_docs"))


def resolve_amendments(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("amend_id", F.col("doc").alias("row_id"))


def pending_amendments(spark: SparkSession, sf: str) -> DataFrame:
    """Amendments that wait for their document, by producer, as of the day that splits the deliveries."""
    early = table(spark, sf, "store_docs").where(F.col("ingested_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    return am.resolve(table(spark, sf, "amendments"), early).where("doc IS NULL").groupBy("emitted_by").agg(F.count("*").alias("n"))


def _shown(entities: str) -> Column:
    each = F.transform(entities, lambda e: F.concat_ws(":", F.coalesce(e.scope, F.lit("body")), F.coalesce(e.type, F.lit("-")), F.coalesce(e.value, F.lit("-"))))
    return F.md5(F.array_join(F.array_sort(F.coalesce(each, F.array().cast("array<string>"))), "|").cast("binary"))


def apply_amendments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after all amendments: merged values, and without those that no producer asserts any more."""
    applied = am.apply_all(table(spark, sf, "store_docs"), _resolved(spark, sf))
    return applied.select("row_id", F.array_join("tags", "|").alias("tags"), F.coalesce(F.size("entities"), F.lit(0)).cast("bigint").alias("n_entities"), _shown("entities").alias("digest"))


def current_claims(spark: SparkSession, sf: str) -> DataFrame:
    """What each producer asserts after all amendments."""
    none = spark.createDataFrame([], "doc long, producer string, field string, value string")
    return am.current_claims(none, _resolved(spark, sf)).groupBy("producer", "field").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


def emitted(spark: SparkSession, sf: str) -> DataFrame:
    """The queue of the first half of the amendments after all additive ones are emitted, declared ones after them; equal records once."""
    every = table(spark, sf, "amendments")
    keyed = every.where("coalesce(doc_key.message_id, doc_key.sha256, doc_key.path, '') <> '' AND emitted_by <> '' AND fields IS NOT NULL")
    additive = keyed.where("mode = 'add' AND coalesce(cardinality(fields.tags), 0) + coalesce(cardinality(fields.entities), 0) > 0")
    queue = am.emit(additive.where("amend_id % 2 = 0").withColumn("mode", F.lit("add")), additive)
    queue = am.emit(queue, keyed.where("mode = 'replace'"), declarative=True)
    return queue.groupBy("mode", "emitted_by").agg(F.count("*").alias("n"), F.countDistinct("amend_id").alias("n_ids"))


def producer_claims(spark: SparkSession, sf: str) -> DataFrame:
    return am.claims(_resolved(spark, sf)).groupBy("producer", "field").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


def retractable_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Retractable values of every field, tags and entities."""
    resolved = _resolved(spark, sf).where("mode <> 'retract'")
    now = am.latest_sets(resolved.withColumn("hash_order", F.col("amend_id")).withColumn("emitted_at", F.concat("emitted_at", F.lpad(F.col("amend_id").cast("string"), 20, "0"))))
    found = am.retractable(am.claims(resolved), am.claims(now))
    return found.select(F.col("doc").alias("row_id"), "producer", "field", "value")


def retractable(spark: SparkSession, sf: str) -> DataFrame:
    return retractable_claims(spark, sf)


def queue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return am.queue_by_emitter(table(spark, sf, "amendments"))


def _producers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "store_docs").where("message_id IS NOT NULL")
    return d.select(F.col("sha256").alias("object_sha"), F.col("processor").alias("plugin"), F.col("message_id").alias("message"), F.sha2("rel_path", 256).alias("source_sha"))


def producers_refcount(spark: SparkSession, sf: str) -> DataFrame:
    return ob.producer_counts(_producers(spark, sf))


def plan_gc(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "store_docs").where("sha256 IS NOT NULL").select("sha256")
    return ob.plan_collect(stored, _producers(spark, sf))


def plan_remove(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "store_docs").where("source = 'imap' AND message_id IS NOT NULL").select(F.col("message_id").alias("message")).distinct()
    return ob.plan_remove(_producers(spark, sf), gone)


def link_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "store_docs").where("sha256 IS NOT NULL AND rel_path IS NOT NULL")
    rows = d.select(F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("folder"), "sha256", F.concat(text.slugify(F.coalesce("subject", "title"), "note"), F.lit(".md")).alias("name"))
    return ob.link_names(rows)


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "store_docs").where("sha256 IS NOT NULL")
    keyed = d.select(F.col("sha256").alias("body_sha"), F.lit("ner").alias("extractor"), F.col("processor").alias("model"), F.col("processor_version").alias("version"), "entities", "ingested_at")
    cache = keyed.where(F.col("ingested_at") < F.lit(SPLIT).cast("timestamp_ntz")).drop("ingested_at").withColumn("cached_at", F.lit("")).dropDuplicates(["body_sha", "extractor", "model", "version"])
    wanted = keyed.select("body_sha", "extractor", "model", "version").distinct()
    looked = ob.cache_lookup(wanted, cache.withColumn("entities", F.coalesce("entities", F.array().cast(cache.schema["entities"].dataType))))
    return looked.where("entities IS NULL").groupBy("model").agg(F.count("*").alias("n"))


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "store_docs").where("rel_path IS NOT NULL")
    before = dm.newest_versions(d.where(F.col("ingested_at") < F.lit(SPLIT).cast("timestamp_ntz")))
    return dm.snapshot_diff(before, dm.newest_versions(d))


def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What an incremental run works on: newest rows added or changed since the day that splits the deliveries, and paths that left the store.

    Paths of chats count as having left it, so that there are some.
    """
    d = table(spark, sf, "store_docs").where("rel_path IS NOT NULL")
    before = dm.newest_versions(d.where(F.col("ingested_at") < F.lit(SPLIT).cast("timestamp_ntz")))
    work, gone = dm.to_process(before, dm.newest_versions(d.where("NOT rel_path LIKE 'chat/%'")))
    return work.select("rel_path", "row_id").unionByName(gone.select("rel_path", F.lit(None).cast("bigint").alias("row_id")))


def shown_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that are written as ISO datetimes with an offset or Z, as they are displayed."""
    d = table(spark, sf, "store_docs").where(r"date RLIKE '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|[+-]\\d\\d:\\d\\d)$'")
    return d.select("row_id", canonical.utc_seconds("date").alias("utc"), canonical.shown_utc("date").alias("shown")).where("utc IS NOT NULL")


def newest_versions(spark: SparkSession, sf: str) -> DataFrame:
    return dm.newest_versions(table(spark, sf, "store_docs").where("rel_path IS NOT NULL")).select("rel_path", "row_id")


def managed_outdated(spark: SparkSession, sf: str) -> DataFrame:
    return dm.managed(table(spark, sf, "store_docs"), "eml", CURRENT).groupBy("processor_version").agg(F.count("*").alias("n"))


def invalid_entities_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return dm.invalid_by_type(table(spark, sf, "store_docs"))


def concurrent_keys(spark: SparkSession, sf: str) -> DataFrame:
    return dm.concurrent_keys(table(spark, sf, "hits"), "query_id", "list_no", "rank")


def thread_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = dm.thread_summary(table(spark, sf, "store_docs"))
    return t.select("thread_id", "n_messages", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_addresses")


def directions(spark: SparkSession, sf: str) -> DataFrame:
    return dm.directions(table(spark, sf, "store_docs"), [OWNER]).groupBy("direction").agg(F.count("*").alias("n"))


def shared_references(spark: SparkSession, sf: str) -> DataFrame:
    return dm.shared_values(table(spark, sf, "store_docs"), "reference")


def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    return dm.chat_lines(table(spark, sf, "documents"), "doc_id", "text").where("key_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.countDistinct("sender").alias("n_senders"))


def validate_findings(spark: SparkSession, sf: str) -> DataFrame:
    return dm.findings(table(spark, sf, "store_docs"))


def participant_strings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "store_docs").where("participants IS NOT NULL").select("row_id", F.array_join(text.participant_names("participants"), "; ").alias("people"))


def day_buckets(spark: SparkSession, sf: str) -> DataFrame:
    found = dm.day_counts(table(spark, sf, "events"), zone="Europe/Zurich")
    return found.select(F.col("day").cast("string").alias("day"), "event_type", "n")


def index_health(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "store_docs")
    indexed = d.where("length(body) > 0").select("rel_path")
    return dm.index_health(d.where("rel_path IS NOT NULL"), indexed, table(spark, sf, "chunk_vectors"))


def session_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns per role of the recorded sessions."""
    d = table(spark, sf, "documents").where(F.col("source").startswith("session:"))
    turns = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\*\*(human|assistant)\*\*:"), F.lit(1))).alias("role"))
    return turns.groupBy("doc_id", "role").agg(F.count("*").alias("n"))


def stream_day_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per UTC day and type, counted by a streaming query over the table's files."""
    return incremental.counted_by_day(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


def default_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "store_docs").select("row_id", F.array_join(text.add_tags("tags", ["imported", "todo"]), "|").alias("tags"))


def extracted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of every type, with their validity."""
    return entities.extract(table(spark, sf, "store_docs"), "row_id", "body")


def extracted_entities(spark: SparkSession, sf: str) -> DataFrame:
    return extracted_values(spark, sf)


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a Markdown file with its metadata as head: rel_path, mtime_ns, content."""
    fields = F.struct("title", "subject", "source", "date", "tags", "message_id", "thread_id", "in_reply_to", "row_id", "sha256", "processor", "processor_version", F.col("title").alias("web_title"))
    text_ = F.concat(F.lit("---\n"), F.to_json(fields), F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    return table(spark, sf, "store_docs").select(F.concat(F.coalesce("rel_path", F.lit("none")), F.lit("#"), F.col("row_id").cast("string")).alias("rel_path"), "mtime_ns", text_.cast("binary").alias("content"))


def markdown_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, written as Markdown files, parsed again: heads, bodies and hashes."""
    rows = markdown.with_fields(markdown.parse(_as_files(spark, sf)))
    return rows.select("rel_path", "title", "date", F.array_join("tags", "|").alias("tags"), "message_id", F.length("body").cast("bigint").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("digest"), "ok")


def head_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that the heads of all documents break, with how many break them."""
    return dm.head_findings(markdown.parse(_as_files(spark, sf))).groupBy("level", "check").agg(F.count("*").alias("n"))


def new_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes made of all documents' texts: contents that are known by the earlier ones are left out, names made unique."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    files = d.select(F.col("rel_path"), F.lit(1_700_000_000_000_000_000).cast("bigint").alias("mtime_ns"), F.col("text").cast("binary").alias("content"))
    known = d.where(F.col("collected_at") < F.lit(SPLIT).cast("timestamp_ntz")).select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    notes = markdown.new_notes(files, known, ["imported"])
    return notes.select("sha256", F.array_join("tags", "|").alias("tags"), F.col("rel_path").rlike(r"^[^/ ]+\.md$").alias("named"))


def session_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions taken apart into blocks, one per turn, and rendered again; turns of the human come as thoughts."""
    d = table(spark, sf, "documents").where(F.col("source").startswith("session:") & F.col("text").isNotNull())
    turns = d.select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", r"(?m)^(?=\*\*(?:human|assistant)\*\*:)")).alias("turn", "text"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col("text").startswith("**human**:"), "thinking").otherwise("text")
    made = turns.select("conv_id", "turn", F.lit(0).alias("block_no"), kind.alias("type"), "text", none.alias("name"), none.alias("input"), none.alias("content"))
    return blocks.conversations(made).select(F.col("conv_id").alias("doc_id"), F.md5(F.col("body").cast("binary")).alias("digest"))


def cache_puts(spark: SparkSession, sf: str) -> DataFrame:
    """The extraction cache after later deliveries were put into that of the earlier ones: the new entry of a key wins."""
    d = table(spark, sf, "store_docs").where("sha256 IS NOT NULL AND processor IS NOT NULL AND processor_version IS NOT NULL")
    rows = d.select(F.col("sha256").alias("body_sha"), F.lit("ner").alias("extractor"), F.col("processor").alias("model"), F.col("processor_version").alias("version"), F.col("row_id").alias("entry"), F.concat(F.col("ingested_at").cast("string"), F.lpad(F.col("row_id").cast("string"), 20, "0")).alias("cached_at"), "ingested_at")
    late = F.coalesce(F.col("ingested_at") >= F.lit(SPLIT).cast("timestamp_ntz"), F.lit(True))
    return ob.cache_put(rows.where(~late).drop("ingested_at"), rows.where(late).drop("ingested_at")).select("body_sha", "model", "version", "entry")


def manifest_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages of all chat days, the later days merged into the earlier ones; each key once."""
    d = table(spark, sf, "documents").withColumn("early", F.coalesce(F.col("collected_at") < F.lit(SPLIT).cast("timestamp_ntz"), F.lit(False)))
    lines = dm.chat_lines(d.select("early", F.col("doc_id"), "text").withColumn("k", F.struct("early", "doc_id")), "k", "text").where("key_id IS NOT NULL")
    rows = lines.select("key_id", F.concat("time", F.lit(" "), F.lpad(F.col("k.doc_id").cast("string"), 12, "0"), F.lit(" "), "text").alias("timestamp"), "k.early")
    merged = dm.merge_manifest(rows.where("early").drop("early"), rows.where("NOT early").drop("early"))
    return merged.select("key_id", F.md5(F.col("timestamp").cast("binary")).alias("digest"))


def producer_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Who produced what from each object, each producer once per message, in order."""
    found = ob.producers(_producers(spark, sf))
    return found.select("object_sha", F.md5(F.array_join(F.transform("producers", lambda p: F.concat_ws("/", p.message, p.plugin, p.source_sha)), "|").cast("binary")).alias("digest"))


#: An amount's digits with a point before the decimals: of comma and point the last is the mark, a lone comma before at most two digits.
_DIGITS = "regexp_replace(replace(substr(value, 4), chr(39), ''), '^[^0-9]+|[^0-9]+$', '', 'g')"
_AMOUNT = f"""(CASE WHEN NOT regexp_matches(replace({_DIGITS}, ',', ''), '^[0-9.]*$') THEN NULL
 WHEN contains({_DIGITS}, ',') AND contains({_DIGITS}, '.') AND instr(reverse({_DIGITS}), ',') < instr(reverse({_DIGITS}), '.') THEN replace(replace({_DIGITS}, '.', ''), ',', '.')
 WHEN contains({_DIGITS}, ',') AND contains({_DIGITS}, '.') THEN replace({_DIGITS}, ',', '')
 WHEN regexp_matches({_DIGITS}, ',[0-9]{{1,2}}$') THEN regexp_replace(replace(regexp_replace({_DIGITS}, ',([0-9]{{1,2}})$', '#\\1'), ',', ''), '#', '.')
 ELSE replace({_DIGITS}, ',', '') END)"""
#: Remainder 1 modulo 97 of the turned account number, letters read as 10 to 35.
_IBAN_VALID = """(length(replace(value, ' ', '')) BETWEEN 14 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(value, ' ', ''), 5) || substr(replace(value, ' ', ''), 1, 4), ''),
 lambda c: CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda d: CAST(d AS BIGINT))), lambda a, d: (a * 10 + d) % 97) = 1)"""


def _key(e: str) -> str:
    return f"coalesce({e}.scope, 'body') || ':' || coalesce({e}.type, '-') || ':' || coalesce({e}.value, '-')"


def queries() -> dict:
    names = (
        canonical_values, entity_amounts, canon_emails, canon_references, content_hashes, thread_ids, resolve_amendments, pending_amendments, apply_amendments, producer_claims, retractable, queue_rollup,
        producers_refcount, plan_gc, plan_remove, link_names, cache_misses, snapshot_diff, changed_documents, shown_dates, newest_versions, managed_outdated, invalid_entities_by_type, concurrent_keys, thread_summary,
        directions, shared_references, chat_lines, validate_findings, participant_strings, day_buckets, index_health,
        default_tags, extracted_entities, extracted_values, session_turns, stream_day_counts, retractable_claims,
        current_claims, emitted, markdown_scan, head_findings, new_notes, session_bodies, cache_puts, manifest_merge, producer_lists, amount_forms,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    expected = ", ".join(f"({literal(k)}, {literal(raw)}, {literal(v)})" for (k, raw), v in zip(LITERALS, _EXPECTED))
    keys = """
k AS (SELECT * FROM (SELECT row_id, rel_path, unnest([{'k': 'message_id', 'v': message_id}, {'k': 'sha256', 'v': sha256}, {'k': 'path', 'v': rel_path}]) AS e FROM store_docs) WHERE e.v <> ''),
ix AS (SELECT e.k AS kind, e.v AS val, arg_max(row_id, (coalesce(rel_path, ''), row_id)) AS doc FROM k GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN doc_key.message_id <> '' THEN 'message_id' WHEN doc_key.sha256 <> '' THEN 'sha256' WHEN doc_key.path <> '' THEN 'path' END AS kind,
 coalesce(nullif(doc_key.message_id, ''), nullif(doc_key.sha256, ''), nullif(doc_key.path, '')) AS val FROM amendments),
r AS (SELECT a.*, ix.doc FROM a LEFT JOIN ix USING (kind, val))"""
    claims = """
c AS (SELECT DISTINCT * FROM (SELECT doc, emitted_by AS producer, 'tags' AS field, unnest(fields.tags) AS value FROM {0} UNION ALL
 SELECT doc, producer, 'entities', concat_ws(chr(31), coalesce(e.scope, 'body'), e.type, e.value) FROM (SELECT doc, emitted_by AS producer, unnest(fields.entities) AS e FROM {0})) WHERE doc IS NOT NULL AND value IS NOT NULL)"""
    state = f"""
nam AS (SELECT DISTINCT * FROM (SELECT doc, emitted_by AS producer, 'tags' AS field, unnest(fields.tags) AS value, mode, coalesce(emitted_at, '') AS moment, amend_id FROM r WHERE doc IS NOT NULL
 UNION ALL SELECT doc, producer, 'entities', {_key('e')}, mode, moment, amend_id FROM (SELECT doc, emitted_by AS producer, unnest(fields.entities) AS e, mode, coalesce(emitted_at, '') AS moment, amend_id FROM r WHERE doc IS NOT NULL)) WHERE value IS NOT NULL),
sets AS (SELECT doc, emitted_by AS producer, f AS field, max(coalesce(emitted_at, '')) AS set_at FROM (SELECT *, unnest(['tags', 'entities']) AS f FROM r WHERE doc IS NOT NULL AND mode IN ('set', 'replace'))
 WHERE (f = 'tags' AND fields.tags IS NOT NULL) OR (f = 'entities' AND fields.entities IS NOT NULL) GROUP BY 1, 2, 3),
gv AS (SELECT doc, producer, field, value, max(moment) AS given_at FROM nam WHERE mode <> 'retract' GROUP BY 1, 2, 3, 4), tk AS (SELECT doc, producer, field, value, max(moment) AS taken_at FROM nam WHERE mode = 'retract' GROUP BY 1, 2, 3, 4),
cur AS (SELECT doc, producer, field, value FROM gv LEFT JOIN tk USING (doc, producer, field, value) LEFT JOIN sets USING (doc, producer, field) WHERE (set_at IS NULL OR given_at >= set_at) AND (taken_at IS NULL OR given_at > taken_at))"""
    objects = "p AS (SELECT sha256 AS object_sha, processor AS plugin, message_id AS message FROM store_docs WHERE message_id IS NOT NULL)"
    newest = "row_number() OVER (PARTITION BY rel_path ORDER BY mtime_ns DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) = 1"
    slug = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(subject, title), '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    live = "list_filter(coalesce(entities, []), lambda e: e.valid IS DISTINCT FROM false)"
    day = DAY_SQL
    chat_day = "(thread_id IS NOT NULL AND message_id IS NULL)"
    zoned = r"regexp_matches(date, '(?i)(Z|[+-]\d\d:?\d\d)$')"
    rules = [("fail", f"missing_{c}", f"{c} IS NULL" + (f" AND NOT {chat_day}" if c == "sha256" else "")) for c in dm.REQUIRED]
    rules += [
        ("fail", "message_without_thread", "message_id IS NOT NULL AND thread_id IS NULL"),
        ("fail", "message_without_participants", "message_id IS NOT NULL AND coalesce(len(participants), 0) = 0"),
        ("fail", "sha256_form", "NOT regexp_matches(sha256, '^[0-9a-f]{64}$')"),
        ("warn", "date_without_zone", rf"NOT {zoned} AND NOT ({chat_day} AND regexp_matches(date, '^\d{{4}}-\d\d-\d\d$'))"),
        ("warn", "thread_id_form", "NOT regexp_matches(thread_id, '^[0-9a-f]{16}$')"),
        ("warn", "address_not_lower_case", "len(list_filter(participants, lambda p: p.address <> lower(p.address))) > 0"),
        ("warn", "version_form", r"NOT regexp_matches(processor_version, '^\d+\.\d+(\.\d+)?$')"),
    ]
    split = f"TIMESTAMP '{SPLIT}'"
    return {
        "canonical_values": f"SELECT * FROM (VALUES {expected}) AS t(kind, raw, value)",
        "entity_amounts": r"""
SELECT row_id, place - 1 AS place, regexp_extract(e.value, '[0-9]+(\.[0-9]+)?') AS amount,
 CASE WHEN regexp_matches(e.value, '^-?\s*\$|\$\s*$') THEN 'USD' WHEN regexp_matches(e.value, '^-?\s*€|€\s*$') THEN 'EUR' WHEN regexp_matches(e.value, '^-?\s*£|£\s*$') THEN 'GBP' WHEN regexp_matches(e.value, '^-?\s*S?Fr\.?([^A-Za-z]|$)|(^|[^A-Za-z])S?Fr\.?\s*$') THEN 'CHF' ELSE nullif(regexp_extract(e.value, '[A-Z]{3}'), '') END AS currency
FROM (SELECT row_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS place FROM store_docs) WHERE e.type = 'amount'""",
        "canon_emails": r"""
SELECT CASE WHEN contains(x, '@') THEN substr(x, 1, instr(x, '@')) || lower(substr(x, instr(x, '@') + 1)) ELSE lower(x) END AS address, count(*) AS n
FROM (SELECT regexp_replace(p.address, '^\s+|\s+$', '', 'g') AS x FROM (SELECT unnest(participants) AS p FROM store_docs) WHERE p.address IS NOT NULL) GROUP BY 1""",
        "canon_references": r"""
SELECT upper(regexp_replace(e.value, '[\s-]', '', 'g')) AS value, (CASE WHEN starts_with(e.value, '+') THEN '+' ELSE '' END) || regexp_replace(e.value, '[^0-9]', '', 'g') AS digits, count(*) AS n
FROM (SELECT unnest(entities) AS e FROM store_docs) WHERE e.type = 'reference' GROUP BY 1, 2""",
        "content_hashes": r"""
SELECT doc_id, sha256(encode(text)) AS sha256, sha1(encode('blob ' || CAST(octet_length(encode(text)) AS VARCHAR)) || '\x00'::BLOB || encode(text)) AS blob,
 '_objects/' || substr(sha256(encode(text)), 1, 2) || '/' || substr(sha256(encode(text)), 3) AS place FROM documents""",
        "thread_ids": "SELECT row_id, substr(sha256(message_id), 1, 16) AS own_thread FROM store_docs WHERE message_id IS NOT NULL",
        "resolve_amendments": f"WITH {keys} SELECT amend_id, doc AS row_id FROM r",
        "pending_amendments": f"WITH {keys.replace('FROM store_docs)', f'FROM store_docs WHERE ingested_at < {split})')} SELECT emitted_by, count(*) AS n FROM r WHERE doc IS NULL GROUP BY 1",
        "amount_forms": "SELECT * FROM (VALUES ('Frankfurt 5 EUR', '5', 'EUR'), ('Freitag 12.50 USD', '12.50', 'USD'), ('Fr 7', '7', 'CHF'), ('7 Fr.', '7', 'CHF'), ('-SFr. 3.20', '-3.20', 'CHF'), ('€ 4', '4', 'EUR'), ('4€', '4', 'EUR'), ('12 Franken', '12', NULL), ('EUR 1''000.-', '1000.00', 'EUR'), ('USD 1,5', '1.5', 'USD')) AS t(raw, amount, currency)",
        "current_claims": f"WITH {keys}, {state} SELECT producer, field, count(*) AS n, count(DISTINCT doc) AS n_docs FROM cur GROUP BY 1, 2",
        "emitted": """
WITH k AS (SELECT *, md5(to_json([doc_key.message_id, doc_key.sha256, doc_key.path]) || coalesce(to_json(fields), '') || emitted_by) AS h FROM amendments WHERE coalesce(doc_key.message_id, doc_key.sha256, doc_key.path, '') <> '' AND emitted_by <> '' AND fields IS NOT NULL),
a AS (SELECT * FROM k WHERE mode = 'add' AND coalesce(len(fields.tags), 0) + coalesce(len(fields.entities), 0) > 0), q AS (SELECT * FROM a WHERE amend_id % 2 = 0),
n AS (SELECT * FROM a WHERE h NOT IN (SELECT h FROM q) QUALIFY row_number() OVER (PARTITION BY h ORDER BY amend_id) = 1),
s AS (SELECT * FROM k WHERE mode = 'replace' QUALIFY row_number() OVER (PARTITION BY h ORDER BY amend_id) = 1),
every AS (SELECT 'add' AS mode, emitted_by, amend_id FROM q UNION ALL SELECT 'add', emitted_by, amend_id FROM n UNION ALL SELECT 'set', emitted_by, amend_id FROM s)
SELECT mode, emitted_by, count(*) AS n, count(DISTINCT amend_id) AS n_ids FROM every GROUP BY 1, 2""",
        "markdown_scan": """
SELECT coalesce(rel_path, 'none') || '#' || row_id AS rel_path, title, date, array_to_string(tags, '|') AS tags, message_id, length(coalesce(body, '')) AS n_chars, md5(coalesce(body, '')) AS digest, true AS ok FROM store_docs""",
        "head_findings": " UNION ALL ".join(
            f"SELECT * FROM (SELECT '{level}' AS level, '{name}' AS \"check\", count(*) AS n FROM store_docs WHERE {broken}) WHERE n > 0"
            for level, name, broken in [
                *[("fail", f"missing_{c}", f"{c} IS NULL" + (f" AND NOT {chat_day}" if c == "sha256" else "")) for c in dm.REQUIRED],
                *[("warn", f"unregistered_{c}", f"{c} IS NOT NULL") for c in ("title", "in_reply_to", "row_id")],
                ("warn", "unregistered_web_title", "title IS NOT NULL AND source IS DISTINCT FROM 'web'"),
            ]
        ),
        "new_notes": f"""
WITH d AS (SELECT *, sha256(encode(text)) AS s FROM documents WHERE text IS NOT NULL)
SELECT s AS sha256, 'imported' AS tags, true AS named FROM d WHERE s NOT IN (SELECT s FROM d WHERE collected_at < {split}) GROUP BY 1""",
        "session_bodies": r"""
WITH d AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '(?m)^(\*\*(human|assistant)\*\*:)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents WHERE starts_with(source, 'session:') AND text IS NOT NULL),
p AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM d),
f AS (SELECT * FROM p WHERE NOT (t = '' AND i = 1 AND doc_id IN (SELECT doc_id FROM p WHERE i > 1)))
SELECT doc_id, md5(string_agg(CASE WHEN starts_with(t, '**human**:') THEN '> ' || replace(t, chr(10), chr(10) || '> ') ELSE t END, chr(10) || chr(10) ORDER BY i)) AS digest FROM f GROUP BY 1""",
        "cache_puts": f"""
SELECT sha256 AS body_sha, processor AS model, processor_version AS version, row_id AS entry FROM store_docs WHERE sha256 IS NOT NULL AND processor IS NOT NULL AND processor_version IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sha256, processor, processor_version ORDER BY coalesce(ingested_at >= {split}, true) DESC, ingested_at DESC NULLS LAST, row_id DESC) = 1""",
        "manifest_merge": rf"""
WITH l AS (SELECT doc_id, coalesce(collected_at < {split}, false) AS early, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT early, regexp_extract(line, '<!-- key_id: ([A-Za-z0-9_]+) -->\s*$', 1) AS key_id, regexp_extract(line, '^\[(\d\d:\d\d)\] ', 1) || ' ' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || ' ' || regexp_extract(line, '^\[\d\d:\d\d\] [^:]+: (.*?)\s*<!-- key_id: [A-Za-z0-9_]+ -->\s*$', 1) AS ts
 FROM l WHERE regexp_matches(line, '^\[\d\d:\d\d\] [^:]+: .*<!-- key_id: [A-Za-z0-9_]+ -->\s*$'))
SELECT key_id, md5(ts) AS digest FROM m QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY early DESC, ts) = 1""",
        "producer_lists": """
WITH p AS (SELECT sha256 AS o, message_id AS m, min((coalesce(processor, chr(0)), coalesce(sha256(encode(rel_path)), chr(0)))) AS x FROM store_docs WHERE message_id IS NOT NULL GROUP BY 1, 2)
SELECT o AS object_sha, md5(string_agg(concat_ws('/', m, nullif(x[1], chr(0)), nullif(x[2], chr(0))), '|' ORDER BY m)) AS digest FROM p GROUP BY 1""",
        "apply_amendments": f"""
WITH {keys}, {state},
gone AS (SELECT doc, field, list(value) AS vs FROM (SELECT DISTINCT doc, field, value FROM nam WHERE mode <> 'retract' EXCEPT SELECT doc, field, value FROM cur) GROUP BY 1, 2),
g AS (SELECT doc, flatten(list(coalesce(fields.tags, [])) FILTER (WHERE mode <> 'retract')) AS t FROM r WHERE doc IS NOT NULL AND mode <> 'retract' GROUP BY 1),
tagged AS (SELECT row_id, CASE WHEN g.doc IS NULL THEN tags ELSE list_sort(list_distinct(list_concat(coalesce(tags, []), t))) END AS tags FROM store_docs LEFT JOIN g ON row_id = g.doc),
own AS (SELECT DISTINCT row_id, {_key('e')} AS v FROM (SELECT row_id, unnest(entities) AS e FROM store_docs WHERE row_id IN (SELECT doc FROM g))
 UNION SELECT doc, {_key('e')} FROM (SELECT doc, unnest(fields.entities) AS e FROM r WHERE doc IS NOT NULL AND mode <> 'retract')),
untouched AS (SELECT row_id, {_key('e')} AS v FROM (SELECT row_id, unnest(entities) AS e FROM store_docs WHERE row_id NOT IN (SELECT doc FROM g))),
ents AS (SELECT row_id, count(*) AS n, md5(string_agg(v, '|' ORDER BY v)) AS digest FROM (SELECT * FROM own UNION ALL SELECT * FROM untouched)
 WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc = row_id AND field = 'entities' AND list_contains(vs, replace(v, ':', ':'))) GROUP BY 1)
SELECT row_id, array_to_string(CASE WHEN gt.vs IS NULL THEN tags ELSE list_filter(tags, lambda x: NOT list_contains(gt.vs, x)) END, '|') AS tags, coalesce(n, 0) AS n_entities, coalesce(digest, md5('')) AS digest
FROM tagged LEFT JOIN gone gt ON gt.doc = row_id AND gt.field = 'tags' LEFT JOIN ents USING (row_id)""",
        "producer_claims": f"WITH {keys}, {claims.format('r')} SELECT producer, field, count(*) AS n, count(DISTINCT doc) AS n_docs FROM c GROUP BY 1, 2",
        "retractable": f"""
WITH {keys}, s AS (SELECT * FROM r WHERE mode <> 'retract' AND doc IS NOT NULL),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc, emitted_by ORDER BY emitted_at DESC NULLS LAST, amend_id DESC) = 1),
{claims.format('s').replace('c AS', 'b AS', 1)}, {claims.format('l').replace('c AS', 'n AS', 1)}
SELECT doc AS row_id, producer, field, value FROM b WHERE EXISTS (SELECT 1 FROM n WHERE n.doc = b.doc AND n.producer = b.producer AND n.field = b.field)
 AND NOT EXISTS (SELECT 1 FROM n WHERE n.doc = b.doc AND n.field = b.field AND n.value = b.value)""",
        "queue_rollup": "SELECT emitted_by, count(*) AS n FROM amendments WHERE emitted_by IS NOT NULL GROUP BY ROLLUP (emitted_by)",
        "producers_refcount": f"WITH {objects} SELECT object_sha, count(DISTINCT message) AS n, min(message) AS first_message FROM p GROUP BY 1",
        "plan_gc": f"WITH {objects} SELECT DISTINCT sha256 FROM store_docs WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT object_sha FROM p WHERE object_sha IS NOT NULL)",
        "plan_remove": f"""
WITH {objects}, m AS (SELECT DISTINCT message_id AS message FROM store_docs WHERE source = 'imap' AND message_id IS NOT NULL),
x AS (SELECT object_sha, count(*) FILTER (WHERE m.message IS NULL) AS n_left, count(m.message) AS n_gone FROM p LEFT JOIN m USING (message) GROUP BY 1)
SELECT object_sha, CASE WHEN n_left = 0 THEN 'delete' ELSE 'rewrite' END AS action, n_left FROM x WHERE n_gone > 0""",
        "link_names": f"""
WITH n AS (SELECT string_split(rel_path, '/')[1] AS folder, sha256, min((CASE WHEN {slug} = '' OR {slug} IS NULL THEN coalesce(nullif({slug}, ''), CASE WHEN coalesce(subject, title) IS NULL THEN NULL ELSE 'note' END) ELSE {slug} END) || '.md') AS name
 FROM store_docs WHERE sha256 IS NOT NULL AND rel_path IS NOT NULL GROUP BY 1, 2)
SELECT folder, sha256, CASE WHEN name IS NULL OR row_number() OVER (PARTITION BY folder, name ORDER BY sha256) = 1 THEN name ELSE substr(name, 1, length(name) - 3) || '_' || substr(sha256, 1, 8) || '.md' END AS name FROM n""",
        "cache_misses": f"""
WITH k AS (SELECT sha256, processor, processor_version, bool_or(ingested_at < {split}) AS hit FROM store_docs WHERE sha256 IS NOT NULL AND processor IS NOT NULL AND processor_version IS NOT NULL GROUP BY 1, 2, 3)
SELECT processor AS model, count(*) AS n FROM k WHERE NOT coalesce(hit, false) GROUP BY 1""",
        "snapshot_diff": f"""
WITH b AS (SELECT * FROM store_docs WHERE rel_path IS NOT NULL AND ingested_at < {split} QUALIFY {newest}), n AS (SELECT * FROM store_docs WHERE rel_path IS NOT NULL QUALIFY {newest})
SELECT rel_path, CASE WHEN b.row_id IS NULL THEN 'added' WHEN n.row_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM b FULL JOIN n USING (rel_path) WHERE b.row_id IS NULL OR n.row_id IS NULL OR b.mtime_ns IS DISTINCT FROM n.mtime_ns OR b.sha256 IS DISTINCT FROM n.sha256""",
        "changed_documents": f"""
WITH b AS (SELECT * FROM store_docs WHERE rel_path IS NOT NULL AND ingested_at < {split} QUALIFY {newest}), n AS (SELECT * FROM store_docs WHERE rel_path IS NOT NULL AND NOT starts_with(rel_path, 'chat/') QUALIFY {newest})
SELECT rel_path, n.row_id FROM b FULL JOIN n USING (rel_path) WHERE b.row_id IS NULL OR n.row_id IS NULL OR b.mtime_ns IS DISTINCT FROM n.mtime_ns OR b.sha256 IS DISTINCT FROM n.sha256""",
        "shown_dates": r"""
SELECT row_id, strftime(timezone('UTC', t), '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(timezone('UTC', t), '%Y-%m-%d %H:%M UTC') AS shown
FROM (SELECT row_id, CAST(date AS TIMESTAMPTZ) AS t FROM store_docs WHERE regexp_matches(date, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$') AND try_cast(date AS TIMESTAMPTZ) IS NOT NULL)""",
        "newest_versions": f"SELECT rel_path, row_id FROM store_docs WHERE rel_path IS NOT NULL QUALIFY {newest}",
        "managed_outdated": f"SELECT processor_version, count(*) AS n FROM store_docs WHERE processor = 'eml' AND processor_version IS DISTINCT FROM '{CURRENT}' GROUP BY 1",
        "invalid_entities_by_type": "SELECT coalesce(e.type, 'unknown') AS type, count(*) AS n FROM (SELECT unnest(entities) AS e FROM store_docs) WHERE e.valid = false GROUP BY 1",
        "concurrent_keys": "SELECT query_id, list_no, rank, count(*) AS n FROM hits GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "thread_summary": f"""
WITH a AS (SELECT thread_id, count(DISTINCT row_id) AS n_messages, CAST(min({day}) AS VARCHAR) AS first_day, CAST(max({day}) AS VARCHAR) AS last_day FROM store_docs WHERE thread_id IS NOT NULL GROUP BY 1),
p AS (SELECT thread_id, count(DISTINCT lower(p.address)) AS n_addresses FROM (SELECT thread_id, unnest(participants) AS p FROM store_docs WHERE thread_id IS NOT NULL) GROUP BY 1)
SELECT thread_id, n_messages, first_day, last_day, coalesce(n_addresses, 0) AS n_addresses FROM a LEFT JOIN p USING (thread_id)""",
        "directions": f"""
SELECT CASE WHEN len(list_filter(participants, lambda p: p.role = 'from' AND lower(p.address) = '{OWNER}')) > 0 THEN 'out' ELSE 'in' END AS direction, count(*) AS n FROM store_docs WHERE len(participants) > 0 GROUP BY 1""",
        "shared_references": f"""
SELECT e.value AS value, count(DISTINCT row_id) AS n_docs, min(row_id) AS first_doc, max(row_id) AS last_doc
FROM (SELECT row_id, unnest({live}) AS e FROM store_docs) WHERE e.type = 'reference' AND e.value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT row_id) > 1""",
        "chat_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, regexp_extract(line, '^\[(\d\d:\d\d)\] ([^:]+): ', 1) AS t, regexp_extract(line, '^\[(\d\d:\d\d)\] ([^:]+): ', 2) AS s FROM l WHERE regexp_matches(line, '^\[\d\d:\d\d\] [^:]+: .*<!-- key_id: [A-Za-z0-9_]+ -->\s*$'))
SELECT doc_id, count(*) AS n, min(t) AS first, max(t) AS last, count(DISTINCT s) AS n_senders FROM m GROUP BY 1""",
        "validate_findings": " UNION ALL ".join(f"SELECT row_id, '{level}' AS level, '{name}' AS \"check\" FROM store_docs WHERE {broken}" for level, name, broken in rules),
        "participant_strings": """
WITH p AS (SELECT row_id, i, trim(concat_ws(' ', p."name", '<' || p.address || '>')) AS s FROM (SELECT row_id, unnest(participants) AS p, generate_subscripts(participants, 1) AS i FROM store_docs)),
f AS (SELECT row_id, s, min(i) AS i FROM p GROUP BY 1, 2)
SELECT row_id, coalesce(string_agg(s, '; ' ORDER BY i), '') AS people FROM store_docs LEFT JOIN f USING (row_id) WHERE participants IS NOT NULL GROUP BY 1""",
        "day_buckets": "SELECT CAST(CAST(timezone('Europe/Zurich', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "session_turns": r"""
SELECT doc_id, role, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^\*\*(human|assistant)\*\*:', 1)) AS role FROM documents WHERE starts_with(source, 'session:')) GROUP BY 1, 2""",
        "stream_day_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "default_tags": "SELECT row_id, array_to_string(list_concat(coalesce(tags, []), list_filter(['imported', 'todo'], lambda t: NOT list_contains(coalesce(tags, []), t))), '|') AS tags FROM store_docs",
        "extracted_entities": " UNION ALL ".join(
            f"SELECT DISTINCT row_id, '{kind}' AS type, value, {shown} AS canonical, {valid} AS valid FROM (SELECT row_id, unnest(regexp_extract_all(body, {literal(entities.PATTERNS[kind])})) AS value FROM store_docs WHERE length(body) > 0)"
            for kind, shown, valid in (
                ("email", "substr(value, 1, instr(value, '@')) || lower(substr(value, instr(value, '@') + 1))", "CAST(NULL AS BOOLEAN)"),
                ("url", "value", "CAST(NULL AS BOOLEAN)"),
                ("phone", "'+' || regexp_replace(value, '[^0-9]', '', 'g')", "CAST(NULL AS BOOLEAN)"),
                ("iban", "replace(value, ' ', '')", _IBAN_VALID),
                ("amount", _AMOUNT, "CAST(NULL AS BOOLEAN)"),
            )
        ),
        "index_health": """
SELECT (SELECT count(DISTINCT rel_path) FROM store_docs) AS n_docs, (SELECT count(DISTINCT rel_path) FROM store_docs WHERE length(body) > 0) AS n_indexed, (SELECT count(DISTINCT rel_path) FROM chunk_vectors) AS n_embedded,
 (SELECT count(DISTINCT rel_path) FROM store_docs WHERE rel_path NOT IN (SELECT rel_path FROM store_docs WHERE length(body) > 0 AND rel_path IS NOT NULL)) AS n_stale""",
    }
