"""Trees of Markdown files with a YAML head, as a table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import hashing, text
from leafmill.operators.ranking import rank_rows

#: Top folders that hold no documents.
SKIPPED = ("plugins", "originals", ".git", ".index")
SCHEMA = "rel_path string, mtime_ns bigint, body string, head string, sha256 string, ok boolean"


def split_head(content: str) -> tuple[str | None, str]:
    """(YAML head or None, body) of a file's text."""
    if not content.startswith("---"):
        return None, content
    lines = content.split("\n")
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    return None, content


def _parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for part in parts:
        rows = []
        for path, mtime, content in zip(part.rel_path, part.mtime_ns, part.content):
            raw = bytes(content)
            try:
                head, body = split_head(raw.decode("utf-8-sig"))
                parsed = yaml.safe_load(head) if head else {}
                if not isinstance(parsed, dict):
                    raise ValueError("the head is no mapping")
                rows.append((path, mtime, body, json.dumps(parsed, default=str, ensure_ascii=False), None, True))
            except (UnicodeDecodeError, ValueError, yaml.YAMLError):
                rows.append((path, mtime, None, None, None, False))
        yield pd.DataFrame(rows, columns=["rel_path", "mtime_ns", "body", "head", "sha256", "ok"])


def read(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``rel_path, mtime_ns, body, head (JSON), sha256, ok`` of all ``.md`` files below ``root``.

    Files in skipped top folders are left out.  A file whose head cannot be read
    has ``ok`` false and no body, so that it can be counted.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    clean = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + clean.replace(".", "\\.") + "/", "")
    listed = files.select(rel.alias("rel_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    listed = listed.where(~F.split_part("rel_path", F.lit("/"), F.lit(1)).isin(*skipped))
    return parse(listed)


def parse(files: DataFrame) -> DataFrame:
    """``rel_path, mtime_ns, body, head (JSON), sha256, ok`` of files (rel_path, mtime_ns, content BINARY); see ``read``."""
    return files.select("rel_path", "mtime_ns", "content").mapInPandas(_parse, SCHEMA).withColumn("sha256", hashing.sha256("body"))


def with_fields(docs: DataFrame) -> DataFrame:
    """The core fields of the head as columns, the whole head as VARIANT in ``extra``."""
    fields = F.from_json("head", "source string, date string, title string, subject string, tags array<string>, processor string, processor_version string, message_id string, thread_id string, in_reply_to string")
    return docs.withColumn("__f", fields).select("*", "__f.*", F.try_parse_json("head").alias("extra")).drop("__f")


def notes(spark: SparkSession, root: str, known: DataFrame, default_tags: list[str]) -> DataFrame:
    """Plain notes (txt, md, markdown) below ``root``; see ``new_notes``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,markdown}").option("recursiveFileLookup", "true").load(root)
    return new_notes(files.select(F.col("path").alias("rel_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content"), known, default_tags)


def new_notes(files: DataFrame, known: DataFrame, default_tags: list[str]) -> DataFrame:
    """``rel_path, body, sha256, tags, date, head`` of notes (rel_path, mtime_ns, content BINARY) that are not known by content yet.

    ``known`` has ``sha256``, of the files' bytes.  A YAML head is taken off the
    body and keeps its fields; one that cannot be read stays in the body.  The
    note's own tags come first, then the default ones that are missing.  A date
    of the head stays, else it is the file's.  Equal contents come once, the
    smallest path wins; names that clash get a number.
    """
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    fresh = hashed.groupBy("sha256").agg(F.min(F.struct("rel_path", "mtime_ns", "content")).alias("f")).join(known.select("sha256"), "sha256", "left_anti")
    # The SHA-256 goes along as the path, as it is what the content is known by.
    parsed = parse(fresh.select(F.col("sha256").alias("rel_path"), "f.mtime_ns", "f.content")).select(F.col("rel_path").alias("sha256"), "body", "head", "ok")
    fields = F.from_json("head", "tags array<string>, date string")
    joined = fresh.select("sha256", "f.rel_path", "f.mtime_ns", F.col("f.content").alias("raw")).join(parsed, "sha256").withColumn("fields", fields)
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.[^.]+$", "")
    named = joined.withColumn("slug", text.slugify(stem, "note"))
    written = F.date_format(F.timestamp_micros((F.col("mtime_ns") / 1000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    # A name that many notes share is numbered over many tasks.
    ranked = rank_rows(named.select("sha256", "slug", F.coalesce("body", F.decode("raw", "UTF-8")).alias("body"), "head", F.col("fields.tags").alias("own"), F.coalesce("fields.date", written).alias("date")), ["slug"], [F.asc("sha256")])
    return ranked.select(
        F.concat("slug", F.when(F.col("rank") > 1, F.concat(F.lit("_"), F.col("rank").cast("string"))).otherwise(""), F.lit(".md")).alias("rel_path"),
        "body",
        "sha256",
        text.add_tags("own", default_tags).alias("tags"),
        "date",
        "head",
    )
