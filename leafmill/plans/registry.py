"""Converters and amenders: registration, checks, and runs over tables."""

from __future__ import annotations

import inspect
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import documents
from leafmill.session import written

log = logging.getLogger(__name__)


@dataclass
class Plugin:
    """A converter makes documents, an amender makes amendments of documents."""

    name: str
    version: str
    kind: str
    run: Callable
    config: dict = field(default_factory=dict)
    description: str = ""
    folders: tuple[str, ...] = ()
    options: dict[str, dict] = field(default_factory=dict)


# What may be said of an option.
OPTION_KEYS = frozenset({"required", "default", "description", "secret"})


def check_manifest(plugin: Plugin) -> list[tuple[str, str]]:
    """(level, message) of what is wrong with a registration; empty if nothing is."""
    out = []
    if not re.fullmatch(r"[a-z][a-z0-9_-]*", plugin.name):
        out.append(("fail", "the name must be lower-case letters, digits, hyphens and underscores"))
    if not re.fullmatch(r"\d+\.\d+(\.\d+)?", plugin.version):
        out.append(("fail", "the version must be numbers with points"))
    if plugin.kind not in ("converter", "amender"):
        out.append(("fail", "the kind must be converter or amender"))
    for folder in plugin.folders:
        if folder.startswith("/") or ".." in folder.split("/"):
            out.append(("fail", f"the folder {folder!r} must lie below the store"))
    for name, said in plugin.options.items():
        if not isinstance(said, dict):
            out.append(("fail", f"the option {name} must be a dictionary"))
        elif unknown := sorted(set(said) - OPTION_KEYS):
            out.append(("warn", f"the option {name} has unknown keys: {', '.join(unknown)}"))
    missing = [name for name, said in plugin.options.items() if isinstance(said, dict) and said.get("required") and name not in plugin.config and "default" not in said]
    if missing:
        out.append(("fail", f"options without a value: {', '.join(missing)}"))
    if not plugin.description:
        out.append(("warn", "a description is missing"))
    return out


def check_interface(plugin: Plugin) -> list[tuple[str, str]]:
    """What is wrong with the signature: a converter takes (spark, config), an amender (documents, config) and may take what a run created."""
    wanted = ["spark", "config"] if plugin.kind == "converter" else ["documents", "config"]
    given = inspect.signature(plugin.run).parameters
    have = list(given)
    out = [] if have[:2] == wanted else [("fail", f"the function must take {', '.join(wanted)}, not {', '.join(have) or 'nothing'}")]
    if plugin.kind == "amender" and "created" not in given and not any(p.kind == p.VAR_KEYWORD for p in given.values()):
        out.append(("warn", "without the argument created it sweeps all documents on every run"))
    return out


class Registry:
    """Plugins by name; of two with one name the later stays."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        problems = check_manifest(plugin) + check_interface(plugin)
        if any(level == "fail" for level, _ in problems):
            raise ValueError("; ".join(message for _, message in problems))
        self.plugins[plugin.name] = plugin

    def remove(self, name: str) -> bool:
        return self.plugins.pop(name, None) is not None

    def convert(self, name: str, spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
        """Documents of a converter, marked with its name and version; contents that ``known`` (sha256) has are left out."""
        plugin = self.plugins[name]
        docs = plugin.run(spark, plugin.config).withColumns({"processor": F.lit(plugin.name), "processor_version": F.lit(plugin.version)})
        return docs if known is None else docs.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")

    def amend(self, docs: DataFrame, skipped: list[str] | None = None, created: DataFrame | None = None) -> list[DataFrame]:
        """Amendments of all amenders for documents outside the skipped folders; one that fails is logged and left out.

        Each amender's records are written when it runs, so that what fails only
        then fails here.  ``created`` (rel_path) are the documents that a run
        made; amenders that take them need not sweep the others.
        """
        scope = docs.where(~text.has_prefix("rel_path", skipped or []))
        out = []
        for plugin in self.plugins.values():
            if plugin.kind == "amender":
                extra = {"created": created} if created is not None and "created" in inspect.signature(plugin.run).parameters else {}
                try:
                    out.append(written(plugin.run(scope, plugin.config, **extra), "amender-records"))
                except Exception:  # whatever a given amender raises
                    log.warning("amender %s failed", plugin.name, exc_info=True)
        return out

    def reprocess(self, name: str, docs: DataFrame, all_versions: bool = False) -> DataFrame:
        """Documents that a converter should make again: outdated ones, or all of its."""
        plugin = self.plugins[name]
        return documents.managed(docs, name, None if all_versions else plugin.version)


def scrub(docs: DataFrame, kinds: list[str], dry_run: bool = True) -> DataFrame:
    """Documents without invalid entities of the given types; as a dry run only ``row_id, n`` of what would go."""
    gone = lambda e: e.type.isin(kinds) & F.coalesce(~e.valid, F.lit(False))
    if dry_run:
        return docs.select("row_id", F.size(F.filter("entities", gone)).alias("n")).where("n > 0")
    return docs.withColumn("entities", F.filter("entities", lambda e: ~gone(e)))


def conformance(plugin: Plugin, outputs: DataFrame) -> DataFrame:
    """``level, check, n`` of a converter's documents; no documents at all is a failure."""
    found = documents.findings(outputs, "rel_path").groupBy("level", "check").agg(F.count("*").alias("n"))
    empty = outputs.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("fail").alias("level"), F.lit("no_output").alias("check"), "n")
    return found.unionByName(empty)


def same_twice(first: DataFrame, second: DataFrame) -> bool:
    """Whether two runs gave the same rows, compared by counts of row hashes."""
    columns = sorted(first.columns)
    one = first.select(F.xxhash64(*columns).alias("h")).groupBy("h").agg(F.count("*").alias("a"))
    two = second.select(F.xxhash64(*columns).alias("h")).groupBy("h").agg(F.count("*").alias("b"))
    return one.join(two, "h", "full").where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count() == 0
