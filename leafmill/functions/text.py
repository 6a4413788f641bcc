"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.expansion import END_MARK

#: Letters, numbers and the underscore, by Unicode category, so that every engine agrees.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_'-]+"
_BLANK = r"[\s\u0085  -     　]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """All words of two or more characters, lower case, in order, with repeats; null for null."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def tokenize(text: Column | str) -> Column:
    """Distinct words in order of first appearance; an empty list for null and empty texts."""
    return F.coalesce(F.array_distinct(words(text)), F.array().cast("array<string>"))


def strip(text: Column | str) -> Column:
    """White space of any kind removed at both ends."""
    # The look-behind keeps a long run inside the text from being tried at each of its places.
    return F.regexp_replace(col(text), f"^{_BLANK}+|(?<!{_BLANK}){_BLANK}+$", "")


def path_tokens(path: Column | str) -> Column:
    """Lower-case parts of a path, cut at separators and where capitals begin; with repeats."""
    pieces = F.split(col(path), r"[/_\-.\s]+")
    humps = F.flatten(F.transform(pieces, lambda p: F.split(p, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")))
    return F.filter(F.transform(humps, F.lower), lambda x: x != "")


def path_score(path: Column | str, term: Column | str) -> Column:
    """3: the term is a part of the path, 2: begins one, 1: lies within the path, 0: none of these."""
    parts, term = path_tokens(path), F.lower(col(term))
    whole = F.transform(F.split(col(path), r"/"), lambda p: F.lower(p))
    every = F.concat(parts, whole)
    return (
        F.when(F.exists(every, lambda x: x == term), 3)
        .when(F.exists(every, lambda x: x.startswith(term)), 2)
        .when(F.lower(col(path)).contains(term), 1)
        .otherwise(0)
    )


def normalize_path(path: Column | str) -> Column:
    """Forward slashes only, without any leading ``./``."""
    return F.regexp_replace(F.translate(col(path), "\\", "/"), r"^(\./)+", "")


def drive_id(path: Column | str) -> Column:
    """The third part of an inventory path, or the whole path if it has fewer."""
    clean = normalize_path(path)
    parts = F.split(clean, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 3)).otherwise(clean)


def has_prefix(path: Column | str, prefixes: list[str]) -> Column:
    """Whether the path lies in one of the folders; empty names are ignored."""
    clean = normalize_path(path)
    found = F.lit(False)
    for prefix in prefixes:
        name = prefix.replace("\\", "/").strip("/")
        while name.startswith("./"):
            name = name[2:]
        if name:
            found = found | (clean == name) | clean.startswith(name + "/")
    return found


def snippet(body: Column | str, terms: Column, width: int = 240, before: int = 60) -> Column:
    """A window around the first of ``terms`` (in their order) that occurs, else the head of the body."""
    body = col(body)
    places = F.filter(F.transform(terms, lambda t: F.position(t, F.lower(body))), lambda p: p > 0)
    at = F.coalesce(F.get(places, F.lit(0)), F.lit(0))
    start = F.greatest(at - before, F.lit(1))
    window = F.substr(body, start, F.lit(width))
    clean = F.trim(F.regexp_replace(window, "[\r\n]+", " "))
    marked = F.concat(F.when(start > 1, "…").otherwise(""), clean, F.when(start + width - 1 < F.length(body), "…").otherwise(""))
    return F.when(at > 0, marked).otherwise(F.trim(F.regexp_replace(F.substr(body, F.lit(1), F.lit(width)), "[\r\n]+", " ")))


def slugify(text: Column | str, empty: str = "") -> Column:
    """Lower case, runs of anything but word characters and hyphens as one underscore; ``empty`` if nothing is left."""
    out = F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}_-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_+|_+$", "")
    return F.when(out == "", empty).otherwise(out)


def window_starts(text: Column | str, window: int = 2000, overlap: int = 200) -> Column:
    """Start offsets of sliding character windows; the last reaches the end. Null and empty texts have none."""
    stride = max(1, window - overlap)
    n = F.length(col(text))
    last = F.greatest(F.ceil((n - window) / F.lit(stride)), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def strip_end_tokens(text: Column | str) -> Column:
    """Text without model end-of-sequence marks."""
    return F.regexp_replace(col(text), END_MARK, "")


def thread_id(root: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a thread's root id."""
    return F.substring(F.sha2(col(root), 256), 1, 16)


def live_entities(entities: Column | str) -> Column:
    """Entities that are not marked invalid; an unknown mark is kept."""
    return F.filter(col(entities), lambda e: ~F.coalesce(~e.valid, F.lit(False)))


def add_tags(tags: Column | str, defaults: list[str]) -> Column:
    """The tags as they are, then the default ones that are missing."""
    own = F.coalesce(col(tags), F.array().cast("array<string>"))
    return F.concat(own, F.array_except(F.array(*[F.lit(t) for t in defaults]).cast("array<string>"), own))


def participant_names(participants: Column | str) -> Column:
    """Distinct ``Name <address>`` strings in order."""
    return F.array_distinct(F.transform(col(participants), lambda p: F.trim(F.concat_ws(" ", p["name"], F.concat(F.lit("<"), p.address, F.lit(">"))))))


def field_lists(body: Column | str, title: Column | str, tags: Column | str, entities: Column | str, participants: Column | str) -> Column:
    """A document's tokens, a list for each field: the tags first, whole and in lower case, then body, title, entities and participants.

    Invalid entities are left out; fields without tokens have an empty list.
    """
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    each = lambda a, f: F.coalesce(F.flatten(F.transform(a, f)), nothing)
    return F.concat(
        F.array(F.coalesce(F.filter(F.transform(col(tags), F.lower), lambda t: t.isNotNull()), none), tokenize(body), tokenize(title)),
        each(live_entities(entities), lambda e: F.array(tokenize(e.value), tokenize(e.canonical))),
        each(col(participants), lambda p: F.array(tokenize(p.address), tokenize(p["name"]))),
    )


def field_tokens(body: Column | str, title: Column | str, tags: Column | str, entities: Column | str, participants: Column | str) -> Column:
    """A document's tokens: each field's own, one after the other, so a word in two fields counts twice."""
    return F.flatten(field_lists(body, title, tags, entities, participants))


def chunk_prefix(title: Column | str, tags: Column | str, entities: Column | str, participants: Column | str, limit: int = 500) -> Column:
    """Title, tags, entities and participants, a line each, empty ones skipped, cut at ``limit`` characters."""
    none = F.lit(None).cast("string")
    blank = lambda c: F.when(c != "", c).otherwise(none)
    ents = F.array_join(F.flatten(F.transform(live_entities(entities), lambda e: F.array(e.value, e.canonical))), " ")
    people = F.array_join(F.flatten(F.transform(col(participants), lambda p: F.array(p.address, p["name"]))), " ")
    return F.substring(F.concat_ws("\n", blank(col(title)), blank(F.array_join(col(tags), " ")), blank(ents), blank(people)), 1, limit)
