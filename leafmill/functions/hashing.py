"""Content hashes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col


def _blob(data: Column) -> Column:
    data = data.cast("binary")
    return F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data)


def sha256(data: Column | str) -> Column:
    """SHA-256 of text (UTF-8) or bytes."""
    return F.sha2(col(data).cast("binary"), 256)


def git_blob_sha1(data: Column | str) -> Column:
    """The SHA-1 under which git stores the content."""
    return F.sha1(_blob(col(data)))


def git_blob_sha256(data: Column | str) -> Column:
    """The same in a SHA-256 repository."""
    return F.sha2(_blob(col(data)), 256)


def object_path(sha: Column | str) -> Column:
    """Place of an object in the content store: two digits as a folder, the rest as a name."""
    return F.concat(F.lit("_objects/"), F.substring(col(sha), 1, 2), F.lit("/"), F.substring(col(sha), 3, 64))
