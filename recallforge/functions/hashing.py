"""Content addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANDLE_PREFIX = "ccr_"
HANDLE = rf"^{HANDLE_PREFIX}[0-9a-f]{{16}}$"


def content_hash(content: Column) -> Column:
    """Tells changed from unchanged content; 64 bits as hexadecimal."""
    return F.substring(F.sha2(content, 256), 1, 16)


def blob_handle(content: Column) -> Column:
    return F.concat(F.lit(HANDLE_PREFIX), F.substring(F.sha2(content, 256), 1, 16))


def is_handle(handle: Column) -> Column:
    return F.coalesce(handle.rlike(HANDLE), F.lit(False))


def shard_path(handle: Column) -> Column:
    """objects/aa/bb/<hash>.bin for a valid handle."""
    digits = F.substring(handle, len(HANDLE_PREFIX) + 1, 16)
    return F.concat_ws("/", F.lit("objects"), F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.concat(digits, F.lit(".bin")))


def path_bank(path: Column) -> Column:
    """Bank id of a repository without a remote."""
    return F.concat(F.lit("repo-"), F.substring(F.sha2(path, 256), 1, 8))
