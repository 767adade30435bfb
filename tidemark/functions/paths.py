"""Column expressions on file paths and URLs. All are plain Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.contracts import ATTACHMENTS, FORMATS


def unit_of(path: Column) -> Column:
    """What counts as one file: the path, or the directory for Spark's ``part-*`` files."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def dataset_of(path: Column) -> Column:
    """The named file or directory: :func:`unit_of` without ``key=value`` partition directories."""
    return F.regexp_replace(unit_of(path), r"(/[^/=]+=[^/]*)+$", "")


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def file_name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name_of(path), r"(?<=.)\.[^.]+$", "")


def type_of(path: Column, names: Iterable[str]) -> Column:
    """Table name whose lower case equals the lower-case stem, else NULL."""
    stem = F.lower(stem_of(path))
    found = F.lit(None).cast("string")
    for name in names:
        found = F.when(stem == name.lower(), F.lit(name)).otherwise(found)
    return found


def format_of(path: Column) -> Column:
    """``csv`` or ``parquet`` from the suffix in any case, else NULL."""
    suffix = F.lower(F.regexp_extract(file_name_of(path), r"^.+\.([^.]+)$", 1))
    return F.when(suffix.isin(*FORMATS), suffix)


def attached_to(path: Column) -> Column:
    """Directory that owns the attachments directory holding ``path``, else NULL."""
    owner = F.regexp_extract(path, rf"^(.*?)/{ATTACHMENTS}/", 1)
    return F.when(owner != "", owner)


def partition_value(path: Column, key: str) -> Column:
    """Value of a ``key=value`` directory in an encoded file path, else NULL."""
    value = F.regexp_extract(path, rf"/{key}=([^/]*)/", 1)
    # Escaped once by the partitioned write and once more by the file path; keep plus signs.
    for _ in range(2):
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.when(value != "", value)
