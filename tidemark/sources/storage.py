"""Files opened inside tasks, by the paths that Spark gives."""

from __future__ import annotations

from functools import reduce
from operator import or_
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's names of file systems, and Arrow's.
SCHEMES = {
    "file": "file",
    "hdfs": "hdfs",
    "s3": "s3",
    "s3a": "s3",
    "s3n": "s3",
    "gs": "gs",
    "abfs": "abfs",
    "abfss": "abfss",
}


def reachable(path: Column) -> Column:
    """Whether tasks can open the file by themselves, by the scheme of its path."""
    return reduce(or_, [path.startswith(f"{scheme}:") for scheme in SCHEMES])


def locate(path: str):
    """Arrow's file system for an encoded path, and the path in it."""
    from pyarrow import fs

    parts = urlsplit(path.replace("#", "%23").replace("?", "%3F"))
    scheme, inner = SCHEMES.get(parts.scheme), unquote(parts.path)
    if scheme is None:
        raise ValueError(f"files of {parts.scheme}:// cannot be opened inside tasks: {path}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + inner.lstrip("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}/")
    return system, inner if scheme == "hdfs" else f"{base.rstrip('/')}{inner}"


def open_file(path: str) -> pa.NativeFile:
    """For reads at any place."""
    system, inner = locate(path)
    return system.open_input_file(inner)


def open_stream(path: str, block: int = 1 << 16) -> pa.NativeFile:
    """For reads from the start, ``block`` bytes at a time."""
    system, inner = locate(path)
    return system.open_input_stream(inner, compression=None, buffer_size=block)
