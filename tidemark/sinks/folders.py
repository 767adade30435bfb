"""Small files and folders on whatever file system Spark writes to."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _absent(error: Py4JJavaError) -> bool:
    return error.java_exception.getClass().getSimpleName() in ("FileNotFoundException", "NoSuchFileException")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    where, fs = _place(spark, path)
    try:
        return [status.getPath().getName() for status in fs.listStatus(where)]
    except Py4JJavaError as error:
        if _absent(error):
            return []
        raise


def make(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.mkdirs(where)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, None if there is no such file."""
    where, fs = _place(spark, path)
    try:
        stream = fs.open(where)
    except Py4JJavaError as error:
        if _absent(error):
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole content at once; False if it exists, which then stays as it is.

    The content is written under another name first. A local folder gets it by a hard link, any other
    file system by renaming, which must refuse to replace a file, as that of HDFS does.
    """
    where, fs = _place(spark, path)
    parent = where.getParent()
    fs.mkdirs(parent)
    draft = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{where.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    real = fs.resolvePath(draft).toUri()
    try:
        if real.getScheme() == "file":
            folder, name = os.path.split(real.getPath())
            try:
                os.link(f"{folder}/{name}", f"{folder}/{where.getName()}")
            except FileExistsError:
                return False
            return True
        return not fs.exists(where) and fs.rename(draft, where)
    finally:
        fs.delete(draft, False)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes files and folders that a table has written; absent ones are passed over."""
    for path in paths:
        where, fs = _place(spark, path)
        fs.delete(where, True)
