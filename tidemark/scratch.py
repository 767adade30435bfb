"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``. Only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def materialise(
    df: DataFrame,
    name: str,
    partition_by: tuple[str, ...] = (),
    session: SparkSession | None = None,
) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, and later steps see real sizes."""
    path = scratch_path(session or df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


#: Rows of at most a few hundred bytes (paths, places of columns) that are safe to broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, known_rows: int | None = None
) -> DataFrame:
    """Hint a broadcast only after counting: more than ``max_rows`` rows are joined by shuffle.

    The count stops after ``max_rows + 1`` rows. Pass a materialised frame of narrow rows.
    """
    rows = df.limit(max_rows + 1).count() if known_rows is None else known_rows
    return F.broadcast(df) if rows <= max_rows else df


#: What one task is given at most: rows that each stand for a file, and bytes of these files.
TASK_FILES, TASK_BYTES = 1000, 64 << 20


def spread_tasks(df: DataFrame, size: str | None = None) -> DataFrame:
    """Spread rows that each stand for a file over tasks: by their number and, given the column ``size``,
    by the bytes to read. The number of partitions is fixed, since adaptive execution would merge a table
    so small into one."""
    total = F.sum(size) if size else F.lit(0)
    rows, weight = df.agg(F.count("*"), F.coalesce(total, F.lit(0))).first()
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, rows // TASK_FILES, weight // TASK_BYTES)
    return df.repartition(max(1, min(tasks, rows)))
