"""Merges driven by newly arrived files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.contracts import EXPORT_CONTRACTS, Contract
from tidemark.plans.exports import compress_exports

_LISTING = (
    T.StructType()
    .add("path", T.StringType())
    .add("modificationTime", T.TimestampType())
    .add("length", T.LongType())
    .add("content", T.BinaryType())
)


def merge_arrivals(
    spark: SparkSession,
    root: str,
    output: str,
    checkpoint: str,
    contracts: Sequence[Contract] = EXPORT_CONTRACTS,
    keep: str = "latest",
    max_files: int = 1000,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start a stream that merges files arriving below ``root`` into the tables below ``output``.

    The stream carries the file listing, since files differ in their columns. Each micro-batch takes
    at most ``max_files`` files, so the list of paths handed to the batch job is bounded, and merges
    under its own batch name, so a replayed batch changes nothing. ``trigger`` defaults to
    ``{"availableNow": True}``: merge what is there, then stop. ``options`` go to
    :func:`compress_exports`; each batch keeps all its files (``policy="all"``) unless told otherwise.
    """
    options = {"policy": "all", **options}

    def merge(batch: DataFrame, number: int) -> None:
        found = [row.path for row in batch.select("path").collect()]
        if found:
            # Paths are file names here, not patterns.
            roots = [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in found]
            compress_exports(
                spark, roots, output, contracts, keep=keep, batch=f"{checkpoint}#{number}", **options
            )

    arrivals = (
        spark.readStream.schema(_LISTING)
        .format("binaryFile")
        .options(recursiveFileLookup=True, maxFilesPerTrigger=max_files)
        .load(root)
        .select("path")
    )
    writer = arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
