"""File catalogue: what lies under the input folders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import EXPORT_CONTRACTS, Contract
from tidemark.functions import paths
from tidemark.scratch import materialise


def list_files(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """(path, modified, size) of every file below ``roots``, as found now. Contents are not read.
    ``modified`` of an empty file is NULL.

    ``path`` is Spark's own URL-encoded file path, the same value that ``_metadata.file_path``
    gives in every other read, so that catalogue and rows join on it.
    """
    # Tasks are sized by file contents, which are not read here: without this, 100 TB of files would
    # be listed by hundreds of thousands of tasks. The setting stays in a session of its own.
    listing = spark.newSession()
    listing.conf.set("spark.sql.files.maxPartitionBytes", "64t")
    found = listing.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    files = materialise(
        found.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_size").alias("size"),
        ),
        "listing",
        session=spark,
    )
    # A scan passes empty files over, though they are in its listing.
    named = found._jdf.inputFiles()
    if len(named) == files.count():
        return files
    names = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(named)
    text = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    listed = DataFrame(spark._jsparkSession.createDataset(names, text), spark)
    path = F.regexp_replace("value", "^file:/+", "file:/").alias("path")
    empty = listed.select(path).join(files.select("path"), "path", "left_anti")
    empty = empty.withColumn("modified", F.lit(None).cast("timestamp")).withColumn("size", F.lit(0).cast("bigint"))
    return materialise(files.unionByName(empty), "listing", session=spark)


def describe_files(
    files: DataFrame, contracts: Sequence[Contract] = EXPORT_CONTRACTS, path: str = "path"
) -> DataFrame:
    """Adds what the path alone tells: unit, dataset, parent, type, format, attached_to.

    ``unit`` is what users call a file: one CSV, or a directory of Spark ``part-*`` files.
    """
    dataset = paths.dataset_of(F.col(path))
    return files.withColumns(
        {
            "unit": paths.unit_of(F.col(path)),
            "dataset": dataset,
            "parent": paths.parent_of(dataset),
            "type": paths.type_of(dataset, [c.name for c in contracts]),
            "format": paths.format_of(dataset),
            "attached_to": paths.attached_to(F.col(path)),
        }
    )


def catalogue(
    spark: SparkSession, roots: Iterable[str], contracts: Sequence[Contract] = EXPORT_CONTRACTS
) -> DataFrame:
    return describe_files(list_files(spark, roots), contracts)


def may_be_file_of(path: Column, contracts: Sequence[Contract], fmt: str) -> Column:
    """Condition on a path that no file of these tables fails. On ``_metadata.file_path`` Spark
    applies it to the file listing, so other files are never opened.

    Spark tests it once more on every row. So it is made of plain substring tests; the exact rule in
    :func:`describe_files` is left to joins with per-file tables.
    """
    lower, may_be = F.lower(path), F.lit(False)
    for contract in contracts:
        name = f"/{contract.name.lower()}.{fmt}"
        may_be = may_be | lower.endswith(name) | lower.contains(f"{name}/")
    return may_be
