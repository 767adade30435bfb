"""The two whole jobs: merge exports into tables, or lay them out per class."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import replace
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import EXPORT_CONTRACTS, Contract
from tidemark.functions import paths
from tidemark.functions.casting import conform, split_failed
from tidemark.operators.choose import newer_than_stored
from tidemark.operators.dedup import dedup_latest
from tidemark.operators.report import reconcile
from tidemark.plans.inspect import Inspection, inspect
from tidemark.plans.table import merge_into, read_table, version_of
from tidemark.scratch import materialise
from tidemark.sinks.files import write_csv, write_parquet, write_per_class
from tidemark.sources.catalogue import list_files

SOURCE_FILE, SOURCE_CLASS, SOURCE_MODIFIED = "source_file", "source_class", "source_modified"
SOURCE = (SOURCE_FILE, SOURCE_CLASS, SOURCE_MODIFIED)
#: Where :func:`organize_exports` notes how new the files were that it laid out.
SOURCE_TIMES = "_sources"
#: The newest file wins; files of the same time are settled by name.
NEWEST = (SOURCE_MODIFIED, SOURCE_FILE)


def with_source(contract: Contract) -> Contract:
    """The contract with three more columns that say which file a row came from."""
    schema = T.StructType(list(contract.schema.fields))
    schema = schema.add(SOURCE_FILE, T.StringType()).add(SOURCE_CLASS, T.StringType())
    schema = schema.add(SOURCE_MODIFIED, T.TimestampType())
    return replace(contract, schema=schema)


def typed_rows(
    found: Inspection, contract: Contract, rejects: str | None = None, batch: str | None = None
) -> DataFrame:
    """Chosen rows in contract types plus their source. Text of a wrong type fails the job or, given
    a ``rejects`` folder, is written there with the names of the failed columns."""
    rows = found.rows(contract)
    if rejects is None:
        return conform(rows, with_source(contract))
    good, bad = split_failed(rows, with_source(contract))
    # A folder per batch: the next one adds to it, a replayed one writes the same again.
    run = quote(batch or uuid.uuid4().hex, safe="")
    write_parquet(bad, f"{rejects}/{contract.name}/run={run}", mode="overwrite")
    return good


def compress_exports(
    spark: SparkSession,
    roots: Iterable[str],
    output: str,
    contracts: Sequence[Contract] = EXPORT_CONTRACTS,
    validation: str = "strict",
    policy: str = "latest",
    keep: str = "stored",
    multiline: bool = True,
    rejects: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Merge all exports below ``roots`` into one stored table per type, ``<output>/<type>``, and
    return the load report. See :func:`tidemark.plans.table.read_table` for reading them.

    Within a batch the newest file wins a key. Against stored rows, ``keep="stored"`` appends new
    keys only and leaves stored data unread but for its keys; ``keep="latest"`` lets the newest file
    win there as well, for which the source columns are stored too.
    """
    if keep not in ("stored", "latest"):
        raise ValueError(f"unknown keep {keep!r}")
    found = inspect(spark, roots, contracts, validation, policy, multiline)
    for contract in contracts:
        if contract.name not in found.staged:
            continue
        rows = typed_rows(found, contract, rejects, batch)
        target = f"{output}/{contract.name}"
        if not contract.keys:
            merge_into(rows.drop(*SOURCE), target, [], batch=batch)
        elif keep == "latest":
            merge_into(rows, target, contract.keys, NEWEST, batch=batch)
        else:
            newest = dedup_latest(rows, contract.keys, NEWEST)
            merge_into(newest.drop(*SOURCE), target, contract.keys, batch=batch, unique=True)
    return found.report


def organize_exports(
    spark: SparkSession,
    roots: Iterable[str],
    output: str,
    contracts: Sequence[Contract] = EXPORT_CONTRACTS,
    policy: str = "latest",
    multiline: bool = True,
) -> DataFrame:
    """Lay exports out per class as ``<output>/<type>.csv/class=<id>/`` and return the load report.

    A class that is there already is replaced only if one of its chosen files is newer than the newest
    that it was loaded from (noted in ``<output>/_sources``), and then by all of them; the files of other classes are reported as ``skip``. Tables about many classes are
    merged by key into the stored table ``<output>/<type>``, of which ``<output>/<type>.csv`` is a
    copy. Validation is always strict.
    """
    found = inspect(spark, roots, contracts, "strict", policy, multiline)
    skipped = None
    for contract in contracts:
        if contract.name not in found.staged:
            continue
        rows = typed_rows(found, contract)
        target = f"{output}/{contract.name}.csv"
        if contract.multi_class:
            # The copy is overwritten, but never read for the next merge.
            if contract.keys:
                merge_into(rows, f"{output}/{contract.name}", contract.keys, NEWEST)
            else:
                merge_into(rows.drop(*SOURCE), f"{output}/{contract.name}", [])
            merged = read_table(spark, f"{output}/{contract.name}")
            write_csv(merged.drop(*SOURCE), target, mode="overwrite")
            continue
        files = found.report.filter((F.col("type") == contract.name) & (F.col("outcome") == "load"))
        classes = files.groupBy("class_id").agg(F.max("modified").alias("modified"))
        times = f"{output}/{SOURCE_TIMES}/{contract.name}"
        stored = loaded_classes(spark, target, times)
        if stored is not None:
            fate = newer_than_stored(classes, stored, "class_id").filter(F.col("outcome") == "skip")
            # Written before the layout changes, which it is compared with.
            older = materialise(fate.select(F.lit(contract.name).alias("type"), "class_id"), "skipped")
            rows = rows.join(older.select(F.col("class_id").alias(SOURCE_CLASS)), SOURCE_CLASS, "left_anti")
            skipped = older if skipped is None else skipped.unionAll(older)
        rows = rows.withColumnRenamed(SOURCE_CLASS, "class").drop(*SOURCE)
        write_per_class(rows, target, mode="overwrite", replace_classes=True)
        # After the layout: a job that dies in between loads the same files once more.
        merge_into(classes, times, ["class_id"], ["modified"], unique=True)
    if skipped is None:
        return found.report
    marked = found.report.join(skipped.withColumn("_skip", F.lit(True)), ["type", "class_id"], "left")
    outcome = F.when(F.col("_skip") & (F.col("outcome") == "load"), "skip").otherwise(F.col("outcome"))
    return marked.withColumn("outcome", outcome).select(*found.report.columns)


def find_orphans(
    found: Inspection, contracts: Sequence[Contract] = EXPORT_CONTRACTS, registry: str = "classes"
) -> DataFrame:
    """Classes that only the registry table lists, or only data files have, with ``issue``.

    Data classes come from the report, so no data rows are read.
    """
    single = [c.name for c in contracts if not c.multi_class and not c.legacy]
    data = found.report.filter((F.col("outcome") == "load") & F.col("type").isin(*single))
    if registry in found.staged:
        contract = next(c for c in contracts if c.name == registry)
        listed = found.rows(contract).select("class_id")
    else:
        listed = data.select("class_id").limit(0)
    return reconcile(listed, data)


def loaded_classes(spark: SparkSession, path: str, times: str) -> DataFrame | None:
    """(class_id, modified) of the class directories below ``path``: the time of the newest file that each
    was loaded from or, where none was noted, of its own files. None if there are no classes."""
    stored = stored_classes(spark, path)
    if stored is None or not version_of(spark, times):
        return stored
    noted = read_table(spark, times).withColumnRenamed("modified", "noted")
    both = stored.join(noted, "class_id", "left")
    return both.select("class_id", F.coalesce("noted", "modified").alias("modified"))


def stored_classes(spark: SparkSession, path: str) -> DataFrame | None:
    """(class_id, modified) of the class directories below ``path``, or None if there are none."""
    try:
        files = list_files(spark, [path])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    named = files.withColumn("class_id", paths.partition_value(F.col("path"), "class"))
    return named.groupBy("class_id").agg(F.max("modified").alias("modified"))
