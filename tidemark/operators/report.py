"""Counts, reconciliation and the load report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATA = "registered_without_data"
NO_ENTRY = "data_without_entry"


def type_counts(files: DataFrame, type_col: str = "type") -> DataFrame:
    return files.groupBy(type_col).agg(F.count(F.lit(1)).alias("files"))


def reconcile(registry: DataFrame, data: DataFrame, class_col: str = "class_id") -> DataFrame:
    """Classes in only one of the two, with ``issue``.

    Both sides shrink to distinct classes before they meet, so a class with most of the rows is
    one row in the join, and each side is read once for both directions.
    """
    listed = registry.select(class_col).filter(F.col(class_col).isNotNull()).distinct()
    found = data.select(class_col).filter(F.col(class_col).isNotNull()).distinct()
    both = listed.withColumn("_listed", F.lit(True)).join(
        found.withColumn("_found", F.lit(True)), class_col, "full_outer"
    )
    issue = F.when(F.col("_found").isNull(), NO_DATA).when(F.col("_listed").isNull(), NO_ENTRY)
    return both.select(class_col, issue.alias("issue")).filter(F.col("issue").isNotNull())


def load_outcome(
    reason: Column,
    chosen: Column,
    type_col: Column,
    legacy: Iterable[str] = (),
) -> Column:
    """``legacy``, ``rejected:<reason>``, ``duplicate`` or ``load``, in that order of precedence."""
    is_legacy = type_col.isin(*legacy) if list(legacy) else F.lit(False)
    return (
        F.when(is_legacy, F.lit("legacy"))
        .when(reason.isNotNull(), F.concat(F.lit("rejected:"), reason))
        .when(~chosen, F.lit("duplicate"))
        .otherwise(F.lit("load"))
    )
