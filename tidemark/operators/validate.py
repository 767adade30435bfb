"""File checks. Each gives one row per file; none moves table rows beyond what it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import Contract, sql_names
from tidemark.operators.project import head_per_file

OK = "ok"
EMPTY = "empty"
MANY_CLASSES = "many_classes"
NO_CLASS = "no_class_id"
UNKNOWN_COLUMN = "unknown_column"
UNKNOWN_FORMAT = "unknown_format"


def column_check(header: Column, contract: Contract) -> Column:
    """NULL if the header is a set of contract columns, else the reason."""
    fits = (F.size(F.array_except(header, F.expr(sql_names(contract)))) == 0) & (
        F.size(F.array_distinct(header)) == F.size(header)
    )
    return F.when(header.isNull() | ~fits, F.lit(UNKNOWN_COLUMN))


def single_id_check(rows: DataFrame, file: str, class_col: str = "class_id") -> DataFrame:
    """Per file: ``class_id`` and ``outcome`` — exactly one distinct non-null class is wanted.

    (file, class) pairs are made distinct inside each task first, by hash and without a sort, so
    the shuffle carries pairs, not rows, and a huge file is no burden on one task.
    """
    pairs = rows.groupBy(F.col(file), F.col(class_col).cast("string").alias("class_id")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    per_file = pairs.groupBy(file).agg(
        F.min("class_id").alias("_low"), F.max("class_id").alias("_high"), F.sum("rows").alias("rows")
    )
    outcome = (
        F.when(F.col("_low").isNull(), NO_CLASS)
        .when(F.col("_low") != F.col("_high"), MANY_CLASSES)
        .otherwise(OK)
    )
    return per_file.select(
        file, F.when(outcome == OK, F.col("_low")).alias("class_id"), outcome.alias("outcome"), "rows"
    )


def first_id_check(
    rows: DataFrame, file: str, position: str, class_col: str = "class_id", n: int = 50
) -> DataFrame:
    """Per file: the first non-null class in its first ``n`` rows. Files without one are left out.

    This check looks at neither the column contract nor later rows.
    """
    head = head_per_file(rows.select(file, position, class_col), file, F.col(position), n)
    return (
        head.filter(F.col(class_col).isNotNull())
        .groupBy(file)
        .agg(F.min_by(F.col(class_col).cast("string"), position).alias("class_id"))
    )


def sibling_class(siblings: DataFrame, parent: str, is_live: Column, class_col: str) -> DataFrame:
    """Parents whose attachments may be kept: some sibling is live data and all siblings share one
    class. A sibling without a class spoils the match. Gives (parent, class_id)."""
    stats = siblings.groupBy(parent).agg(
        F.bool_or(is_live).alias("_live"),
        F.min(class_col).alias("_low"),
        F.max(class_col).alias("_high"),
        F.bool_and(F.col(class_col).isNotNull()).alias("_all"),
    )
    keep = F.col("_live") & F.col("_all") & (F.col("_low") == F.col("_high"))
    return stats.filter(keep).select(parent, F.col("_low").alias("class_id"))


def attachments_with_siblings(
    attachments: DataFrame, siblings: DataFrame, parent: str, is_live: Column, class_col: str
) -> DataFrame:
    """Attachments of valid parents."""
    valid = sibling_class(siblings, parent, is_live, class_col)
    return attachments.join(valid, parent, "left_semi")
