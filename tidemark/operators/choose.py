"""Choice among catalogued files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POLICIES = ("latest", "first", "all")


def one_file_per_key(
    files: DataFrame,
    order_by: Iterable[Column],
    multi_class: Iterable[str] = (),
    type_col: str = "type",
    class_col: str = "class_id",
) -> DataFrame:
    """First file per (type, class) by ``order_by``. Tables about many classes pass through; other
    files need a class."""
    passes = F.col(type_col).isin(*multi_class) if list(multi_class) else F.lit(False)
    keyed = files.filter(F.col(class_col).isNotNull() & ~passes)
    rank = Window.partitionBy(type_col, class_col).orderBy(*order_by)
    chosen = keyed.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
    return chosen.unionAll(files.filter(passes))


def latest_per_parent(
    files: DataFrame, parent: str = "parent", recency: str = "modified"
) -> DataFrame:
    """Newest file in each directory; equal times are settled by the other columns."""
    rest = [F.col(c).asc_nulls_last() for c in files.columns if c not in (parent, recency)]
    rank = Window.partitionBy(parent).orderBy(F.col(recency).desc_nulls_last(), *rest)
    return files.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def newer_than_stored(
    new: DataFrame, stored: DataFrame, target: str, modified: str = "modified"
) -> DataFrame:
    """Each new file with ``outcome``: ``new``, ``replace`` or, if not newer, ``skip``."""
    old = stored.select(F.col(target), F.col(modified).alias("stored_modified"))
    outcome = (
        F.when(F.col("stored_modified").isNull(), "new")
        .when(F.col(modified) <= F.col("stored_modified"), "skip")
        .otherwise("replace")
    )
    return new.join(old, target, "left").withColumn("outcome", outcome)
