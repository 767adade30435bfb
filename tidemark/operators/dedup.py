"""Distinct rows, deduplication by key and key merges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.union import diagonal_union

#: Types without an order; they do not take part in settling ties.
_UNORDERED = (T.MapType, T.VariantType)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedup_any(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row per key, no say in which. NULL keys are equal to each other. Without keys the whole
    row is the key."""
    keys = list(keys)
    return df.dropDuplicates(keys) if keys else df.distinct()


def dedup_latest(df: DataFrame, keys: Iterable[str], latest_by: Iterable[str]) -> DataFrame:
    """The row with the highest ``latest_by`` values per key. Ties go to the highest values of the
    other columns, left to right, so that the winner never depends on file or task order. NULL is
    lower than any value, and NULL keys are equal to each other.

    The whole row is one ``max`` over a struct. Spark aggregates it inside each task before the
    shuffle, so a key that holds a third of all rows sends one row per task. Without keys the whole
    row is the key.
    """
    keys, latest_by = list(keys), list(latest_by)
    if not keys:
        return df.distinct()
    rest = [f for f in df.schema if f.name not in keys and f.name not in latest_by]
    ordered = latest_by + [f.name for f in rest if not isinstance(f.dataType, _UNORDERED)]
    unordered = [f.name for f in rest if isinstance(f.dataType, _UNORDERED)]
    if not ordered and not unordered:
        return df.distinct()
    rank = F.struct(*[F.col(f"`{name}`") for name in ordered])
    if unordered:
        row = F.struct(*[F.col(f"`{name}`") for name in ordered + unordered])
        best = F.max_by(row, rank)
    else:
        best = F.max(rank)
    kept = df.groupBy(*keys).agg(best.alias("_row"))
    return kept.select(
        [F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def match_keys(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str) -> DataFrame:
    """Semi or anti join of ``left`` with the keys of ``right``; NULL keys match each other. Without
    keys whole rows are compared; both sides then have the same columns."""
    keys = list(keys) or left.columns
    other = right.select([F.col(key).alias(f"_r_{key}") for key in keys])
    condition = None
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = same if condition is None else condition & same
    return left.join(other, condition, how)


def merge_latest(
    stored: DataFrame, new: DataFrame, keys: Iterable[str], latest_by: Iterable[str]
) -> DataFrame:
    """Stored and new rows in one, the latest row per key."""
    return dedup_latest(diagonal_union(stored, new), keys, latest_by)


def merge_keep_stored(stored: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Stored rows as they are, plus one row for each key that only ``new`` has.

    ``stored`` must already be unique by key. Only its key columns enter the join.
    """
    keys = list(keys)
    if not keys:
        return diagonal_union(stored, new).distinct()
    added = match_keys(dedup_any(new, keys), stored, keys, "left_anti")
    return diagonal_union(stored, added)
