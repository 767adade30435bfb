"""Columns of embedding vectors as integers, and as matrices inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries beyond are held here, so that an offset can be added.
MOST = 1 << 62


def usable(vector: str) -> Column:
    """Whether a vector is there, and all its entries are there and finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def as_integers(vector: str, scale: float, offset: int = 0) -> Column:
    """``floor(scale * c) + offset`` of each entry, as long. Entries past 2 ** 62 are held there."""

    def one(c: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(MOST))), F.lit(-float(MOST))))
        return scaled.cast("long") + F.lit(offset).cast("long")

    return F.transform(F.col(f"`{vector}`").cast("array<double>"), one)


def padded(numbers: Column, width: int, fill: int = 0) -> Column:
    """Entries that shorter vectors lack have the value ``fill``."""
    lacking = F.greatest(F.lit(width) - F.size(numbers), F.lit(0))
    return F.concat(numbers, F.array_repeat(F.lit(fill).cast("long"), lacking))


def shape(rows: DataFrame, numbers: str) -> tuple[int, int, int, int]:
    """(rows, longest vector, least entry, greatest entry) of a materialised table."""
    n, width, low, high = rows.agg(
        F.count("*"),
        F.max(F.size(numbers)),
        F.min(F.array_min(numbers)),
        F.max(F.array_max(numbers)),
    ).first()
    return n, max(width or 0, 0), low or 0, high or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a column of equally long lists of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def tree(rows: DataFrame, merge: Callable[[Iterator[bytes]], bytes], tasks: int, fan: int = 16) -> bytes | None:
    """All values of (part int, state binary) as one, merged on the executors ``fan`` at a time.

    ``part`` runs from 0 to ``tasks`` - 1. The driver gets one value of at most ``fan``.
    """

    def merged(group: pa.Table) -> pa.Table:
        at = group.column("part")[0].as_py() // fan
        order = np.argsort(group.column("part").to_numpy(), kind="stable")
        states = group.column("state").take(pa.array(order))
        return pa.table({"part": pa.array([at], pa.int32()), "state": [merge(s.as_py() for s in states)]})

    while tasks > fan:
        groups = rows.groupBy(F.floor(F.col("part") / fan))
        rows = groups.applyInArrow(merged, "part int, state binary")
        tasks = -(-tasks // fan)
    left = sorted((r["part"], bytes(r["state"])) for r in rows.collect())
    return merge(iter([s for _, s in left])) if left else None
