"""Columns added to documents by a function over the bytes of their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as tx

#: (bytes, offsets) of the texts of some rows, to one array per new column.
Make = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` without columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone])


def add_columns(
    docs: DataFrame, text: str, schema: str, start: Callable[[], Make], size: int = tx.PIECE
) -> DataFrame:
    """``docs`` with the columns of ``schema``, which replace columns of the same names.

    ``start`` is called once per task and gives the function for the rows of each piece of text.
    """
    new = T.StructType.fromDDL(schema)
    kept = without(docs, new.names)
    given = kept.columns
    both = docs.select(
        F.col(f"`{text}`").alias("\u0001text"),
        *[F.col(f"`{c}`") for c in given],
    )
    added = new.names
    schema_out = T.StructType([*kept.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch, data, offsets in tx.batch_pieces(batches, "\u0001text", size):
            arrays = [batch.column(i + 1) for i in range(len(given))] + make(data, offsets)
            yield pa.RecordBatch.from_arrays(arrays, [*given, *added])

    return both.mapInArrow(run, schema_out)
