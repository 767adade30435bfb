"""Union by name with missing columns and widened types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDTH = [
    T.BooleanType(),
    T.ByteType(),
    T.ShortType(),
    T.IntegerType(),
    T.LongType(),
    T.FloatType(),
    T.DoubleType(),
]


def supertype(left: T.DataType, right: T.DataType) -> T.DataType:
    """Smallest type that holds both: text holds everything, numbers widen, booleans are 0/1."""
    if left == right or isinstance(right, T.NullType):
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        return T.StringType()
    if left in _WIDTH and right in _WIDTH:
        wide, narrow = sorted((left, right), key=_WIDTH.index, reverse=True)
        # A 32-bit float cannot hold 32- or 64-bit integers.
        if isinstance(wide, T.FloatType) and narrow in (T.IntegerType(), T.LongType()):
            return T.DoubleType()
        return wide
    dates = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(left, dates) and isinstance(right, dates):
        return max(left, right, key=lambda t: dates.index(type(t)))
    raise TypeError(f"no common type for {left.simpleString()} and {right.simpleString()}")


def union_schema(left: T.StructType, right: T.StructType) -> T.StructType:
    """Columns of ``left``, then those only ``right`` has, each at its supertype."""
    theirs = {field.name: field.dataType for field in right}
    fields = [
        T.StructField(f.name, supertype(f.dataType, theirs.get(f.name, f.dataType))) for f in left
    ]
    fields += [T.StructField(f.name, f.dataType) for f in right if f.name not in left.names]
    return T.StructType(fields)


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; absent ones are typed NULL."""
    have = {field.name: field.dataType for field in df.schema}
    columns = []
    for field in schema:
        column = F.col(f"`{field.name}`") if field.name in have else F.lit(None)
        if have.get(field.name) != field.dataType:
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(columns)


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Union of all rows. The types are settled first: Spark's own widening would cast text to
    numbers under ANSI rules and fail at run time."""
    if not frames:
        raise ValueError("diagonal_union needs at least one frame")
    schema = reduce(union_schema, (df.schema for df in frames))
    return reduce(DataFrame.unionAll, (fit(df, schema) for df in frames))
