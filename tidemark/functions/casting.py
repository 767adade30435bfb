"""Contract casts (strict and lenient), text casts and opt-in date parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import Contract


def as_text(column: Column) -> Column:
    return column.cast("string")


def parse_timestamp(text: Column) -> Column:
    """ISO date or timestamp as wall-clock time without zone; NULL where it does not parse."""
    return text.try_cast("timestamp_ntz")


def parse_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({name: parse_timestamp(F.col(name)) for name in columns})


def failed_casts(df: DataFrame, schema: T.StructType) -> Column:
    """Names of the columns whose text is present but not of the contract type."""
    checks = [
        F.expr(f"CASE WHEN `{f.name}` IS NOT NULL AND {_typed(f, 'try_cast')} IS NULL THEN '{f.name}' END")
        for f in schema
        if f.name in df.columns and df.schema[f.name].dataType != f.dataType
    ]
    return F.array_compact(F.array(*checks)).cast("array<string>")


def _typed(field: T.StructField, how: str) -> str:
    return f"{how}(`{field.name}` AS {field.dataType.simpleString()})"


def conform(df: DataFrame, contract: Contract, lenient: bool = False) -> DataFrame:
    """Full contract in contract order: present columns cast, absent ones typed NULL.

    Strict casts fail the job on text that is not of the type. Lenient casts give NULL; see
    :func:`split_failed` for keeping such rows apart.
    """
    have = {field.name: field.dataType for field in df.schema}
    columns = []
    for field in contract.schema:
        if have.get(field.name) == field.dataType:
            columns.append(f"`{field.name}`")
        elif field.name in have:
            columns.append(f"{_typed(field, 'try_cast' if lenient else 'cast')} AS `{field.name}`")
        else:
            columns.append(f"cast(NULL AS {field.dataType.simpleString()}) AS `{field.name}`")
    return df.selectExpr(*columns)


def split_failed(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Lenient conform as two frames: rows that cast, and the others as text with their reason."""
    checked = df.withColumn("failed_columns", failed_casts(df, contract.schema))
    good = checked.filter(F.size("failed_columns") == 0)
    bad = checked.filter(F.size("failed_columns") > 0)
    return conform(good, contract, lenient=True), bad
