"""Projection on a contract, and row-position helpers per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.contracts import Contract


def project(df: DataFrame, contract: Contract) -> DataFrame:
    """Contract columns that are present, in contract order."""
    return df.select([name for name in contract.names if name in df.columns])


def head_per_file(df: DataFrame, file: str, position: Column, n: int = 50) -> DataFrame:
    """First ``n`` rows of every file.

    Written as ``row_number <= n`` so that Spark keeps at most ``n`` rows per file in each task
    before the shuffle, however large one file is.
    """
    rank = Window.partitionBy(file).orderBy(position)
    return (
        df.withColumn("_row", F.row_number().over(rank)).filter(F.col("_row") <= n).drop("_row")
    )
