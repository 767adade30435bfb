"""Parquet reads, across files of different types, and empty tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import Contract
from tidemark.functions.casting import conform
from tidemark.operators.union import diagonal_union
from tidemark.scratch import materialise
from tidemark.sources.catalogue import list_files
from tidemark.sources.delimited import PathFilter
from tidemark.sources.heads import read_signatures
from tidemark.sources.storage import reachable

#: Files that one scan is told by name.
NAMED_PATHS = 10_000


class UnknownColumns(ValueError):
    """A Parquet input holds columns outside its contract."""


def read_parquet(
    spark: SparkSession, roots: Iterable[str], contract: Contract | None = None
) -> DataFrame:
    """Parquet files as one table or, given a contract, checked and conformed to it.

    Files may differ in columns and types. They are grouped by footer, each group is read with its own
    schema, and the groups are united by name: absent columns are NULL, types widen, text absorbs other
    types. The footers are read in tasks; in stores that tasks can't open, files must be of types that
    Spark merges.
    """
    roots = list(roots)
    files = _read_signatures(spark, roots)
    if files is None:
        rows = spark.read.option("mergeSchema", True).parquet(*roots)
    else:
        parted = F.col("path").rlike("/[^/=]+=[^/]*/[^/]+$")
        kinds = files.groupBy("signature").agg(
            F.min("path").alias("first"), F.count("*").alias("files"), F.bool_or(parted).alias("parted")
        )
        kinds = kinds.orderBy("first").collect()
        # Spark finds either partition columns or files in folders of any name.
        deep = not any(kind.parted for kind in kinds)
        reader = spark.read.option("recursiveFileLookup", deep)
        if len(kinds) < 2:
            rows = reader.parquet(*roots)
        else:
            parts = [part for kind in kinds for part in _of_kind(spark, roots, files, kind, deep)]
            rows = diagonal_union(*parts)
    if contract is None:
        return rows
    unknown = sorted(set(rows.columns) - set(contract.names))
    if unknown:
        raise UnknownColumns(f"{contract.name}: columns outside the contract: {', '.join(unknown)}")
    return conform(rows, contract)


def _read_signatures(spark: SparkSession, roots: list[str]) -> DataFrame | None:
    """(path, signature) of the files that hold rows, None if tasks can't open them."""
    files = list_files(spark, roots).filter(F.col("size") > 0)
    if not files.filter(~reachable(F.col("path"))).isEmpty():
        return None
    return materialise(read_signatures(files), "signatures")


def _of_kind(
    spark: SparkSession, roots: list[str], files: DataFrame, kind: Row, deep: bool
) -> Iterator[DataFrame]:
    """The rows of all files with one footer, in their own types. A scan opens only files it is told."""
    first = re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(kind.first))
    schema = spark.read.parquet(first).schema
    mine = files.filter(F.col("signature") == kind.signature)
    turns = 1 + kind.files // NAMED_PATHS
    for turn in range(turns):
        named = mine.filter(F.pmod(F.xxhash64("path"), F.lit(turns)) == turn)
        named = [row.path for row in named.select("path").collect()]
        if named:
            rows = spark.read.schema(schema).option("recursiveFileLookup", deep).parquet(*roots)
            yield rows.filter(F.col("_metadata.file_path").isin(named))


def text_rows(
    spark: SparkSession, roots: Iterable[str], contract: Contract, wanted: PathFilter
) -> DataFrame:
    """(path, row_no, contract columns as text) of the Parquet files that ``wanted`` selects, to be
    unioned with rows read from text. Columns a file lacks are NULL."""
    rows = (
        spark.read.schema(contract.schema)
        .option("recursiveFileLookup", True)
        .parquet(*roots)
        .filter(wanted(F.col("_metadata.file_path")))
    )
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row_no"),
        *[F.col(name).cast("string").alias(name) for name in contract.names],
    )


def empty(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([], contract.schema)
