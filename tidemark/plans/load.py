"""Load one table straight from folders, without class checks or a stored table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import FORMATS, Contract
from tidemark.functions.casting import conform
from tidemark.operators.choose import latest_per_parent
from tidemark.operators.project import project
from tidemark.scratch import materialise
from tidemark.sources import columnar, delimited
from tidemark.sources.catalogue import describe_files, list_files, may_be_file_of
from tidemark.sources.heads import read_heads
from tidemark.sources.storage import reachable

#: Chosen files that one scan is told by name.
CHOSEN_PATHS = 10_000


def _headers(spark: SparkSession, roots: list[str], files: DataFrame, contract: Contract) -> DataFrame:
    """(path, header, reason) of the chosen files, and of no others."""
    far = (F.col("format") == "csv") & ~reachable(F.col("path"))
    found = read_heads(files.filter(~far)).select("path", "header", "reason")
    if not files.filter(far).isEmpty():
        scanned = delimited.read_headers(spark, roots, lambda path: may_be_file_of(path, [contract], "csv"))
        scanned = scanned.join(files.select("path"), "path", "left_semi")
        found = found.unionByName(scanned.withColumn("reason", F.lit(None).cast("string")))
    return found.filter("header IS NOT NULL OR reason IS NOT NULL")


def load_latest(
    spark: SparkSession, roots: Iterable[str], contract: Contract, formats: Iterable[str] = FORMATS
) -> DataFrame:
    """The newest file of the table in each directory below ``roots``, as one typed table.

    Repeated rows within a file are dropped; a ragged row fails the job. The columns are those of the contract that some file
    has; other columns are left out.
    """
    roots = list(roots)
    files = describe_files(list_files(spark, roots), [contract])
    files = files.filter(F.col("type").isNotNull() & F.col("format").isin(*formats))
    files = materialise(files, "files")
    units = files.groupBy("parent", "dataset").agg(F.max("modified").alias("modified"))
    newest = latest_per_parent(units).select("dataset")
    files = materialise(files.join(newest, "dataset", "left_semi").filter("size > 0"), "newest")
    headers = materialise(_headers(spark, roots, files, contract), "headers")
    broken = headers.filter("reason IS NOT NULL").select("path").first()
    if broken:
        raise ValueError(f"not a readable {contract.name} file: {broken.path}")

    count = files.count()
    turns = 1 + count // CHOSEN_PATHS
    width, parts = delimited.reach(headers, contract), []
    for turn in range(turns):
        now = F.pmod(F.xxhash64("path"), F.lit(turns)) == turn
        mine, theirs = files.filter(now), headers.filter(now)
        # Files that were not chosen are not opened, whatever is in them.
        named = [(row.path, row.format) for row in mine.select("path", "format").collect()]
        for fmt in sorted({fmt for _, fmt in named}):
            chosen = [path for path, of in named if of == fmt]
            if fmt == "csv":
                rows = delimited.positional_rows(spark, roots, width, lambda path, c=chosen: path.isin(c))
                rows = delimited.refuse_ragged(delimited.bind(rows, theirs, contract, files=len(named)))
            else:
                rows = columnar.text_rows(spark, roots, contract, lambda path, c=chosen: path.isin(c))
                rows = rows.drop("row_no")
            parts.append(rows)
    if not parts:
        return project(columnar.empty(spark, contract).select(), contract)
    rows = reduce(DataFrame.unionByName, parts)
    seen = headers.select(F.explode("header").alias("name"))
    seen = seen.filter(F.col("name").isin(contract.names)).distinct()
    present = {r[0] for r in seen.collect()}
    absent = [name for name in contract.names if name not in present]
    rows = rows.distinct().drop("path")
    return project(conform(rows, contract).drop(*absent), contract)
