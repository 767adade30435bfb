"""Typed CSV reads by column *name*, for any number of files with different headers.

Spark binds CSV columns by position. So every file is read in one scan as positional text cells,
the header of each file comes from its first line, and a join on the file path tells
each row which cell belongs to which contract column. There is one scan per table however many
header variants exist, no list of paths on the driver, and no shuffle of rows while the header
table is small enough to broadcast (it is counted first).

A row is *ragged* if there is text in any cell after the last one of its file's header, however far
out. Its cells are in doubt, so such rows are never cut to fit without a word: :func:`bind` marks them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import Contract, sql_names
from tidemark.functions.casting import conform
from tidemark.functions.paths import unit_of
from tidemark.scratch import BROADCAST_ROWS, broadcast_if_small, materialise
from tidemark.sources.catalogue import list_files
from tidemark.sources.heads import read_first_lines
from tidemark.sources.storage import reachable

#: Quotes are doubled inside quoted fields, as spreadsheet tools and data frames write them.
CSV_OPTIONS = {"header": True, "escape": '"', "enforceSchema": True, "recursiveFileLookup": True}

PathFilter = Callable[[Column], Column]

_RECORD = "_record"


def everything(path: Column) -> Column:
    return F.lit(True)


def _header_pattern(names: Iterable[str]) -> str:
    cell = '"?(?:' + "|".join(re.escape(name) for name in names) + ')"?'
    return rf"^\x{{FEFF}}?{cell}(?:,{cell})*\s*$"


def split_header(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^\x{FEFF}|\s+$", "")
    return F.transform(F.split(bare, ","), lambda cell: F.regexp_replace(cell, '^"|"$', ""))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lines of a task, which come file by file, the first of each file."""
    last = None
    for batch in batches:
        paths, rows = batch.column("path"), batch.num_rows
        if not rows:
            continue
        changes = pc.not_equal(paths.slice(1), paths.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(paths[0].as_py() != last, changes))
        last = paths[rows - 1].as_py()
        if len(starts):
            yield batch.take(pa.array(starts))


def read_headers(
    spark: SparkSession,
    roots: Iterable[str],
    wanted: PathFilter = everything,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """(path, header): the column names of each file, by a scan of all lines; :func:`first_headers` reads less.

    With ``names``, a first line holding any other name gives a NULL header. Then the lines that
    are not such headers fold into one counter per file within each task, so only about two short
    rows per file are shuffled and nothing is sorted. Without ``names`` any first line is taken, and
    each task sends one line per file.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(list(roots))
        .filter(wanted(F.col("_metadata.file_path")))
        .filter(F.col("_metadata.file_block_start") == 0)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("line_no"),
            "value",
        )
        .filter(F.col("value") != "")
    )
    if names is None:
        # An aggregate over texts would sort all lines first.
        lines = lines.mapInArrow(_first_of_each, "path string, line_no bigint, value string")
        first = lines.groupBy("path").agg(F.min_by("value", "line_no").alias("line"))
    else:
        header_like = F.when(F.col("value").rlike(_header_pattern(names)), F.col("value"))
        folded = lines.groupBy("path", header_like.alias("line")).agg(
            F.min("line_no").alias("line_no")
        )
        first = folded.groupBy("path").agg(F.min_by("line", "line_no").alias("line"))
    return first.select("path", split_header(F.col("line")).alias("header"))


def _opened(path: Column) -> Column:
    """Whether tasks read the first line by themselves. Other names may be of compressed files, and some
    stores only Spark can open."""
    return F.lower(path).endswith(".csv") & reachable(path)


def first_headers(spark: SparkSession, roots: Iterable[str], files: DataFrame) -> DataFrame:
    """What :func:`read_headers` gives without ``names`` for the ``files`` (path, size) that lie below ``roots``,
    from the first bytes of each. Only those that tasks can't open are scanned."""
    files = files.filter("size > 0")
    lines = read_first_lines(files.filter(_opened(F.col("path")))).filter("value IS NOT NULL")
    found = lines.select("path", split_header(F.col("value")).alias("header"))
    if not files.filter(~_opened(F.col("path"))).isEmpty():
        found = found.unionByName(read_headers(spark, roots, lambda path: ~_opened(path)))
    return found


def with_places(headers: DataFrame, contract: Contract) -> DataFrame:
    """(path, places, last_place): for each contract column its 1-based place in the file, 0 if
    absent, and the number of columns the file has."""
    places = f"transform({sql_names(contract)}, name -> int(array_position(header, name)))"
    return headers.selectExpr("path", f"{places} AS places", "size(header) AS last_place")


def positional_rows(
    spark: SparkSession,
    roots: Iterable[str],
    width: int,
    wanted: PathFilter = everything,
    multiline: bool = True,
    numbered: bool = False,
) -> DataFrame:
    """(path, [row_no], cells, record) of whole files; ``row_no`` rises within each file. ``record`` is
    the text of a row that may have more than ``width`` cells, of others NULL.

    ``multiline`` allows line breaks inside quotes and streams each file through one task, however
    large it is: where a record starts depends on all quotes before it. Switch it off for exports
    without such breaks, and Spark splits large files by itself. Nothing else decides between the
    two, neither the size of a file nor that of the cluster.
    """
    names = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _RECORD]])
    rows = (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS, multiLine=multiline, columnNameOfCorruptRecord=_RECORD)
        .csv(list(roots))
        .filter(wanted(F.col("_metadata.file_path")))
    )
    number = ["monotonically_increasing_id() AS row_no"] if numbered else []
    cells = f"array({', '.join(names)}) AS cells"
    # Spark notes the text of every row of another width; short rows are told by their commas.
    commas = f"length({_RECORD}) - length(replace({_RECORD}, ',', ''))"
    record = f"CASE WHEN {commas} >= {width} THEN {_RECORD} END AS record"
    return rows.selectExpr("_metadata.file_path AS path", *number, cells, record)


#: The cells of ``record``, text in quotes being an x: enough to see which have text.
_SPLIT = r"""
    split(regexp_replace(regexp_replace(record, '(^|,)""(?=,|$)', '$1'), '"[^"]*"', 'x'), ',', -1)
"""

#: Whether there is text past the ``last_place`` cells of a header: among the cells, or past them.
RAGGED = rf"""
    exists(slice(cells, last_place + 1, size(cells)), cell -> cell IS NOT NULL)
    OR (record IS NOT NULL AND exists(
        slice({_SPLIT}, greatest(size(cells), last_place) + 1, length(record) + 1), cell -> cell <> ''))
"""


def bind(
    rows: DataFrame,
    headers: DataFrame,
    contract: Contract,
    keep: Sequence[str] = ("path",),
    files: int | None = None,
) -> DataFrame:
    """Rows of (path, cells, record) as ``keep``, one text column per contract column, in its order, and
    ``ragged``. Rows of files that ``headers`` lacks are left out.

    ``headers`` (path, header) must be materialised: its rows are counted, unless the number of
    ``files`` is given.
    """
    places = with_places(headers.filter(F.col("header").isNotNull()), contract)
    joined = rows.join(broadcast_if_small(places, known_rows=files), "path")
    # Place 0 (absent) is NULL first, since element 0 is an error; past the end gives NULL.
    cells = [
        f"try_element_at(cells, nullif(places[{i}], 0)) AS `{name}`"
        for i, name in enumerate(contract.names)
    ]
    return joined.selectExpr(*keep, *cells, f"{RAGGED} AS ragged")


def refuse_ragged(rows: DataFrame) -> DataFrame:
    """Rows of :func:`bind` without ``ragged``; a ragged row fails the job."""
    message = F.concat(F.lit("a row has more cells than the header of its file, "), F.col("path"))
    fine = F.when(F.col("ragged"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(fine).drop("ragged")


def bucket_of(path: Column, buckets: int) -> Column:
    """Bucket of a file; part files of one directory fall together."""
    return F.pmod(F.hash(unit_of(path)), F.lit(buckets))


def bound_rows(
    spark: SparkSession,
    roots: Iterable[str],
    headers: DataFrame,
    contract: Contract,
    wanted: PathFilter = everything,
    multiline: bool = True,
    buckets: int = 1,
    keep: Sequence[str] = ("path",),
    width: int | None = None,
    files: int | None = None,
) -> DataFrame:
    """:func:`positional_rows` bound by :func:`bind`, with ``bucket``.

    Where the header table is too large to broadcast, files are divided into ``buckets`` by path.
    Each bucket is a scan of its own files with its own part of the header table, so that rows are
    never shuffled to find their header. ``width`` and number of ``files`` of ``headers`` are looked
    up if not given.
    """
    width, numbered, parts = width or reach(headers, contract), "row_no" in keep, []
    for bucket in range(buckets):
        mine, theirs = wanted, headers
        if buckets > 1:
            mine = lambda path, b=bucket: wanted(path) & (bucket_of(path, buckets) == b)
            theirs = headers.filter(bucket_of(F.col("path"), buckets) == bucket)
        rows = positional_rows(spark, roots, width, mine, multiline, numbered)
        bound = bind(rows, theirs, contract, keep, files if buckets == 1 else None)
        parts.append(bound.withColumn("bucket", F.lit(bucket)))
    return reduce(DataFrame.unionAll, parts)


def reach(headers: DataFrame, contract: Contract) -> int:
    """How many cells of a row are needed: up to the last contract column of any file. Columns of no
    contract beyond that do not widen the scan."""
    last = with_places(headers, contract).agg(F.max(F.array_max("places"))).first()[0]
    return max(last or 0, 1)


def read_csv(
    spark: SparkSession,
    roots: Iterable[str],
    contract: Contract,
    multiline: bool = True,
    lenient: bool = False,
) -> DataFrame:
    """All CSV files below ``roots`` as one table of the contract, bound by column name.

    Columns outside the contract are left out; absent ones are NULL. An input folder without rows
    gives an empty table with the contract schema. Ragged rows, and text that is not of the contract
    type, fail the job or, when ``lenient``, lose the cells beyond the header and give NULL;
    ``casting.split_failed`` keeps rows of wrong types apart instead.
    """
    roots = list(roots)
    files = list_files(spark, roots)
    headers = materialise(first_headers(spark, roots, files), "headers")
    rows = bound_rows(
        spark,
        roots,
        headers,
        contract,
        multiline=multiline,
        buckets=buckets_for(files.count()),
    )
    rows = rows.drop("ragged") if lenient else refuse_ragged(rows)
    return conform(rows, contract, lenient)


def buckets_for(files: int) -> int:
    """Buckets that keep each part of a per-file table small enough to broadcast."""
    # Buckets are uneven; a third of the limit is kept in reserve.
    return 1 + files // (BROADCAST_ROWS * 2 // 3)


def read_distinct(spark: SparkSession, roots: Iterable[str], contract: Contract) -> DataFrame:
    """:func:`read_csv` without repeated rows."""
    return read_csv(spark, roots, contract).distinct()
