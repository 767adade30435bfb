"""Data members of zip archives, read inside tasks.

Archives are opened by path through Arrow's file systems (local or mounted folders, HDFS, object
stores) and streamed, so neither their size nor the size of a member is limited. Members, not
archives, are the unit of work: one archive with most of the data still spreads over many tasks.
Python only lists members and splits text into cells; types, checks and deduplication are Spark's.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import EXPORT_CONTRACTS, Contract
from tidemark.scratch import spread_tasks
from tidemark.sources.catalogue import describe_files
from tidemark.sources.heads import BROKEN, UNREADABLE, records
from tidemark.sources.storage import open_file

MEMBERS = "archive_path string, member_path string, modified timestamp, size bigint, reason string"
CELLS = "path string, row_no bigint, cells array<string>"
#: Row number that says that the rest of a member could not be read; its cells are NULL.
BROKEN_ROW = -1
_BATCH_ROWS, _BATCH_CHARS = 8192, 8 * 1024 * 1024


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            names, sizes, reason = [None], [row["size"]], UNREADABLE
            try:
                with zipfile.ZipFile(open_file(row["path"])) as archive:
                    files = [info for info in archive.infolist() if not info.is_dir()]
                names, sizes, reason = [f.filename for f in files], [f.file_size for f in files], None
            except BROKEN:
                pass
            n = len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["path"]] * n, pa.string()),
                    pa.array(names, pa.string()),
                    pa.array([row["modified"]] * n, batch.schema.field("modified").type),
                    pa.array(sizes, pa.int64()),
                    pa.array([reason] * n, pa.string()),
                ],
                names=["archive_path", "member_path", "modified", "size", "reason"],
            )


def list_members(files: DataFrame, contracts: Sequence[Contract] = EXPORT_CONTRACTS) -> DataFrame:
    """Catalogue rows of all members of the zip archives among ``files`` (path, modified, size), keyed by
    archive and member.

    ``path`` is ``<archive>!/<member>``. Two archives with the same member path stay apart. An archive
    that can't be read is one row without ``member_path``, with ``reason``.
    """
    archives = files.filter(F.lower("path").endswith(".zip")).select("path", "modified", "size")
    members = spread_tasks(archives).mapInArrow(_list_members, MEMBERS)
    path = F.concat_ws("!/", "archive_path", "member_path")
    return describe_files(members.withColumn("path", path), contracts)


def _cell_batches(path: str, lines: Iterable[list[str]]) -> Iterator[pa.RecordBatch]:
    """Cells of one member without its header; empty cells are NULL, blank lines are skipped. What can't
    be read any further ends with :data:`BROKEN_ROW`."""
    numbers: list[int] = []
    cells: list[list[str | None] | None] = []
    chars, number = 0, 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * len(numbers), pa.string()),
                pa.array(numbers, pa.int64()),
                pa.array(cells, pa.list_(pa.string())),
            ],
            names=["path", "row_no", "cells"],
        )

    lines = iter(lines)
    while True:
        try:
            line = next(lines, None)
        except BROKEN:
            numbers.append(BROKEN_ROW)
            cells.append(None)
            break
        if line is None:
            break
        numbers.append(number)
        cells.append([cell or None for cell in line])
        chars += sum(map(len, line))
        number += 1
        if len(numbers) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
            yield flush()
            numbers, cells, chars = [], [], 0
    if numbers:
        yield flush()


def _member_lines(row: dict) -> Iterator[list[str]]:
    with zipfile.ZipFile(open_file(row["archive_path"])) as archive, archive.open(row["member_path"]) as raw:
        yield from islice(records(raw), 1, None)


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from _cell_batches(row["path"], _member_lines(row))


def read_members(members: DataFrame) -> DataFrame:
    """(path, row_no, cells, record) of the CSV members in a :func:`list_members` frame, as
    :func:`tidemark.sources.delimited.positional_rows` gives them of loose files."""
    wanted = members.filter("format = 'csv' AND member_path IS NOT NULL")
    wanted = wanted.select("archive_path", "member_path", "path", "size")
    rows = spread_tasks(wanted, "size").mapInArrow(_read_members, CELLS)
    return rows.withColumn("record", F.lit(None).cast("string"))
