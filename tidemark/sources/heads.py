"""What the first bytes of a file tell: its columns, and a class among its first rows.

A task opens files by itself and reads no further than it has to: a few kilobytes of a CSV, as much of an
archive member, the footer of a Parquet file. So the cost of a head does not grow with its file.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import spread_tasks
from tidemark.sources.storage import open_file, open_stream

UNREADABLE = "unreadable"
#: ``rows``: how many rows were seen, at most as many as were asked for, but one at least if there is one.
HEADS = "path string, header array<string>, kinds array<string>, rows int, first_id string, reason string"
#: A field longer than this means that a quote is never closed.
LONGEST_FIELD = 1 << 27
#: What broken content raises. Failures to reach a file are not among them: these must fail the task.
BROKEN = (csv.Error, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, pa.ArrowInvalid)


def kind_of(field: pa.DataType) -> str:
    """Spark's name of the contract type that holds a Parquet column, or else Arrow's of its own."""
    if pa.types.is_dictionary(field):
        field = field.value_type
    if pa.types.is_string(field) or pa.types.is_large_string(field):
        return "string"
    if pa.types.is_signed_integer(field):
        return "bigint"
    if pa.types.is_floating(field):
        return "double"
    return "boolean" if pa.types.is_boolean(field) else str(field)


def records(stream: Iterable[bytes] | io.IOBase) -> Iterator[list[str]]:
    """Records of a CSV, blank lines left out."""
    csv.field_size_limit(LONGEST_FIELD)
    text = io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="")
    return (record for record in csv.reader(text) if record)


def csv_head(stream, id_column: str, rows: int) -> tuple:
    """(header, rows seen, first id among them) of an open CSV, read no further than needed."""
    lines = records(stream)
    header = next(lines, None)
    if header is None:
        return None, 0, None
    header[-1] = header[-1].rstrip()
    place, first, seen = header.index(id_column) if id_column in header else None, None, 0
    for record in islice(lines, max(rows, 1)):
        seen += 1
        if place is not None and first is None and place < len(record):
            first = record[place] or None
    return header, seen, first


def parquet_footer(file: pa.NativeFile):
    """An open Parquet file's footer. It is fetched first and read from memory, so that a failing store
    is not taken for a broken file."""
    import pyarrow.parquet as pq

    size = file.size()
    tail = file.read_at(min(8, size), max(0, size - 8))
    length = int.from_bytes(tail[:4], "little") if len(tail) == 8 and tail[4:] == b"PAR1" else -1
    if not 0 < length <= size - 12:
        raise pa.ArrowInvalid("no Parquet footer")
    footer = file.read_at(length, size - 8 - length)
    try:
        return pq.ParquetFile(pa.BufferReader(b"PAR1" + footer + tail))
    except OSError as error:
        raise pa.ArrowInvalid(str(error)) from error


def parquet_head(file: pa.NativeFile, id_column: str, rows: int) -> tuple:
    """(header, kinds, rows seen, first id among them) of an open Parquet file."""
    import pyarrow.parquet as pq

    found = parquet_footer(file)
    schema, first = found.schema_arrow, None
    seen = min(found.metadata.num_rows, max(rows, 1))
    if rows and seen and id_column in schema.names:
        batches = pq.ParquetFile(file).iter_batches(rows, columns=[id_column])
        ids = next(batches).column(0).cast(pa.string()).drop_null()
        first = ids[0].as_py() if len(ids) else None
    return schema.names, [kind_of(t) for t in schema.types], seen, first


def _heads(id_column: str, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                header = kinds = first = reason = None
                seen = 0
                try:
                    if row["archive_path"] is not None:
                        with zipfile.ZipFile(open_file(row["archive_path"])) as archive:
                            with archive.open(row["member_path"]) as member:
                                header, seen, first = csv_head(member, id_column, rows)
                    elif row["format"] == "parquet":
                        with open_file(row["path"]) as file:
                            header, kinds, seen, first = parquet_head(file, id_column, rows)
                    else:
                        with open_stream(row["path"]) as stream:
                            header, seen, first = csv_head(stream, id_column, rows)
                except BROKEN:
                    reason = UNREADABLE
                found.append((row["path"], header, kinds, seen, first, reason))
            names = [c.split()[0] for c in HEADS.split(", ")]
            kinds_of = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string()]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds_of, strict=True)], names=names
            )

    return run


def read_heads(files: DataFrame, id_column: str = "class_id", rows: int = 0) -> DataFrame:
    """:data:`HEADS` of each of ``files`` (path, format and, for members, archive_path and member_path): its
    columns, and the first ``id_column`` that is not empty in its first ``rows`` rows.

    A file whose content cannot be read as what its name says has ``reason`` :data:`UNREADABLE`. A file
    without a line has no header.
    """
    for name in ("archive_path", "member_path"):
        files = files if name in files.columns else files.withColumn(name, F.lit(None).cast("string"))
    wanted = files.select("path", "format", "archive_path", "member_path")
    return spread_tasks(wanted).mapInArrow(_heads(id_column, rows), HEADS)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with open_stream(path) as stream:
                lines = io.TextIOWrapper(stream, "utf-8-sig", errors="replace")
                found.append(next((bare for line in lines if (bare := line.removesuffix("\n"))), None))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), pa.array(found, pa.string())], names=["path", "value"]
        )


def read_first_lines(files: DataFrame) -> DataFrame:
    """(path, value): the first line of each file that is not empty, as Spark's text reader has it, NULL
    if there is none. For files that are not compressed."""
    return spread_tasks(files.select("path")).mapInArrow(_first_lines, "path string, value string")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with open_file(path) as file:
                schema = parquet_footer(file).schema_arrow
            found.append("\n".join(f"{field.name} {field.type}" for field in schema))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), pa.array(found, pa.string())], names=["path", "signature"]
        )


def read_signatures(files: DataFrame) -> DataFrame:
    """(path, signature) of Parquet files: their columns and types as text. A broken file fails the job."""
    return spread_tasks(files.select("path")).mapInArrow(_signatures, "path string, signature string")
