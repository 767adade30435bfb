"""A stored table that merges can be added to safely.

A merge reads the table it changes, so it never writes over it. Rows go to a new directory under
``data/``; then one small file under ``commits/`` names the files that make up the new version. A job
that dies before that leaves the table as it was. The file of a version can be created only once, so of two
writers that start from one version the second fails there, and merges again into what the first left.

The commit knows of every file how large it is and which range of the first key column it holds. Rows
are written in key order, so files hold narrow ranges, and a merge looks at few of them. Only files that hold
a key to be replaced are rewritten. Files that no kept version names are removed.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedup import dedup_any, dedup_latest, match_keys
from tidemark.operators.union import fit, union_schema
from tidemark.scratch import materialise
from tidemark.sinks import folders

#: A merge also rewrites files below this size, once there are more of them than the table should have.
SMALL_BYTES, MAX_SMALL = 16 << 20, 32
#: Versions whose files stay, for readers that have just begun.
KEEP_VERSIONS = 10
#: Names of past batches that a commit carries on. A stream replays its last batch alone.
BATCH_NAMES = 1000
#: First keys of a batch that the driver compares with the ranges of files one by one.
NAMED_KEYS = 10_000
#: Longer ends of a range are not noted: such a file may hold any key.
_LONGEST_KEY = 200
#: How often a merge starts again from what another writer has committed meanwhile.
ATTEMPTS = 100


class Conflict(RuntimeError):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class File:
    """One data file, ``<directory>/<name>``. ``low`` and ``high`` are ends of its first key column as
    text, None where unknown; ``nulls`` says whether it holds NULL there."""

    name: str
    size: int
    rows: int
    low: str | None
    high: str | None
    nulls: bool


@dataclass(frozen=True)
class Version:
    """``whole`` are directories of which every file is part of the version; ``dropped`` are the files
    of the version before that this one does without."""

    number: int
    schema: T.StructType
    files: tuple[File, ...]
    whole: tuple[str, ...]
    dropped: tuple[str, ...]
    batches: tuple[str, ...]

    def dump(self) -> str:
        files = [[f.name, f.size, f.rows, f.low, f.high, f.nulls] for f in self.files]
        return json.dumps(
            {
                "version": self.number,
                "schema": self.schema.jsonValue(),
                "files": files,
                "whole": self.whole,
                "dropped": self.dropped,
                "batches": self.batches,
            }
        )

    @staticmethod
    def load(text: str) -> Version:
        row = json.loads(text)
        return Version(
            row["version"],
            T.StructType.fromJson(row["schema"]),
            tuple(File(*f) for f in row["files"]),
            tuple(row["whole"]),
            tuple(row["dropped"]),
            tuple(row["batches"]),
        )


def _commit_path(path: str, number: int) -> str:
    return f"{path}/commits/{number:08d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = folders.names(spark, f"{path}/commits")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def _current(spark: SparkSession, path: str) -> Version | None:
    numbers = _numbers(spark, path)
    return Version.load(folders.read_text(spark, _commit_path(path, numbers[-1]))) if numbers else None


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a merge under this batch name has been committed, of the last :data:`BATCH_NAMES`."""
    current = _current(spark, path)
    return current is not None and batch in current.batches


def version_of(spark: SparkSession, path: str) -> int:
    """Number of the current version, 0 for a table that does not exist yet."""
    return max(_numbers(spark, path), default=0)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    current = _current(spark, path)
    if current is None:
        raise FileNotFoundError(f"no committed version under {path}")
    return _read(spark, path, current, current.files)


def _read(spark: SparkSession, path: str, version: Version, files: Iterable[File]) -> DataFrame:
    names = [f.name for f in files]
    if not names:
        return spark.createDataFrame([], version.schema)
    if len(names) == len(version.files):
        # A directory whose files are all wanted is listed as one.
        names = [*version.whole, *[n for n in names if n.split("/")[0] not in version.whole]]
    return spark.read.schema(version.schema).parquet(*[f"{path}/data/{name}" for name in names])


def _write(rows: DataFrame, path: str, number: int, keys: Sequence[str]) -> tuple[str, list[File]]:
    """Writes rows in key order; the name of the new directory and what its files hold."""
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    place = f"{path}/data/{name}"
    if keys:
        order = [F.col(f"`{key}`") for key in keys]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.parquet(place)
    written = rows.sparkSession.read.schema(rows.schema).parquet(place)
    first, none = F.lit(None).cast("string"), F.lit(True)
    if keys and _comparable(rows.schema[keys[0]].dataType):
        first, none = F.col(f"`{keys[0]}`"), F.col(f"`{keys[0]}`").isNull()
    found = (
        written.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
        .agg(
            F.count("*").alias("rows"),
            F.min(first).cast("string").alias("low"),
            F.max(first).cast("string").alias("high"),
            F.bool_or(none).alias("nulls"),
        )
        .collect()
    )
    files = []
    for f in sorted(found):
        known = f.low is not None and max(len(f.low), len(f.high)) <= _LONGEST_KEY
        low, high = (f.low, f.high) if known else (None, None)
        files.append(File(f"{name}/{f.file}", f["size"], f["rows"], low, high, f["nulls"]))
    return name, files


def _comparable(kind: T.DataType) -> bool:
    """Types whose order Python has too, for text and whole numbers."""
    return isinstance(kind, T.StringType | T.IntegerType | T.LongType)


def _may_hold(files: Iterable[File], fresh: DataFrame, keys: Sequence[str]) -> tuple[File, ...]:
    """The files whose range of the first key holds one of ``fresh``: exactly, if that has up to
    :data:`NAMED_KEYS` different ones (classes, mostly), else by the range of them all."""
    files = tuple(files)
    if not keys or not files or not _comparable(fresh.schema[keys[0]].dataType):
        return files
    key = F.col(f"`{keys[0]}`")
    found = [row[0] for row in fresh.select(key).distinct().limit(NAMED_KEYS + 1).collect()]
    nulls, named, whole = None in found, sorted(k for k in found if k is not None), len(found) <= NAMED_KEYS
    if not whole:
        *named, nulls = fresh.agg(F.min(key), F.max(key), F.bool_or(key.isNull())).first()
    read = str if isinstance(fresh.schema[keys[0]].dataType, T.StringType) else int

    def meets(f: File) -> bool:
        if f.nulls and (nulls or f.low is None):
            return True
        if not named:
            return False
        if f.low is None:
            return True
        if not whole:
            return read(f.low) <= named[1] and named[0] <= read(f.high)
        at = bisect_left(named, read(f.low))
        return at < len(named) and named[at] <= read(f.high)

    return tuple(f for f in files if meets(f))


def _publish(spark: SparkSession, path: str, version: Version, keep_versions: int) -> bool:
    """Makes this the current version unless another writer has made one of that number."""
    if not folders.create_text(spark, _commit_path(path, version.number), version.dump()):
        return False
    for number in _numbers(spark, path):
        if number > version.number - keep_versions:
            break
        # What the next version does without, no later one has again. Another writer may have
        # removed all this a moment ago.
        following = folders.read_text(spark, _commit_path(path, number + 1))
        if following is not None:
            dropped = Version.load(following).dropped
            folders.remove(spark, [f"{path}/data/{name}" for name in dropped])
            folders.remove(spark, [_commit_path(path, number)])
    return True


def _next(current: Version | None, schema: T.StructType, batch: str | None, kept: Iterable[File],
          name: str | None, added: Iterable[File]) -> Version:
    kept, added = tuple(kept), tuple(added)
    if current is None:
        return Version(1, schema, added, (name,), (), (batch,) if batch else ())
    names = {f.name for f in kept}
    dropped = [f.name for f in current.files if f.name not in names]
    touched = {n.split("/")[0] for n in dropped}
    whole = [d for d in current.whole if d not in touched] + ([name] if added else [])
    # A directory without a file in the new version goes as a whole.
    gone = sorted(touched - {n.split("/")[0] for n in names})
    dropped = [n for n in dropped if n.split("/")[0] not in gone] + gone
    batches = (*current.batches, batch)[-BATCH_NAMES:] if batch else current.batches
    return Version(current.number + 1, schema, kept + added, tuple(whole), tuple(dropped), batches)


def merge_into(
    new: DataFrame,
    path: str,
    keys: Iterable[str],
    latest_by: Iterable[str] | None = None,
    batch: str | None = None,
    unique: bool = False,
    keep_versions: int = KEEP_VERSIONS,
) -> int:
    """Merge ``new`` into the table at ``path`` by key and return the version number.

    Without ``latest_by`` stored rows stay and only rows with new keys are appended: of stored files
    only those whose range of the first key meets that of ``new`` are read, and of these the key
    columns. With ``latest_by`` the row with the highest values in these columns wins, wherever it
    is. Then files that hold a key of ``new`` are rewritten, all others stay as they are. Without keys the
    whole row is the key: the table holds distinct rows. Should a column change its type, all is rewritten.

    Any number of jobs may merge into one table: one that finds that another was faster merges again
    into the version that the other made. ``unique`` says that ``new`` has one row per key already. A
    ``batch`` that has been committed already is left alone, so a replayed batch changes nothing. A
    reader has the time of ``keep_versions`` merges before files of its version are removed.
    """
    spark, keys = new.sparkSession, list(keys)
    latest_by = None if latest_by is None or not keys else list(latest_by)
    if unique:
        fresh = new
    elif latest_by is None:
        fresh = dedup_any(new, keys)
    else:
        fresh = dedup_latest(new, keys, latest_by)
    staged = None
    for _ in range(ATTEMPTS):
        current = _current(spark, path)
        if current is not None and batch is not None and batch in current.batches:
            return current.number
        if current is None:
            name, files = _write(fresh, path, 1, keys)
            version = _next(None, new.schema, batch, (), name, files)
        else:
            # Written once: it is used several times below, and Catalyst then knows its size.
            staged = materialise(fresh, "fresh") if staged is None else staged
            name, version = _merged(path, current, staged, keys, latest_by, batch)
        if _publish(spark, path, version, max(1, keep_versions)):
            return version.number
        if name:
            folders.remove(spark, [f"{path}/data/{name}"])
    raise Conflict(f"other writers committed to {path} first, {ATTEMPTS} times")


def _merged(
    path: str,
    current: Version,
    fresh: DataFrame,
    keys: list[str],
    latest_by: list[str] | None,
    batch: str | None,
) -> tuple[str | None, Version]:
    """Writes what the next version needs; the new directory and the version."""
    spark = fresh.sparkSession
    schema = union_schema(current.schema, fresh.schema)
    retyped = any(schema[f.name].dataType != f.dataType for f in current.schema)
    if fresh.isEmpty() and not retyped:
        return None, _next(current, schema, batch, current.files, None, ())
    fresh = fit(fresh, schema)
    compared = keys or schema.names

    def stored(files: Iterable[File]) -> DataFrame:
        return fit(_read(spark, path, current, files), schema)

    near = current.files if retyped else _may_hold(current.files, fresh, keys)
    small = [f for f in current.files if f.size < SMALL_BYTES]
    rewritten = {f.name for f in small} if len(small) > MAX_SMALL else set()
    if retyped:
        rewritten = {f.name for f in current.files}
    if latest_by is None:
        # Stored keys that also occur in the batch first: a small batch is broadcast to that scan.
        known = match_keys(stored(near).select(compared), fresh, compared, "left_semi")
        changed = match_keys(fresh, materialise(known, "known"), compared, "left_anti")
    else:
        if near and not retyped:
            old = _read(spark, path, current, near)
            held = [F.col(f"`{k}`") if k in old.columns else F.lit(None).alias(k) for k in keys]
            held = old.select(*held, F.col("_metadata.file_path").alias("_file"))
            held = match_keys(held, fresh, keys, "left_semi").select("_file").distinct()
            # Names of files, of which the commit lists all.
            rewritten |= {"/".join(row[0].split("/")[-2:]) for row in held.collect()}
    taken = [f for f in current.files if f.name in rewritten]
    kept = [f for f in current.files if f.name not in rewritten]
    if latest_by is None:
        rows = stored(taken).unionAll(changed) if taken else changed
    elif taken:
        # Rows that are not contested are copied without taking part in the choice.
        contested = match_keys(stored(taken), fresh, keys, "left_semi")
        winners = dedup_latest(contested.unionAll(fresh), keys, latest_by)
        rows = match_keys(stored(taken), fresh, keys, "left_anti").unionAll(winners)
    else:
        rows = fresh
    name, files = _write(rows, path, current.number + 1, keys)
    if not files:
        folders.remove(spark, [f"{path}/data/{name}"])
    return name if files else None, _next(current, schema, batch, kept, name, files)
