"""From input folders to a load report and staged rows.

First the *heads* of all files are read: their columns and, for the fast check, their first rows. What they
rule out is never parsed. The rest is parsed once: one scan of all CSV files of all tables, joined with
one small row per file (the *manifest*: which cell is which column), is staged as Parquet, still as
text. Checks then read one or two staged columns, and the load reads the staged rows of the chosen files.
Only counts, the list of table names and, some thousands at a time, paths of files that a scan must not
open reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import ATTACHMENTS, EXPORT_CONTRACTS, Contract, sql_names
from tidemark.functions import paths
from tidemark.operators import validate as v
from tidemark.operators.choose import POLICIES, one_file_per_key
from tidemark.operators.report import load_outcome
from tidemark.scratch import broadcast_if_small, materialise
from tidemark.sources import archives, columnar, delimited
from tidemark.sources.catalogue import describe_files, list_files, may_be_file_of
from tidemark.sources.heads import UNREADABLE, read_heads
from tidemark.sources.storage import reachable

NO_SIBLING = "no_sibling_data"
WRONG_TYPE = "wrong_type"
RAGGED = "ragged_row"
#: What the report calls an archive that can't be read, so that nobody knows what it holds.
ARCHIVE = "archive"

CLASS_ID = "class_id"
#: Rows of a file that the fast check looks at.
FAST_ROWS = 50
#: Paths of files that one scan leaves out by name.
WRONG_PATHS = 10_000


@dataclass(frozen=True)
class Inspection:
    """``report``: one row per file, with ``class_id`` and ``outcome``. ``files``: which paths make
    up each of them (``unit``). ``staged``: per table, the text rows of all files that their heads do not
    rule out: ``path``, ``row_no``, ``bucket``, ``class_id``, ``cells`` in the order of the contract, and
    ``fault``."""

    report: DataFrame
    staged: dict[str, DataFrame]
    files: DataFrame
    buckets: int

    def rows(self, contract: Contract) -> DataFrame:
        """Text rows of the files to load, with ``source_file``, ``source_class`` (that of the file,
        which single rows may lack) and ``source_modified``."""
        chosen = self.report.filter((F.col("type") == contract.name) & (F.col("outcome") == "load"))
        chosen = chosen.select(
            F.col("unit").alias("source_file"),
            F.col("class_id").alias("source_class"),
            F.col("modified").alias("source_modified"),
        )
        chosen = chosen.join(self.files, chosen["source_file"] == self.files["unit"]).drop("unit")
        # Cells get their names before the join: a contract may have a column called like those of it.
        cells = [F.get("cells", F.lit(i)).alias(f"_{i}") for i in range(len(contract.names))]
        rows = self.staged[contract.name].select("path", "bucket", *cells)
        # Bucket by bucket, as the rows were staged: the files of one are few enough to broadcast.
        parts = []
        for bucket in range(self.buckets):
            mine = chosen.filter(delimited.bucket_of(F.col("source_file"), self.buckets) == bucket)
            staged = rows.filter(F.col("bucket") == bucket)
            parts.append(staged.join(broadcast_if_small(mine), "path"))
        named = [F.col(f"_{i}").alias(name) for i, name in enumerate(contract.names)]
        source = ["source_file", "source_class", "source_modified"]
        return reduce(DataFrame.unionAll, parts).select(*named, *source)


def inspect(
    spark: SparkSession,
    roots: Iterable[str],
    contracts: Sequence[Contract] = EXPORT_CONTRACTS,
    validation: str = "strict",
    policy: str = "latest",
    multiline: bool = True,
) -> Inspection:
    """Catalogue, check and choose the files below ``roots``, loose or in zip archives.

    ``validation="strict"`` wants contract columns only and one class per file (tables about many
    classes need the columns only). ``"fast"`` wants a class in the first 50 rows and looks at
    nothing else; columns outside the contract are then ignored. Either way a file with a row of more
    cells than its header is rejected, and so are files that are empty or can't be read.

    ``policy`` says which of several files for one table and class is loaded: the ``"latest"``, the
    ``"first"`` by path, or ``"all"``, leaving duplicates to the row-level key.
    """
    if validation not in ("strict", "fast") or policy not in POLICIES:
        raise ValueError(f"unknown validation {validation!r} or policy {policy!r}")
    roots, strict = list(roots), validation == "strict"
    live = [c for c in contracts if not c.legacy]

    files = materialise(_catalogue(spark, roots, contracts), "catalogue")
    present = files.filter(F.col("reason").isNull()).groupBy("type").agg(
        F.count("*").alias("files"), F.count_if(_far()).alias("far")
    )
    present = {row["type"]: row for row in present.collect()}
    loaded = [c for c in live if c.name in present]
    buckets = delimited.buckets_for(sum(row.files for row in present.values()))

    far = any(present[c.name].far for c in loaded)
    heads = materialise(_heads(spark, roots, files, loaded, strict, multiline, far), "heads")
    staged = _stage(spark, roots, files, heads, loaded, multiline, buckets)
    if strict:
        verdicts = _class_of_all_rows(staged, loaded)
    else:
        verdicts = _class_of_first_rows(heads)
    verdicts = verdicts.join(_faults(staged), "unit", "left")
    units = materialise(_judge(files, heads, verdicts, contracts), "units")
    report = _outcomes(units, contracts, policy)
    report = report.unionByName(_attachments(files, units, contracts), allowMissingColumns=True)
    tables = {c.name: staged.filter(F.col("type") == c.name) for c in loaded}
    return Inspection(materialise(report, "report"), tables, files.select("path", "unit"), buckets)


def _catalogue(spark: SparkSession, roots: list[str], contracts: Sequence[Contract]) -> DataFrame:
    """Loose files and members of archives, with a ``reason`` for those that hold nothing or can't be opened."""
    listed = list_files(spark, roots)
    archive = F.lower("path").endswith(".zip")
    loose = describe_files(listed.filter(~archive), contracts)
    members = archives.list_members(listed.filter(archive & (F.col("size") > 0)), contracts)
    closed = F.col("reason").isNotNull()
    members = members.withColumn("type", F.when(closed, F.lit(ARCHIVE)).otherwise(F.col("type")))
    files = loose.unionByName(members, allowMissingColumns=True)
    nothing = F.when(F.col("size") == 0, F.lit(v.EMPTY))
    return files.withColumn("reason", F.coalesce("reason", nothing))


def _far() -> Column:
    """Loose CSV files in stores that Spark reads, but tasks can't open by themselves. Spark's scan has to
    tell their heads, at the price of all lines."""
    loose = (F.col("format") == "csv") & F.col("archive_path").isNull()
    return F.coalesce(loose & ~reachable(F.col("path")), F.lit(False))


def _heads(
    spark: SparkSession,
    roots: list[str],
    files: DataFrame,
    loaded: Sequence[Contract],
    strict: bool,
    multiline: bool,
    far: bool,
) -> DataFrame:
    """(path, unit, type, format, archive_path, header, rows, first_id, reason) of every loadable file."""
    in_archive = F.col("archive_path").isNotNull()
    wanted = files.filter(
        F.col("type").isin(*[c.name for c in loaded])
        & F.col("reason").isNull()
        & ((F.col("format") == "csv") | (~in_archive & (F.col("format") == "parquet")))
    )
    rows = 0 if strict else FAST_ROWS
    found = read_heads(wanted.filter(~_far()), CLASS_ID, rows)
    if far:
        found = found.unionByName(_heads_by_scan(spark, roots, wanted.filter(_far()), loaded, rows, multiline))
    about = ("path", "unit", "type", "format", "archive_path")
    found = found.join(wanted.select(*about), "path")
    nothing = F.when(F.col("header").isNull(), F.lit(v.EMPTY))
    reason = F.coalesce("reason", nothing, _column_reason(loaded, strict))
    found = found.select(*about, "header", "rows", "first_id", reason.alias("reason"))
    if strict:
        return found
    # Not one part of the file has a class in its first rows.
    found = materialise(found, "first-rows")
    none = _class_of_first_rows(found).filter(F.col("verdict") != v.OK)
    found = found.join(none.select("unit", "verdict"), "unit", "left")
    return found.withColumn("reason", F.coalesce("reason", "verdict")).drop("verdict")


def _heads_by_scan(
    spark: SparkSession, roots: list[str], files: DataFrame, loaded: Sequence[Contract], rows: int, multiline: bool
) -> DataFrame:
    """What :func:`read_heads` gives, for loose CSV files."""

    def wanted(path: Column) -> Column:
        return may_be_file_of(path, loaded, "csv")

    headers = delimited.read_headers(spark, roots, wanted).join(files.select("path"), "path", "left_semi")
    headers = materialise(headers, "headers")
    first = spark.createDataFrame([], "path string, rows int, first_id string")
    if rows:
        one = Contract.of("first", f"{CLASS_ID} STRING")
        seen = delimited.bound_rows(
            spark, roots, headers, one, wanted, multiline, delimited.buckets_for(headers.count()), ("path", "row_no")
        )
        some = seen.groupBy("path").agg(F.lit(1).alias("rows"))
        first = some.join(v.first_id_check(seen, "path", "row_no", CLASS_ID, rows), "path", "left")
        first = first.withColumnRenamed(CLASS_ID, "first_id")
    nothing = [F.lit(None).cast("array<string>").alias("kinds"), F.lit(None).cast("string").alias("reason")]
    rows_seen = F.coalesce("rows", F.lit(0)).alias("rows")
    return headers.join(first, "path", "left").select("path", "header", nothing[0], rows_seen, "first_id", nothing[1])


def _column_reason(loaded: Sequence[Contract], strict: bool) -> Column:
    reason = F.lit(None).cast("string")
    for c in loaded:
        kinds = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}'" for f in c.schema)
        fits = F.expr(
            "forall(arrays_zip(header, kinds), "
            f"pair -> coalesce(map({kinds})[pair.header] = pair.kinds, true))"
        )
        wrong = F.when(F.col("kinds").isNotNull() & ~fits, F.lit(WRONG_TYPE))
        columns = v.column_check(F.col("header"), c) if strict else F.lit(None)
        reason = F.when(F.col("type") == c.name, F.coalesce(columns, wrong)).otherwise(reason)
    return reason


def _by_type(loaded: Sequence[Contract], value) -> Column:
    found = F.lit(None)
    for c in loaded:
        found = F.when(F.col("type") == c.name, value(c)).otherwise(found)
    return found


def _manifest(heads: DataFrame, loaded: Sequence[Contract], buckets: int) -> DataFrame:
    """One row per file to scan: type, bucket, and for each column of its contract the place in the file."""
    places = _by_type(
        loaded, lambda c: F.expr(f"transform({sql_names(c)}, name -> int(array_position(header, name)))")
    )
    return heads.select(
        "path",
        "type",
        delimited.bucket_of(F.col("unit"), buckets).alias("file_bucket"),
        places.alias("places"),
        F.size("header").alias("last_place"),
        F.col("archive_path").isNotNull().alias("inside"),
        (F.col("format") == "parquet").alias("typed"),
    )


def _bound(rows: DataFrame, manifest: DataFrame, loaded: Sequence[Contract]) -> DataFrame:
    """Positional rows with their files: cells in the order of the contract, and what is wrong."""
    joined = rows.join(manifest, "path")
    # Place 0 (absent) is NULL first, since element 0 is an error; past the end gives NULL.
    cells = F.expr("transform(places, place -> try_element_at(cells, nullif(place, 0)))")
    ids = _by_type(loaded, lambda c: F.lit(c.names.index(CLASS_ID) if CLASS_ID in c.names else None))
    fault = F.when(F.col("cells").isNull(), UNREADABLE).when(F.expr(delimited.RAGGED), RAGGED)
    return joined.select(
        "path", "type", F.col("file_bucket").alias("bucket"), "row_no", fault.alias("fault"), cells.alias("cells"),
        ids.cast("int").alias("_at"),
    ).select(
        "path", "type", "bucket", "row_no", "fault", F.get("cells", F.col("_at")).alias(CLASS_ID), "cells"
    )


def _stage(
    spark: SparkSession,
    roots: list[str],
    files: DataFrame,
    heads: DataFrame,
    loaded: Sequence[Contract],
    multiline: bool,
    buckets: int,
) -> DataFrame:
    """The rows of all files that their heads do not rule out, written once."""
    empty = spark.createDataFrame(
        [], f"path string, type string, bucket int, row_no bigint, fault string, {CLASS_ID} string, cells array<string>"
    )
    if not loaded:
        return empty
    usable = heads.filter(F.col("reason").isNull())
    manifest = _manifest(usable, loaded, buckets)
    counts = manifest.groupBy("type").agg(
        F.count_if("typed").alias("typed"),
        F.count_if("inside").alias("inside"),
        F.count_if(~F.col("typed") & ~F.col("inside")).alias("loose"),
        F.max(F.when(~F.col("typed"), F.array_max("places"))).alias("reach"),
    )
    counts = {row["type"]: row for row in counts.collect()}
    reach = max((row.reach or 0 for row in counts.values()), default=0)
    lines = manifest.filter(~F.col("typed"))
    known = sum(row.loose + row.inside for row in counts.values())

    scans = []
    if any(row.loose for row in counts.values()):
        tables = [c for c in loaded if c.name in counts and counts[c.name].loose]
        # Files that are ruled out are not opened, unless there are too many to name; then the join drops them.
        out = files.filter("format = 'csv' AND archive_path IS NULL").join(lines, "path", "left_anti")
        out = out.filter(F.col("type").isin(*[c.name for c in tables])).select("path").limit(WRONG_PATHS + 1)
        out = [row.path for row in out.collect()]
        out = out if len(out) <= WRONG_PATHS else []

        def wanted(path: Column) -> Column:
            table = may_be_file_of(path, tables, "csv")
            return table & ~path.isin(out) if out else table

        scans.append(delimited.positional_rows(spark, roots, max(reach, 1), wanted, multiline, True))
    if any(row.inside for row in counts.values()):
        inside = files.join(lines.select("path"), "path", "left_semi").filter("archive_path IS NOT NULL")
        scans.append(archives.read_members(inside))
    parts = [empty]
    for rows in scans:
        parts += _bound_by_bucket(rows, lines, loaded, buckets, known)
    for c in loaded:
        if c.name in counts and counts[c.name].typed:
            chosen = manifest.filter(F.col("typed") & (F.col("type") == c.name))
            parts.append(_parquet_rows(spark, roots, chosen, heads, c))
    rows = reduce(DataFrame.unionByName, parts)
    return materialise(rows, "rows", ("type", "bucket"))


def _bound_by_bucket(
    rows: DataFrame, manifest: DataFrame, loaded: Sequence[Contract], buckets: int, files: int
) -> list[DataFrame]:
    """Rows joined with a manifest that is small enough to broadcast. One that is not is divided by path,
    and the rows are written once so divided: however many files, the input is scanned once."""
    if buckets == 1:
        return [_bound(rows, broadcast_if_small(manifest, known_rows=files), loaded)]
    apart = rows.withColumn("bucket", delimited.bucket_of(F.col("path"), buckets))
    apart = materialise(apart, "positional", ("bucket",))
    return [
        _bound(
            apart.filter(F.col("bucket") == bucket).drop("bucket"),
            broadcast_if_small(manifest.filter(F.col("file_bucket") == bucket)),
            loaded,
        )
        for bucket in range(buckets)
    ]


def _parquet_rows(
    spark: SparkSession, roots: list[str], manifest: DataFrame, heads: DataFrame, contract: Contract
) -> DataFrame:
    mine = heads.filter(F.col("type") == contract.name)
    broken = mine.filter(F.col("reason").isin(WRONG_TYPE, UNREADABLE)).select("path")
    rows = _typed_rows(spark, roots, broken, contract)
    rows = rows.join(broadcast_if_small(manifest.select("path", F.col("file_bucket").alias("bucket"))), "path")
    class_id = F.col(CLASS_ID) if CLASS_ID in contract.names else F.lit(None).cast("string")
    return rows.select(
        "path",
        F.lit(contract.name).alias("type"),
        "bucket",
        "row_no",
        F.lit(None).cast("string").alias("fault"),
        class_id.alias(CLASS_ID),
        F.array(*[F.col(f"`{name}`") for name in contract.names]).alias("cells"),
    )


def _typed_rows(
    spark: SparkSession, roots: list[str], broken: DataFrame, contract: Contract
) -> DataFrame:
    """Text rows of the contract's Parquet files but those of ``broken`` (path), which a typed scan
    must not open. However many these are, a scan names about :data:`WRONG_PATHS` of them: files are
    divided by path, and each part is scanned and written by itself."""
    turns = 1 + broken.count() // WRONG_PATHS

    def part_of(path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(turns))

    parts = []
    for turn in range(turns):
        mine = broken if turns == 1 else broken.filter(part_of(F.col("path")) == turn)
        named = [row.path for row in mine.collect()]

        def wanted(path: Column, turn: int = turn, named: list[str] = named) -> Column:
            typed = may_be_file_of(path, [contract], "parquet") & ~path.isin(named)
            return typed if turns == 1 else typed & (part_of(path) == turn)

        rows = columnar.text_rows(spark, roots, contract, wanted)
        parts.append(rows if turns == 1 else materialise(rows, "typed"))
    return reduce(DataFrame.unionAll, parts)


def _class_of_all_rows(staged: DataFrame, loaded: Sequence[Contract]) -> DataFrame:
    """(unit, class_id, verdict) of the units that have rows: one class among all of them, except in
    tables about many."""
    # Rows shrink to a few per path first; only then are paths cut to units.
    pairs = staged.filter("fault IS NULL OR cells IS NOT NULL").select("type", "path", CLASS_ID).distinct()
    pairs = pairs.withColumn("unit", paths.unit_of(F.col("path")))
    many = F.col("type").isin(*[c.name for c in loaded if c.multi_class])
    single = v.single_id_check(pairs.filter(~many), "unit").withColumnRenamed("outcome", "verdict")
    whole = pairs.filter(many).select("unit").distinct()
    whole = whole.selectExpr("unit", "cast(NULL AS string) AS class_id", f"'{v.OK}' AS verdict")
    return single.select("unit", "class_id", "verdict").unionByName(whole)


def _class_of_first_rows(heads: DataFrame) -> DataFrame:
    """(unit, class_id, verdict) of the units that have rows, from their heads alone."""
    classed = F.when(F.col("first_id").isNotNull(), F.col("path"))
    found = heads.filter("rows > 0").groupBy("unit").agg(F.min_by("first_id", classed).alias("class_id"))
    verdict = F.when(F.col("class_id").isNull(), v.NO_CLASS).otherwise(v.OK)
    return found.withColumn("verdict", verdict)


def _faults(staged: DataFrame) -> DataFrame:
    """(unit, fault): what is wrong in some row of a unit."""
    found = staged.filter("fault IS NOT NULL").select("path", "fault").distinct()
    return found.groupBy(paths.unit_of(F.col("path")).alias("unit")).agg(F.max("fault").alias("fault"))


def _judge(
    files: DataFrame, heads: DataFrame, verdicts: DataFrame, contracts: Sequence[Contract]
) -> DataFrame:
    """One row per unit of a known table: when, how large, which class, and why not loadable."""
    legacy = [c.name for c in contracts if c.legacy]
    reasons = heads.select("path", F.col("reason").alias("_head"))
    # An empty part file does not spoil the others: units without any row are empty in the end.
    known = F.when(F.coalesce("_head", "reason") != v.EMPTY, F.coalesce("_head", "reason"))
    units = (
        files.filter(F.col("type").isNotNull())
        .join(reasons, "path", "left")
        .withColumn("_columns", known)
        .groupBy("unit", "type", "format", "parent", "archive_path")
        .agg(
            F.max("modified").alias("modified"),
            F.sum("size").alias("size"),
            F.max("_columns").alias("_columns"),
        )
        .join(verdicts, "unit", "left")
    )
    in_archive = F.col("archive_path").isNotNull()
    reason = (
        F.when(F.col("type") == ARCHIVE, UNREADABLE)
        .when(F.col("format").isNull() | (in_archive & (F.col("format") != "csv")), v.UNKNOWN_FORMAT)
        .when(F.col("_columns").isNotNull(), F.col("_columns"))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("verdict").isNull(), v.EMPTY)
        .when(F.col("verdict") != v.OK, F.col("verdict"))
    )
    is_legacy = F.col("type").isin(*legacy) if legacy else F.lit(False)
    return units.withColumn("reason", F.when(~is_legacy, reason)).drop("_columns", "verdict", "fault")


def _outcomes(units: DataFrame, contracts: Sequence[Contract], policy: str) -> DataFrame:
    multi = [c.name for c in contracts if c.multi_class]
    legacy = [c.name for c in contracts if c.legacy]
    valid = units.filter(F.col("reason").isNull())
    if policy == "all":
        chosen = valid
    else:
        order = [F.col("modified").desc()] if policy == "latest" else []
        chosen = one_file_per_key(valid, [*order, F.col("unit")], multi)
    flags = chosen.select("unit").withColumn("_chosen", F.lit(True))
    joined = units.join(flags, "unit", "left")
    outcome = load_outcome(
        F.col("reason"), F.coalesce("_chosen", F.lit(False)), F.col("type"), legacy
    )
    return joined.withColumn("outcome", outcome).drop("_chosen")


def _attachments(files: DataFrame, units: DataFrame, contracts: Sequence[Contract]) -> DataFrame:
    """Report rows for files in attachment folders. They belong to the class that all valid files beside
    the folder share, of which one at least is of a live table; a valid file without a class, as those
    of legacy tables and of tables about many classes, belongs to none. Otherwise they are rejected."""
    live = [c.name for c in contracts if not c.legacy]
    valid = units.filter(F.col("reason").isNull())
    owners = v.sibling_class(valid, "parent", F.col("type").isin(*live), "class_id")
    owners = owners.withColumnRenamed("parent", "attached_to")
    attached = files.filter(F.col("attached_to").isNotNull()).join(owners, "attached_to", "left")
    reason = F.when(F.col("class_id").isNull(), F.lit(NO_SIBLING))
    return attached.select(
        F.col("path").alias("unit"),
        F.lit(ATTACHMENTS).alias("type"),
        "format",
        "parent",
        "archive_path",
        "modified",
        "size",
        "class_id",
        reason.alias("reason"),
        F.coalesce(F.concat(F.lit("rejected:"), reason), F.lit("load")).alias("outcome"),
    )
