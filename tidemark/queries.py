"""Every operator as a query over the driver tables, with the SQL it must agree with.

Queries that need files first let Spark write the tables as exports into the scratch folder, so
their work grows with the tables as well.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import Contract
from tidemark.functions import paths
from tidemark.functions.casting import as_text, parse_dates
from tidemark.operators import dedup, report, validate
from tidemark.operators.choose import latest_per_parent, newer_than_stored, one_file_per_key
from tidemark.operators.project import project
from tidemark.operators.union import diagonal_union
from tidemark.plans.exports import compress_exports, find_orphans, organize_exports
from tidemark.plans.inspect import inspect
from tidemark.plans.load import load_latest
from tidemark.plans.table import merge_into, read_table
from tidemark.scratch import materialise, scratch_path
from tidemark.sinks import folders
from tidemark.sinks.files import write_csv, write_parquet, write_per_class
from tidemark.sources import archives, columnar, delimited
from tidemark.sources.catalogue import catalogue, list_files
from tidemark.sources.heads import read_heads
from tidemark.streaming.arrivals import merge_arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

def query(sql: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        name = function.__name__.removesuffix("_query")
        QUERIES[name] = function
        ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- merge, deduplication, union -----------------------------------------------------------------


def _order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored: one row per order. New: what its lines say later, with other columns."""
    stored = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_key",
        "o_orderstatus AS status",
        "o_orderdate AS changed",
        "o_totalprice AS amount",
        "o_orderpriority AS priority",
    )
    new = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_key",
        "l_linestatus AS status",
        "l_shipdate AS changed",
        "l_extendedprice AS amount",
        "l_suppkey AS supplier",
    )
    return stored, new


_MERGED_ORDERS = """
    SELECT * FROM (
        SELECT o_orderkey AS order_key, o_orderstatus AS status, o_orderdate AS changed,
               o_totalprice AS amount, o_orderpriority AS priority, NULL::BIGINT AS supplier
        FROM orders
        UNION ALL
        SELECT l_orderkey, l_linestatus, l_shipdate, l_extendedprice, NULL, l_suppkey FROM lineitem)
    QUALIFY row_number() OVER (
        PARTITION BY order_key
        ORDER BY changed DESC NULLS LAST, status DESC NULLS LAST, amount DESC NULLS LAST,
                 priority DESC NULLS LAST, supplier DESC NULLS LAST) = 1
"""


@query(_MERGED_ORDERS)
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _order_states(spark, sf_dir)
    return dedup.merge_latest(stored, new, ["order_key"], ["changed"])


@query(_MERGED_ORDERS)
def stored_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge through a stored table in two versions."""
    stored, new = _order_states(spark, sf_dir)
    path = scratch_path(spark, "orders")
    for batch in (stored, new):
        merge_into(batch, path, ["order_key"], ["changed"])
    return read_table(spark, path)


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = table(spark, sf_dir, "documents").selectExpr("doc_id AS item_id", "lang", "n_chars AS size")
    new = table(spark, sf_dir, "part").selectExpr("p_partkey AS item_id", "p_brand AS brand", "p_size AS size")
    return stored, new


_APPENDED_ITEMS = """
    SELECT doc_id AS item_id, lang, n_chars AS size, NULL::VARCHAR AS brand FROM documents
    UNION ALL
    SELECT p_partkey, NULL, p_size::BIGINT, p_brand FROM part
    WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = p_partkey)
"""


@query(_APPENDED_ITEMS)
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _items(spark, sf_dir)
    return dedup.merge_keep_stored(stored, new, ["item_id"])


@query(_APPENDED_ITEMS)
def stored_merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stored table; merging the second batch twice changes nothing."""
    stored, new = _items(spark, sf_dir)
    path = scratch_path(spark, "items")
    for batch in (stored, new, new):
        merge_into(batch, path, ["item_id"])
    return read_table(spark, path)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def merge_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without keys holds distinct rows; merging the same rows again changes nothing."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount"
    )
    path = scratch_path(spark, "keyless")
    for batch in (rows.where("l_quantity < 30"), rows.where("l_quantity > 20"), rows):
        merge_into(batch, path, [])
    return read_table(spark, path)


@query("""
    SELECT * FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def dedup_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return dedup.dedup_latest(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT DISTINCT md5(text) AS text_md5, n_chars FROM documents")
def dedup_any_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivor is free, so only columns that the key determines are shown."""
    kept = dedup.dedup_any(table(spark, sf_dir, "documents"), ["text"])
    return kept.select(F.md5("text").alias("text_md5"), "n_chars")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return dedup.distinct_rows(lines.select("l_returnflag", "l_linestatus", "l_shipdate"))


@query("""
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
           NULL::INTEGER AS nation
    FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier
""")
def diagonal_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS nation", "s_acctbal AS balance", "s_name AS name", "s_suppkey AS id"
    )
    return diagonal_union(customers, suppliers)


@query("""
    SELECT l_linenumber::VARCHAR AS code, l_quantity AS amount, l_orderkey AS key,
           (l_tax > 0.02)::BIGINT AS flag
    FROM lineitem
    UNION ALL
    SELECT o_orderpriority, o_custkey::DOUBLE, o_orderkey, o_custkey FROM orders
    UNION ALL
    SELECT c_name, c_acctbal, c_nationkey::BIGINT, c_custkey FROM customer
""")
def diagonal_union_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer with text, double with long, long with integer and boolean with long."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber AS code", "l_quantity AS amount", "l_orderkey AS key", "l_tax > 0.02 AS flag"
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS code", "o_custkey AS amount", "o_orderkey AS key", "o_custkey AS flag"
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_name AS code", "c_acctbal AS amount", "c_nationkey AS key", "c_custkey AS flag"
    )
    return diagonal_union(lines, orders, customers)


# --- projections and casts -----------------------------------------------------------------------


@query("SELECT DISTINCT event_type, user_id FROM events")
def contract_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract.of("seen", "event_type STRING, absent_column STRING, user_id BIGINT")
    return dedup.distinct_rows(project(table(spark, sf_dir, "events"), contract))


@query("SELECT c_custkey::VARCHAR AS class_id, c_name FROM customer")
def cast_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(as_text(F.col("c_custkey")).alias("class_id"), "c_name")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS ordered FROM orders
""")
def parse_dates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderstatus WHEN 'P' THEN 'n/a' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS ordered",
    )
    return parse_dates(texts, ["ordered"])


@query("""
    SELECT event_id, '/in/' || user_id AS parent,
           CASE WHEN event_type IN ('click', 'view') THEN event_type END AS type,
           CASE WHEN value < 20 THEN 'csv' WHEN value < 40 THEN 'parquet' END AS format
    FROM events
""")
def classify_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file paths: names in mixed case, with known, unknown and no suffix."""
    path = """concat('/in/', user_id, '/', initcap(event_type),
        CASE WHEN value < 20 THEN '.CSV' WHEN value < 40 THEN '.Parquet' WHEN value < 60 THEN '.txt'
             ELSE '' END)"""
    files = table(spark, sf_dir, "events").select("event_id", F.expr(path).alias("path"))
    return files.select(
        "event_id",
        paths.parent_of(F.col("path")).alias("parent"),
        paths.type_of(F.col("path"), ["click", "view"]).alias("type"),
        paths.format_of(F.col("path")).alias("format"),
    )


# --- choice among files --------------------------------------------------------------------------


@query("""
    SELECT regexp_extract(url, '^(.*)/[^/]+$', 1) AS parent, max(page_id) AS page_id
    FROM pages GROUP BY 1
""")
def latest_per_parent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(paths.parent_of(F.col("url")).alias("parent"), "page_id")
    return latest_per_parent(pages, "parent", "page_id")


@query("""
    WITH files AS (
        SELECT event_id, event_type AS type, ts,
               CASE WHEN value >= 5 THEN user_id::VARCHAR END AS class_id
        FROM events)
    SELECT event_id, type, class_id FROM files WHERE type = 'error'
    UNION ALL
    SELECT event_id, type, class_id FROM (
        SELECT *, row_number() OVER (PARTITION BY type, class_id ORDER BY ts DESC, event_id) AS n
        FROM files WHERE type <> 'error' AND class_id IS NOT NULL)
    WHERE n = 1
""")
def one_file_per_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files; 'error' stands for a table about many classes."""
    files = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_type AS type",
        "ts",
        "CASE WHEN value >= 5 THEN string(user_id) END AS class_id",
    )
    order = [F.col("ts").desc(), F.col("event_id")]
    return one_file_per_key(files, order, ["error"]).select("event_id", "type", "class_id")


@query("""
    WITH arrived AS (
        SELECT l_orderkey AS target, max(l_shipdate) AS modified
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    kept AS (
        SELECT l_orderkey AS target, max(l_shipdate) AS stored_modified
        FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT target, modified, stored_modified,
           CASE WHEN stored_modified IS NULL THEN 'new'
                WHEN modified <= stored_modified THEN 'skip' ELSE 'replace' END AS outcome
    FROM arrived LEFT JOIN kept USING (target)
""")
def newer_than_stored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest returned line of an order against its latest other line."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "target")
    latest = F.max("l_shipdate").alias("modified")
    arrived = lines.filter("l_returnflag = 'R'").groupBy("target").agg(latest)
    kept = lines.filter("l_returnflag <> 'R'").groupBy("target").agg(latest)
    return newer_than_stored(arrived, kept, "target")


# --- checks and reports --------------------------------------------------------------------------


@query("""
    SELECT l_orderkey AS file,
           CASE WHEN min(class_id) = max(class_id) THEN min(class_id) END AS class_id,
           CASE WHEN count(class_id) = 0 THEN 'no_class_id'
                WHEN count(DISTINCT class_id) > 1 THEN 'many_classes' ELSE 'ok' END AS outcome,
           count(*) AS rows
    FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS class_id
          FROM lineitem)
    GROUP BY 1
""")
def single_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, line status as class; returned lines have none."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS file", "CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS class_id"
    )
    return validate.single_id_check(rows, "file")


@query("""
    SELECT file, arg_min(class_id, position) AS class_id FROM (
        SELECT user_id AS file, event_id AS position,
               CASE WHEN value > 200 THEN event_type END AS class_id,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
        FROM events)
    WHERE n <= 50 AND class_id IS NOT NULL
    GROUP BY file
""")
def sample_first_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files; only rare events carry a class, in many files beyond row 50 or never."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id AS file", "event_id AS position", "CASE WHEN value > 200 THEN event_type END AS class_id"
    )
    return validate.first_id_check(rows, "file", "position")


@query("""
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (
        SELECT l_orderkey FROM lineitem GROUP BY 1
        HAVING bool_or(l_returnflag <> 'R') AND min(l_linestatus) = max(l_linestatus))
""")
def sibling_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attachments beside their lines; lines not returned are live data."""
    attachments = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS parent", "o_orderstatus")
    siblings = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "parent")
    kept = validate.attachments_with_siblings(
        attachments, siblings, "parent", F.col("l_returnflag") != "R", "l_linestatus"
    )
    return kept.withColumnRenamed("parent", "o_orderkey")


@query("SELECT event_type AS type, count(*) AS files FROM events GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.type_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "type"))


@query("""
    SELECT vec_id AS class_id, 'registered_without_data' AS issue
    FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)
    UNION ALL
    SELECT DISTINCT doc_id, 'data_without_entry'
    FROM labels WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE doc_id = vec_id)
""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS class_id")
    data = table(spark, sf_dir, "labels").selectExpr("doc_id AS class_id")
    return report.reconcile(registry, data)


@query("""
    WITH files AS (
        SELECT doc_id, lang, source, n_chars,
               CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' END AS reason
        FROM documents LEFT JOIN labels USING (doc_id)),
    ranked AS (
        SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n
        FROM files WHERE reason IS NULL)
    SELECT doc_id, CASE WHEN lang = 'es' THEN 'legacy'
                        WHEN reason IS NOT NULL THEN 'rejected:' || reason
                        WHEN n > 1 THEN 'duplicate' ELSE 'load' END AS outcome
    FROM files LEFT JOIN ranked USING (doc_id)
""")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a type (source) and class (language); one per pair is loaded."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    files = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn(
        "reason", F.expr("CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' END")
    )
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    chosen = one_file_per_key(files.filter("reason IS NULL"), order, (), "source", "lang")
    flags = chosen.select("doc_id", F.lit(True).alias("chosen"))
    joined = files.join(flags, "doc_id", "left")
    outcome = report.load_outcome(
        F.col("reason"), F.coalesce("chosen", F.lit(False)), F.col("lang"), ["es"]
    )
    return joined.select("doc_id", outcome.alias("outcome"))


# --- files: catalogue, CSV, Parquet, archives ----------------------------------------------------


def _write_files(files: DataFrame, root: str) -> DataFrame:
    """Small files, ``<root>/<place>`` each, written by the tasks: (place)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, folder = fs.FileSystem.from_uri(root)
        for rows in batches:
            for place, text in zip(rows["place"], rows["text"], strict=True):
                filesystem.create_dir(f"{folder}/{place}".rpartition("/")[0])
                with filesystem.open_output_stream(f"{folder}/{place}") as file:
                    file.write(text.encode())
            yield rows[["place"]]

    return materialise(files.mapInPandas(write, "place string"), "files")


_OF_NATION = "SELECT c_nationkey AS nation, count(*) AS n, min(c_custkey) AS least FROM customer GROUP BY 1"


@query(f"""
    SELECT CASE WHEN nation % 4 = 3 THEN NULL ELSE 'accounts' END AS type,
           CASE WHEN nation % 4 < 3 THEN CASE WHEN nation % 4 = 1 THEN 'parquet' ELSE 'csv' END END AS format,
           n % 2 = 0 AS empty, count(*) AS files, min(nation)::VARCHAR AS least
    FROM ({_OF_NATION}) GROUP BY ALL
""")
def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per nation that has customers: of three kinds of name, empty for an even number of them."""
    root = scratch_path(spark, "catalogue")
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    kind = F.col("c_nationkey") % 4
    name = F.when(kind == 1, "Accounts.PARQUET").when(kind == 3, "readme.csv").otherwise("accounts.csv")
    place = F.concat(F.lit("n="), F.col("c_nationkey"), F.lit("/"), name)
    text = F.when(F.col("n") % 2 == 0, F.lit("")).otherwise(F.lit("class_id\n"))
    _write_files(nations.select(place.alias("place"), text.alias("text")), root)
    found = catalogue(spark, [root], [_ACCOUNTS])
    nation = F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("int")
    return (
        found.groupBy("type", F.when(F.col("type").isNotNull(), F.col("format")).alias("format"), (F.col("size") == 0).alias("empty"))
        .agg(F.count("*").alias("files"), F.min(nation).cast("string").alias("least"))
    )


def _write_parts(df: DataFrame, path: str, by: str) -> None:
    """One CSV directory per value of ``by``, each with its header line."""
    write_per_class(df.withColumn("class", F.col(by)), path)


@query("""
    SELECT DISTINCT 'customers' AS source, c_nationkey::VARCHAR AS class_id, NULL::VARCHAR AS reason
    FROM customer
    UNION ALL
    SELECT DISTINCT 'suppliers', s_nationkey::VARCHAR, 'unknown_column' FROM supplier
""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV per nation from two tables, of which one has a column outside the contract."""
    contract = Contract.of("accounts", "id BIGINT, nation BIGINT, segment STRING, balance DOUBLE")
    root = scratch_path(spark, "contract-check")
    _write_parts(_accounts(spark, sf_dir), f"{root}/customers", "nation")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS nation", "s_suppkey AS id", "s_name AS supplier_name"
    )
    _write_parts(suppliers, f"{root}/suppliers", "nation")
    headers = read_heads(list_files(spark, [root]).withColumn("format", F.lit("csv")))
    return headers.select(
        F.regexp_extract("path", "/(customers|suppliers)/", 1).alias("source"),
        paths.partition_value(F.col("path"), "class").alias("class_id"),
        validate.column_check(F.col("header"), contract).alias("reason"),
    ).distinct()


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_acctbal AS balance", "c_custkey AS id", "c_nationkey AS nation", "c_mktsegment AS segment"
    )


@query("""
    SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment,
           c_acctbal AS balance, NULL::VARCHAR AS note FROM customer
    UNION ALL
    SELECT s_suppkey, s_nationkey::BIGINT, NULL, s_acctbal, s_name FROM supplier
""")
def load_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with different columns in different orders, loaded as one table."""
    contract = Contract.of(
        "accounts", "id BIGINT, nation BIGINT, segment STRING, balance DOUBLE, note STRING"
    )
    root = scratch_path(spark, "load-type")
    _write_parts(_accounts(spark, sf_dir), f"{root}/customers", "nation")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS note", "s_suppkey AS id", "s_acctbal AS balance", "s_nationkey AS nation"
    )
    _write_parts(suppliers, f"{root}/suppliers", "nation")
    return delimited.read_csv(spark, [root], contract)


@query("""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag, l_quantity,
           l_linestatus = 'O' AS is_open, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS price
    FROM lineitem
""")
def csv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four contract types and NULLs, through CSV."""
    contract = Contract.of(
        "lines",
        "l_orderkey BIGINT, l_linenumber BIGINT, l_returnflag STRING, l_quantity DOUBLE, "
        "is_open BOOLEAN, price DOUBLE",
    )
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS price",
        "l_linestatus = 'O' AS is_open",
        "l_quantity",
        "l_returnflag",
        "l_linenumber",
        "l_orderkey",
    )
    root = scratch_path(spark, "typed-scan")
    write_csv(lines, root)
    return delimited.read_csv(spark, [root], contract)


_SAID = """concat('"', role, '" said, "', text, '"')"""


@query(f"""
    SELECT conv_id, turn, role, {_SAID} AS said FROM conversations
""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks, written and read back."""
    said = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{_SAID} AS said")
    root = scratch_path(spark, "csv")
    write_csv(said, root)
    contract = Contract.of("said", "conv_id BIGINT, turn BIGINT, role STRING, said STRING")
    return delimited.read_csv(spark, [root], contract)


@query("""
    SELECT p_type, p_partkey, p_size::BIGINT AS p_size, NULL::DOUBLE AS p_weight, p_name, p_brand,
           p_retailprice
    FROM part
""")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read under a contract: other order, a widened column and an absent one."""
    contract = Contract.of(
        "part",
        "p_type STRING, p_partkey BIGINT, p_size BIGINT, p_weight DOUBLE, p_name STRING, "
        "p_brand STRING, p_retailprice DOUBLE",
    )
    return columnar.read_parquet(spark, [f"{sf_dir}/part.parquet"], contract)


@query("SELECT * FROM orders")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "parquet")
    write_parquet(table(spark, sf_dir, "orders"), root)
    return columnar.read_parquet(spark, [root])


@query("SELECT *, p_brand AS class FROM part")
def partitioned_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "layout")
    parts = table(spark, sf_dir, "part").withColumn("class", F.col("p_brand"))
    write_per_class(parts, root, fmt="parquet")
    return spark.read.parquet(root)


@query("""
    SELECT NULL::VARCHAR AS note, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           o_orderpriority
    FROM orders
""")
def empty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a byte, without a row, and a folder without a file: each an empty table, united with
    one that has rows."""
    contract = Contract.of("orders", "note STRING, o_orderkey BIGINT")
    root, orders = scratch_path(spark, "empty"), table(spark, sf_dir, "orders")
    folders.make(spark, f"{root}/folder")
    write_csv(orders.select("o_orderkey").filter("o_orderkey IS NULL"), f"{root}/header")
    none = table(spark, sf_dir, "region").select(F.lit("orders.csv").alias("place"), F.lit("").alias("text"))
    _write_files(none.limit(1), f"{root}/bytes")
    parts = [delimited.read_csv(spark, [f"{root}/{name}"], contract) for name in ("folder", "header", "bytes")]
    return diagonal_union(*parts, orders)


@query("""
    SELECT c_custkey::BIGINT AS id, c_nationkey::VARCHAR AS code, c_acctbal AS balance, NULL::VARCHAR AS note
    FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey::VARCHAR, NULL, s_name FROM supplier
    UNION ALL SELECT p_partkey, p_brand, p_size::DOUBLE, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM part
""")
def parquet_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files of one table whose columns are of different types, or absent."""
    root = scratch_path(spark, "mixed")
    for name, source, columns in (
        ("a", "customer", ("c_custkey AS id", "c_nationkey AS code", "c_acctbal AS balance")),
        ("b", "supplier", ("s_name AS note", "CAST(s_suppkey AS INT) AS id", "CAST(s_nationkey AS BIGINT) AS code")),
        ("c", "part", ("p_size AS balance", "p_partkey AS id", "p_brand AS code", "p_size > 25 AS note")),
    ):
        write_parquet(table(spark, sf_dir, source).selectExpr(*columns), f"{root}/{name}/accounts.parquet")
    return columnar.read_parquet(spark, [root]).select("id", "code", "balance", "note")


def _write_archives(df: DataFrame, root: str, member: str) -> None:
    """Rows as CSV members of zip archives, one archive per batch of rows, written by the tasks. A
    retried task writes to a new name, and an archive counts only once it is named in the result."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, folder = fs.FileSystem.from_uri(root)
        filesystem.create_dir(folder)
        for rows in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(member, rows.to_csv(index=False))
            name = f"{uuid.uuid4().hex}.zip"
            with filesystem.open_output_stream(f"{folder}/{name}") as file:
                file.write(buffer.getvalue())
            yield pd.DataFrame({"name": [name]})

    return materialise(df.mapInPandas(write, "name string"), "archives")


@query("SELECT conv_id, turn, role, text FROM conversations")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations out of zip archives; every archive has the same member path."""
    contract = Contract.of("talks", "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    root = scratch_path(spark, "zips")
    talks = table(spark, sf_dir, "conversations").select("text", "role", "turn", "conv_id")
    written = _write_archives(talks, root, "export/talks.csv")
    members = archives.list_members(list_files(spark, [root]), [contract])
    members = members.withColumn("name", paths.file_name_of(F.col("archive_path")))
    members = materialise(members.join(written, "name", "left_semi"), "members")
    headers = materialise(read_heads(members).select("path", "header"), "headers")
    rows = delimited.bind(archives.read_members(members), headers, contract)
    return delimited.conform(delimited.refuse_ragged(rows), contract)


@query("""
    SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment,
           c_acctbal AS balance FROM customer
    UNION ALL
    SELECT s_suppkey, s_nationkey::BIGINT, NULL, s_acctbal FROM supplier
""")
def load_latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two directories; in one a newer Parquet table stands beside an older CSV of the same name, in the
    other a newer CSV beside an older Parquet table that could not be loaded."""
    contract = Contract.of(
        "accounts", "id BIGINT, nation BIGINT, note STRING, segment STRING, balance DOUBLE"
    )
    root = scratch_path(spark, "load-latest")
    accounts = _accounts(spark, sf_dir).withColumn("nation", F.col("nation").cast("bigint"))
    write_csv(accounts.withColumn("balance", F.lit(0.0)), f"{root}/a/accounts.csv")
    write_parquet(accounts, f"{root}/a/accounts.parquet")
    # Never opened: its columns are of other types.
    write_parquet(accounts.selectExpr("segment AS id", "id AS segment"), f"{root}/b/accounts.parquet")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal AS balance", "s_nationkey AS nation", "s_suppkey AS id"
    )
    write_csv(suppliers.unionAll(suppliers).repartition("id"), f"{root}/b/accounts.csv")
    return load_latest(spark, [root], contract)


# --- whole jobs ----------------------------------------------------------------------------------

_ACCOUNTS = Contract.of(
    "accounts",
    "class_id STRING, account_id BIGINT, balance DOUBLE, segment STRING, note STRING",
    keys=["account_id"],
)


def _write_drop(spark: SparkSession, sf_dir: str, root: str, first: bool) -> None:
    """Customers per nation. The first drop has no balances; the second has them, in another column
    order, but lacks households."""
    customers = table(spark, sf_dir, "customer")
    if first:
        rows = customers.selectExpr(
            "c_nationkey AS class_id", "c_custkey AS account_id", "0D AS balance", "c_mktsegment AS segment"
        )
    else:
        rows = customers.filter("c_mktsegment <> 'HOUSEHOLD'").selectExpr(
            "c_mktsegment AS segment", "c_acctbal AS balance", "c_nationkey AS class_id", "c_custkey AS account_id"
        )
    _write_parts(rows, f"{root}/drop={'first' if first else 'second'}/accounts.csv", "class_id")


_MERGED_ACCOUNTS = """
    SELECT c_nationkey::VARCHAR AS class_id, c_custkey AS account_id,
           CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE c_acctbal END AS balance,
           c_mktsegment AS segment, NULL::VARCHAR AS note
    FROM customer
"""


@query(_MERGED_ACCOUNTS)
def export_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drops of per-class exports merged by key; the newer file wins."""
    root, output = scratch_path(spark, "exports"), scratch_path(spark, "tables")
    for first in (True, False):
        _write_drop(spark, sf_dir, root, first)
    compress_exports(spark, [root], output, [_ACCOUNTS], policy="all")
    return read_table(spark, f"{output}/accounts")


@query("""
    SELECT DISTINCT 'first' AS dropped, c_nationkey::VARCHAR AS class_id, 'duplicate' AS outcome
    FROM customer
    WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
    UNION ALL
    SELECT DISTINCT 'first', c_nationkey::VARCHAR, 'load' FROM customer
    WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
    UNION ALL
    SELECT DISTINCT 'second', c_nationkey::VARCHAR, 'load'
    FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
""")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load report over the same two drops, under the policy that one file per class loads."""
    root = scratch_path(spark, "exports")
    for first in (True, False):
        _write_drop(spark, sf_dir, root, first)
    found = inspect(spark, [root], [_ACCOUNTS], policy="latest").report
    dropped = paths.partition_value(F.col("unit"), "drop").alias("dropped")
    return found.select(dropped, "class_id", "outcome")


@query("""
    SELECT c_nationkey::VARCHAR AS class_id,
      CASE WHEN bool_or(c_acctbal < -900) THEN 'rejected:ragged_row' ELSE 'load' END AS outcome
    FROM customer GROUP BY c_nationkey
""")
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class files in which a row about a large debt has text one, two or eleven cells past the header."""
    root = scratch_path(spark, "ragged")
    out = F.element_at(F.array(*[F.lit("," * n + "more") for n in (0, 1, 10)]), (F.col("c_custkey") % 3 + 1).cast("int"))
    more = F.when(F.col("c_acctbal") < -900, out)
    line = F.concat_ws(",", "c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment", more)
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("class"), F.lit(1).alias("rank"), line.alias("value")
    )
    header = F.lit("class_id,account_id,balance,segment").alias("value")
    heads = rows.select("class", F.lit(0).alias("rank"), header).distinct()
    lines = rows.unionAll(heads).repartition("class").sortWithinPartitions("class", "rank")
    lines.drop("rank").write.partitionBy("class").text(f"{root}/accounts.csv")
    return inspect(spark, [root], [_ACCOUNTS]).report.select("class_id", "outcome")


_LATEST_ACCOUNTS = """
    WITH kept AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
    SELECT c_nationkey::VARCHAR AS class_id, c_custkey AS account_id,
           CASE WHEN c_nationkey IN (SELECT c_nationkey FROM kept) THEN c_acctbal ELSE 0 END AS balance,
           c_mktsegment AS segment
    FROM customer
    WHERE c_mktsegment <> 'HOUSEHOLD' OR c_nationkey NOT IN (SELECT c_nationkey FROM kept)
"""


@query(_LATEST_ACCOUNTS)
def organize_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two drops laid out per class one after the other; the newest file of a class stays."""
    root, output = scratch_path(spark, "exports"), scratch_path(spark, "by-class")
    for first in (True, False):
        _write_drop(spark, sf_dir, root, first)
        organize_exports(spark, [root], output, [_ACCOUNTS])
    laid = spark.read.option("header", True).schema(_ACCOUNTS.schema).csv(f"{output}/accounts.csv")
    return laid.select("class_id", "account_id", "balance", "segment")


@query("""
    SELECT DISTINCT c_nationkey::VARCHAR AS nation,
      CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey::VARCHAR END AS class_id,
      CASE WHEN c_nationkey % 5 > 0 THEN 'load' ELSE 'rejected:no_class_id' END AS outcome
    FROM customer
""")
def fast_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a column of no contract load after the fast check, which wants a class only; the files
    of every fifth nation have none."""
    root = scratch_path(spark, "fast")
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_name AS holder",
        "CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS class_id",
        "c_custkey AS account_id",
        "c_nationkey AS class",
    )
    write_per_class(rows, f"{root}/accounts.csv")
    found = inspect(spark, [root], [_ACCOUNTS], validation="fast").report
    nation = paths.partition_value(F.concat("unit", F.lit("/")), "class").alias("nation")
    return found.select(nation, "class_id", "outcome")


_LEDGER = Contract.of("ledger", "class_id STRING, id BIGINT", keys=["id"])


@query("""
    SELECT DISTINCT 'accounts' AS type, c_nationkey::VARCHAR AS nation, 'load' AS outcome FROM customer
    UNION ALL
    SELECT CASE n_regionkey WHEN 3 THEN 'archive' ELSE 'ledger' END, n_nationkey::VARCHAR,
      CASE WHEN n_regionkey IN (1, 3) THEN 'rejected:unreadable' WHEN n_regionkey = 0 THEN 'load'
        ELSE 'rejected:empty' END
    FROM nation
""")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over sound exports beside files that are no Parquet, no archive, without a byte or a row."""
    root = scratch_path(spark, "unreadable")
    _write_parts(_as_exports(spark, sf_dir), f"{root}/accounts.csv", "class_id")
    region = F.col("n_regionkey")
    name = F.when(region == 1, "ledger.parquet").when(region == 3, "ledger.zip").otherwise("ledger.csv")
    text = F.when(region == 2, "").when(region == 4, "id,class_id\n").when(region == 0, F.concat(F.lit("id,class_id\n1,"), "n_nationkey"))
    files = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n="), "n_nationkey", F.lit("/"), name).alias("place"),
        F.coalesce(text, F.concat(F.lit("PK"), "n_name")).alias("text"),
    )
    _write_files(files, root)
    found = inspect(spark, [root], [_ACCOUNTS, _LEDGER]).report
    nation = paths.partition_value(F.concat("unit", F.lit("/")), "n")
    return found.select("type", F.coalesce(nation, "class_id").alias("nation"), "outcome")


def _as_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment AS segment", "c_acctbal AS balance", "c_nationkey AS class_id", "c_custkey AS account_id"
    )


_REGISTRY = Contract.of("registry", "class_id STRING, name STRING", keys=["class_id"], multi_class=True)


@query("""
    WITH registered AS (
      SELECT n_nationkey::VARCHAR AS class_id FROM nation WHERE n_regionkey <> 2
      UNION SELECT (100 + s_nationkey)::VARCHAR FROM supplier
    ), loaded AS (SELECT DISTINCT c_nationkey::VARCHAR AS class_id FROM customer WHERE c_nationkey % 3 > 0)
    SELECT class_id, 'registered_without_data' AS issue FROM registered ANTI JOIN loaded USING (class_id)
    UNION ALL
    SELECT class_id, 'data_without_entry' FROM loaded ANTI JOIN registered USING (class_id)
""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a registry without data files, and of data files without an entry."""
    root = scratch_path(spark, "orphans")
    _write_parts(_as_exports(spark, sf_dir).filter("class_id % 3 > 0"), f"{root}/accounts.csv", "class_id")
    nations = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").selectExpr("n_name AS name", "n_nationkey AS class_id")
    ghosts = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "100 + s_nationkey AS class_id")
    write_csv(nations.unionAll(ghosts), f"{root}/registry.csv")
    found = inspect(spark, [root], [_ACCOUNTS, _REGISTRY])
    return find_orphans(found, [_ACCOUNTS, _REGISTRY], "registry")


@query(f"""
    SELECT nation::VARCHAR AS nation, CASE WHEN n_regionkey = 0 THEN 'rejected:no_sibling_data'
      WHEN n_regionkey IN (1, 2) THEN 'rejected:no_sibling_data' ELSE 'load' END AS outcome,
      CASE WHEN n_regionkey > 2 THEN nation::VARCHAR END AS class_id
    FROM ({_OF_NATION}) JOIN nation ON n_nationkey = nation
""")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per nation with notes: beside no data, data of two classes, data and a file without a
    class, or data of one class, which alone makes the notes part of it."""
    root = scratch_path(spark, "attachments")
    nations = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    nations = nations.agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"))
    nations = nations.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("nation"))
    row = F.concat(F.lit("class_id,account_id\n"), "nation", F.lit(","), "least", F.lit("\n"))
    other = F.concat(F.lit("class_id,id\nother"), "nation", F.lit(","), "n", F.lit("\n"))
    files = [
        (F.lit("supplementary/notes.txt"), F.col("n_name"), F.lit(True)),
        (F.lit("accounts.csv"), row, F.col("n_regionkey") > 0),
        (F.lit("ledger.csv"), other, F.col("n_regionkey") == 1),
        (F.lit("registry.csv"), F.lit("class_id\n1\n"), F.col("n_regionkey") == 2),
    ]
    each = F.explode(F.array(*[F.when(c, F.struct(p.alias("p"), t.alias("t"))) for p, t, c in files])).alias("f")
    files = nations.select("nation", each).filter("f IS NOT NULL")
    place = F.concat(F.lit("n="), "nation", F.lit("/"), "f.p")
    _write_files(files.select(place.alias("place"), F.col("f.t").alias("text")), root)
    found = inspect(spark, [root], [_ACCOUNTS, _LEDGER, _REGISTRY]).report
    nation = paths.partition_value(F.col("unit"), "n").alias("nation")
    return found.filter("type = 'supplementary'").select(nation, "outcome", "class_id")


@query(_MERGED_ACCOUNTS)
def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two drops arrive one after the other and are merged by a file stream."""
    root, output = scratch_path(spark, "arrivals"), scratch_path(spark, "tables")
    checkpoint = scratch_path(spark, "stream")
    for first in (True, False):
        _write_drop(spark, sf_dir, root, first)
        merge_arrivals(spark, root, output, checkpoint, [_ACCOUNTS]).awaitTermination()
    return read_table(spark, f"{output}/accounts").select(_ACCOUNTS.names)
