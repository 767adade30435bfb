"""Operators on small frames: edge cases, laws on random tables, and the shape of plans."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import EXPORT_CONTRACTS, Contract
from tidemark.functions import paths
from tidemark.functions.casting import conform, parse_dates
from tidemark.operators import dedup, report, validate
from tidemark.operators.choose import latest_per_parent, newer_than_stored, one_file_per_key
from tidemark.operators.project import head_per_file, project
from tidemark.operators.union import diagonal_union, supertype
from tidemark.scratch import broadcast_if_small
from tidemark.sources import columnar

ROWS = "k1 string, k2 bigint, at bigint, v string"


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_contracts():
    widths = {c.name: len(c.names) for c in EXPORT_CONTRACTS}
    assert widths == {
        "manifest": 25, "classes": 8, "responses": 44, "media_views": 13, "page_views": 15,
        "tags": 3, "items": 20,
    }
    kinds = {f.dataType.simpleString() for c in EXPORT_CONTRACTS for f in c.schema}
    assert kinds == {"string", "bigint", "double", "boolean"}
    for c in EXPORT_CONTRACTS:
        assert set(c.keys) <= set(c.names) and len(set(c.names)) == len(c.names)
        assert bool(c.keys) != c.legacy


@pytest.mark.parametrize(
    "left, right, wide",
    [
        ("bigint", "string", "string"),
        ("boolean", "bigint", "bigint"),
        ("boolean", "double", "double"),
        ("bigint", "double", "double"),
        ("int", "bigint", "bigint"),
        ("int", "float", "double"),
        ("date", "timestamp_ntz", "timestamp_ntz"),
        ("double", "double", "double"),
        ("void", "bigint", "bigint"),
    ],
)
def test_supertype(spark, left, right, wide):
    kind = {k: spark.sql(f"SELECT CAST(NULL AS {k}) AS x").schema[0].dataType for k in (left, right)}
    assert supertype(kind[left], kind[right]).simpleString() == wide
    assert supertype(kind[right], kind[left]).simpleString() == wide


def test_supertype_without_common_type():
    with pytest.raises(TypeError, match="no common type"):
        supertype(T.LongType(), T.ArrayType(T.LongType()))


def test_union_is_associative_up_to_column_order(spark):
    a = spark.createDataFrame([(1, "x")], "a bigint, b string")
    b = spark.createDataFrame([("y", True)], "b string, c boolean")
    c = spark.createDataFrame([("z", 2)], "a string, c bigint")
    left, right = diagonal_union(diagonal_union(a, b), c), diagonal_union(a, diagonal_union(b, c))
    assert rows(left.select("a", "b", "c")) == rows(right.select("a", "b", "c"))
    assert rows(diagonal_union(a, b, c)) == rows(left)
    assert ("1", "x", None) in rows(left) and ("z", None, 2) in rows(left)


def test_project_and_conform(spark):
    contract = Contract.of("t", "a BIGINT, b STRING, c DOUBLE")
    df = spark.createDataFrame([("x", "1", 9)], "b string, a string, z bigint")
    assert project(df, contract).columns == ["a", "b"]
    assert conform(df, contract).schema == contract.schema
    assert rows(conform(df, contract)) == [(1, "x", None)]


def test_parse_dates(spark):
    texts = [("2024-02-03",), ("2024-02-03 04:05:06.789",), ("2024-02-03T04:05:06",), ("n/a",), (None,)]
    got = parse_dates(spark.createDataFrame(texts, "t string"), ["t"])
    assert got.dtypes == [("t", "timestamp_ntz")]
    assert [str(r.t) for r in got.collect()] == [
        "2024-02-03 00:00:00", "2024-02-03 04:05:06.789000", "2024-02-03 04:05:06", "None", "None",
    ]


def test_paths(spark):
    names = ["responses", "page_views"]
    cases = {
        "file:/x/c1/Responses.CSV": ("responses", "csv", "file:/x/c1", None),
        "/x/page_views.parquet": ("page_views", "parquet", "/x", None),
        "/x/responses.txt": ("responses", None, "/x", None),
        "/x/my_responses.csv": (None, "csv", "/x", None),
        "/x/responses.2.csv": (None, "csv", "/x", None),
        "/x/responses": ("responses", None, "/x", None),
        "/x/.csv": (None, None, "/x", None),
        "/x/responses.parquet/part-0.parquet": ("responses", "parquet", "/x", None),
        "/x/responses.csv/class=a/part-0.csv": ("responses", "csv", "/x", None),
        "/x/supplementary/a/b.txt": (None, None, "/x/supplementary/a", "/x"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    dataset = paths.dataset_of(F.col("path"))
    got = df.select(
        "path",
        paths.type_of(dataset, names),
        paths.format_of(dataset),
        paths.parent_of(dataset),
        paths.attached_to(F.col("path")),
    )
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == cases


def test_class_names_survive_the_layout(spark, folder):
    from tidemark.sinks.files import write_per_class
    from tidemark.sources.catalogue import list_files

    names = ["a b", "c+d", "e/f", "g%20h", "i=j", "ü"]
    df = spark.createDataFrame([(n, n) for n in names], "class_id string, class string")
    write_per_class(df, f"{folder}/t.csv")
    found = list_files(spark, [f"{folder}/t.csv"])
    got = found.select(paths.partition_value(F.col("path"), "class")).collect()
    assert sorted(r[0] for r in got) == sorted(names)


def test_columns_without_an_order_do_not_settle_ties(spark):
    df = spark.sql("SELECT 1 AS k, map('a', id) AS m, id % 3 AS at FROM range(3)")
    got = dedup.dedup_latest(df, ["k"], ["at"]).collect()
    assert [(r.k, r.m, r["at"]) for r in got] == [(1, {"a": 2}, 2)]


def test_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, "a"), (None, 1, 2, "b"), ("x", None, 1, "c"), ("x", None, 1, "c")], ROWS
    )
    assert rows(dedup.dedup_latest(df, ["k1", "k2"], ["at"])) == [
        ("x", None, 1, "c"), (None, 1, 2, "b"),
    ]
    assert dedup.dedup_any(df, ["k1", "k2"]).count() == 2
    assert dedup.distinct_rows(df).count() == 3
    new = spark.createDataFrame([(None, 1, 9, "new"), (None, None, 9, "new")], ROWS)
    merged = dedup.merge_keep_stored(dedup.dedup_any(df, ["k1", "k2"]), new, ["k1", "k2"])
    assert merged.filter("v = 'new'").select("k2").collect()[0].k2 is None and merged.count() == 3


ROW = st.tuples(
    st.sampled_from([None, "a", "b"]), st.sampled_from([None, 1, 2]), st.integers(0, 3), st.sampled_from("xyz")
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, max_size=12), st.lists(ROW, max_size=12))
def test_merge_laws(spark, old, fresh):
    keys = ["k1", "k2"]
    stored = dedup.dedup_latest(spark.createDataFrame(old, ROWS), keys, ["at"])
    new = spark.createDataFrame(fresh, ROWS)
    merged = dedup.merge_latest(stored, new, keys, ["at"])
    want = {}
    for row in old + fresh:
        best = want.setdefault(row[:2], row)
        want[row[:2]] = max(best, row, key=lambda r: r[2:])
    assert rows(merged) == sorted(want.values(), key=repr)
    assert rows(dedup.merge_latest(merged, new, keys, ["at"])) == rows(merged)
    shuffled = random.sample(old + fresh, len(old + fresh))
    assert rows(dedup.dedup_latest(spark.createDataFrame(shuffled, ROWS), keys, ["at"])) == rows(merged)

    kept = dedup.merge_keep_stored(stored, new, keys)
    assert rows(kept.select(*keys)) == sorted(want, key=repr)
    assert set(rows(stored)) <= set(rows(kept))
    assert rows(dedup.merge_keep_stored(kept, new, keys)) == rows(kept)


def test_hot_keys_shrink_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS at")
    latest = plan(dedup.dedup_latest(df, ["k"], ["at"])).split("== Physical Plan ==")[1]
    assert "partial_max" in latest.split("Exchange hashpartitioning", 1)[1]
    head = plan(head_per_file(df, "k", F.col("at"), 50)).split("== Physical Plan ==")[1]
    assert "row_number(), 50, Partial" in head.split("Exchange hashpartitioning", 1)[1]


def test_null_safe_merges_join_by_hash_or_sort(spark):
    a, b = (spark.createDataFrame([("x", 1, 1, "v")], ROWS) for _ in "ab")
    for hint in ("broadcast", "merge"):
        shape = plan(dedup.match_keys(a, b.hint(hint), ["k1", "k2"], "left_anti"))
        assert "NestedLoop" not in shape and "Cartesian" not in shape


def test_broadcast_needs_a_count(spark):
    small = broadcast_if_small(spark.range(5), max_rows=5)
    large = broadcast_if_small(spark.range(6), max_rows=5)
    assert "strategy=broadcast" in plan(spark.range(9).join(small, "id"))
    assert "strategy=broadcast" not in plan(spark.range(9).join(large, "id"))


def test_one_file_per_key(spark):
    files = spark.createDataFrame(
        [
            ("responses", "c1", 1, "a"), ("responses", "c1", 2, "b"), ("responses", None, 9, "c"),
            ("page_views", "c1", 1, "d"), ("classes", None, 1, "e"), ("classes", None, 2, "f"),
        ],
        "type string, class_id string, modified bigint, path string",
    )
    latest = one_file_per_key(files, [F.col("modified").desc(), F.col("path")], ["classes"])
    assert sorted(r.path for r in latest.collect()) == ["b", "d", "e", "f"]
    first = one_file_per_key(files, [F.col("path")], ["classes"])
    assert sorted(r.path for r in first.collect()) == ["a", "d", "e", "f"]


def test_latest_and_newer(spark):
    files = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "parent string, modified bigint, path string")
    assert sorted(r.path for r in latest_per_parent(files).collect()) == ["b", "c"]
    stored = spark.createDataFrame([("p", 2), ("q", 0)], "parent string, modified bigint")
    got = newer_than_stored(files, stored, "parent").select("path", "outcome")
    assert rows(got) == [("a", "skip"), ("b", "skip"), ("c", "replace")]


def test_checks(spark):
    data = [("f1", 1, "a"), ("f1", 2, None), ("f2", 1, "a"), ("f2", 2, "b"), ("f3", 1, None)]
    df = spark.createDataFrame(data, "file string, pos bigint, class_id string")
    assert rows(validate.single_id_check(df, "file").select("file", "class_id", "outcome")) == [
        ("f1", "a", "ok"), ("f2", None, "many_classes"), ("f3", None, "no_class_id"),
    ]
    assert rows(validate.first_id_check(df, "file", "pos", n=1)) == [("f1", "a"), ("f2", "a")]
    late = df.withColumn("pos", -F.col("pos"))
    assert rows(validate.first_id_check(late, "file", "pos", n=1)) == [("f2", "b")]


def test_siblings(spark):
    attached = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "parent string")
    siblings = spark.createDataFrame(
        [("p", "a", True), ("p", "a", False), ("q", "a", True), ("q", "b", True), ("r", "a", False)],
        "parent string, class_id string, live boolean",
    )
    kept = validate.attachments_with_siblings(attached, siblings, "parent", F.col("live"), "class_id")
    assert rows(kept) == [("p",)]


def test_reconcile_and_counts(spark):
    registry = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "class_id string")
    data = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "class_id string")
    assert rows(report.reconcile(registry, data)) == [
        ("a", "registered_without_data"), ("c", "data_without_entry"),
    ]
    assert rows(report.type_counts(registry, "class_id")) == [("a", 1), ("b", 2), (None, 1)]


def test_parquet_contract(spark, folder):
    contract = Contract.of("t", "a BIGINT, b STRING")
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{folder}/x")
    assert columnar.read_parquet(spark, [f"{folder}/x"], contract).schema == contract.schema
    with pytest.raises(columnar.UnknownColumns, match="a"):
        columnar.read_parquet(spark, [f"{folder}/x"], Contract.of("t", "b STRING"))
    assert columnar.empty(spark, contract).schema == contract.schema
