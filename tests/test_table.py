"""The stored table and the file stream."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import Contract
from tidemark.plans import table as t
from tidemark.plans.table import merge_into, read_table, version_of
from tidemark.streaming.arrivals import merge_arrivals

ROWS = "k bigint, at bigint, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_and_replay(spark, folder):
    path = f"{folder}/t"
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    assert version_of(spark, path) == 0
    merge_into(spark.createDataFrame([(1, 1, "a"), (1, 1, "a")], ROWS), path, ["k"], batch="b1")
    new = spark.createDataFrame([(1, 9, "no"), (2, 1, "b"), (None, 1, "n")], ROWS)
    assert merge_into(new, path, ["k"], batch="b2") == 2
    want = [(1, 1, "a"), (2, 1, "b"), (None, 1, "n")]
    assert rows(read_table(spark, path)) == want
    first = set(os.listdir(f"{path}/data"))
    assert merge_into(new, path, ["k"], batch="b2") == 2  # replayed: nothing happens
    assert set(os.listdir(f"{path}/data")) == first
    assert merge_into(new, path, ["k"], batch="b3") == 3  # merged again: no new rows
    assert rows(read_table(spark, path)) == want


def test_latest_keeps_untouched_rows(spark, folder):
    """Disjoint and overlapping keys: nothing stored is lost."""
    path = f"{folder}/t"
    merge_into(spark.range(100).selectExpr("id AS k", "5L AS at", "'old' AS v"), path, ["k"], ["at"])
    new = spark.range(90, 120).selectExpr("id AS k", "IF(id < 95, 9L, 1L) AS at", "'new' AS v")
    merge_into(new, path, ["k"], ["at"])
    got = read_table(spark, path)
    assert got.count() == 120 and got.select("k").distinct().count() == 120
    assert got.filter("v = 'new'").agg(F.min("k"), F.count("k")).first() == (90, 25)


def test_columns_are_added_and_widened(spark, folder):
    path = f"{folder}/t"
    merge_into(spark.createDataFrame([(1, 7)], "k bigint, x bigint"), path, ["k"])
    merge_into(spark.createDataFrame([(2, "new")], "k bigint, y string"), path, ["k"])
    assert rows(read_table(spark, path)) == [(1, 7, None), (2, None, "new")]
    merge_into(spark.createDataFrame([(3, "text")], "k bigint, x string"), path, ["k"])
    assert rows(read_table(spark, path)) == [(1, "7", None), (2, None, "new"), (3, "text", None)]


def test_a_failed_merge_leaves_the_table(spark, folder):
    path = f"{folder}/t"
    merge_into(spark.createDataFrame([(1, 1, "a")], ROWS), path, ["k"], ["at"])
    bad = spark.createDataFrame([(2, 1, "b")], ROWS).withColumn("v", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        merge_into(bad.withColumn("v", F.col("v").cast("string")), path, ["k"], ["at"])
    assert rows(read_table(spark, path)) == [(1, 1, "a")] and version_of(spark, path) == 1


def data_files(path):
    """Every data file with its time and content."""
    found = {}
    for folder, _, names in os.walk(f"{path}/data"):
        for name in names:
            if name.startswith("part-"):
                with open(f"{folder}/{name}", "rb") as file:
                    found[f"{folder}/{name}"] = (os.stat(file.fileno()).st_mtime_ns, file.read())
    return found


def test_small_files_become_few(spark, folder, monkeypatch):
    monkeypatch.setattr(t, "MAX_SMALL", 3)
    path = f"{folder}/t"
    for k in range(12):
        merge_into(spark.createDataFrame([(k, 1, "a")], ROWS), path, ["k"])
        assert len(t._current(spark, path).files) <= 5
    assert rows(read_table(spark, path)) == [(k, 1, "a") for k in sorted(range(12), key=lambda k: repr((k, 1, "a")))]


@pytest.fixture
def ranges(spark, folder, monkeypatch):
    """A table of 1,000 keys in several files, each with a range of its own."""
    monkeypatch.setattr(t, "SMALL_BYTES", 0)
    path = f"{folder}/t"
    for low in range(0, 1000, 250):
        some = spark.range(low, low + 250).selectExpr("id AS k", "5L AS at", "'old' AS v")
        merge_into(some, path, ["k"], ["at"])
    assert len(t._current(spark, path).files) >= 4
    return path


def test_only_files_with_contested_keys_are_rewritten(spark, ranges):
    before, old = data_files(ranges), t._current(spark, ranges)
    merge_into(spark.createDataFrame([(300, 9, "new"), (5000, 9, "new")], ROWS), ranges, ["k"], ["at"])
    now = t._current(spark, ranges)
    gone = {f.name for f in old.files} - {f.name for f in now.files}
    assert len(gone) == 1
    after = data_files(ranges)
    assert all(after[name] == content for name, content in before.items())  # kept versions read them
    got = read_table(spark, ranges)
    assert got.count() == 1001 and rows(got.filter("v = 'new'")) == [(300, 9, "new"), (5000, 9, "new")]
    # New keys alone change no file, under either rule; nor does an older row.
    for latest in (["at"], None):
        merge_into(spark.createDataFrame([(6000 + bool(latest), 1, "x")], ROWS), ranges, ["k"], latest)
        files = {f.name for f in t._current(spark, ranges).files}
        assert {f.name for f in now.files} <= files
    assert read_table(spark, ranges).count() == 1003


def test_files_out_of_range_are_not_read(spark, ranges, monkeypatch):
    files = t._current(spark, ranges).files
    fresh = spark.createDataFrame([(10, 1, "x"), (760, 1, "y")], ROWS)
    for most, want in ((10_000, {0, 3}), (1, {0, 1, 2, 3})):
        monkeypatch.setattr(t, "NAMED_KEYS", most)
        near = t._may_hold(files, fresh, ["k"])
        assert {int(f.low) // 250 for f in near} == want and (len(near) < len(files)) == (most > 1)
    fresh = spark.createDataFrame([(260, 1, "x"), (300, 1, "y")], ROWS)
    assert {int(f.low) // 250 for f in t._may_hold(files, fresh, ["k"])} == {1}
    assert t._may_hold(files, spark.createDataFrame([(None, 1, "x")], ROWS), ["k"]) == ()
    merge_into(spark.createDataFrame([(None, 1, "n")], ROWS), ranges, ["k"], ["at"])
    merge_into(spark.createDataFrame([(None, 2, "m")], ROWS), ranges, ["k"], ["at"])
    assert rows(read_table(spark, ranges).filter("k IS NULL")) == [(None, 2, "m")]


def test_ranges_of_text_and_other_keys(spark, folder, monkeypatch):
    monkeypatch.setattr(t, "SMALL_BYTES", 0)
    for kind, keys in (("string", ["a", "Z", "é", "x" * 500, ""]), ("double", [0.5, -1.0, 7.0, 1e300, 0.0])):
        path = f"{folder}/{kind}"
        for turn in range(2):
            for key in keys:
                merge_into(spark.createDataFrame([(key, turn)], f"k {kind}, at int"), path, ["k"], ["at"])
        got = read_table(spark, path).collect()
        assert len(got) == len(keys) and {r.k for r in got} == set(keys) and {r["at"] for r in got} == {1}


def test_two_writers_lose_nothing(spark, folder, monkeypatch):
    path = f"{folder}/t"
    merge_into(spark.createDataFrame([(0, 1, "a")], ROWS), path, ["k"], ["at"])
    write, waiting = t._write, [1]

    def slow(rows, *rest):
        if waiting:  # while the first merge writes, another one is committed
            waiting.pop()
            merge_into(spark.createDataFrame([(2, 1, "c"), (0, 3, "c")], ROWS), path, ["k"], ["at"])
        return write(rows, *rest)

    monkeypatch.setattr(t, "_write", slow)
    assert merge_into(spark.createDataFrame([(1, 1, "b"), (0, 2, "b")], ROWS), path, ["k"], ["at"]) == 3
    assert rows(read_table(spark, path)) == [(0, 3, "c"), (1, 1, "b"), (2, 1, "c")]
    # What the loser had written is gone: the files of the three versions are all there is.
    versions = [t.Version.load(t.folders.read_text(spark, t._commit_path(path, n))) for n in (1, 2, 3)]
    assert {n.split("/data/")[1] for n in data_files(path)} == {f.name for v in versions for f in v.files}


def test_many_writers_at_once(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{folder}/t"

    def write(k):
        some = spark.createDataFrame([(k, k, "own"), (-1, k, "shared")], ROWS)
        return merge_into(some, path, ["k"], ["at"], batch=f"b{k}")

    with ThreadPoolExecutor(6) as pool:
        assert sorted(pool.map(write, range(6))) == [1, 2, 3, 4, 5, 6]
    assert rows(read_table(spark, path)) == sorted([(k, k, "own") for k in range(6)] + [(-1, 5, "shared")], key=repr)
    assert merge_into(spark.createDataFrame([(9, 9, "x")], ROWS), path, ["k"], ["at"], batch="b3") == 6


def test_a_version_is_created_once(spark, folder):
    path = f"{folder}/commits/00000001.json"
    assert t.folders.create_text(spark, path, "one") and not t.folders.create_text(spark, path, "two")
    assert t.folders.read_text(spark, path) == "one" and os.listdir(f"{folder}/commits") == ["00000001.json"]
    assert t.folders.read_text(spark, f"{folder}/nothing") is None
    assert t.folders.names(spark, f"{folder}/nothing") == []


def test_disk_use_is_bounded(spark, folder):
    path, sizes = f"{folder}/t", []
    for turn in range(50):
        some = spark.range(40).selectExpr("id AS k", f"{turn}L AS at", "'x' AS v")
        merge_into(some, path, ["k"], ["at"], keep_versions=3)
        sizes.append(len(data_files(path)))
    assert max(sizes) <= 3 * len(t._current(spark, path).files) and len(os.listdir(f"{path}/data")) <= 3
    assert sorted(os.listdir(f"{path}/commits")) == [f"{n:08d}.json" for n in (48, 49, 50)]
    assert read_table(spark, path).filter("at = 49").count() == 40


def test_small_batches_are_broadcast(spark, folder):
    """A merge of few keys must not shuffle the stored rows."""
    path = f"{folder}/t"
    merge_into(spark.range(10_000).selectExpr("id AS k", "1L AS at", "'x' AS v"), path, ["k"], ["at"])
    stored = read_table(spark, path)
    fresh = t.materialise(spark.createDataFrame([(1, 2, "y")], ROWS), "fresh")
    shape = t.match_keys(stored, fresh, ["k"], "left_anti")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in shape and "Exchange hashpartitioning" not in shape


def test_stream(spark, folder, write):
    """Files with different headers, in several micro-batches; a restart merges what is new only."""
    contract = Contract.of("visits", "class_id STRING, id BIGINT, n BIGINT", keys=["id"])
    root, out, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"
    write(f"{root}/a[1]/visits.csv", "class_id,id,n\nc1,1,1\nc1,2,1\n", age=90)
    write(f"{root}/b/visits.csv", "n,id,class_id\n2,2,c1\n2,3,c1\n", age=50)

    def run():
        query = merge_arrivals(spark, root, out, checkpoint, [contract], max_files=1)
        query.awaitTermination()
        table = read_table(spark, f"{out}/visits")
        return version_of(spark, f"{out}/visits"), rows(table.select("id", "n"))

    assert run() == (2, [(1, 1), (2, 2), (3, 2)])
    write(f"{root}/c/visits.csv", "class_id,id\nc1,3\nc2,4\n", age=10)  # two classes: rejected
    write(f"{root}/d/visits.csv", "class_id,id,n\nc1,1,7\n", age=5)
    assert run() == (4, [(1, 7), (2, 2), (3, 2)])


def test_without_keys_rows_are_distinct(spark, folder):
    path = f"{folder}/t"
    some = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (None, 2, "b")], ROWS)
    merge_into(some, path, [])
    more = spark.createDataFrame([(1, 1, "a"), (None, 2, "b"), (1, 1, None)], ROWS)
    for _ in range(2):
        merge_into(more, path, [], ["at"])
    assert rows(read_table(spark, path)) == [(1, 1, "a"), (1, 1, None), (None, 2, "b")]


def test_a_crashed_commit_is_no_obstacle(spark, folder, write):
    path = f"{folder}/t"
    merge_into(spark.createDataFrame([(1, 1, "a")], ROWS), path, ["k"])
    write(f"{path}/commits/.00000002.json-0", '{"version":')
    os.makedirs(f"{path}/data/v00000002-0/_temporary/0")
    assert merge_into(spark.createDataFrame([(2, 1, "b")], ROWS), path, ["k"]) == 2
    assert rows(read_table(spark, path)) == [(1, 1, "a"), (2, 1, "b")]
