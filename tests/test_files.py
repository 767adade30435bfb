"""Heads, damaged and empty files, Parquet files of different types, and what scans leave unopened."""

import io
import os
import struct
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.contracts import MEDIA_VIEWS, Contract
from tidemark.plans import inspect as plan
from tidemark.plans.exports import compress_exports, find_orphans, organize_exports
from tidemark.plans.inspect import inspect
from tidemark.plans.load import load_latest
from tidemark.plans.table import read_table
from tidemark.sources import archives, columnar, delimited, heads, storage
from tidemark.sources.catalogue import list_files

HEAD = "class_id,student_id,chapter,page,media_id,access_count\n"
VISITS = Contract.of("visits", "class_id STRING, id BIGINT, n DOUBLE, note STRING", keys=["id"])


def outcomes(report, root):
    return {r.unit.split(root, 1)[1].lstrip("/"): r.outcome for r in report.collect()}


class Counted(io.BytesIO):
    """Counts the bytes that were asked for."""

    taken = 0

    def read(self, size=-1):
        data = super().read(size)
        self.taken += len(data)
        return data

    read1 = read

    def size(self):
        return len(self.getvalue())

    def read_at(self, size, place):
        self.taken += size
        return self.getvalue()[place : place + size]


def test_heads_do_not_read_bodies():
    taken = []
    for rows in (10, 200_000):
        stream = Counted(b'\xef\xbb\xbf"a","class_id"\n\n' + b'"x\n""y""",c1\n' * rows)
        assert heads.csv_head(stream, "class_id", 5) == (["a", "class_id"], 5, "c1")
        taken.append(stream.taken)
    assert taken[1] <= 3 * 8192
    taken = []
    for rows in (10, 500_000):
        sink = io.BytesIO()
        pq.write_table(pa.table({"class_id": [f"c{i}" for i in range(rows)]}), sink, use_dictionary=False)
        file = Counted(sink.getvalue())
        assert heads.parquet_head(file, "class_id", 0) == (["class_id"], ["string"], 1, None)
        taken.append(file.taken)
    assert taken[1] < taken[0] + 200


def test_heads_of_odd_files():
    def head(text, rows=50):
        return heads.csv_head(io.BytesIO(text), "id", rows)

    assert head(b"") == (None, 0, None) and head(b"\n \n") == ([""], 0, None)
    assert head(b"id\n") == (["id"], 0, None)
    assert head(b"a,id\r\n1\r\n2,\r\n3,x\r\n", 2) == (["a", "id"], 2, None)
    assert head(b"a,id\r\n1\r\n2,\r\n3,x\r\n", 3) == (["a", "id"], 3, "x")
    assert head(b"\xff\xfe,id\n1,2\n")[2] == "2"
    for broken in (b"", b"PAR1", b"x" * 100, b"x" * 50 + struct.pack("<i", 40) + b"PAR1"):
        with pytest.raises(heads.BROKEN):
            heads.parquet_head(Counted(broken), "id", 0)


def test_paths_of_any_name(spark, folder, write):
    names = ["a b+c%41é[1]{2}#?.csv", "x.csv"]
    for name in names:
        write(f"{folder}/d é/{name}", "id\n1\n")
    write(f"{folder}/d é/zero%é.csv", "")
    files = list_files(spark, [folder]).collect()
    assert sorted(f.size for f in files) == [0, 5, 5] and [f.modified for f in files if not f.size] == [None]
    for f in files:
        with storage.open_file(f.path) as file:
            assert file.size() == f.size
    with pytest.raises(ValueError, match="viewfs"):
        storage.open_file("viewfs://store/x")
    for path, want in (("s3a://b/x%20y", "s3"), ("wasb://b/x", None)):
        assert storage.SCHEMES.get(path.split(":")[0]) == want


def test_unreadable_and_empty_input_is_reported(spark, folder, write):
    root = f"{folder}/in é"
    write(f"{root}/good/media_views.csv", HEAD + "c1,s,1,1,m1,1\n")
    write(f"{root}/zero/media_views.csv", "")
    write(f"{root}/blank/media_views.csv", "\n\n")
    write(f"{root}/head/media_views.csv", HEAD)
    write(f"{root}/garbage/media_views.parquet", "no parquet at all")
    write(f"{root}/cut/media_views.parquet", "PAR1")
    write(f"{root}/broken.zip", "no zip")
    write(f"{root}/zero.zip", "")
    fine = spark.createDataFrame([("c2", "m2")], "class_id string, media_id string")
    fine.coalesce(1).write.parquet(f"{root}/fine/media_views.parquet")
    body = HEAD + "c3,s,1,1,m3,1\n" * 20_000
    with zipfile.ZipFile(f"{root}/half.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("fine/media_views.csv", HEAD + "c4,s,1,1,m4,1\n")
        archive.writestr("bad/media_views.csv", body)
        archive.writestr("none/media_views.csv", "")
        place = archive.getinfo("bad/media_views.csv").header_offset
    with open(f"{root}/half.zip", "r+b") as file:
        file.seek(place + 150)
        file.write(b"\xff" * 40)
    for validation in ("strict", "fast"):
        got = outcomes(inspect(spark, [root], validation=validation).report, "in%20é")
        got = got or outcomes(inspect(spark, [root], validation=validation).report, "in%20%C3%A9")
        assert got == {
            "good/media_views.csv": "load",
            "fine/media_views.parquet": "load",
            "zero/media_views.csv": "rejected:empty",
            "blank/media_views.csv": "rejected:empty",
            "head/media_views.csv": "rejected:empty",
            "garbage/media_views.parquet": "rejected:unreadable",
            "cut/media_views.parquet": "rejected:unreadable",
            "broken.zip": "rejected:unreadable",
            "half.zip!/fine/media_views.csv": "load",
            "half.zip!/bad/media_views.csv": "rejected:unreadable",
            "half.zip!/none/media_views.csv": "rejected:empty",
        }
    compress_exports(spark, [root], f"{folder}/out")
    assert sorted(r.media_id for r in read_table(spark, f"{folder}/out/media_views").collect()) == ["m1", "m2", "m4"]


def test_ragged_text_is_found_however_far_out(spark, folder, write):
    cases = {
        "one": "c1,s,1,1,m1,1,more\n",
        "two": "c1,s,1,1,m1,1,,more\n",
        "ten": "c1,s,1,1,m1,1,,,,,,,,,,more\n",
        "quoted": 'c1,s,1,1,"m,1",1,,"a, b\n""c"""\n',
        "short": "c1\n",
        "commas": 'c1,"a,b,c,d,e,f,g,h,i,j,k"\n',
        "nothing": 'c1,s,1,1,m1,1,,,,"",,\n',
    }
    for name, row in cases.items():
        write(f"{folder}/in/{name}/media_views.csv", HEAD + "c1,s,1,1,m0,1\n" + row)
        with zipfile.ZipFile(f"{folder}/in/{name}.zip", "w") as archive:
            archive.writestr(f"{name}/media_views.csv", HEAD + "c1,s,1,1,m0,1\n" + row)
    got = outcomes(inspect(spark, [f"{folder}/in"], policy="all").report, "/in")
    want = {name: "rejected:ragged_row" if name in ("one", "two", "ten", "quoted") else "load" for name in cases}
    assert got == {f"{n}/media_views.csv": o for n, o in want.items()} | {
        f"{n}.zip!/{n}/media_views.csv": o for n, o in want.items()
    }
    contract = Contract.of("t", "id BIGINT, text STRING")
    write(f"{folder}/t/t.csv", "id,text\n1,a,,EXTRA\n")
    with pytest.raises(Exception, match="more cells than the header"):
        delimited.read_csv(spark, [f"{folder}/t"], contract).collect()
    write(f"{folder}/u/t.csv", "id,other,text,note\n1,a,b,,,,,\n2,a,b,,,EXTRA\n")
    rows = delimited.read_csv(spark, [f"{folder}/u"], contract, lenient=True)
    assert sorted(map(tuple, rows.collect())) == [(1, "b"), (2, "b")]
    with pytest.raises(Exception, match="more cells than the header"):
        delimited.read_csv(spark, [f"{folder}/u"], contract).count()


def test_what_heads_rule_out_is_not_scanned(spark, folder, write, monkeypatch):
    scanned = []
    read = delimited.positional_rows

    def watched(*args, **options):
        rows = read(*args, **options)
        scanned.append({r.path.rsplit("/", 2)[1] for r in rows.select("path").distinct().collect()})
        return rows

    monkeypatch.setattr(delimited, "positional_rows", watched)
    write(f"{folder}/none/media_views.csv", HEAD + ",s,1,1,m1,1\n" * 60 + "c1,s,1,1,m2,1\n")
    write(f"{folder}/some/media_views.csv", HEAD + ",s,1,1,m1,1\n" * 49 + "c1,s,1,1,m2,1\n")
    write(f"{folder}/extra/media_views.csv", "class_id,bonus\nc2,1\n")
    got = outcomes(inspect(spark, [folder], validation="fast").report, folder)
    assert got == {
        "none/media_views.csv": "rejected:no_class_id",
        "some/media_views.csv": "load",
        "extra/media_views.csv": "load",
    }
    inspect(spark, [folder])
    assert scanned == [{"some", "extra"}, {"none", "some"}]


def test_one_listing_and_one_scan_for_all_tables(spark, folder, write, monkeypatch):
    for n in range(6):
        write(f"{folder}/{n}/media_views.csv", HEAD + f"c{n},s,1,1,m1,1\n")
        write(f"{folder}/{n}/page_views.csv", f"class_id,student_id\nc{n},s\n")
        write(f"{folder}/{n}/responses.csv", f"student_id,class_id\ns,c{n}\n")
    calls = []
    listed, scanned = plan.list_files, delimited.positional_rows
    monkeypatch.setattr(plan, "list_files", lambda *a: calls.append("list") or listed(*a))
    monkeypatch.setattr(delimited, "positional_rows", lambda *a: calls.append("scan") or scanned(*a))
    reports = []
    for most in (200_000, 5):
        monkeypatch.setattr("tidemark.sources.delimited.BROADCAST_ROWS", most)
        found = inspect(spark, [folder])
        reports.append(sorted(map(tuple, found.report.collect()), key=repr))
        assert found.rows(MEDIA_VIEWS).count() == 6
    assert calls == ["list", "scan"] * 2 and reports[0] == reports[1] and len(reports[0]) == 18


def test_parquet_files_of_different_types(spark, folder):
    def write(name, table):
        os.makedirs(f"{folder}/{name}", exist_ok=True)
        pq.write_table(table, f"{folder}/{name}/visits.parquet")

    write("a [1]", pa.table({"id": pa.array([1], pa.int32()), "n": pa.array([1], pa.int64())}))
    write("b", pa.table({"n": pa.array([0.5], pa.float64()), "id": pa.array([2**40], pa.int64())}))
    write("c", pa.table({"id": pa.array([3], pa.int8()), "note": pa.array(["x"]).dictionary_encode()}))
    write("d", pa.table({"id": pa.array([None], pa.int64()), "note": pa.array([True])}))
    rows = columnar.read_parquet(spark, [folder])
    assert dict(rows.dtypes) == {"id": "bigint", "n": "double", "note": "string"}
    want = [(1, 1.0, None), (2**40, 0.5, None), (3, None, "x"), (None, None, "true")]
    assert sorted(map(tuple, rows.select("id", "n", "note").collect()), key=repr) == sorted(want, key=repr)
    typed = columnar.read_parquet(spark, [folder], VISITS)
    assert typed.columns == VISITS.names and typed.count() == 4
    with pytest.raises(columnar.UnknownColumns):
        columnar.read_parquet(spark, [folder], Contract.of("visits", "id BIGINT"))


def test_partitioned_parquet_keeps_its_partitions(spark, folder):
    spark.range(4).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(f"{folder}/t")
    spark.range(4, 6).selectExpr("cast(id AS int) AS id", "id % 2 AS k").write.mode("append").partitionBy("k").parquet(f"{folder}/t")
    rows = columnar.read_parquet(spark, [f"{folder}/t"])
    assert sorted(map(tuple, rows.select("id", "k").collect())) == [(i, i % 2) for i in range(6)]


def test_files_that_were_not_chosen_are_not_opened(spark, folder, write):
    write(f"{folder}/a/visits.csv", "id,n\n1,0.5\n1,0.5\n", age=10)
    wrong = spark.createDataFrame([("x",)], "id string")
    wrong.coalesce(1).write.parquet(f"{folder}/a/visits.parquet")
    for file in os.listdir(f"{folder}/a/visits.parquet"):
        os.utime(f"{folder}/a/visits.parquet/{file}", (1_000_000_000,) * 2)
    spark.createDataFrame([(2,)], "id bigint").coalesce(1).write.parquet(f"{folder}/b/visits.parquet")
    write(f"{folder}/b/visits.csv", "garbage,n\n1,2,3\n", age=10**8)
    write(f"{folder}/c/visits.csv", "", age=0)
    got = load_latest(spark, [folder], VISITS)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 0.5), (2, None)] and got.columns == ["id", "n"]
    write(f"{folder}/d/visits.parquet", "garbage")
    with pytest.raises(ValueError, match="not a readable visits file"):
        load_latest(spark, [folder], VISITS)
    only = load_latest(spark, [f"{folder}/c"], VISITS)
    assert only.count() == 0


def test_loose_and_zipped_copies_give_equal_rows(spark, folder, write):
    body = 'id,note\n1,"a ""b"",\nc"\n2,\n\n3,""\n4, x \n5,é"q\n6\n'
    write(f"{folder}/loose/t.csv", body)
    with zipfile.ZipFile(f"{folder}/t.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("t.csv", "\ufeff" + body)
    contract = Contract.of("t", "id BIGINT, note STRING")
    loose = delimited.read_csv(spark, [f"{folder}/loose"], contract)
    members = archives.list_members(list_files(spark, [folder]), [contract])
    found = heads.read_heads(members).select("path", "header")
    zipped = delimited.bind(archives.read_members(members), found.cache(), contract)
    zipped = delimited.conform(delimited.refuse_ragged(zipped), contract)
    assert sorted(map(tuple, zipped.collect())) == sorted(map(tuple, loose.collect()))
    assert loose.count() == 6


def test_attachments_beside_files_without_a_class(spark, folder, write):
    for name in ("plain", "legacy", "registry", "mixed", "broken"):
        write(f"{folder}/{name}/media_views.csv", HEAD + f"{name},s,1,1,m1,1\n")
        write(f"{folder}/{name}/supplementary/notes.txt", "n")
    write(f"{folder}/legacy/tags.csv", "tag_type,tag,item_id\na,b,c\n")
    write(f"{folder}/registry/classes.csv", "class_id\nregistry\n")
    write(f"{folder}/mixed/page_views.csv", "class_id,student_id\nother,s\n")
    write(f"{folder}/broken/page_views.csv", "student_id\ns\n")
    found = inspect(spark, [folder])
    kept = found.report.filter("type = 'supplementary' AND outcome = 'load'")
    assert {r.class_id for r in kept.collect()} == {"plain", "broken"}
    issues = {tuple(r) for r in find_orphans(found).collect()}
    assert ("plain", "data_without_entry") in issues and len(issues) == 5


def test_organize_compares_times_of_sources(spark, folder, write):
    def ids():
        laid = spark.read.option("header", True).csv(f"{folder}/out/media_views.csv")
        return sorted(r.media_id for r in laid.collect())

    write(f"{folder}/in/x/media_views.csv", HEAD + "c1,s,1,1,m1,1\nc1,s,1,1,m2,1\n", age=1000)
    organize_exports(spark, [f"{folder}/in"], f"{folder}/out")
    assert ids() == ["m1", "m2"]
    # Newer than what was loaded, though older than the moment of loading.
    write(f"{folder}/in/y/media_views.csv", HEAD + "c1,s,1,1,m3,1\n", age=500)
    write(f"{folder}/in/z/media_views.csv", HEAD + "c2,s,1,1,m4,1\n", age=900)
    organize_exports(spark, [f"{folder}/in"], f"{folder}/out")
    assert ids() == ["m3", "m4"]
    write(f"{folder}/late/media_views.csv", HEAD + "c1,s,1,1,m5,1\n", age=700)
    write(f"{folder}/late/q/media_views.csv", HEAD + "c2,s,1,1,m6,1\n", age=800)
    report = organize_exports(spark, [f"{folder}/late"], f"{folder}/out")
    assert {r.class_id: r.outcome for r in report.collect()} == {"c1": "skip", "c2": "load"}
    assert ids() == ["m3", "m6"]
