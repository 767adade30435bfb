"""Whole jobs on small exports: every case of the input layout."""

import os
import zipfile

import pytest
from conftest import new_folder, write_file
from pyspark.sql import functions as F

from tidemark.contracts import MEDIA_VIEWS
from tidemark.contracts import RESPONSES as RESPONSES_TABLE
from tidemark.plans.exports import (
    compress_exports,
    find_orphans,
    organize_exports,
    stored_classes,
)
from tidemark.plans.inspect import inspect
from tidemark.plans.table import read_table

RESPONSES = "class_id,student_id,item_id,lrn_question_position,dt_submitted,prompt,points_earned"


def outcomes(report, root):
    return {
        (r.unit.split(root, 1)[1].lstrip("/"), r.type): r.outcome
        for r in report.select("unit", "type", "outcome").collect()
    }


@pytest.fixture(scope="module")
def exports():
    root, write = f"{new_folder()}/in", write_file
    row = "{c},s{s},i1,1,2024-01-0{s},\"say \"\"hi\"\", then\nleave\",{p}\n"
    write(f"{root}/full/responses.csv", RESPONSES + "\n" + row.format(c="c1", s=1, p=3))
    write(
        f"{root}/reordered/Responses.CSV",
        "student_id,class_id,item_id,dt_submitted\ns2,c2,i9,2024-02-02\n",
    )
    write(f"{root}/extra/responses.csv", RESPONSES + ",bonus\nc3,s,i,1,d,p,1,x\n")
    write(f"{root}/two/responses.csv", RESPONSES + "\nc4,s,i,1,d,p,1\nc5,s,i,2,d,p,1\n")
    write(f"{root}/nulls/responses.csv", RESPONSES + "\n,s6,i,1,d6,p,1\nc6,s6,i,2,d6,p,1\n")
    write(f"{root}/noclass/responses.csv", "student_id,item_id\ns,i\n")
    write(f"{root}/header/responses.csv", RESPONSES + "\n")
    write(f"{root}/zero/responses.csv", "")
    write(
        f"{root}/late/page_views.csv",
        "class_id,student_id\n" + ",s\n" * 50 + "c7,s7\n",
    )
    write(f"{root}/suffix/responses.txt", RESPONSES + "\n")
    write(f"{root}/legacy/tags.csv", "tag_type,tag,item_id\na,b,c\n")
    write(f"{root}/legacy/items.csv", "class_id,item_id\nc1,i1\n")
    write(f"{root}/other/readme.csv", "a,b\n1,2\n")
    write(f"{root}/classes.csv", "class_id,book,release\nc1,b1,r1\nc2,b2,r2\nghost,b3,r3\n")
    media = "class_id,student_id,chapter,page,media_id,proportion_video,log_json\n"
    json = '"{""a"": [1, 2],\n""b"": ""x""}"'
    write(f"{root}/old/media_views.csv", media + f"c1,s1,ch,pg,m1,0.5,{json}\n", age=100)
    write(f"{root}/new/media_views.csv", media + f"c1,s1,ch,pg,m2,0.75,{json}\n", age=10)
    write(f"{root}/full/supplementary/notes.txt", "notes")
    write(f"{root}/alone/supplementary/notes.txt", "notes")
    return root


@pytest.fixture(scope="module")
def strict(spark, exports):
    return inspect(spark, [exports])


@pytest.fixture(scope="module")
def everything(spark, exports):
    return inspect(spark, [exports], policy="all")


def test_strict_report(strict, exports):
    got = outcomes(strict.report, exports)
    assert got == {
        ("full/responses.csv", "responses"): "load",
        ("reordered/Responses.CSV", "responses"): "load",
        ("extra/responses.csv", "responses"): "rejected:unknown_column",
        ("two/responses.csv", "responses"): "rejected:many_classes",
        ("nulls/responses.csv", "responses"): "load",
        ("noclass/responses.csv", "responses"): "rejected:no_class_id",
        ("header/responses.csv", "responses"): "rejected:empty",
        ("zero/responses.csv", "responses"): "rejected:empty",
        ("late/page_views.csv", "page_views"): "load",
        ("suffix/responses.txt", "responses"): "rejected:unknown_format",
        ("legacy/tags.csv", "tags"): "legacy",
        ("legacy/items.csv", "items"): "legacy",
        ("classes.csv", "classes"): "load",
        ("old/media_views.csv", "media_views"): "duplicate",
        ("new/media_views.csv", "media_views"): "load",
        ("full/supplementary/notes.txt", "supplementary"): "load",
        ("alone/supplementary/notes.txt", "supplementary"): "rejected:no_sibling_data",
    }


def test_fast_looks_at_first_rows_only(spark, exports):
    got = outcomes(inspect(spark, [exports], validation="fast").report, exports)
    assert got["late/page_views.csv", "page_views"] == "rejected:no_class_id"
    assert got["extra/responses.csv", "responses"] == "load"
    assert got["two/responses.csv", "responses"] == "load"


def test_orphans(strict):
    got = {tuple(r) for r in find_orphans(strict).collect()}
    assert got == {
        ("ghost", "registered_without_data"),
        ("c6", "data_without_entry"),
        ("c7", "data_without_entry"),
    }


def test_policy(spark, exports, everything):
    got = outcomes(inspect(spark, [exports], policy="first").report, exports)
    assert got["new/media_views.csv", "media_views"] == "load"  # "new" sorts before "old"
    got = outcomes(everything.report, exports)
    assert got["old/media_views.csv", "media_views"] == "load"


def test_compress(spark, exports, folder):
    out = f"{folder}/out"
    compress_exports(spark, [exports], out)
    responses = read_table(spark, f"{out}/responses")
    assert dict(responses.dtypes)["points_earned"] == "bigint"
    assert len(responses.columns) == 44
    rows = {r.student_id: r for r in responses.collect()}
    assert set(rows) == {"s1", "s2", "s6"}
    assert rows["s1"].prompt == 'say "hi", then\nleave'
    assert rows["s2"].item_id == "i9" and rows["s2"].points_earned is None
    assert responses.count() == 4
    media = read_table(spark, f"{out}/media_views").collect()
    assert [(r.media_id, r.proportion_video, r.log_json) for r in media] == [
        ("m2", 0.75, '{"a": [1, 2],\n"b": "x"}')
    ]
    assert read_table(spark, f"{out}/classes").count() == 3

    before = sorted(map(tuple, responses.collect()), key=str)
    compress_exports(spark, [exports], out)
    assert sorted(map(tuple, read_table(spark, f"{out}/responses").collect()), key=str) == before


def test_keep_latest_replaces_older_rows(spark, folder, write):
    head = "class_id,student_id,chapter,page,media_id,access_count\n"
    write(f"{folder}/b1/media_views.csv", head + "c,s,1,1,m1,1\nc,s,1,1,m2,1\n", age=100)
    write(f"{folder}/b2/media_views.csv", head + "c,s,1,1,m2,2\nc,s,1,1,m3,2\n", age=50)
    write(f"{folder}/b0/media_views.csv", head + "c,s,1,1,m1,9\n", age=500)
    for batch in ("b1", "b2", "b0"):
        compress_exports(spark, [f"{folder}/{batch}"], f"{folder}/out", keep="latest")
    got = {r.media_id: r.access_count for r in read_table(spark, f"{folder}/out/media_views").collect()}
    assert got == {"m1": 1, "m2": 2, "m3": 2}


def test_archives(spark, folder, write):
    """Twin archives hold the same member path; both are read, with quotes and line breaks."""
    os.makedirs(f"{folder}/in dir")
    body = RESPONSES + '\n{c},{s},i1,1,d,"a ""b"",\nc",\n'
    for name, c, s in (("a", "c1", "s1"), ("b", "c2", "s2")):
        with zipfile.ZipFile(f"{folder}/in dir/{name}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("x/responses.csv", body.format(c=c, s=s))
            archive.writestr("x/supplementary/deep/notes.txt", "n")
            archive.writestr("x/ignored.txt", "n")
    write(f"{folder}/in dir/loose+1/responses.csv", body.format(c="c3", s="s3"))
    report = compress_exports(spark, [f"{folder}/in dir"], f"{folder}/out")
    rows = read_table(spark, f"{folder}/out/responses").collect()
    assert {(r.class_id, r.student_id, r.prompt, r.points_earned) for r in rows} == {
        (f"c{i}", f"s{i}", 'a "b",\nc', None) for i in (1, 2, 3)
    }
    kept = report.filter("type = 'supplementary'").select("class_id", "outcome").collect()
    assert {tuple(r) for r in kept} == {("c1", "load"), ("c2", "load")}


def test_parquet_input(spark, folder, write):
    good = spark.createDataFrame(
        [("c1", "s1", "i", 3)], "class_id string, student_id string, item_id string, attempt int"
    )
    good.coalesce(1).write.parquet(f"{folder}/in/x/responses.parquet")
    good.withColumn("bonus", F.lit(1)).write.parquet(f"{folder}/in/y/responses.parquet")
    good.withColumn("attempt", F.lit("x")).write.parquet(f"{folder}/in/z/responses.parquet")
    report = compress_exports(spark, [f"{folder}/in"], f"{folder}/out")
    assert outcomes(report, f"{folder}/in") == {
        ("x/responses.parquet", "responses"): "load",
        ("y/responses.parquet", "responses"): "rejected:unknown_column",
        ("z/responses.parquet", "responses"): "rejected:wrong_type",
    }
    assert [r.attempt for r in read_table(spark, f"{folder}/out/responses").collect()] == [3]


def test_any_number_of_wrongly_typed_files(spark, folder):
    sql = "SELECT 'c1' AS class_id, 's1' AS student_id, '{0}' AS item_id, {1} AS attempt"
    good, wrong = f"{folder}/in/x/responses.parquet", f"{folder}/in/z/responses.parquet"
    for n in range(3):
        spark.sql(sql.format(n, "1L")).coalesce(1).write.mode("append").parquet(good)
    spark.sql(sql.format("i", "'x'")).coalesce(1).write.parquet(wrong)
    one = next(f for f in os.listdir(wrong) if f.endswith(".parquet"))
    for n in range(10_001):
        os.link(f"{wrong}/{one}", f"{wrong}/part-{n:05}.parquet")
    seen = inspect(spark, [f"{folder}/in"])
    assert outcomes(seen.report, f"{folder}/in") == {
        ("x/responses.parquet", "responses"): "load",
        ("z/responses.parquet", "responses"): "rejected:wrong_type",
    }
    rows = seen.rows(RESPONSES_TABLE).select("item_id", "attempt").collect()
    assert sorted(tuple(r) for r in rows) == [("0", "1"), ("1", "1"), ("2", "1")]


def test_rejects(spark, folder, write):
    head = "class_id,student_id,chapter,page,media_id,access_count\n"
    write(f"{folder}/in/media_views.csv", head + "c,s,1,1,m1,1\nc,s,1,1,m2,many\n")
    compress_exports(spark, [f"{folder}/in"], f"{folder}/out", rejects=f"{folder}/rejects")
    assert read_table(spark, f"{folder}/out/media_views").count() == 1
    bad = spark.read.parquet(f"{folder}/rejects/media_views").collect()
    assert [(r.media_id, r.access_count, r.failed_columns) for r in bad] == [
        ("m2", "many", ["access_count"])
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        compress_exports(spark, [f"{folder}/in"], f"{folder}/out2")


def test_organize(spark, exports, folder, write):
    out = f"{folder}/organized"
    organize_exports(spark, [exports], out)
    # Registries of several runs are merged.
    write(f"{folder}/more/classes.csv", "book,class_id\nb9,c9\nnew,c1\n", age=-1000)
    organize_exports(spark, [f"{folder}/more"], out)
    listed = spark.read.option("header", True).csv(f"{out}/classes.csv")
    assert {(r.class_id, r.book) for r in listed.collect()} == {
        ("c1", "new"), ("c2", "b2"), ("c9", "b9"), ("ghost", "b3"),
    }
    classes = {r.class_id for r in stored_classes(spark, f"{out}/responses.csv").collect()}
    assert classes == {"c1", "c2", "c6"}
    # The layout is valid input again: part files in a class directory are one file.
    again = inspect(spark, [out]).report
    assert {r.outcome for r in again.collect()} == {"load"}
    assert again.filter("type = 'responses'").count() == 3
    # A second run over the same, now older, input replaces nothing.
    before = stored_classes(spark, f"{out}/responses.csv").collect()
    organize_exports(spark, [exports], out)
    assert sorted(stored_classes(spark, f"{out}/responses.csv").collect()) == sorted(before)


def test_many_files_go_by_buckets(spark, exports, everything, monkeypatch):
    """More files than may be broadcast at once: same report, same rows."""
    whole = everything
    monkeypatch.setattr("tidemark.sources.delimited.BROADCAST_ROWS", 9)
    split = inspect(spark, [exports], policy="all")
    assert split.staged["responses"].select("bucket").distinct().count() > 1
    assert outcomes(split.report, exports) == outcomes(whole.report, exports)
    for contract in (RESPONSES_TABLE, MEDIA_VIEWS):
        rows = [sorted(map(tuple, i.rows(contract).collect()), key=repr) for i in (whole, split)]
        assert rows[0] == rows[1] and rows[0]


def test_files_with_ragged_rows_are_rejected(spark, folder, write):
    head = "class_id,student_id,chapter,page,media_id,access_count\n"
    write(f"{folder}/a/media_views.csv", head + "c1,s,1,1,m1,1\nc1,s,1,1,m2,1,more\n")
    write(f"{folder}/b/media_views.csv", head + "c2,s,1,1,m1,1\nc2,s,1,1,m2,\n")
    for validation in ("strict", "fast"):
        found = inspect(spark, [folder], validation=validation)
        got = {r.unit.rsplit("/", 2)[1]: r.outcome for r in found.report.collect()}
        assert got == {"a": "rejected:ragged_row", "b": "load"}
        assert found.rows(MEDIA_VIEWS).count() == 2


def test_organize_decides_per_class(spark, folder, write):
    head = "class_id,student_id,chapter,page,media_id,access_count\n"
    write(f"{folder}/in/x/media_views.csv", head + "c1,s,1,1,m1,1\n", age=100)
    organize_exports(spark, [f"{folder}/in"], f"{folder}/out", policy="all")
    write(f"{folder}/in/y/media_views.csv", head + "c1,s,1,1,m2,1\n", age=-10**9)
    report = organize_exports(spark, [f"{folder}/in"], f"{folder}/out", policy="all")
    assert {r.outcome for r in report.collect()} == {"load"}
    laid = spark.read.option("header", True).csv(f"{folder}/out/media_views.csv")
    assert sorted(r.media_id for r in laid.collect()) == ["m1", "m2"]
    os.utime(f"{folder}/in/y/media_views.csv", (1_000_000_000,) * 2)
    report = organize_exports(spark, [f"{folder}/in"], f"{folder}/out", policy="all")
    assert {r.outcome for r in report.collect()} == {"skip"}


def test_rejects_of_several_batches(spark, folder, write):
    head = "class_id,student_id,chapter,page,media_id,access_count\n"
    write(f"{folder}/in/media_views.csv", head + "c,s,1,1,m2,many\n")
    for batch in ("one", "two", "two"):
        compress_exports(
            spark, [f"{folder}/in"], f"{folder}/out", rejects=f"{folder}/rejects", batch=batch
        )
    assert spark.read.parquet(f"{folder}/rejects/media_views").count() == 2
