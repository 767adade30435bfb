import csv
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import Contract
from tidemark.functions.casting import split_failed
from tidemark.sources import delimited
from tidemark.sources.catalogue import list_files, may_be_file_of

CONTRACT = Contract.of("t", "id BIGINT, text STRING, flag BOOLEAN, ratio DOUBLE, note STRING")


def _odd_text(rng, n):
    return "".join(rng.choice(['"', ",", "\n", "x", "é", " ", "id", '""', "\n\n", "\r\n"]) for _ in range(n))


def _write_random(path, rng, columns, rows, line_end="\n"):
    made = []
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=line_end)
        writer.writerow(columns)
        for _ in range(rows):
            row = {
                "id": rng.randrange(10**9),
                "text": _odd_text(rng, rng.randrange(1, 30)),
                "note": rng.choice([None, "plain", _odd_text(rng, 5)]),
                "ratio": rng.choice([None, rng.random()]),
                "flag": rng.choice([None, True, False]),
            }
            made.append(tuple(row.get(c) if c in columns else None for c in CONTRACT.names))
            writer.writerow(["" if row[c] is None else row[c] for c in columns])
    return made


def test_matches_the_csv_module(spark, folder):
    """Different headers, any text, whatever the size of splits: as Python's reader has it."""
    rng, made = random.Random(5), []
    for i, columns in enumerate([["id", "text", "note"], ["note", "ratio", "text", "flag", "id"]]):
        made += _write_random(f"{folder}/{i}.csv", rng, columns, 300)
    try:
        # Small splits, which records would run over.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = delimited.read_csv(spark, [folder], CONTRACT).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, rows), key=repr) == sorted(made, key=repr)


def test_windows_line_ends(spark, folder):
    made = _write_random(f"{folder}/a.csv", random.Random(6), ["id", "ratio", "flag"], 100, "\r\n")
    rows = delimited.read_csv(spark, [folder], CONTRACT).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(made, key=repr)


def test_ragged_rows_are_not_cut(spark, folder, write):
    write(f"{folder}/a.csv", "id,text\n1,a,EXTRA\n2,b,\n3\n")
    write(f"{folder}/b.csv", "text,id,note\nc,4,n\n")
    with pytest.raises(Exception, match="more cells than the header"):
        delimited.read_csv(spark, [folder], CONTRACT).collect()
    with pytest.raises(Exception, match="more cells than the header"):
        delimited.read_csv(spark, [folder], CONTRACT).count()
    rows = delimited.read_csv(spark, [folder], CONTRACT, lenient=True).select("id", "text", "note")
    assert sorted(map(tuple, rows.collect())) == [(1, "a", None), (2, "b", None), (3, None, None), (4, "c", "n")]


def test_stray_quotes_do_not_depend_on_splits(spark, folder, write):
    write(f"{folder}/t.csv", 'id,text\n1,5" pipe\n2,x\n3,y\n')
    got = []
    for size in ("8", "1000000"):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = delimited.read_csv(spark, [folder], CONTRACT).select("id", "text").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got.append(sorted(map(tuple, rows)))
    assert got == [[(1, '5" pipe'), (2, "x"), (3, "y")]] * 2


def test_wide_headers_outside_the_contract(spark, folder, write):
    junk = ",".join(f"j{i}" for i in range(21_000))
    write(f"{folder}/wide.csv", f"id,{junk}\n1,{junk}\n")
    write(f"{folder}/t.csv", "text,id\nx,2\n")
    rows = delimited.positional_rows(spark, [folder], 3, lambda path: path.endswith("/t.csv"))
    assert rows.count() == 1
    headers = delimited.read_headers(spark, [folder])
    assert delimited.reach(headers, CONTRACT) == 2


def test_headers(spark, folder, write):
    write(f"{folder}/plain/t.csv", "id,text\n1,id\n")
    write(f"{folder}/quoted bom/t.csv", '﻿"id","flag"\r\n1,true\r\n')
    write(f"{folder}/blank/t.csv", "\n\nid,note\n")
    write(f"{folder}/unknown/t.csv", "id,bonus\nid,text\n")
    known = delimited.read_headers(spark, [folder], names=CONTRACT.names)
    got = {r.path.rsplit("/", 2)[1]: r.header for r in known.collect()}
    want = {"plain": ["id", "text"], "quoted%20bom": ["id", "flag"], "blank": ["id", "note"]}
    assert got == {**want, "unknown": None}
    anything = delimited.read_headers(spark, [folder])
    got = {r.path.rsplit("/", 2)[1]: r.header for r in anything.collect()}
    assert got == {**want, "unknown": ["id", "bonus"]}


def test_other_files_are_not_opened(spark, folder, write):
    for i in range(20):
        write(f"{folder}/{i}/{'t' if i == 7 else 'other'}.csv", "id\n1\n")
    rows = delimited.positional_rows(spark, [folder], 1, lambda path: path.endswith("/t.csv"))
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 1


def test_no_rows(spark, folder, write):
    write(f"{folder}/t.csv", "id,text\n")
    table = delimited.read_csv(spark, [folder], CONTRACT)
    assert table.schema == CONTRACT.schema and table.count() == 0


def test_distinct_read(spark, folder, write):
    write(f"{folder}/a.csv", "id,text\n1,a\n1,a\n")
    write(f"{folder}/b.csv", "text,id\na,1\nb,2\n")
    assert delimited.read_distinct(spark, [folder], CONTRACT).count() == 2


def test_lenient_keeps_every_row(spark):
    texts = spark.createDataFrame([("1", "x"), ("one", "x"), (None, "x")], "id string, ratio string")
    good, bad = split_failed(texts.withColumn("ratio", F.lit("0.5")), CONTRACT)
    assert sorted(r.id or 0 for r in good.collect()) == [0, 1] and good.schema == CONTRACT.schema
    assert [(r.id, r.failed_columns) for r in bad.collect()] == [("one", ["id"])]


def test_row_filters_are_plain(spark, folder, write):
    """Spark repeats the path condition on every row, so it must not hold regular expressions."""
    write(f"{folder}/t.csv", "id\n1\n")
    rows = delimited.positional_rows(
        spark, [folder], 1, lambda path: may_be_file_of(path, [CONTRACT], "csv")
    )
    assert "regexp" not in rows._jdf.queryExecution().toString() and rows.count() == 1


def _odd_heads(folder, write):
    """Files whose first lines are told in all ways, and what these are."""
    write(f"{folder}/plain/t.csv", "id,text\n1,id\n")
    write(f"{folder}/quoted bom/T.CSV", '﻿"id","flag" \r\n1,true\r\n')
    write(f"{folder}/old line ends/t.csv", "\r\rnote,id\rx,1\r")
    write(f"{folder}/many/t.csv", "\n" * 12_000 + "ratio,id\n" + "id,text\n" * 25_000)
    write(f"{folder}/no end/t.csv", "id,bonus")
    write(f"{folder}/other name/t.txt", "\nid,note\n1,x\n")
    write(f"{folder}/blank/t.csv", "\n\n")
    write(f"{folder}/nothing/t.csv", "")
    os.makedirs(f"{folder}/packed")
    with gzip.open(f"{folder}/packed/t.csv.gz", "wt") as file:
        file.write("text,id\nx,1\n")
    return {
        "plain": ["id", "text"],
        "quoted%20bom": ["id", "flag"],
        "old%20line%20ends": ["note", "id"],
        "many": ["ratio", "id"],
        "no%20end": ["id", "bonus"],
        "other%20name": ["id", "note"],
        "packed": ["text", "id"],
    }


def test_first_lines_are_opened_or_scanned_alike(spark, folder, write):
    want = _odd_heads(folder, write)
    for found in (
        delimited.read_headers(spark, [folder]),
        delimited.first_headers(spark, [folder], list_files(spark, [folder])),
    ):
        rows = found.collect()
        assert {r.path.rsplit("/", 2)[1]: r.header for r in rows} == want and len(rows) == len(want)


def test_lines_are_not_sorted_for_headers(spark, folder, write):
    """A sort of all lines of a task takes memory in proportion to them."""
    write(f"{folder}/t.csv", "id,text\n" + "1,x\n" * 1000)
    plan = delimited.read_headers(spark, [folder])._jdf.queryExecution().executedPlan().toString()
    steps = [line.strip(" +-:") for line in plan.splitlines()]
    scan = next(i for i, step in enumerate(steps) if "FileScan text" in step)
    narrowed = next(i for i, step in enumerate(steps) if step.startswith("MapInArrow"))
    assert narrowed < scan and not any(step.startswith("Sort") for step in steps[narrowed:])


def test_only_files_that_tasks_cannot_open_are_scanned_for_headers(spark, folder, write, monkeypatch):
    scanned, scan = [], delimited.read_headers

    def watched(*args, **options):
        found = scan(*args, **options)
        scanned.extend(r.path.rsplit("/", 1)[1] for r in found.collect())
        return found

    monkeypatch.setattr(delimited, "read_headers", watched)
    write(f"{folder}/a/t.csv", "id,text\n1,a\n")
    write(f"{folder}/a/u.csv", "text,id\nb,2\n")
    rows = delimited.read_csv(spark, [f"{folder}/a"], CONTRACT).select("id", "text")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")] and scanned == []
    with gzip.open(f"{folder}/a/v.csv.gz", "wt") as file:
        file.write("note,text,id\nn,c,3\n")
    rows = delimited.read_csv(spark, [f"{folder}/a"], CONTRACT).select("id", "text")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b"), (3, "c")] and scanned == ["v.csv.gz"]
