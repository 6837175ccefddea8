import os

import pytest
from pyspark.sql import functions as F

from surveyloom.sources import csv_export, csv_table, snapshots


def _write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def _audit(spark, tmp_path, text):
    loaded = csv_table.read_csv(spark, _write(tmp_path, text))
    return loaded, {r["kind"]: r for r in loaded.audit.collect()}


def test_clean_file_has_no_findings(spark, tmp_path):
    loaded, audit = _audit(spark, tmp_path, "a,b,c\n1,x,true\n2,y,FALSE\n\n , ,\n3.5,,true\n")
    assert audit == {}
    assert loaded.table.dtypes == [("a", "double"), ("b", "string"), ("c", "double")]
    assert [tuple(r) for r in loaded.table.collect()] == [(1.0, "x", 1.0), (2.0, "y", 0.0), (3.5, None, 1.0)]


def test_ragged_rows_are_counted_and_located(spark, tmp_path):
    loaded, audit = _audit(spark, tmp_path, "a,b\n1,2\n3,4,5\n6\n\n7,8,9\n")
    assert audit["too-many-cells"]["n"] == 2 and audit["too-many-cells"]["sample_lines"] == [3, 6]
    assert audit["too-few-cells"]["n"] == 1 and audit["too-few-cells"]["sample_lines"] == [4]
    assert loaded.table.count() == 4


def test_quoted_delimiters_are_not_ragged(spark, tmp_path):
    loaded, audit = _audit(spark, tmp_path, 'a,b\n"x, ""y""",2\n')
    assert audit == {} and loaded.table.first()["a"] == 'x, "y"'


def test_open_quote_is_reported(spark, tmp_path):
    _, audit = _audit(spark, tmp_path, 'a,b\n1,2\n"oops,3\n4,5\n')
    assert audit["open-quote"]["sample_lines"] == [3]


@pytest.mark.parametrize("delimiter", [";", "\t", "|"])
def test_delimiters_are_detected(spark, tmp_path, delimiter):
    loaded, _ = _audit(spark, tmp_path, "a,b\n1,2\n".replace(",", delimiter))
    assert loaded.table.columns == ["a", "b"] and loaded.header.delimiter == delimiter


def test_single_column(spark, tmp_path):
    _, audit = _audit(spark, tmp_path, "only\n1\n2\n")
    assert set(audit) == {"no-delimiter"}


def test_header_problems(spark, tmp_path):
    loaded, audit = _audit(spark, tmp_path, "Q1,Q1,,Q1_1\n1,2,3,4\n")
    assert loaded.table.columns == ["Q1", "Q1_2", "Q1_1"]
    assert audit["blank-header"]["n"] == 1 and audit["repeated-header"]["columns"] == ["Q1_2"]
    assert "repeated-header" not in _audit(spark, tmp_path, "Q1,Q1_1\n1,2\n")[1]
    assert "headerless" in _audit(spark, tmp_path, "1,2.5\n3,4\n")[1]
    with pytest.raises(ValueError):
        csv_table.read_csv(spark, _write(tmp_path, ",\n1,2\n"))
    with pytest.raises(ValueError):
        csv_table.read_csv(spark, _write(tmp_path, "\x01\x02,b\n1,2\n"))


@pytest.mark.parametrize("cells, style", [
    (["1,234", "12,345,678.5", "-9,999"], "thousands separators"), (["1,5", "2,25", "3,125"], "decimal commas"),
    (["5%", "7.5 %", "1%"], "percent signs"), (["1,5", "x", "y"], None), (["1,5", "2,5", "7"], None),
])
def test_numbers_written_as_text(spark, cells, style):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    found = csv_table.numeric_text(df).collect()
    assert [r["format"] for r in found] == ([] if style is None else [style])


def test_parsing_numeric_text(spark):
    df = spark.createDataFrame([("1,234",), ("x",)], "c string")
    assert [r[0] for r in csv_table.parse_numeric_text(df, "c", "thousands separators").collect()] == [1234.0, None]


def test_the_delimiter_is_judged_on_all_lines(spark, tmp_path):
    text = "a;b\n" + "".join(f"1,{i},x;y\n" for i in range(9)) + "".join(f"left {i};right\n" for i in range(200))
    header = csv_table.read_csv(spark, _write(tmp_path, text)).header
    assert header.delimiter == ";" and header.fields == ["a", "b"]


def test_quoted_line_breaks_are_sound_under_multi_line(spark, tmp_path):
    path = _write(tmp_path, 'a,b\n1,"two\nlines"\n2,"x\n\ny"\n3,z\n4\n5,6,7\n')
    loaded = csv_table.read_csv(spark, path, multi_line=True)
    assert loaded.table.count() == 5
    found = {r["kind"]: (r["n"], r["sample_lines"]) for r in loaded.audit.collect()}
    assert found == {"too-few-cells": (1, [5]), "too-many-cells": (1, [6])}


def test_line_numbers_across_splits(spark, tmp_path):
    path = _write(tmp_path, "\n".join(str(i) for i in range(1, 5001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = csv_table.split_lines(spark, path)
        lines = csv_table.with_line_numbers(lines, lines)
        assert lines.filter(F.col("line").cast("string") != F.col("value")).count() == 0 and lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_formula_guard(spark):
    cells = ["=1+1", "-3.5", "+1e4", "-abc", "@x", "\tq", "plain", "a=b", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in csv_export.export_view(df).collect()] == [
        "'=1+1", "-3.5", "+1e4", "'-abc", "'@x", "'\tq", "plain", "a=b", "", ""]
    assert csv_export.guarded_name("=h") == "'=h" and csv_export.guarded_name("-5") == "-5"


def test_single_file_export(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 'a "q", b', None), (2.5, "line\nbreak", "é")], "n double, s string, `=f` string")
    path = str(tmp_path / "out")
    csv_export.write_single_csv(df, path)
    part, = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().decode("utf-8") == (
        '﻿n,s,\'=f\r\n1,"a ""q"", b",\r\n2.5,"line\nbreak",é\r\n')


def test_folder_export_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f'v "{i}", x', None if i % 2 else "y") for i in range(50)], "i int, s string, t string")
    path = str(tmp_path / "out")
    csv_export.write_csv(df.repartition(3), path)
    back = csv_table.read_csv(spark, path).table
    assert sorted((int(r["i"]), r["s"], r["t"]) for r in back.collect()) == sorted(map(tuple, df.collect()))


def _parts(root):
    """Every whole stored table, with the time it was written."""
    return {str(p.parent): p.stat().st_mtime_ns for p in (root / ".parts").glob("*/*/_SUCCESS")}


def test_equal_tables_are_stored_once(spark, tmp_path):
    root = str(tmp_path)
    rows = [(i, None if i % 3 else f"n{i}", [None, i]) for i in range(50)]
    schema = "id int, name string, l array<int>"
    a = spark.createDataFrame(rows, schema)
    turned = spark.createDataFrame(rows[::-1], schema).repartition(5)
    snapshots.save_snapshot(spark, root, "one", {"a": a, "turned": turned})
    stored = _parts(tmp_path)
    assert len(stored) == 1
    snapshots.save_snapshot(spark, root, "one", {"a": turned})
    snapshots.save_snapshot(spark, root, "two", {"b": a, "c": a.limit(0)})
    kept = _parts(tmp_path)
    assert len(kept) == 2 and stored.items() <= kept.items()
    assert snapshots.delete_snapshot(spark, root, "one")
    assert _parts(tmp_path) == kept
    datasets = snapshots.load_snapshot(spark, root, "two")[0]
    assert sorted(map(str, datasets["b"].collect())) == sorted(map(str, a.collect())) and datasets["c"].count() == 0
    snapshots.save_snapshot(spark, root, "two", {"c": a.limit(0)})
    assert len(_parts(tmp_path)) == 1
    assert snapshots.delete_snapshot(spark, root, "two") and not _parts(tmp_path)
    assert not snapshots.delete_snapshot(spark, root, "two")


def test_fingerprint_has_no_order(spark):
    rows = [(None, 1), (1, None), (1, None)]
    made = [spark.createDataFrame(r, "x int, y int") for r in (rows, rows[::-1])]
    assert snapshots.fingerprint(made[0]) == snapshots.fingerprint(made[1].repartition(3))


def test_fingerprint_tells_tables_apart(spark):
    made = [
        ([(None, 1), (1, None)], "x int, y int"), ([(1, None), (1, None)], "x int, y int"), ([(None, 1)], "x int, y int"),
        ([(None, 1), (1, None)], "y int, x int"), ([(None, 1), (1, None)], "x int, y bigint"), ([], "x int, y int"),
        ([(None, 1), (1, None)] * 2, "x int, y int"), ([([None, "a"],)], "v array<string>"), ([(["a", None],)], "v array<string>"),
        ([(["null", "a"],)], "v array<string>"), ([(None,)], "v array<string>"), ([({"a": None},)], "v map<string, int>"),
        ([({},)], "v map<string, int>"), ([("",)], "v string"), ([(None,)], "v string"),
    ]
    keys = [snapshots.fingerprint(spark.createDataFrame(rows, schema)) for rows, schema in made]
    assert len(set(keys)) == len(keys)


def test_tables_that_change_between_reads_are_filed_as_stored(spark, tmp_path):
    noisy = spark.range(40).select("id", F.udf(lambda _: os.urandom(8).hex())("id").alias("r"))
    snapshots.save_snapshot(spark, str(tmp_path), "one", {"a": noisy})
    stored = snapshots.load_snapshot(spark, str(tmp_path), "one")[0]["a"]
    assert stored.count() == 40
    (place,) = _parts(tmp_path)
    assert snapshots.fingerprint(stored) == place.split("/")[-2]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    a, b = spark.range(3), spark.range(5).withColumnRenamed("id", "x")
    assert snapshots.list_snapshots(spark, root).count() == 0
    snapshots.save_snapshot(spark, root, "one", {"a": a, "again": a}, {"pin": b}, {"k": 1})
    snapshots.save_snapshot(spark, root, "two", {"b": b})
    assert [(r["name"], r["n_tables"], r["total_rows"]) for r in snapshots.list_snapshots(spark, root).collect()] == [
        ("two", 1, 5), ("one", 2, 8)]
    datasets, views, settings = snapshots.load_snapshot(spark, root, "one")
    assert datasets["again"].count() == 3 and views["pin"].columns == ["x"] and settings == {"k": 1}
    snapshots.save_snapshot(spark, root, "one", {"b": b})
    assert len(_parts(tmp_path)) == 1 and len(list((tmp_path / "one" / "manifest").iterdir())) == 1
    assert list(snapshots.load_snapshot(spark, root, "one")[0]) == ["b"]
    snapshots.copy_snapshot(spark, root, "two", root + "/other")
    assert snapshots.load_snapshot(spark, root + "/other", "two")[0]["b"].count() == 5
    assert snapshots.delete_snapshot(spark, root, "two")
    assert [r["name"] for r in snapshots.list_snapshots(spark, root).collect()] == ["one"]
    with pytest.raises(ValueError):
        snapshots.save_snapshot(spark, root, "../x", {"b": b})


@pytest.mark.parametrize("manifest, sound", [
    ({"version": 1, "tables": {"t0": {"columns": ["a"], "rows": 1}}, "datasets": [{"name": "d", "table": "t0"}]}, True),
    ({"version": 1}, True), ([], False), ({"version": "1"}, False), ({}, False), ({"version": 2}, False),
    ({"version": 1, "tables": []}, False), ({"version": 1, "tables": {"t0": {"columns": [1], "rows": 1}}}, False),
    ({"version": 1, "datasets": [{"name": "d", "table": "t9"}]}, False), ({"version": 1, "views": [None]}, False),
    ({"version": 1, "datasets": "t0"}, False),
])
def test_manifest_validation(manifest, sound):
    assert (snapshots.problems(manifest) == []) is sound


def _torn_csv(rng, n):
    """Text of a CSV file with line breaks, delimiters and marks in cells, and what it holds."""
    lines, rows = ["a,b,c"], []
    for i in range(n):
        cell = "".join(rng.choice(["x", ",", "\n", '""', "é", "\n\n", " "]) for _ in range(rng.randrange(12)))
        width = rng.choice([3, 3, 3, 3, 2, 4])
        lines.append(",".join([str(i), f'"{cell}"', *["z"] * (width - 2)]))
        rows.append((i, cell.replace('""', '"'), width))
    return "\n".join(lines) + "\n", rows


@pytest.fixture
def split_bytes(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [1 << 20, 700, 64, 17])
def test_records_do_not_depend_on_the_splits(spark, tmp_path, split_bytes, size):
    import random

    rng, want, folder = random.Random(size), [], tmp_path / "many"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        text, rows = _torn_csv(rng, 40)
        (folder / name).write_text(text, newline="")
        want.append(rows)
    split_bytes(size)
    loaded = csv_table.read_csv(spark, str(folder), delimiter=",", multi_line=True, typed=False)
    found = sorted((int(r["a"]), r["b"] or "") for r in loaded.table.collect())
    assert found == sorted((i, cell.strip()) for rows in want for i, cell, _ in rows)
    audit = {r["kind"]: r for r in loaded.audit.collect()}
    for kind, width in (("too-few-cells", 2), ("too-many-cells", 4)):
        places = [j for rows in want for j, r in enumerate(rows, 2) if r[2] == width]
        assert audit[kind]["n"] == len(places) and audit[kind]["sample_lines"] == places[:3]
    assert "open-quote" not in audit


@pytest.mark.parametrize("size", [1 << 20, 9])
def test_a_mark_left_open_takes_the_rest_of_its_file(spark, tmp_path, split_bytes, size):
    from surveyloom.sources.csv_records import records

    path = _write(tmp_path, 'a,b\n1,2\n\n \u00a0,\n3,"four\nfive,6\n7,8\n')
    split_bytes(size)
    found = sorted(map(tuple, records(spark, path).select("number", "cells", "marks", "filled", "text").collect()))
    assert found == [(1, 2, 0, True, "a,b"), (2, 2, 0, True, "1,2"), (3, 2, 0, False, " \u00a0,"), (4, 2, 1, True, '3,"four\nfive,6\n7,8')]
    audit = {r["kind"]: r for r in csv_table.read_csv(spark, path, delimiter=",", multi_line=True).audit.collect()}
    assert audit["open-quote"]["sample_lines"] == [4] and set(audit) == {"open-quote"}
