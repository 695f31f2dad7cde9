import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mensura.plans.catalog import QUERIES
from mensura.session import scratch
from mensura.sources import tables

SCHEMA = "unit int, rt double, acc int"


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_columns_are_found_by_name(spark, tmp_path):
    path = put(
        tmp_path, a="unit,rt,acc\n1,500.5,1\n2,,0\n", b="acc,unit,rt\n1,9,600\n", c='note,rt,"acc",unit\n"x, ""y""",7,1,3\n',
        d="\ufeffunit,rt,acc\n4,NaN,0\n", e="", f="unit,rt,acc\n",
    )
    rows = tables.read_csv(spark, path, SCHEMA).orderBy("unit").collect()
    assert [tuple(r) for r in rows] == [(1, 500.5, 1), (2, None, 0), (3, 7.0, 1), (4, None, 0), (9, 600.0, 1)]


def test_missing_and_repeated_columns(spark, tmp_path):
    path = put(tmp_path, a="unit,rt,acc\n1,2,1\n", b="unit,acc\n5,0\n")
    with pytest.raises(ValueError, match="b.csv lacks the columns \\['rt'\\]"):
        tables.read_csv(spark, path, SCHEMA)
    rows = tables.read_csv(spark, path, SCHEMA, optional=["rt"]).orderBy("unit").collect()
    assert [tuple(r) for r in rows] == [(1, 2.0, 1), (5, None, 0)]
    put(tmp_path, b="unit,rt,acc,Unit\n5,1,0,6\n")
    with pytest.raises(ValueError, match="repeats the columns"):
        tables.read_csv(spark, path, SCHEMA)


def test_other_separators_packed_and_no_files(spark, tmp_path):
    (tmp_path / "p.tsv.gz").write_bytes(gzip.compress(b"rt\tacc\tunit\n5\t1\t8\n"))
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path), SCHEMA).collect()] == [(8, 5.0, 1)]
    (tmp_path / "none").mkdir()
    put(tmp_path / "none", only="")
    empty = tables.read_csv(spark, str(tmp_path / "none"), SCHEMA, unit_pattern="x")
    assert empty.columns == ["unit", "rt", "acc", "file_unit"] and empty.count() == 0


def test_unit_files_of_two_layouts(spark, tmp_path):
    path = put(tmp_path, s1="unit,rt,acc\n1,2,1\n", s2="acc,rt,unit\n0,3,2\n")
    rows = tables.read_unit_tables(spark, path, SCHEMA, r"s(\\d)\\.csv".replace("\\\\", "\\")).orderBy("unit").collect()
    assert [tuple(r) for r in rows] == [(1, 2.0, 1, "1"), (2, 3.0, 0, "2")]


def test_edges_by_name(spark, tmp_path):
    path = put(tmp_path, a="channel_b,channel_a\nx,y\n", b="channel_a,channel_b,distance\nx,z,1\n")
    assert sorted(tuple(r) for r in tables.read_edges(spark, path).collect()) == [("x", "y"), ("x", "z"), ("y", "x"), ("z", "x")]


@pytest.fixture
def files(tmp_path):
    draw = random.Random(1)
    held = {
        "empty": b"", "feed": b"\n", "feeds": b"\n" * 9000, "text": b"a\r\nb\rc", "closed": b"a\nb\n", "plain": b"abc",
        "noise": draw.randbytes(300_000), "long": b"x" * 200_000, "lines": b"".join(b"%d,%d\n" % (i, i * i) for i in range(30_000)),
    }
    for name, data in held.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    return str(tmp_path), held


def named(frame, column):
    return {r.path.rsplit("/", 1)[1].removesuffix(".bin"): (r.length, r[column]) for r in frame.collect()}


@pytest.mark.parametrize("size", ["128m", "20k"])
def test_streamed_hashes(spark, files, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        if size == "20k":
            ranges = spark.read.text(files[0]).filter("value <> ''").select("_metadata.file_path", "_metadata.file_block_start").distinct()
            assert ranges.groupBy("file_path").count().filter("count > 5").count() >= 2
        got = named(tables.fingerprints(spark, files[0]), "sha256")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files[1].items()}


def test_large_files_are_hashed_step_by_step(spark, files, monkeypatch):
    taken = []
    monkeypatch.setattr(tables, "scratch", lambda s: taken.append(scratch(s)) or taken[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = named(tables.fingerprints(spark, files[0], step_bytes=50_000), "sha256")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files[1].items()}
    steps = spark.read.parquet(taken[0]).filter("length(piece) < 50000").groupBy("path", "step").agg(F.sum(F.length("piece") + 1).alias("n"))
    assert steps.groupBy("path").count().filter("count > 1").count() >= 2 and steps.filter("n > 100000").isEmpty()


def by_hand(data, leaf):
    """Hash tree of the pieces between line feeds."""
    if not data:
        return hashlib.sha256(b"0").hexdigest()
    pieces = data.split(b"\n")
    level = [hashlib.sha256(p).digest() for p in (pieces[:-1] if data.endswith(b"\n") else pieces)]
    while True:
        level = [hashlib.sha256(b"".join(level[i : i + leaf])).digest() for i in range(0, len(level), leaf)]
        if len(level) == 1:
            return hashlib.sha256(str(len(data)).encode() + level[0]).hexdigest()


@pytest.mark.parametrize("size,leaf", [("128m", 4096), ("20k", 4096), ("20k", 50)])
def test_range_hashes_do_not_depend_on_the_ranges(spark, files, size, leaf):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = named(tables.range_fingerprints(spark, files[0], leaf), "tree_sha256")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (len(d), by_hand(d, leaf)) for n, d in files[1].items()}


def test_packed_files_are_refused(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"a"))
    with pytest.raises(ValueError, match="unpacks"):
        tables.fingerprints(spark, str(tmp_path))


def test_query_names_the_changed_file(spark):
    assert [r.name for r in QUERIES["s13_source_identity"](spark, "/root/testdata/sf0.001").collect()] == ["nation.parquet"]


@pytest.mark.parametrize("most", [0, 1, 2, 256])
def test_headers_found_by_tasks(spark, tmp_path, monkeypatch, most):
    """The same rows, whether the driver or tasks look into the files, and whether a layout is named file by file or not."""
    monkeypatch.setattr(tables, "HEADER_FILES", most)
    texts = {"folder=1/a b": "﻿unit,rt,acc\n1,2,1\n", "folder=2/a": "acc,rt,unit\n0,3,2\nunit,rt,acc\n", "folder=3/a": "unit,rt,acc\r\n3,NaN,1\r\n", "folder=4/a": "",
             "folder=5/a": 'unit,"folder",rt,acc\n5,x,4,1\n', "folder=6/a": "unit,rt,acc\n", "folder=7/a": "unit,rt,acc\n7,,0\n7,1,0"}
    if most == 256:
        texts = {n.replace(" ", ""): t for n, t in texts.items()}  # named files with a space were not found before either
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    got = tables.read_unit_tables(spark, str(tmp_path), SCHEMA, r"folder=(\d+)").collect()
    want = [(1, 2.0, 1, "1"), (2, 3.0, 0, "2"), (None, None, None, "2"), (3, None, 1, "3"), (5, 4.0, 1, "5"), (7, None, 0, "7"), (7, 1.0, 0, "7")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    (tmp_path / "folder=8").mkdir()
    (tmp_path / "folder=8" / "a.csv").write_text("unit,rt\n8,1\n")
    with pytest.raises(ValueError, match=r"folder=8/a.csv lacks the columns \['acc'\]"):
        tables.read_unit_tables(spark, str(tmp_path), SCHEMA, r"folder=(\d+)")


UNIT_ROWS = [(u, c, f'a"{u},') for u in range(300) for c in ("A", "R") if (u, c) != (7, "R")]


def test_many_files_are_not_opened_by_the_driver(spark, tmp_path, monkeypatch):
    """One layout is one scan of the folder, and violations read it once (failed with a look into each file and three scans)."""
    opened = []
    look = tables._first_line
    monkeypatch.setattr(tables, "_first_line", lambda s, f: opened.append(f) or look(s, f))
    for u in range(300):
        (tmp_path / f"folder={u}").mkdir()
        (tmp_path / f"folder={u}" / "part.csv").write_text("unit,condition\n" + "".join(f"{v},{c}\n" for v, c, _ in UNIT_ROWS if v == u))
    loaded = tables.read_unit_tables(spark, str(tmp_path), "unit bigint, condition string", r"folder=(\d+)")
    assert not opened
    expected = spark.createDataFrame([(3,), (300,), (300,)], "unit bigint")
    found = tables.unit_table_violations(loaded, "unit", "condition", ["A", "R"], expected)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert sorted(map(tuple, found.collect())) == [("300", "missing"), ("300", "missing"), ("7", "condition_mismatch")]


def test_unit_files_come_back_as_written(spark, tmp_path):
    from mensura.sources import sinks

    df = spark.createDataFrame([*UNIT_ROWS, (None, "A", None)], "unit bigint, condition string, note string")
    assert sinks.write_unit_tables(df.repartition(5), "unit", f"{tmp_path}/units") == 301
    loaded = tables.read_unit_tables(spark, f"{tmp_path}/units", "unit bigint, condition string, note string", r"folder=(\d+)")
    got = [tuple(r) for r in loaded.collect()]
    assert sorted(r[:3] for r in got if r[0] is not None) == sorted(UNIT_ROWS) and all(r[3] == str(r[0]) for r in got if r[0] is not None)
    assert [r for r in got if r[0] is None] == [(None, "A", None, "")]
