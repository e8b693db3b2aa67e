"""Many small files: written by many tasks, one per row or key, and read back whole."""

import pathlib
import os
import re

import pytest

import __spark_entry__ as entry
from lintlake.session import checkpoint_folder
from lintlake.sources import readers, sinks


def writers(folder):
    """The tasks that wrote the files below a folder."""
    return {re.match(r"part-(\d+)", f.name)[1] for f in folder.rglob("part-*") if f.is_file()}


@pytest.mark.parametrize("name, home", [("json_documents", "documents"), ("published_files", "files"), ("sink_numbered_lines", "lines")])
def test_small_tables_are_written_by_many_tasks(spark, folder, name, home):
    root = pathlib.Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(root.glob(f"{home}-*"))
    entry.queries()[name](spark, folder)
    made, = set(root.glob(f"{home}-*")) - before
    assert len(writers(made)) > 1


def test_one_file_per_row(spark, tmp_path):
    rows = spark.createDataFrame([(f'{{\n "n": {k}{"" if k == 3 else "}"}',) for k in range(50)], "value string").coalesce(1)
    sinks.text_files(rows, str(tmp_path / "t"))
    assert len([f for f in (tmp_path / "t").glob("part-*") if f.stat().st_size]) == 50
    assert sorted(r.n for r in readers.json_object(spark, str(tmp_path / "t"), "n int").collect()) == [k for k in range(50) if k != 3]
    # A first task without rows leaves an empty file, which is no document.
    sinks.text_files(rows.limit(1), str(tmp_path / "one"))
    assert [r.n for r in readers.json_object(spark, str(tmp_path / "one"), "n int").collect()] == [0]


def test_one_folder_per_key(spark, tmp_path):
    rows = spark.range(60).selectExpr("cast(id AS string) AS value", "id % 20 AS part").coalesce(1)
    sinks.text_files(rows, str(tmp_path / "t"), "part")
    made = sinks.published(spark, str(tmp_path / "t")).selectExpr("regexp_extract(path, 'part=([0-9]+)/', 1) AS part", "line_count").collect()
    assert sorted((int(r.part), r.line_count) for r in made) == [(k, 3) for k in range(20)]
    assert len(writers(tmp_path / "t")) > 1


@pytest.mark.parametrize("part", ["128m", "100k", "3000b"])
def test_lines_are_numbered_where_they_are_read(spark, tmp_path, part):
    """Files of one block and of many; equal names in two folders; blank lines and a batch that ends within a file."""
    want = set()
    for name, n in (("a/x.txt", 30_000), ("b/x.txt", 7), ("b/y.txt", 1), ("b/z.txt", 0), ("c/w.txt", 12_000)):
        os.makedirs(tmp_path / "in" / name[0], exist_ok=True)
        lines = ["" if k % 11 == 3 else f"{name}:{k}" for k in range(1, n + 1)]
        (tmp_path / "in" / name).write_text("".join(f"{line}\n" for line in lines))
        want |= {(name[2:], k, line) for k, line in enumerate(lines, 1)}
    conf = {"spark.sql.files.maxPartitionBytes": part, "spark.sql.files.openCostInBytes": "1k"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        made = readers.numbered_json_lines(spark, str(tmp_path / "in" / "*"))
        got = [tuple(r) for r in made.collect()]
        plan = made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == 42_008 and set(got) == want
    assert "MapInArrow" in plan
