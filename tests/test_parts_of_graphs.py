"""Graphs of many small parts and of large ones: circles, levels and the order that follows from them."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import graph
from lintlake.queries import views as V
from tests.test_graph import edges_frame, longest, mutual


def parts_of_graph(seed):
    """Many small parts, some with circles, and one of a hundred imports."""
    rng = random.Random(seed)
    edges = [(f"p{part:02d}/{rng.randrange(6)}", f"p{part:02d}/{rng.randrange(6)}") for part in range(30) for _ in range(7)]
    return edges + [(f"z{max(a, b) if k % 9 else min(a, b):02d}", f"z{min(a, b) if k % 9 else max(a, b):02d}") for k, a, b in ((k, rng.randrange(50), rng.randrange(50)) for k in range(100))]


@pytest.mark.parametrize("small", [0, 30, 100_000])
def test_small_and_large_parts(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small or 1)
    edges = parts_of_graph(small)
    clean = [(a, b) for a, b in edges if a != b]
    assert {r.file: r.cycle for r in graph.cycles(edges_frame(spark, edges)).collect()} == mutual(edges)
    assert {r.file: r.level for r in graph.levels(edges_frame(spark, edges)).collect()} == longest(clean)


def test_small_parts_take_no_rounds(spark, monkeypatch):
    """As many files, but no more jobs, whatever the parts are like."""
    def no(*_):
        raise AssertionError("a round over the whole graph")

    monkeypatch.setattr(graph, "_spread", no)
    ladder = [(f"f{a:02d}", f"f{b:02d}") for a in range(40) for b in range(a) if (a + b) % 3 == 0 or a == b + 1]
    step = graph.Tables.put
    puts = []
    monkeypatch.setattr(graph.Tables, "put", lambda self, name, frame: (puts.append(name), step(self, name, frame))[1])
    assert {r.file: r.level for r in graph.levels(edges_frame(spark, ladder)).collect()} == {f"f{k:02d}": k for k in range(40)}
    assert puts.count("edges") < 6 and "state" not in puts
    both = ladder + [(b, a) for a, b in ladder]
    assert {r.cycle for r in graph.cycles(edges_frame(spark, both)).collect()} == {"f00"}


def test_fix_order_of_files_that_import_themselves(spark):
    edges = edges_frame(spark, [("a", "b"), ("c", "c"), ("d", "e"), ("e", "d"), ("f", "f"), ("f", "b")])
    found = spark.createDataFrame([(name, 1, name, 1) for name in "abcdefg"], "id string, phase int, file string, line int")
    got = {r.id: (r.level, r.circular) for r in graph.fix_order(found, edges, F.lit(1)).collect()}
    assert got == {"a": (1, False), "b": (0, False), "c": (0, True), "d": (0, True), "e": (0, True), "f": (1, False), "g": (0, False)}


def test_ranked_findings_are_the_findings(spark, folder):
    ranked = V.ranked_findings(spark, folder)
    whole = V.findings(spark, folder).select(*ranked.columns)
    assert ranked.dtypes == whole.dtypes and sorted(map(repr, ranked.collect())) == sorted(map(repr, whole.collect()))
    # A number per group: no sort of rows with texts.
    assert "SortAggregate" not in ranked._jdf.queryExecution().executedPlan().toString()
