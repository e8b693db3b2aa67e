"""Tests of the third round's findings."""

import re

import pytest
from pyspark.sql import functions as F

from lintlake.operators import cluster, dedup, graph, groups, skew
from lintlake.queries import views as V


def exchanges(frame):
    """The keys by which the plan deals rows, and the columns that go along."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange (hash|round)", line)]


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_findings_are_dealt_before_texts_join(spark, folder, no_broadcast):
    found = V.findings(spark, folder)
    wide = [line for line in exchanges(found) if "description" in line or "struct" in line or "best" in line or "(file" in line]
    assert not wide
    assert any("l_partkey" in line for line in exchanges(found))


def test_popular_keys_stay_where_they_are(spark):
    large = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 20)).when(F.col("id") % 2 == 0, F.concat(F.lit("rare"), "id")).alias("key"), "id")
    small = spark.createDataFrame([(f"k{i}", i) for i in range(0, 20, 2)] + [("rare6", 7), ("k2", 99)], "key string, m int")
    counts = large.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    got = skew.beside_popular(large, small, ["key"], counts, popular=100)
    want = large.join(small, ["key"], "left")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def clustered(spark, whole):
    rows = [(f"i{k:03d}", f"R{k % 2}", "LOW", "big" if k % 4 else f"f{k % 16}", k, "say it", "say it") for k in range(200)]
    found = spark.createDataFrame(rows, "id string, rule string, severity string, file string, line int, description string, search_pattern string")
    kept, cluster.WHOLE = cluster.WHOLE, whole
    try:
        return found, sorted(map(tuple, cluster.split(cluster.by_file(found), found).collect()))
    finally:
        cluster.WHOLE = kept


def test_huge_clusters_are_split_alike(spark):
    """The file with most findings is numbered by slices or in one task, with the same parts."""
    found, by_slices = clustered(spark, 10)
    assert by_slices == clustered(spark, 10_000)[1]
    sizes = {}
    for c, part, _, _ in by_slices:
        sizes[c, part] = sizes.get((c, part), 0) + 1
    assert len(by_slices) == 200 and max(sizes.values()) == 12 and sizes["file|big", "R1|say it|9"] == 4 and sizes["file|f0", "R0|say it|1"] == 12


def test_parts_with_detail_need_no_join(spark):
    found, _ = clustered(spark, 10)
    rows = cluster.cut_up(cluster.detailed(found.withColumn("cluster", cluster.file_cluster(found)).withColumn("type", F.lit("file")), "cluster", "type", "severity", "description"))
    parts = cluster.split(cluster.by_file(found), found)
    def same(a, b):
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    same(cluster.summarised(rows), cluster.summary(parts, found))
    same(cluster.paired(rows), cluster.related(parts, found))
    assert not [line for line in exchanges(cluster.paired(rows)) if "related_id" in line]


def test_snippets_of_different_lines_stay(spark):
    text = "call it with four plain words here"
    rows = [("R1", "LOW", "src/x.ts", line, text, snippet) for line, snippet in [(3, "line 3"), (8, "a\nb"), (13, "b"), (18, "c\nline 3x"), (23, "x"), (28, "y"), (30, "line 30")]]
    found = spark.createDataFrame(rows, "rule string, severity string, file string, line int, description string, snippet string")
    made = dedup.merge_near(found).collect()
    assert [(r.line, r.end_line, r.merged, r.snippet) for r in made] == [(3, 30, 7, "line 3\na\nb\nc\nline 3x\nx\ny\nline 30")]


def test_near_groups_are_components_of_pairs(spark):
    """Two wordings that alternate, single lines between, several findings on a line: runs and links over other runs."""
    said = ["alpha beta gamma delta `x`", "alpha beta gamma delta `y`", "one two three four five", "alpha beta gamma other"]
    rows = [("R1", f"f{k % 5}", (k * 7919) % 97, said[(k * k + k // 7) % 4]) for k in range(260)]
    found = spark.createDataFrame(rows, "rule string, file string, line int, description string")
    pairs = dedup.near_pairs(found).collect()
    want = set()
    for r, f, a, d in rows:
        for r2, f2, b, e in rows:
            if f == f2 and 0 < b - a <= 5 and len(set(d.split()) & set(e.split()) - {"`x`", "`y`"}) + ("`x`" in d and "`x`" in e) >= 4 and d.split("`")[1:2] == e.split("`")[1:2]:
                want.add((f, a, b))
    assert {(p.file, p.low, p.high) for p in pairs} == want
    linked = graph.components(spark.createDataFrame([(f"{f}:{a}", f"{f}:{b}") for f, a, b in want], "a string, b string"))
    groups_ = {}
    for r in linked.collect():
        groups_.setdefault(r.component, set()).add((r.node.split(":")[0], int(r.node.split(":")[1])))
    assert len(groups_) > 5
    first = {node: min(line for _, line in nodes) for nodes in groups_.values() for node in nodes}
    assert {(r.file, r.line): r.first_line for r in dedup.near_groups(found).collect()} == first


def test_near_pairs_deal_findings_once(spark):
    found = spark.createDataFrame([("R1", "f", 1, "a b c d e")], "rule string, file string, line int, description string")
    assert len(exchanges(dedup.near_pairs(found))) == 1


@pytest.mark.parametrize("heavy", [0, 2, 6, 1000])
def test_blast_radius_over_sets_of_hubs(spark, heavy, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 3)
    links = {(f"n{a}", f"n{b}") for a in range(40) for b in range(40) if a != b and (a * 7 + b * b) % (3 + b) == 0}
    made = graph.blast_radius(spark.createDataFrame(sorted(links), "src string, dst string"), heavy).collect()
    before = {}
    for a, b in links:
        before.setdefault(b, set()).add(a)
    want = {}
    for b, near in before.items():
        far = set().union(*[before.get(a, set()) for a in near]) - {b}
        want[b] = (len(near), len(near | far) - len(near), len(near | far))
    assert {r.file: (r.direct_callers, r.transitive_callers, r.total_affected_files) for r in made} == want


def test_outsiders_of_families_are_not_dealt(spark, no_broadcast):
    rows = [(f"i{k}", f"R0{k % 4}", "LOW", f"f{k % 9}", k, 4, f"say it {k % 2}", "x") for k in range(80)]
    found = spark.createDataFrame(rows, "id string, rule string, severity string, file string, line int, phase int, search_pattern string, description string")
    made = groups.families(found)
    got = groups.collapse(found, made)
    assert not [line for line in exchanges(got) if "#" in line and "concat(#" in line]
    members = {r.id for r in got.where("family_id IS NOT NULL").collect()}
    assert members == {f"i{k}" for k in range(80) if k % 4 == 1} and got.count() == 80


def test_similar_groups_go_over_files(spark):
    rows = [(f"i{k}", "R1", f"f{k % 5}", "value one is not checked" if k % 2 else "value two is not checked", 3) for k in range(50)] + [("n", None, "f0", None, None)]
    found = spark.createDataFrame(rows, "id string, rule string, file string, description string, phase int")
    assert groups._per_file(found).count() == 11
    assert [(r.rule, r.findings, r.files) for r in groups.similar_groups(found, 0.5).collect()] == [("R1", 50, 5)]
    got = groups.tag_similar(found, 0.5).groupBy("cross_cutting", "cross_cutting_group").count().collect()
    assert sorted(map(tuple, got), key=repr) == [(False, None, 1), (True, "3.1 value one is not checked", 50)]
