"""Tests of the fourth round's findings."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.operators import cluster, validate, verify
from lintlake.queries import catalogue
from lintlake.session import Tables, checkpoint_folder


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_violations_of_odd_references(spark, seed):
    """Ids and references that are null, empty, repeated or made of each other, against a plain count."""
    rng = random.Random(seed)
    names = [f"i{k}" for k in range(12)] + [None, ""]
    found = [(rng.choice(names), rng.choice([*names, "x", "y"]), rng.choice([True, False, None]), rng.choice(["c1", "c2", "z", "", None])) for _ in range(60)]
    families = [(f"F{k}", rng.choice([*names, "x", "gone"])) for k in range(9)]
    clusters = [("c1",), ("c2",), ("c2",), (None,)]
    tiers = [("a", "FAIL"), ("b", "FAIL"), ("c", "PASS"), (None, "FAIL")]
    blockers = [("a", rng.choice([*names, "y"])) for _ in range(12)] + [("a", None), ("a", "y"), ("a", "y")]
    ids, roots = {r[0] for r in found} - {None}, {r[0] for r in found if r[2]} - {None}
    want = [("missing_parent", i, p) for i, p, _, _ in found if p and p not in ids]
    want += [("parent_not_root", i, p) for i, p, _, _ in found if p and p not in roots]
    want += [("missing_family_root", f, r) for f, r in families if r and r not in ids]
    want += [("no_cluster", i, "") for i, _, _, c in found if not c]
    want += [("unknown_cluster", i, c) for i, _, _, c in found if c == "z"]
    want += [("missing_blocker", i, t) for t, i in blockers if i not in ids]
    want += [("fail_without_blocker", t, "") for t in ("b", None)]
    made = verify.violations(
        spark.createDataFrame(found, "id string, parent_finding_id string, is_root_cause boolean, cluster_id string"),
        spark.createDataFrame(families, "family_id string, root_finding_id string"), spark.createDataFrame(clusters, "cluster_id string"),
        spark.createDataFrame(tiers, "tier string, status string"), spark.createDataFrame(blockers, "tier string, id string"))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))


def test_findings_of_violations_are_made_once(spark, folder):
    """What is read for each check is a table, not the line items and what is joined to them."""
    made = catalogue.QUERIES["integrity_violations"](spark, folder)
    assert "l_partkey" not in plan_of(made)


def test_family_keys_are_written_once(spark):
    fields = ["`x` 12", "", None, " Do `y` this-7 3", "later"]
    names = [f"f{k}" for k in range(len(fields))]
    frame = spark.createDataFrame([tuple(fields), (None,) * 5, ("4", "`5`", "", "-", "!"), ("A1 b", *fields[:4])], ", ".join(f"{n} string" for n in names))
    made = frame.select(F.when(F.coalesce("f0", F.lit("")) != "none", text.family_key(*[F.col(n) for n in names])).alias("key"))
    assert [r.key for r in made.collect()] == ["do this", "", "", "a1 b"]
    assert plan_of(made).count("lower(f0") == 1


def rows_of(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_sets_of_clusters_with_one_number_are_told_apart(spark):
    """Two sets may get the same number by the first hash; then all get others, and merging goes on as before."""
    rows = [(c, "file", f"i{k}") for k in range(40) for c in ("a" if k < 20 else "b", f"c{k % 4}", f"c{k % 4}")] + [(None, "file", "i1"), ("a", "other", "i0"), ("a", "x", None)]
    members = spark.createDataFrame(rows, "cluster string, type string, id string")

    def alike(turn, places):
        return F.when(turn == 0, F.lit(7)).otherwise(F.xxhash64(turn, places))

    held, sets = cluster._sets(members, Tables(spark), alike)
    assert sets.count() == sets.select("key").distinct().count() == 10
    assert rows_of(held.join(sets, "key").select("id", F.explode("places").alias("p")).select("p.cluster", "p.type", "id")) == rows_of(members.where("cluster IS NOT NULL"))
    made = cluster.merge(members, share=0.9).collect()
    assert len(made) == 81 and {r.type for r in made} == {"file"} and sum(r.id is None for r in made) == 1


@pytest.mark.parametrize("whole,hot", [(1000, 64), (1, 64), (1, 4), (30, 4), (100, 2)])
def test_huge_clusters_with_small_groups(spark, whole, hot, monkeypatch):
    """Clusters and groups of them above and below what a task may hold, rules and texts missing among them."""
    monkeypatch.setattr(cluster, "WHOLE", whole)
    monkeypatch.setattr(cluster, "HOT", hot)
    rows = [(["big", "big", "mid", f"s{k % 7}"][k % 4], "file", f"i{k:03d}", [None, "R1", "R1", "R2", "R1"][k % 5], f"f{k % 3}", k * 7 % 50, [None, "v", "v", "v"][k // 5 % 4], f"m{k % 2}") for k in range(240)]
    made = cluster.cut_up(spark.createDataFrame(rows, "cluster string, type string, id string, rule string, file string, line int, variant string, more string"), size=5, rules=2)
    at, want = {}, []
    size = {c: sum(r[0] == c for r in rows) for c in {r[0] for r in rows}}
    for c, kind, i, rule, file, line, variant, more in sorted(rows, key=lambda r: (r[4], r[5], r[2])):
        at[c, rule, variant] = n = at.get((c, rule, variant), 0) + 1
        want.append((c, kind, i, rule, file, line, more, "|".join([x for x in (rule, variant) if x] + [str(-(-n // 5))]) if size[c] > 5 else ""))
    assert rows_of(made.select("cluster", "type", "id", "rule", "file", "line", "more", "part")) == sorted(map(repr, want))


def test_parts_that_say_enough_need_no_join(spark):
    rows = [(f"i{k:02d}", f"R{k % 2}", ["LOW", None, "HIGH"][k % 3], f"f{k % 4}", k, ["say it", None, ""][k % 3]) for k in range(60)]
    found = spark.createDataFrame(rows, "id string, rule string, severity string, file string, line int, description string")
    members = cluster.by_file(found)
    parts = cluster.split(members, found, more=cluster.SAID)
    assert parts.columns == ["cluster", "part", "type", "id", *cluster.SAID]
    assert rows_of(parts.select("cluster", "part", "type", "id")) == rows_of(cluster.split(members, found))
    assert rows_of(cluster.summary(parts, found)) == rows_of(cluster.summary(parts.drop(*cluster.SAID), found))


def test_phantoms_can_be_told_before(spark):
    files = spark.createDataFrame([("a.py",), ("b.py",), ("b.py",), (None,), ("",)], "path string")
    texts = ['{"rule":"R1","file":%s,"line":%s,"description":"d","severity":"LOW","category":"c","confidence":"high"}' % (f, n)
             for f in ('"a.py"', '"b.py"', '"c.py"', '""', "null", '"#1"', '"C.py"') for n in (3, '"x"', 0)] + ["[1]", "{broken", " "]
    found = validate.parsed(spark.createDataFrame([("s", t) for t in texts for _ in range(2)], "source string, value string"))
    phantoms = validate.unlisted(found, files)
    assert sorted(r.file for r in phantoms.collect()) == ["#1", "C.py", "c.py"]
    want, got = validate.checked(found, files), validate.checked(found, phantoms=phantoms)
    assert got.columns == found.drop("_kind", "_line_type").columns + ["_reason"]
    assert rows_of(got) == rows_of(want.select(*got.columns)) and got.where("_reason LIKE 'phantom_file:%'").count() == 6


def test_intake_leaves_only_packed_texts_and_results(spark, folder):
    home = Path(urlparse(checkpoint_folder(spark)).path)
    before = set(home.iterdir())
    made = catalogue.QUERIES["stream_intake"](spark, folder)
    new, = set(home.iterdir()) - before
    assert sorted(p.name for p in new.iterdir()) == ["done", "in", "rejected", "valid"]
    texts = [p for p in (new / "in").iterdir() if p.name.startswith("part-")]
    assert len(texts) >= 4 and all(p.name.endswith(".txt.gz") for p in texts)
    for table in ("valid", "rejected"):
        assert sorted(p.name for p in (new / table).glob("batch=*")) == ["batch=0", "batch=1"]
    lines = spark.read.text(str(new / "in"))
    assert lines.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert made.agg(F.sum("findings")).first()[0] == lines.where("trim(value) <> ''").count()
