"""Published versions, counts from the write, joins with hot keys, keys with repos."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import dedup, groups, skew
from lintlake.sources import sinks


def test_versions_and_pointers(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(LookupError):
        sinks.table(spark, path)
    assert sinks.publish(spark.range(3), path) == 1
    old = sinks.table(spark, path)
    assert sinks.publish(spark.range(5).withColumn("part", F.col("id") % 2), path, "part") == 2
    # A reader that began before goes on with what it saw.
    assert (old.count(), sinks.table(spark, path).count(), sinks.table(spark, path, 1).count()) == (3, 5, 3)
    assert [(r.version, r.rows) for r in sinks.pointers(spark, path).orderBy("version").collect()] == [(1, 3), (2, 5)]
    assert sinks.publish(spark.range(4), path, no_loss=True) is None
    assert sinks.table(spark, path).count() == 5 and len(list((tmp_path / "table" / "versions").iterdir())) == 2
    assert sinks.publish(spark.range(5), path, no_loss=True) == 3
    assert sinks.forget(spark, path, keep=1) == 2 and sinks.table(spark, path).count() == 5


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.publish(spark.range(3), path)
    broken = spark.range(1000).repartition(8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish(broken, path)
    assert sinks.table(spark, path).count() == 3 and sinks.publish(spark.range(7), path) == 2


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    made = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counts_come_from_the_write(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k % 50, "x") for k in range(200)], "id int, name string").repartition(4)
    once = rows.rdd.map(lambda r: (read.add(1), r)[1]).toDF(rows.schema)
    counts = sinks.processed(once, {"valid": lambda f: f.where("id < 30"), "final": lambda f: f.groupBy("id").agg(F.min("name").alias("name"))}, str(tmp_path / "t"))
    assert counts == {"raw": 200, "valid": 120, "final": 30} and read.value == 200
    assert sinks.table(spark, str(tmp_path / "t")).count() == 30
    assert dedup.processing_summary(spark, {"raw": 9, "valid": 7, "final": 4}).first() == (9, 2, 3, 4)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_are_plain_joins(spark, how):
    large = spark.createDataFrame([("h" if k % 2 else None if k % 5 == 0 else f"k{k % 40}", k) for k in range(800)], "key string, n int")
    small = spark.createDataFrame([("h", 1), ("h", 2), ("k3", 3), ("k4", 4), (None, 5), ("z", 6)], "key string, m int")
    got = skew.join(large, small, ["key"], how, salts=7)
    want = large.join(small, ["key"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_key_with_half_of_the_rows_is_no_large_task(spark):
    large = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("key"), "id")
    small = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("m")).unionByName(spark.createDataFrame([("hot", -1)], "key string, m long"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        def sizes(joined):
            return sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())

        plain, salted = sizes(large.join(small, "key", "left")), sizes(skew.join(large, small, ["key"], "left"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(plain) == sum(salted) == 40_000 and len(salted) == 8
    assert plain[-1] > 5 * plain[4] and salted[-1] < 2 * salted[4]


def test_equal_paths_of_two_repos_stay_apart(spark):
    text = "call `run` with four plain words here"
    rows = [(repo, "R1", "LOW" if repo == "a" else "HIGH", "src/x.ts", line, text, f"code {line}", scanner) for repo in "ab" for line in (1, 3) for scanner in ("s", "t")]
    rows += [("a", "R1", "LOW", "src/x.ts", 5, text, "code 3", "s"), ("b", "R1", "LOW", "src/x.ts", 40, text, "far", "s")]
    found = spark.createDataFrame(rows, "repo string, rule string, severity string, file string, line int, description string, snippet string, scanner string")
    single = dedup.same_line(found)
    assert sorted((r.repo, r.line, r.severity, r.scanner) for r in single.collect()) == [
        ("a", 1, "LOW", "s,t"), ("a", 3, "LOW", "s,t"), ("a", 5, "LOW", "s"), ("b", 1, "HIGH", "s,t"), ("b", 3, "HIGH", "s,t"), ("b", 40, "LOW", "s")]
    merged = {(r.repo, r.line): (r.end_line, r.severity, r.merged, r.snippet) for r in dedup.merge_near(single).collect()}
    assert merged == {("a", 1): (5, "LOW", 3, "code 1\ncode 3"), ("b", 1): (3, "HIGH", 2, "code 1\ncode 3"), ("b", 40): (40, "LOW", 1, "far")}
    files = spark.createDataFrame([("a", "src/x.ts", "api"), ("c", "src/x.ts", "other")], "repo string, path string, layer string")
    assert {(r.repo, r.layer) for r in dedup.with_layer(single, files).collect()} == {("a", "api"), ("b", "unclassified")}
    assert [(r.files, r["count"]) for r in groups.cross_cutting_groups(single.withColumn("search_pattern", F.lit("p")), 2).collect()] == [(2, 6)]


def test_similar_wording_tags_findings(spark):
    said = ["value one is not checked before use", "value two is not checked before use", "value three is not checked before use"]
    rows = [(f"i{k}", "R1", f"f{k}", said[k % 3], 4) for k in range(6)] + [("j0", "R1", "f0", "something else entirely", 4), ("j1", "R2", "f1", said[0], 2), ("j2", "R1", "f9", None, 4)]
    made = groups.tag_similar(spark.createDataFrame(rows, "id string, rule string, file string, description string, phase int"))
    got = {r.id: (r.cross_cutting, r.cross_cutting_group) for r in made.collect()}
    assert got == {**{f"i{k}": (True, f"4.1 {said[0]}") for k in range(6)}, **{k: (False, None) for k in ("j0", "j1", "j2")}}
