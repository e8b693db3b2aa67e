"""What the plans must look like for the jobs to hold on large, skewed inputs."""

from pyspark.sql import functions as F

from lintlake.operators import gate, groups, scan, stats
from lintlake.queries import views as V


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_limits_per_group_are_cut_before_the_shuffle(spark, folder):
    assert "WindowGroupLimit" in physical(gate.trend(V.history(spark, folder), "repo", ["ts", "event_id"]))
    found = V.findings(spark, folder).withColumn("severity_multiplier", F.lit(1)).withColumn("effective_severity", F.lit("x"))
    assert "WindowGroupLimit" in physical(stats.top_per_theme(found))


def test_distinct_files_are_counted_in_two_steps(spark, folder):
    plan = physical(groups.cross_cutting_groups(V.findings(spark, folder)))
    assert "partial_count" in plan and "rule#" in plan
    # One exchange on (key, file) before the one on the key: a hot key is spread over its files.
    assert any("Exchange hashpartitioning" in line and "file#" in line for line in plan.splitlines())


def test_top_lists_are_no_global_sorts(spark, folder):
    assert "TakeOrderedAndProject" in physical(stats.hotspots(V.items(spark, folder)))


def test_scan_reads_only_what_it_needs(spark, folder):
    plan = physical(V.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content")).transform(
        lambda d: scan.lines(d, "doc_id")).groupBy("doc_id").count())
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_no_cartesian_product(spark, folder):
    found, files = V.findings(spark, folder), V.parts(spark, folder)
    for frame in (stats.profile(found, files), gate.overall(gate.tiers(found), gate.readiness(found, 10))):
        assert "CartesianProduct" not in physical(frame) and "NestedLoopJoin" not in physical(frame)
