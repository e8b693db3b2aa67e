"""First stage: files in; findings, statistics, tasks and a verdict out.

Everything is one lazy lineage up to the findings.  They feed all that follows, so they are
materialised once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lintlake.catalog import rules as R
from lintlake.operators import dedup, duplicates, gate, groups, inventory, scan, stats, tasks
from lintlake.session import cut


def scanned(files: DataFrame, by_stack=R.BY_STACK, more: DataFrame | None = None) -> DataFrame:
    """Rule scan, de-duplicated and numbered; ``more`` holds findings of other scanners."""
    found = scan.rule_scan(files, by_stack)
    if more is not None:
        found = found.unionByName(more, allowMissingColumns=True)
    return dedup.assign_ids(dedup.same_line(found))


def per_layer(findings: DataFrame) -> DataFrame:
    return findings.groupBy("layer").agg(*stats.levels(), F.count(F.lit(1)).alias("findings"), F.countDistinct("file").alias("files"))


def run(files: DataFrame, by_stack=R.BY_STACK, more: DataFrame | None = None, thresholds: dict | None = None) -> dict[str, DataFrame]:
    """files(path, stack, content) -> the tables of an audit, by name."""
    listed = inventory.inventory(files)
    layer_totals = inventory.layer_totals(listed)
    found = groups.cross_cutting(scanned(listed, by_stack, more))
    made = groups.families(found)
    findings = cut(groups.collapse(found, made))
    loc = inventory.totals(listed).select(F.col("total_loc").alias("loc"))
    health = duplicates.duplication(files).select(F.lit(None).cast("double").alias("coverage_line_pct"), "duplication_pct")
    judged = gate.tiers(findings, health, thresholds)
    scored = gate.readiness(findings, loc)
    return {
        "inventory": listed, "layers": layer_totals, "findings": findings, "families": made,
        "severity": stats.severity_counts(findings), "layer_breakdown": stats.layers(findings, layer_totals),
        "hotspots": stats.hotspots(findings), "tasks": tasks.phase_tasks(findings), "tiers": judged,
        "blockers": gate.blockers(findings, judged), "readiness": scored, "verdict": gate.overall(judged, scored),
        "triage": scan.triage(listed, findings), "batches": tasks.scan_batches(listed),
    }


def overview(made: dict[str, DataFrame]) -> DataFrame:
    """(measure, value) rows of an audit."""
    def one(name, frame, value):
        return frame.select(F.lit(name).alias("measure"), value.cast("string").alias("value"))

    count = F.count(F.lit(1))
    rows = [one("files", made["inventory"].agg(count.alias("n")), F.col("n")), one("findings", made["findings"].agg(count.alias("n")), F.col("n")),
            one("families", made["families"].agg(count.alias("n")), F.col("n")), one("batches", made["batches"].agg(F.max("batch").alias("n")), F.col("n")),
            one("readiness", made["readiness"], F.col("readiness_score")), one("verdict", made["verdict"], F.col("overall")),
            made["severity"].select(F.concat(F.lit("severity:"), "severity").alias("measure"), F.col("findings").cast("string").alias("value")),
            made["tiers"].select(F.concat(F.lit("tier:"), "tier").alias("measure"), F.col("status").alias("value"))]
    return reduce(DataFrame.unionByName, rows)
