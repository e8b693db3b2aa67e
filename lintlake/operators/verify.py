"""Reconciliation between independent sources, and referential checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lintlake import schema  # noqa: F401  (schemas of the frames named below)
from lintlake.catalog import maps as M
from lintlake.functions import severity
from lintlake.functions.lookup import first_match
from lintlake.functions.rows import beside
from lintlake.operators import marks
from lintlake.operators.ordering import numbered
from lintlake.session import stored


def recall_misses(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (rule, file) pairs no finding covers."""
    return expected.join(found.select("rule", "file").distinct(), ["rule", "file"], "left_anti").select("rule", "file")


# ------------------------------------------------------------------------ reconciliation
def reconcile(claims: DataFrame, ratings: DataFrame, blocking=M.BLOCKING_RATINGS) -> DataFrame:
    """claims(req_id, status) against ratings(req_id, rating): one row per requirement with the issue, if any."""
    joined = claims.join(ratings, "req_id", "full_outer")
    status, rating = F.coalesce("status", F.lit("NOT_CHECKED")), F.coalesce("rating", F.lit("NOT_CHECKED"))
    claimed = status == "VERIFIED"
    issue = first_match([(claimed & rating.isin(list(blocking)), "disagreement"), (claimed & (rating == "NOT_CHECKED"), "unrated"),
                         (claimed & (rating == "PARTIAL"), "advisory")], F.lit(None).cast("string"))
    return joined.select("req_id", status.alias("status"), rating.alias("rating"), issue.alias("issue"))


def rating_summary(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("requirements"))


def unrated(claims: DataFrame, ratings: DataFrame) -> DataFrame:
    """Claims of a finished requirement the verifier never rated."""
    return claims.where("status = 'VERIFIED'").join(ratings, "req_id", "left_anti").select("req_id")


def verdict(claims: DataFrame, ratings: DataFrame, runtime_failures: DataFrame | None = None, hard_failures: int = 0,
            blocking=M.BLOCKING_RATINGS) -> DataFrame:
    """One row: BLOCKED or CLEAR, the first gate that blocks, and the counts behind it.

    runtime_failures is a frame of failed checks."""
    rows = reconcile(claims, ratings, blocking)
    checked = F.col("rating") != "NOT_CHECKED"
    made = rows.agg(F.count(F.lit(1)).alias("requirements"), F.count_if(checked).alias("rated"),
                    *[F.count_if(F.col("rating") == r).alias(r.lower()) for r in ("SHELL", "MISSING", "PARTIAL")],
                    F.count_if(F.col("issue") == "unrated").alias("unrated"), F.count_if(F.col("issue") == "disagreement").alias("disagreements"))
    made = made.withColumn("hard_failures", F.lit(hard_failures))
    made = beside(made, runtime_failures.agg(F.count(F.lit(1)).alias("runtime_failures"))) if runtime_failures is not None \
        else made.withColumn("runtime_failures", F.lit(0).cast("long"))
    bad = F.col("shell") + F.col("missing") + (F.col("partial") if "PARTIAL" in blocking else F.lit(0))
    gates = [(F.col("hard_failures") > 0, "gate_5_deterministic"), (F.col("rated") == 0, "gate_3"), (bad > 0, "gate_3"),
             (F.col("unrated") > 0, "gate_3"), (F.col("runtime_failures") > 0, "gate_4"),
             (F.col("disagreements") > 0, "gate_5_reconciliation"), (F.col("requirements") == 0, "gate_5_no_evidence")]
    first = first_match(gates, F.lit(None).cast("string"))
    return made.withColumn("blocked_at", first).withColumn("verdict", F.when(F.col("blocked_at").isNull(), "CLEAR").otherwise("BLOCKED"))


# -------------------------------------------------------------------------- referential checks
MARKS = 1 << 26  # places for what is referred to: bitmaps of 8 MB at most


def _absent(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The references of wanted(ref) that known(ref) lacks.  Only what may be wanted is moved to be compared."""
    return stored(wanted.join(marks.only_marked(known, "ref", wanted, "ref", MARKS), "ref", "left_anti"))


def violations(findings: DataFrame, families: DataFrame, clusters: DataFrame, tiers: DataFrame, blockers: DataFrame) -> DataFrame:
    """References that lead nowhere: (check, id, detail).

    findings(id, parent_finding_id, is_root_cause, cluster_id); families(family_id, root_finding_id);
    clusters(cluster_id); tiers(tier, status); blockers(tier, id).  Hand in tables: findings are read several times.

    A reference is looked up once, however many rows make it: those of a family name the same root.  What leads nowhere is
    stored, so that rows meet it where they are unless it is long."""
    ids = findings.select(F.col("id").alias("ref"))
    roots = findings.where(F.coalesce("is_root_cause", F.lit(False))).select(F.col("id").alias("ref"))
    children = findings.where(F.coalesce("parent_finding_id", F.lit("")) != "")
    rooted = families.where(F.coalesce("root_finding_id", F.lit("")) != "")
    clustered = findings.where(F.coalesce("cluster_id", F.lit("")) != "")
    blockers = stored(blockers.select("tier", "id"))

    parents = stored(children.select(F.col("parent_finding_id").alias("ref")).distinct())
    wanted = stored(parents.union(rooted.select("root_finding_id")).union(blockers.select("id")).distinct())
    gone = _absent(wanted, ids)
    orphaned = stored(gone.join(parents, "ref", "left_semi").select("ref", F.lit("missing_parent").alias("check"))
                      .union(_absent(parents, roots).select("ref", F.lit("parent_not_root"))))
    strange = stored(clustered.select("cluster_id").distinct().join(clusters.select("cluster_id"), "cluster_id", "left_anti"))

    def listed(check, rows, who, detail):
        return rows.select(F.lit(check).alias("check") if isinstance(check, str) else check,
                           F.col(who).cast("string").alias("id"), detail.cast("string").alias("detail"))

    found = [
        listed(F.col("check"), children.join(orphaned, F.col("parent_finding_id") == F.col("ref")), "id", F.col("parent_finding_id")),
        listed("missing_family_root", rooted.join(gone, F.col("root_finding_id") == F.col("ref"), "left_semi"), "family_id", F.col("root_finding_id")),
        listed("no_cluster", findings.where(F.coalesce("cluster_id", F.lit("")) == ""), "id", F.lit("")),
        listed("unknown_cluster", clustered.join(strange, "cluster_id", "left_semi"), "id", F.col("cluster_id")),
        # A blocker without an id leads nowhere as well.
        listed("missing_blocker", blockers.join(gone, F.col("id").eqNullSafe(F.col("ref")), "left_semi"), "id", F.col("tier")),
        listed("fail_without_blocker", tiers.where("status = 'FAIL'").join(blockers.select("tier").distinct(), "tier", "left_anti"), "tier", F.lit("")),
    ]
    return reduce(DataFrame.unionByName, found)


def _counted(findings: DataFrame) -> DataFrame:
    """(measure, value, n): everything a published statistic can be compared with."""
    def group(measure, key):
        return findings.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), "value", "n")

    total = findings.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("measure"), F.lit("").alias("value"), "n")
    files = findings.agg(F.countDistinct("file").alias("n")).select(F.lit("affected_files").alias("measure"), F.lit("").alias("value"), "n")
    return (total.unionByName(files).unionByName(group("severity", F.coalesce("severity", F.lit("MEDIUM"))))
            .unionByName(group("phase", F.col("phase").cast("string"))))


def stats_mismatches(findings: DataFrame, published: DataFrame, tasks: DataFrame) -> DataFrame:
    """Published numbers(measure, value, n) and task counts per phase that differ from the findings:
    (source, measure, value, declared, derived)."""
    derived = _counted(findings).withColumnRenamed("n", "derived")
    per_phase = tasks.groupBy(F.col("phase").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("declared"))
    declared = (published.select(F.lit("stats").alias("source"), "measure", "value", F.col("n").alias("declared"))
                .unionByName(per_phase.select(F.lit("tasks").alias("source"), F.lit("phase").alias("measure"), "value", "declared")))
    wanted = derived.withColumn("source", F.explode(F.when(F.col("measure") == "phase", F.split(F.lit("stats,tasks"), ",")).otherwise(F.split(F.lit("stats"), ","))))
    joined = wanted.join(declared, ["source", "measure", "value"], "full_outer")
    a, b = F.coalesce("declared", F.lit(0)), F.coalesce("derived", F.lit(0))
    return joined.where(a != b).select("source", "measure", "value", a.alias("declared"), b.alias("derived"))


# ------------------------------------------------------------------------------ parts and merge
def valid_part(parts: DataFrame) -> Column:
    """Whether an impact part(cluster_id, cluster_label, analyzed_at, source_files_read, read_count, findings,
    strategy, fix_order) is whole and consistent."""
    def text(name):
        return F.trim(F.coalesce(name, F.lit(""))) != ""

    ids = F.transform("findings", lambda f: f["finding_id"])
    return F.coalesce(
        text("cluster_label") & text("analyzed_at") & (F.size("source_files_read") > 0) & (F.col("read_count") >= F.size("source_files_read"))
        & (F.size("findings") > 0)
        & ~F.exists("findings", lambda f: (F.trim(F.coalesce(f["finding_id"], F.lit(""))) == "") | (F.trim(F.coalesce(f["file"], F.lit(""))) == "") | F.coalesce(f["line"] <= 0, F.lit(True)))
        & F.col("strategy").isin(STRATEGIES) & (F.size(F.array_except("fix_order", ids)) == 0), F.lit(False))


# Strategies an approach may name.
STRATEGIES = ["extract_and_replace", "inline_fix", "refactor_pattern", "config_centralize", "wrap_and_deprecate"]


def part_status(expected: DataFrame, parts: DataFrame) -> DataFrame:
    """Per expected cluster: completed, invalid or missing."""
    judged = parts.withColumn("ok", valid_part(parts)).groupBy("cluster_id").agg(F.bool_and("ok").alias("ok"))
    return expected.join(judged, "cluster_id", "left").select(
        "cluster_id", F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "completed").otherwise("invalid").alias("status"))


def part_summary(status: DataFrame) -> DataFrame:
    made = status.agg(F.count(F.lit(1)).alias("expected"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "invalid", "missing")])
    return made.withColumn("complete", (F.col("expected") > 0) & (F.col("completed") == F.col("expected")))


def stale(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """Whether merged rows no longer match their parts: (parts_findings, merged_findings, newest_part, merged_at, stale).

    parts(cluster_id, findings, modified); merged(cluster_id, modified)."""
    a = parts.agg(F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("parts_findings"),
                  F.countDistinct("cluster_id").alias("part_clusters"), F.max("modified").alias("newest_part"))
    b = merged.agg(F.count(F.lit(1)).alias("merged_findings"), F.countDistinct("cluster_id").alias("merged_clusters"), F.min("modified").alias("merged_at"))
    return beside(a, b).withColumn("stale", F.col("merged_at").isNull() | (F.col("parts_findings") != F.col("merged_findings"))
                                   | (F.col("part_clusters") != F.col("merged_clusters")) | (F.col("newest_part") > F.col("merged_at")))


def impact_rows(parts: DataFrame) -> DataFrame:
    """Findings of all parts with their part's header."""
    header = [c for c in parts.columns if c != "findings"]
    return parts.select(*header, F.explode("findings").alias("f")).select("f.*", *header)


def cluster_impacts(clusters: DataFrame, impacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Clusters with their impact rows and the severity of each row's finding; clusters without rows are kept."""
    rows = impacts.join(findings.select(F.col("id").alias("finding_id"), F.col("severity").alias("_s")), "finding_id", "left")
    return (clusters.join(rows, "cluster_id", "left")
            .withColumn("severity", F.when(F.col("finding_id").isNotNull(), F.coalesce("_s", F.lit("MEDIUM")))).drop("_s"))


# --------------------------------------------------------------------------------- evidence
def evidence_freshness(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded hashes against the files now: (req_id, path, state)."""
    current = files.select("path", F.sha2("content", 256).alias("now"))
    joined = evidence.join(current, "path", "left")
    state = first_match([(F.col("now").isNull(), "FILE NOT FOUND"), (F.col("now") != F.col("content_sha256"), "HASH MISMATCH")], "OK")
    return joined.select("req_id", "path", state.alias("state"))


def evidence_sample_size(total: Column) -> Column:
    return F.when(total <= 20, total).when(total <= 100, 10).otherwise(20)


def snippet_sample_size(total: Column) -> Column:
    return F.least(F.greatest(F.lit(10), F.least(F.lit(50), F.floor(total / 10))), total)


def sampled(frame: DataFrame, key: str, size) -> DataFrame:
    """A fixed sample: the rows whose key hashes lowest, as many as ``size(total)`` says."""
    total = frame.agg(size(F.count(F.lit(1))).alias("n"))
    placed = numbered(frame.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)), [], [F.col("_h"), F.col(key)], "_p")
    return beside(placed, total).where(F.col("_p") <= F.col("n")).drop("_h", "_p", "n")


def unverified_phases(completed: DataFrame, verified: DataFrame) -> DataFrame:
    """Completed phases without verification, the next one marked."""
    left = completed.select("phase").distinct().join(verified.select("phase").distinct(), "phase", "left_anti")
    first = left.agg(F.min("phase").alias("first"))
    return beside(left, first).select("phase", (F.col("phase") == F.col("first")).alias("next"))


def first_blocking(checks: DataFrame, per: str) -> DataFrame:
    """checks(per, gate, position, blocked): the first gate that blocks, per key."""
    return checks.where("blocked").groupBy(per).agg(F.min_by("gate", "position").alias("blocked_at"))


def adjusted_severity(findings: DataFrame, raises: Column, lowers: Column) -> DataFrame:
    return findings.withColumn("adjusted_severity", severity.adjusted(F.col("severity"), raises, lowers))
