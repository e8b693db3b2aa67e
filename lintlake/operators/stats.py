"""Statistics, matrices and orderings over the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.catalog import maps as M
from lintlake.functions import severity, text
from lintlake.functions.lookup import first_match, literal_array, lookup
from lintlake.functions.rows import beside


def rows() -> Column:
    return F.count(F.lit(1))


def levels(*names: str) -> list[Column]:
    return [severity.counted(F.col("severity"), n).alias(n.lower()) for n in (names or M.SEVERITIES)]


def severity_counts(findings: DataFrame) -> DataFrame:
    """All five levels with their counts, zeros included; unknown levels are left out."""
    spark = findings.sparkSession
    every = spark.range(1).select(F.explode(literal_array(M.SEVERITIES)).alias("severity"))
    counts = findings.groupBy(F.coalesce("severity", F.lit("MEDIUM")).alias("severity")).agg(rows().alias("n"))
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def severity_percent(findings: DataFrame) -> DataFrame:
    """Counts per level with their share of all findings."""
    counts = severity_counts(findings)  # five rows
    return counts.withColumn("percent", text.percent(F.col("findings"), F.sum("findings").over(Window.partitionBy(F.lit(1)))))


def categories(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(rows().alias("findings"), *levels())


def layers(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """Findings per layer with the layer's files, lines and density; totals(layer, files, loc)."""
    counts = findings.groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(rows().alias("findings"))
    loc = F.coalesce("loc", F.lit(0))
    return counts.join(totals, "layer", "left").select(
        "layer", F.coalesce("files", F.lit(0)).alias("files"), loc.cast("long").alias("loc"), "findings",
        text.density(F.col("findings"), loc).alias("density_per_kloc"))


def phases(findings: DataFrame) -> DataFrame:
    """Findings per phase; a phase that is no number counts as 0."""
    phase = F.coalesce(F.col("phase").try_cast("int") if dict(findings.dtypes)["phase"] == "string" else F.col("phase"), F.lit(0))
    counts = findings.groupBy(phase.alias("phase")).agg(rows().alias("findings"), *levels("CRITICAL", "HIGH"))
    return counts.withColumn("name", severity.phase_name(F.col("phase")))


def scanners(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("scanner", F.lit("unknown")).alias("scanner")).agg(rows().alias("findings"))


def rules(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy(F.coalesce("rule", F.lit("UNKNOWN")).alias("rule")).agg(rows().alias("findings"))
    return counts.withColumn("name", severity.rule_name(F.col("rule")))


def affected_files(findings: DataFrame) -> DataFrame:
    return findings.agg(F.countDistinct(F.nullif("file", F.lit(""))).alias("affected_files"))


def cross_cutting_stats(findings: DataFrame) -> DataFrame:
    inside = F.count_if(F.coalesce("cross_cutting", F.lit(False)))
    return findings.agg(
        inside.alias("total_findings_in_groups"),
        F.countDistinct(F.when(F.col("cross_cutting"), F.nullif("cross_cutting_group", F.lit("")))).alias("total_groups"),
        text.percent(inside, rows()).alias("percent_cross_cutting"))


def enrichment(findings: DataFrame) -> DataFrame:
    """How many findings come with code, with a plan, with either."""
    code = (F.coalesce("current_code", F.lit("")) != "") | (F.coalesce("target_code", F.lit("")) != "")
    plan = F.coalesce(F.size("fix_plan") > 0, F.lit(False)) if "fix_plan" in findings.columns else F.lit(False)
    either = F.count_if(code | plan)
    return findings.agg(F.count_if(code).alias("has_target_code"), F.count_if(plan).alias("has_fix_plan"), either.alias("has_either"),
                        F.count_if(~(code | plan)).alias("has_neither"), text.percent(either, rows()).alias("enrichment_rate_percent"))


def hotspots(findings: DataFrame, n: int = 10) -> DataFrame:
    """The files with the most findings."""
    return (findings.groupBy(F.coalesce("file", F.lit("unknown")).alias("file")).agg(rows().alias("findings"))
            .orderBy(F.desc("findings"), "file").limit(n))


def densest_files(findings: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """The files with the most findings per thousand lines."""
    counts = findings.groupBy("file").agg(rows().alias("findings"))
    joined = counts.join(files.select(F.col("path").alias("file"), "loc"), "file").where(F.col("loc") > 0)
    return (joined.withColumn("density", F.round(F.col("findings") / (F.col("loc") / 1000.0), 1))
            .orderBy(F.desc("density"), "file").limit(n))


def cross_cutting_summary(findings: DataFrame) -> DataFrame:
    """Per group name: findings, layers and worst severity."""
    inside = findings.where(F.col("cross_cutting") & (F.coalesce("cross_cutting_group", F.lit("")) != ""))
    return (inside.groupBy("cross_cutting_group").agg(
        rows().alias("findings"), F.countDistinct("layer").alias("layers"), F.min("rule").alias("rule"),
        severity.of_rank(F.min(severity.rank(F.coalesce("severity", F.lit("LOW")), 4))).alias("highest_severity")))


def ordered_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("findings"), "cross_cutting_group")


# -------------------------------------------------------------------------------- matrices
def rule_layer_matrix(findings: DataFrame, rule_names: list[str]) -> DataFrame:
    """One row per layer, one column per rule: PASS, WARN(n) up to five findings, FAIL(n) beyond."""
    counts = findings.groupBy("layer").agg(*[F.count_if(F.col("rule") == r).alias(r) for r in rule_names])

    def cell(name):
        n = F.col(name)
        shown = n.cast("string")
        return (F.when(n == 0, "PASS").when(n <= 5, F.concat(F.lit("WARN("), shown, F.lit(")")))
                .otherwise(F.concat(F.lit("FAIL("), shown, F.lit(")")))).alias(name)

    return counts.select("layer", *[cell(r) for r in rule_names])


def compliance(findings: DataFrame, layer_names: DataFrame) -> DataFrame:
    """All rules by all layers with totals: (rule, layer, findings, verdict); 'Total' stands for all.

    The frame is fixed rules times the layers of the inventory; counts come from a cube."""
    spark = findings.sparkSession
    every = M.SCANNABLE_RULES + M.PROCESS_RULES + ["Total"]
    totals = spark.range(1).select(F.lit("Total").alias("layer"))
    # A handful of layers; each is paired with the fixed list of rules by exploding the list.
    frame = layer_names.select("layer").distinct().unionByName(totals).select("layer", F.explode(literal_array(every)).alias("rule"))
    known = findings.join(layer_names.select("layer").distinct(), "layer", "left_semi")
    cube = known.cube("rule", "layer").agg(rows().alias("n")).select(
        F.coalesce("rule", F.lit("Total")).alias("rule"), F.coalesce("layer", F.lit("Total")).alias("layer"), "n")
    n = F.coalesce("n", F.lit(0))
    return frame.join(cube, ["rule", "layer"], "left").select(
        "rule", "layer", F.when(~F.col("rule").isin(M.PROCESS_RULES), n).alias("findings"),
        F.when(F.col("rule").isin(M.PROCESS_RULES), "N/A").when(n == 0, "PASS")
        .otherwise(F.concat(F.lit("FAIL ("), n.cast("string"), F.lit(")"))).alias("verdict"))


def rule_severities(findings: DataFrame) -> DataFrame:
    """All scannable rules with their severity counts."""
    spark = findings.sparkSession
    every = spark.range(1).select(F.explode(literal_array(M.SCANNABLE_RULES)).alias("rule"))
    counts = findings.groupBy("rule").agg(rows().alias("violations"), *levels())
    names = ["violations", *[s.lower() for s in M.SEVERITIES]]
    return every.join(counts, "rule", "left").select("rule", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def key_metrics(findings: DataFrame, totals: DataFrame, files: DataFrame) -> DataFrame:
    """One row: densities, extremes, clean layers and rules, shares."""
    per_layer = layers(findings, totals).select("layer", "density_per_kloc")
    all_layers = totals.join(per_layer, "layer", "left").select("layer", F.coalesce("density_per_kloc", F.lit(0.0)).alias("d"))
    layer_row = all_layers.agg(F.min_by("layer", F.struct(-F.col("d"), "layer")).alias("highest_layer"),
                               F.min_by("layer", F.struct("d", "layer")).alias("lowest_layer"),
                               F.count_if(F.col("d") == 0).alias("clean_layers"), rows().alias("layers"))
    loc = totals.agg(F.sum("loc").alias("loc"))
    total = findings.agg(rows().alias("findings"), *levels("CRITICAL", "HIGH"),
                         F.count_if(F.col("category") == "security").alias("security"),
                         F.count_if(F.col("category") == "typing").alias("typing"),
                         F.countDistinct(F.when(F.col("rule").isin(M.SCANNABLE_RULES), F.col("rule"))).alias("dirty_rules"))
    top = densest_files(findings, files, 1).select(F.col("file").alias("densest_file"), F.col("density").alias("densest_file_density"))
    joined = beside(beside(beside(total, loc), layer_row), top)
    n = F.col("findings")
    return joined.select(
        "findings", F.round(n / F.greatest(F.col("loc") / 1000.0, F.lit(0.1)), 1).alias("density"), "highest_layer", "lowest_layer",
        "densest_file", "densest_file_density", "clean_layers", "layers", (F.lit(len(M.SCANNABLE_RULES)) - F.col("dirty_rules")).alias("clean_rules"),
        "critical", "high", text.percent(F.col("critical") + F.col("high"), n).alias("critical_high_percent"),
        text.percent(F.col("security"), n).alias("security_percent"), text.percent(F.col("typing"), n).alias("typing_percent"))


def readiness_gates(findings: DataFrame) -> DataFrame:
    """The five yes/no gates: (gate, status, findings in the way)."""
    grave = F.col("severity").isin("CRITICAL", "HIGH")
    critical = F.col("severity") == "CRITICAL"
    blockers = {
        "Production-safe": critical | (grave & (F.col("category") == "security")),
        "CRITICAL-free": critical,
        "Security-clean": F.col("category") == "security",
        "Type-safe": grave & (F.col("category") == "typing"),
        "Build-clean": F.col("rule") == "R14",
    }
    counted = findings.agg(*[F.count_if(test).alias(name) for name, test in blockers.items()])
    gates = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("blocking")) for n in blockers])
    return counted.select(F.explode(gates).alias("g")).select(
        "g.gate", F.when(F.col("g.blocking") == 0, "YES").otherwise("NO").alias("status"), "g.blocking")


def layer_health(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """Every layer with its status and the rule it breaks most."""
    per_rule = findings.groupBy("layer", "rule").agg(rows().alias("n"), severity.counted(F.col("severity"), "CRITICAL").alias("c"))
    per_layer = per_rule.groupBy("layer").agg(F.sum("n").alias("findings"), F.sum("c").alias("critical"),
                                              F.min_by(F.struct("rule", "n"), F.struct((-F.col("n")).alias("n"), "rule")).alias("top"))
    joined = totals.join(per_layer, "layer", "left")
    n, c = F.coalesce("findings", F.lit(0)), F.coalesce("critical", F.lit(0))
    density = text.density(n, F.col("loc"))
    status = first_match([(n == 0, "CLEAN"), ((density >= 8.0) | (c >= 3), "CRITICAL"),
                          ((density >= 3.0) | (c > 0), "NEEDS ATTENTION")], "ACCEPTABLE")
    shown = F.concat("top.rule", F.lit(" ("), F.col("top.n").cast("string"), F.lit(")"))
    return joined.select("layer", "files", "loc", n.alias("findings"), density.alias("density"),
                         F.coalesce(shown, F.lit("--")).alias("top_rule"), status.alias("status"))


def readiness_band(score: Column) -> Column:
    return F.when(score >= 95, "Production Ready").when(score >= 80, "Needs Attention").otherwise("Blocked")


def themes(findings: DataFrame) -> DataFrame:
    """Findings per theme with files and grave findings."""
    theme = lookup(M.CATEGORY_THEME, F.col("category"))
    return (findings.withColumn("theme", theme).where(F.col("theme").isNotNull()).groupBy("theme")
            .agg(rows().alias("findings"), *levels("CRITICAL", "HIGH"), F.countDistinct("file").alias("files")))


def top_per_theme(findings: DataFrame, n: int = 5) -> DataFrame:
    """The worst findings of each theme by severity and multiplier.

    ``row_number() <= n`` is cut map-side first, so a large theme costs its task only n rows per map task."""
    theme = lookup(M.CATEGORY_THEME, F.col("category"))
    order = Window.partitionBy("theme").orderBy(severity.rank(F.col("severity")), F.desc("severity_multiplier"), "id")
    return (findings.withColumn("theme", theme).where(F.col("theme").isNotNull())
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
            .select("theme", "position", "id", "effective_severity"))


def profile(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files with and without findings, density and its band."""
    hit = findings.select(F.col("file").alias("path")).distinct().withColumn("hit", F.lit(True))
    counted = files.join(hit, "path", "left").agg(rows().alias("files"), F.count("hit").alias("files_with_findings"), F.sum("loc").cast("long").alias("loc"))
    total = findings.agg(rows().alias("findings"))
    density = F.round(F.col("findings") / F.greatest(F.col("loc") / 1000.0, F.lit(0.1)), 1)
    band = F.when(density < 2, "clean").when(density <= 5, "typical").when(density <= 10, "needs attention").otherwise("alarming")
    return beside(counted, total).select(
        "files", "loc", "findings", "files_with_findings", (F.col("files") - F.col("files_with_findings")).alias("clean_files"),
        text.percent(F.col("files_with_findings"), F.col("files")).alias("percent_with_findings"), density.alias("density"), band.alias("band"))


# ---------------------------------------------------------------------------- across services
def service_heatmap(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """Severities per service with a grand total; totals(service, loc)."""
    counts = findings.rollup("service").agg(*levels(), rows().alias("total")).withColumn("service", F.coalesce("service", F.lit("Total")))
    loc = totals.rollup("service").agg(F.sum("loc").cast("long").alias("loc")).withColumn("service", F.coalesce("service", F.lit("Total")))
    return counts.join(loc, "service", "left").withColumn("density_per_kloc", text.density(F.col("total"), F.coalesce("loc", F.lit(0))))


def shared_rules(findings: DataFrame, at_least: int = 2) -> DataFrame:
    """Rules broken in several services, per service: counts, severity range and an example."""
    rank = severity.rank(F.col("severity"))
    per = findings.groupBy("rule", "service").agg(rows().alias("findings"), F.min(rank).alias("worst"), F.max(rank).alias("mildest"), F.min("id").alias("example"))
    spread = per.groupBy("rule").agg(F.count(F.lit(1)).alias("services"), F.sum("findings").alias("instances")).where(F.col("services") >= at_least)
    return per.join(spread, "rule").select(
        "rule", "service", "services", "instances", "findings", severity.of_rank(F.col("mildest")).alias("min_severity"),
        severity.of_rank(F.col("worst")).alias("max_severity"), "example")


def service_order(findings: DataFrame, totals: DataFrame, calls: DataFrame) -> DataFrame:
    """Services in the order to fix them: CRITICAL density, consumers, and mostly-LOW ones last.
    calls(service, consumer)."""
    counts = findings.groupBy("service").agg(*levels("CRITICAL", "LOW"), rows().alias("total"))
    loc = totals.groupBy("service").agg(F.sum("loc").alias("loc"))
    consumers = calls.where(F.col("service") != F.col("consumer")).groupBy("service").agg(F.countDistinct("consumer").alias("consumers"))
    joined = (counts.join(loc, "service").join(consumers, "service", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))
              .withColumn("critical_density", text.density(F.col("critical"), F.col("loc")))
              .withColumn("mostly_low", F.col("low") * 2 > F.col("total")))
    # One row per service by now.
    order = Window.partitionBy(F.lit(1)).orderBy("mostly_low", F.desc("critical_density"), F.desc("consumers"), "service")
    return joined.select("service", "critical_density", "consumers", "mostly_low", F.row_number().over(order).alias("priority"))


def version_mismatches(manifests: DataFrame) -> DataFrame:
    """Dependencies that services use in differing versions; manifests(service, dependency, version)."""
    versions = manifests.select("dependency", "service", "version").distinct()
    mixed = versions.groupBy("dependency").agg(F.countDistinct("version").alias("versions")).where(F.col("versions") > 1)
    return versions.join(mixed, "dependency").select("dependency", "service", "version", "versions")


# -------------------------------------------------------------------------------- orderings
def must_fix(findings: DataFrame) -> DataFrame:
    """Grave findings and family roots."""
    root = F.coalesce("is_root_cause", F.lit(False)) if "is_root_cause" in findings.columns else F.lit(False)
    return findings.where(F.col("severity").isin("CRITICAL", "HIGH") | root)


def severity_order() -> list[Column]:
    return [severity.rank(F.coalesce("severity", F.lit("MEDIUM"))), F.col("file"), F.coalesce("line", F.lit(0)), F.col("id")]


def must_fix_per_phase(findings: DataFrame) -> DataFrame:
    return must_fix(findings).groupBy(F.coalesce("phase", F.lit(M.LAST_PHASE)).alias("phase")).agg(rows().alias("must_fix"))


def top_risks(findings: DataFrame, n: int = 3) -> DataFrame:
    """The first critical findings; where there are none, the first of all.

    Critical ones sort first by severity, so one ordered limit finds either."""
    ranked = findings.orderBy(*severity_order()).limit(n)
    worst = ranked.agg(F.count_if(F.col("severity") == "CRITICAL").alias("criticals"))
    return beside(ranked, worst).where((F.col("criticals") == 0) | (F.col("severity") == "CRITICAL")).select("id", "severity", "description")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings per severity before and after."""
    b = before.groupBy("severity").agg(rows().alias("before"))
    a = after.groupBy("severity").agg(rows().alias("after"))
    return b.join(a, "severity", "full_outer").select(
        "severity", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"),
        (F.coalesce("before", F.lit(0)) - F.coalesce("after", F.lit(0))).alias("resolved"))
