"""Statistics, matrices, gate, trend and service tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog import maps as M
from lintlake.functions import severity as S, text as X
from lintlake.functions.rows import beside
from lintlake.operators import gate, graph, groups, stats
from lintlake.queries import views as V
from lintlake.queries.findings import GROUPED, NAMES, ROOT_RULES, FAMILY
from lintlake.queries.registry import query

LEVELS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in M.SEVERITIES)
GRAVE = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH"))
EVERY_LEVEL = "(SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'REVIEW']) AS severity)"


@query("severity_counts", V.sql("items", f"SELECT s.severity, count(i.rule) AS findings FROM {EVERY_LEVEL} s LEFT JOIN items i ON s.severity = i.severity GROUP BY 1"))
def severity_counts(spark, folder):
    return stats.severity_counts(V.items(spark, folder))


@query("severity_percent", V.sql("items", f"""SELECT severity, findings, round(findings * 100.0 / sum(findings) OVER (), 1) AS percent FROM (
  SELECT s.severity, count(i.rule) AS findings FROM {EVERY_LEVEL} s LEFT JOIN items i ON s.severity = i.severity GROUP BY 1)"""))
def severity_percent(spark, folder):
    return stats.severity_percent(V.items(spark, folder))


@query("severity_per_layer", V.sql("items", f"SELECT layer, {LEVELS} FROM items GROUP BY layer"))
def severity_per_layer(spark, folder):
    return V.items(spark, folder).groupBy("layer").agg(*stats.levels())


@query("category_breakdown", V.sql("items", f"SELECT {V.map_sql(M.RULE_CATEGORY, 'rule')} AS category, count(*) AS findings, {LEVELS} FROM items GROUP BY 1"))
def category_breakdown(spark, folder):
    raw = V.items(spark, folder)
    return stats.categories(raw.withColumn("category", S.normal_category(F.lit(None), F.col("rule"))))


LAYER_TOTALS = "SELECT layer, files, loc FROM layers"
DENSITY = "CASE WHEN loc > 0 THEN round({n} / greatest(loc / 1000.0, 0.1), 1) ELSE 0.0 END"


def totals(spark, folder):
    return V.layers(spark, folder).select("layer", "files", "loc")


@query("layer_density", V.sql("items layers", f"SELECT i.layer, coalesce(files, 0) AS files, coalesce(loc, 0) AS loc, findings, {DENSITY.format(n='findings')} AS density_per_kloc FROM (SELECT layer, count(*) AS findings FROM items GROUP BY 1) i LEFT JOIN layers l ON i.layer = l.layer"))
def layer_density(spark, folder):
    return stats.layers(V.items(spark, folder), totals(spark, folder))


@query("phase_breakdown", V.sql("findings", f"SELECT phase, {V.map_sql(M.PHASE_NAME, 'phase')} AS name, findings, critical, high FROM (SELECT CASE WHEN line % 50 = 0 THEN 0 ELSE phase END AS phase, count(*) AS findings, {GRAVE} FROM findings GROUP BY 1)"))
def phase_breakdown(spark, folder):
    text_phase = F.when(F.col("line") % 50 == 0, "unknown").otherwise(F.col("phase").cast("string"))
    return stats.phases(V.findings(spark, folder).withColumn("phase", text_phase))


@query("scanner_breakdown", V.sql("items", "SELECT scanner, count(*) AS findings FROM items GROUP BY 1"))
def scanner_breakdown(spark, folder):
    return stats.scanners(V.items(spark, folder))


@query("rule_breakdown", V.sql("items", f"SELECT rule, count(*) AS findings, {V.map_sql(M.RULE_NAME, 'rule', 'rule')} AS name FROM items GROUP BY 1"))
def rule_breakdown(spark, folder):
    return stats.rules(V.items(spark, folder))


@query("affected_files", V.sql("items", "SELECT count(DISTINCT file) AS affected_files FROM items"))
def affected_files(spark, folder):
    return stats.affected_files(V.items(spark, folder))


CROSSED = """SELECT c.*, g."group" AS cross_cutting_group FROM crossed c LEFT JOIN groups g ON c.rule = g.rule AND c.pattern = g.pattern"""


def crossed(spark, folder):
    return groups.cross_cutting(V.findings(spark, folder))


@query("cross_cutting_stats", V.sql("findings", "SELECT count(cross_cutting_group) AS total_findings_in_groups, count(DISTINCT cross_cutting_group) AS total_groups, round(count(cross_cutting_group) * 100.0 / count(*), 1) AS percent_cross_cutting FROM marked", **GROUPED, marked=CROSSED))
def cross_cutting_stats(spark, folder):
    return stats.cross_cutting_stats(crossed(spark, folder))


SUMMARY = f"SELECT cross_cutting_group, count(*) AS findings, count(DISTINCT layer) AS layers, min(rule) AS rule, {NAMES.format('min(' + V.rank_sql('severity') + ')')} AS highest_severity FROM marked WHERE cross_cutting_group IS NOT NULL GROUP BY 1"


@query("cross_cutting_summary", V.sql("findings", SUMMARY, **GROUPED, marked=CROSSED))
def cross_cutting_summary(spark, folder):
    return stats.ordered_groups(stats.cross_cutting_summary(crossed(spark, folder)))


@query("enrichment_stats", V.sql("findings", """SELECT count(*) FILTER (WHERE c) AS has_target_code, count(*) FILTER (WHERE p) AS has_fix_plan, count(*) FILTER (WHERE c OR p) AS has_either,
  count(*) FILTER (WHERE NOT (c OR p)) AS has_neither, round(count(*) FILTER (WHERE c OR p) * 100.0 / count(*), 1) AS enrichment_rate_percent
  FROM (SELECT line % 3 = 0 OR target_code IS NOT NULL AS c, line % 4 = 0 AS p FROM findings)"""))
def enrichment_stats(spark, folder):
    plan = F.when(F.col("line") % 4 == 0, F.array(F.lit("step"))).otherwise(F.array().cast("array<string>"))
    found = V.findings(spark, folder).withColumn("fix_plan", plan).withColumn("current_code", F.when(F.col("line") % 3 == 0, F.col("current_code")))
    return stats.enrichment(found)


@query("hotspots", V.sql("items", "SELECT file, count(*) AS findings FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def hotspots(spark, folder):
    return stats.hotspots(V.items(spark, folder))


DENSEST = "SELECT file, findings, loc, round(findings / (loc / 1000.0), 1) AS density FROM (SELECT file, count(*) AS findings FROM items GROUP BY 1) JOIN parts ON file = path WHERE loc > 0 ORDER BY density DESC, file LIMIT 10"


@query("densest_files", V.sql("items parts", DENSEST))
def densest_files(spark, folder):
    return stats.densest_files(V.items(spark, folder), V.parts(spark, folder))


# --------------------------------------------------------------------------------- matrices
CELLS = ", ".join(f"CASE WHEN n_{r} = 0 THEN 'PASS' WHEN n_{r} <= 5 THEN concat('WARN(', cast(n_{r} AS varchar), ')') ELSE concat('FAIL(', cast(n_{r} AS varchar), ')') END AS \"{r}\"" for r in M.SCANNABLE_RULES)
CELL_COUNTS = ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS n_{r}" for r in M.SCANNABLE_RULES)


# Two hundred areas per layer, so that a cell holds none, a few or many findings.
AREA = "concat(layer, '/', line % 200)"


@query("rule_layer_matrix", V.sql("items", f"SELECT layer, {CELLS} FROM (SELECT {AREA} AS layer, {CELL_COUNTS} FROM items GROUP BY 1)"))
def rule_layer_matrix(spark, folder):
    return stats.rule_layer_matrix(V.items(spark, folder).withColumn("layer", F.expr(AREA)), M.SCANNABLE_RULES)


EVERY_RULE = "[" + ", ".join(f"'{r}'" for r in M.SCANNABLE_RULES + M.PROCESS_RULES + ["Total"]) + "]"
PROCESS = "(" + ", ".join(f"'{r}'" for r in M.PROCESS_RULES) + ")"


@query("compliance_cube", V.sql("items layers", f"""
SELECT f.rule, f.layer, CASE WHEN f.rule IN {PROCESS} THEN NULL ELSE coalesce(n, 0) END AS findings,
  CASE WHEN f.rule IN {PROCESS} THEN 'N/A' WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE concat('FAIL (', cast(n AS varchar), ')') END AS verdict
FROM (SELECT layer, unnest({EVERY_RULE}) AS rule FROM (SELECT DISTINCT layer FROM areas UNION ALL SELECT 'Total')) f
LEFT JOIN (SELECT coalesce(rule, 'Total') AS rule, coalesce(layer, 'Total') AS layer, count(*) AS n FROM (SELECT rule, {AREA} AS layer FROM items) WHERE layer IN (SELECT layer FROM areas) GROUP BY CUBE (rule, layer)) c
  ON f.rule = c.rule AND f.layer = c.layer""", areas="SELECT concat(layer, '/', cast(area AS varchar)) AS layer FROM (SELECT layer, unnest(range(200)) AS area FROM layers)"))
def compliance_cube(spark, folder):
    areas = V.layers(spark, folder).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda n: F.concat("layer", F.lit("/"), n.cast("string")))).alias("layer"))
    return stats.compliance(V.items(spark, folder).withColumn("layer", F.expr(AREA)), areas)


@query("rule_severities", V.sql("items", f"""SELECT r.rule, coalesce(violations, 0) AS violations, {', '.join(f'coalesce({s.lower()}, 0) AS {s.lower()}' for s in M.SEVERITIES)}
  FROM (SELECT unnest([{', '.join(f"'{r}'" for r in M.SCANNABLE_RULES)}]) AS rule) r LEFT JOIN (SELECT rule, count(*) AS violations, {LEVELS} FROM items GROUP BY 1) i ON r.rule = i.rule"""))
def rule_severities(spark, folder):
    return stats.rule_severities(V.items(spark, folder))


@query("key_metrics", V.sql("findings parts layers", f"""
WITH d AS (SELECT l.layer, {DENSITY.format(n='coalesce(n, 0)')} AS d FROM layers l LEFT JOIN (SELECT layer, count(*) AS n FROM findings GROUP BY 1) f ON l.layer = f.layer),
top AS (SELECT file, round(count(*) / (any_value(loc) / 1000.0), 1) AS density FROM findings JOIN parts ON file = path GROUP BY file ORDER BY 2 DESC, 1 LIMIT 1)
SELECT count(*) AS findings, round(count(*) / greatest((SELECT sum(loc) FROM layers) / 1000.0, 0.1), 1) AS density, (SELECT layer FROM d ORDER BY d DESC, layer LIMIT 1) AS highest_layer,
  (SELECT layer FROM d ORDER BY d, layer LIMIT 1) AS lowest_layer, (SELECT file FROM top) AS densest_file, (SELECT density FROM top) AS densest_file_density,
  (SELECT count(*) FROM d WHERE d = 0) AS clean_layers, (SELECT count(*) FROM d) AS layers, 14 - count(DISTINCT rule) AS clean_rules, {GRAVE},
  round(count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) * 100.0 / count(*), 1) AS critical_high_percent,
  round(count(*) FILTER (WHERE category = 'security') * 100.0 / count(*), 1) AS security_percent, round(count(*) FILTER (WHERE category = 'typing') * 100.0 / count(*), 1) AS typing_percent FROM findings"""))
def key_metrics(spark, folder):
    return stats.key_metrics(V.findings(spark, folder), totals(spark, folder), V.parts(spark, folder))


@query("readiness_gates", V.sql("findings", """SELECT gate, CASE WHEN blocking = 0 THEN 'YES' ELSE 'NO' END AS status, blocking FROM (
  SELECT 'Production-safe' AS gate, count(*) FILTER (WHERE severity = 'CRITICAL' OR severity = 'HIGH' AND category = 'security') AS blocking FROM findings
  UNION ALL SELECT 'CRITICAL-free', count(*) FILTER (WHERE severity = 'CRITICAL') FROM findings UNION ALL SELECT 'Security-clean', count(*) FILTER (WHERE category = 'security') FROM findings
  UNION ALL SELECT 'Type-safe', count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH') AND category = 'typing') FROM findings UNION ALL SELECT 'Build-clean', count(*) FILTER (WHERE rule = 'R14') FROM findings)"""))
def readiness_gates(spark, folder):
    return stats.readiness_gates(V.findings(spark, folder))


@query("layer_health", V.sql("findings layers", f"""
WITH per AS (SELECT CASE WHEN length(layer) % 3 = 0 THEN 'elsewhere' ELSE layer END AS layer, rule, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c FROM findings GROUP BY 1, 2),
lay AS (SELECT layer, sum(n) AS findings, sum(c) AS critical, arg_min({{'rule': rule, 'n': n}}, (-n, rule)) AS top FROM per GROUP BY 1)
SELECT l.layer, files, loc, cast(coalesce(findings, 0) AS bigint) AS findings, {DENSITY.format(n='coalesce(findings, 0)')} AS density,
  coalesce(top.rule || ' (' || cast(top.n AS varchar) || ')', '--') AS top_rule,
  CASE WHEN coalesce(findings, 0) = 0 THEN 'CLEAN' WHEN {DENSITY.format(n='coalesce(findings, 0)')} >= 8 OR critical >= 3 THEN 'CRITICAL' WHEN {DENSITY.format(n='coalesce(findings, 0)')} >= 3 OR critical > 0 THEN 'NEEDS ATTENTION' ELSE 'ACCEPTABLE' END AS status
FROM layers l LEFT JOIN lay ON l.layer = lay.layer"""))
def layer_health(spark, folder):
    found = V.findings(spark, folder).withColumn("layer", F.when(F.length("layer") % 3 == 0, "elsewhere").otherwise(F.col("layer")))
    return stats.layer_health(found, totals(spark, folder))


@query("theme_rollup", V.sql("findings", f"SELECT {V.map_sql(M.CATEGORY_THEME, 'category')} AS theme, count(*) AS findings, {GRAVE}, count(DISTINCT file) AS files FROM findings GROUP BY 1"))
def theme_rollup(spark, folder):
    return stats.themes(V.findings(spark, folder))


MULTIPLIED = """SELECT f.*, coalesce(n, 0) AS direct_callers, CASE WHEN coalesce(n, 0) >= 16 THEN 5 WHEN n >= 8 THEN 4 WHEN n >= 4 THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END AS severity_multiplier
FROM findings f LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM edges GROUP BY 1) e ON f.file = e.dst"""


def multiplied(spark, folder):
    return graph.with_multiplier(V.findings(spark, folder), V.edges(spark, folder))


@query("severity_multiplier", V.sql("findings edges", "SELECT id, direct_callers, severity_multiplier, concat(severity, '-x', cast(severity_multiplier AS varchar)) AS effective_severity FROM m", m=MULTIPLIED))
def severity_multiplier(spark, folder):
    return multiplied(spark, folder).select("id", "direct_callers", "severity_multiplier", "effective_severity")


@query("top_per_theme", V.sql("findings edges", f"""SELECT theme, cast(position AS int) AS position, id, effective_severity FROM (
  SELECT {V.map_sql(M.CATEGORY_THEME, 'category')} AS theme, id, concat(severity, '-x', cast(severity_multiplier AS varchar)) AS effective_severity,
    row_number() OVER (PARTITION BY {V.map_sql(M.CATEGORY_THEME, 'category')} ORDER BY {V.rank_sql('severity')}, severity_multiplier DESC, id) AS position FROM m) WHERE position <= 5""", m=MULTIPLIED))
def top_per_theme(spark, folder):
    return stats.top_per_theme(multiplied(spark, folder))


@query("codebase_profile", V.sql("findings parts", """SELECT files, loc, findings, w AS files_with_findings, files - w AS clean_files, round(w * 100.0 / files, 1) AS percent_with_findings, density,
  CASE WHEN density < 2 THEN 'clean' WHEN density <= 5 THEN 'typical' WHEN density <= 10 THEN 'needs attention' ELSE 'alarming' END AS band FROM (
  SELECT count(*) AS files, cast(sum(loc) AS bigint) AS loc, (SELECT count(*) FROM findings) AS findings, count(*) FILTER (WHERE path IN (SELECT file FROM findings)) AS w,
    round((SELECT count(*) FROM findings) / greatest(sum(loc) / 1000.0, 0.1), 1) AS density FROM parts)"""))
def codebase_profile(spark, folder):
    return stats.profile(V.findings(spark, folder), V.parts(spark, folder))


# ------------------------------------------------------------------------------- services
@query("service_heatmap", V.sql("items layers", f"""SELECT s.service, {', '.join(x.lower() for x in M.SEVERITIES)}, total, l.loc, {DENSITY.format(n='total').replace('loc', 'l.loc')} AS density_per_kloc FROM (
  SELECT coalesce(service, 'Total') AS service, {LEVELS}, count(*) AS total FROM items GROUP BY ROLLUP (service)) s
  LEFT JOIN (SELECT coalesce(service, 'Total') AS service, cast(sum(loc) AS bigint) AS loc FROM layers GROUP BY ROLLUP (service)) l ON s.service = l.service"""))
def service_heatmap(spark, folder):
    return stats.service_heatmap(V.items(spark, folder), V.layers(spark, folder).select("service", "loc"))


@query("densest_critical_service", V.sql("items layers", """SELECT s.service, round(critical / greatest(loc / 1000.0, 0.1), 1) AS critical_density FROM
  (SELECT service, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM items GROUP BY 1) s JOIN (SELECT service, sum(loc) AS loc FROM layers GROUP BY 1) l ON s.service = l.service
  ORDER BY 2 DESC, 1 LIMIT 1"""))
def densest_critical_service(spark, folder):
    heat = stats.service_heatmap(V.items(spark, folder), V.layers(spark, folder).select("service", "loc")).where("service <> 'Total'")
    return heat.select("service", X.density(F.col("critical"), F.col("loc")).alias("critical_density")).orderBy(F.desc("critical_density"), "service").limit(1)


@query("shared_rules", V.sql("findings", f"""SELECT p.rule, service, services, cast(instances AS bigint) AS instances, findings, {NAMES.format('mild')} AS min_severity, {NAMES.format('worst')} AS max_severity, example FROM (
  SELECT rule, service, count(*) AS findings, min({V.rank_sql('severity')}) AS worst, max({V.rank_sql('severity')}) AS mild, min(id) AS example FROM findings GROUP BY 1, 2) p
  JOIN (SELECT rule, count(DISTINCT service) AS services, count(*) AS instances FROM findings GROUP BY 1 HAVING count(DISTINCT service) >= 2) r ON p.rule = r.rule"""))
def shared_rules(spark, folder):
    return stats.shared_rules(V.findings(spark, folder))


@query("service_order", V.sql("items layers", """
WITH c AS (SELECT service, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS total FROM items GROUP BY 1),
l AS (SELECT service, sum(loc) AS loc FROM layers GROUP BY 1),
k AS (SELECT a.r_name AS service, count(DISTINCT b.r_name) AS consumers FROM calls JOIN region a ON callee = a.r_regionkey JOIN region b ON caller = b.r_regionkey WHERE a.r_name <> b.r_name GROUP BY 1),
x AS (SELECT c.service, round(critical / greatest(loc / 1000.0, 0.1), 1) AS critical_density, coalesce(consumers, 0) AS consumers, low * 2 > total AS mostly_low FROM c JOIN l ON c.service = l.service LEFT JOIN k ON c.service = k.service)
SELECT *, cast(row_number() OVER (ORDER BY mostly_low, critical_density DESC, consumers DESC, service) AS int) AS priority FROM x""",
                             calls="SELECT n_nationkey % 5 AS caller, n_regionkey AS callee FROM nation"))
def service_order(spark, folder):
    region = V.table(spark, folder, "region")
    calls = (V.table(spark, folder, "nation").select((F.col("n_nationkey") % 5).alias("caller"), F.col("n_regionkey").alias("callee"))
             .join(region.select(F.col("r_regionkey").alias("callee"), F.col("r_name").alias("service")), "callee")
             .join(region.select(F.col("r_regionkey").alias("caller"), F.col("r_name").alias("consumer")), "caller"))
    return stats.service_order(V.items(spark, folder), V.layers(spark, folder).select("service", "loc"), calls)


@query("version_mismatches", """WITH v AS (SELECT DISTINCT p_name AS dependency, p_type AS service, concat('1.', cast(p_size % 3 AS varchar)) AS version FROM part)
SELECT v.dependency, service, version, versions FROM v JOIN (SELECT dependency, count(DISTINCT version) AS versions FROM v GROUP BY 1 HAVING count(DISTINCT version) > 1) m ON v.dependency = m.dependency""")
def version_mismatches(spark, folder):
    made = V.table(spark, folder, "part").select(F.col("p_name").alias("dependency"), F.col("p_type").alias("service"),
                                                 F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string")).alias("version"))
    return stats.version_mismatches(made)


# ------------------------------------------------------------------------------- orderings
@query("severity_order", V.sql("findings", f"SELECT id, row_number() OVER (ORDER BY {V.rank_sql('severity')}, file, line, id) AS position FROM findings"))
def severity_order(spark, folder):
    from lintlake.operators.ordering import numbered
    return numbered(V.findings(spark, folder), [], stats.severity_order(), "position").select("id", "position")


@query("must_fix", V.sql("findings", "SELECT f.id, f.severity FROM findings f WHERE severity IN ('CRITICAL', 'HIGH') OR id IN (SELECT root_finding_id FROM families)", **FAMILY))
def must_fix(spark, folder):
    found = V.findings(spark, folder)
    marked = groups.collapse(found, groups.families(found, ROOT_RULES), ROOT_RULES)
    before = F.coalesce("original_severity", "severity")
    return stats.must_fix(marked.withColumn("severity", before)).select("id", "severity")


@query("must_fix_per_phase", V.sql("findings", "SELECT phase, count(*) AS must_fix FROM findings WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1"))
def must_fix_per_phase(spark, folder):
    return stats.must_fix_per_phase(V.findings(spark, folder))


@query("top_risks", V.sql("findings", "SELECT id, severity, description FROM findings WHERE severity = 'CRITICAL' ORDER BY file, line, id LIMIT 3"))
def top_risks(spark, folder):
    return stats.top_risks(V.findings(spark, folder))


@query("top_risks_without_critical", V.sql("findings", f"SELECT id, severity, description FROM findings WHERE severity <> 'CRITICAL' ORDER BY {V.rank_sql('severity')}, file, line, id LIMIT 3"))
def top_risks_without_critical(spark, folder):
    return stats.top_risks(V.findings(spark, folder).where("severity <> 'CRITICAL'"))


@query("layer_order", V.sql("items", "SELECT layer, count(*) AS findings, row_number() OVER (ORDER BY count(*) DESC, layer) AS position FROM items GROUP BY layer"))
def layer_order(spark, folder):
    from lintlake.operators.ordering import numbered
    counts = V.items(spark, folder).groupBy("layer").agg(F.count(F.lit(1)).alias("findings"))
    return numbered(counts, [], [-F.col("findings"), F.col("layer")], "position")


@query("before_after", V.sql("findings", """SELECT coalesce(b.severity, a.severity) AS severity, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(before, 0) - coalesce(after, 0) AS resolved FROM
  (SELECT severity, count(*) AS before FROM findings GROUP BY 1) b FULL OUTER JOIN (SELECT severity, count(*) AS after FROM findings WHERE target_code IS NULL AND severity <> 'REVIEW' GROUP BY 1) a ON b.severity = a.severity"""))
def before_after(spark, folder):
    found = V.findings(spark, folder)
    return stats.before_after(found, found.where("target_code IS NULL AND severity <> 'REVIEW'"))


# ------------------------------------------------------------------------------------ gate
WEIGHTED = "sum(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 2 ELSE 10 END) / 10.0"
SCORE = "round(greatest(0.0, least(100.0, 100.0 - {w} / greatest({loc} / 1000.0, 1.0))), 2)"


@query("readiness_score", V.sql("findings parts", f"SELECT count(*) AS findings, {SCORE.format(w=WEIGHTED, loc='(SELECT sum(loc) * 100 FROM parts)')} AS readiness_score FROM findings"))
def readiness_score(spark, folder):
    loc = V.parts(spark, folder).agg((F.sum("loc") * 100).alias("loc"))
    return gate.readiness(V.findings(spark, folder), loc)


@query("readiness_per_layer", V.sql("findings layers", f"SELECT layer, findings, {SCORE.format(w='w', loc='loc')} AS readiness_score, CASE WHEN {SCORE.format(w='w', loc='loc')} >= 95 THEN 'Production Ready' WHEN {SCORE.format(w='w', loc='loc')} >= 80 THEN 'Needs Attention' ELSE 'Blocked' END AS band FROM (SELECT f.layer, count(*) AS findings, {WEIGHTED} AS w, any_value(l.loc) AS loc FROM findings f JOIN (SELECT layer, loc * 100 AS loc FROM layers) l ON f.layer = l.layer GROUP BY f.layer)"))
def readiness_per_layer(spark, folder):
    sizes = V.layers(spark, folder).select("layer", (F.col("loc") * 100).alias("loc"))
    return gate.readiness_by(V.findings(spark, folder), sizes, "layer").withColumn("band", stats.readiness_band(F.col("readiness_score")))


HEALTH = "SELECT round(avg(value) * 4, 2) AS coverage_line_pct, round(avg(value), 2) AS duplication_pct FROM events"


def health(spark, folder):
    return V.table(spark, folder, "events").agg(F.round(F.avg("value") * 4, 2).alias("coverage_line_pct"), F.round(F.avg("value"), 2).alias("duplication_pct"))


def _tier_sql() -> str:
    rows = []
    for tier, rules in M.TIER_RULES.items():
        names = ", ".join(f"'{r}'" for r in rules)
        rows.append(f"SELECT '{tier}' AS tier, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'HIGH') AS h, count(*) AS n FROM gated WHERE rule IN ({names})")
    return " UNION ALL ".join(rows)


def _say(*parts):
    return "concat(" + ", ".join(parts) + ")"


TIERS = f"""SELECT tier, status, details, c AS critical, h AS high, n AS total,
  CASE WHEN status <> 'FAIL' OR tier = 'coverage' THEN 0 WHEN tier = 'security' AND c > 0 THEN c ELSE c + h END AS blockers FROM (
SELECT *, CASE tier WHEN 'build' THEN CASE WHEN c + h = 0 THEN 'PASS' WHEN c + h <= 5 THEN 'WARN' ELSE 'FAIL' END
  WHEN 'security' THEN CASE WHEN c + h > 0 THEN 'FAIL' ELSE 'PASS' END WHEN 'secrets' THEN CASE WHEN c + h > 0 THEN 'FAIL' WHEN n > 0 THEN 'WARN' ELSE 'PASS' END
  WHEN 'coverage' THEN CASE WHEN cov >= 60 THEN 'PASS' WHEN cov >= 48 THEN 'WARN' ELSE 'FAIL' END
  WHEN 'duplication' THEN CASE WHEN dup <= 5 THEN 'PASS' WHEN dup <= 7.5 THEN 'WARN' ELSE 'FAIL' END
  ELSE CASE WHEN n = 0 THEN 'PASS' WHEN c + h = 0 THEN 'WARN' ELSE 'FAIL' END END AS status,
 CASE tier WHEN 'build' THEN CASE WHEN c + h = 0 THEN concat('no grave build finding (', n, ' in all)') ELSE concat(c + h, ' grave build findings (', c, ' critical, ', h, ' high)') END
  WHEN 'security' THEN CASE WHEN c > 0 THEN concat(c, ' critical security findings (0 allowed)') WHEN h > 0 THEN concat(h, ' high security findings (0 allowed)') ELSE 'no grave security finding' END
  WHEN 'secrets' THEN CASE WHEN c + h > 0 THEN concat(c + h, ' grave findings on secrets (0 allowed)') WHEN n > 0 THEN concat(n, ' findings on settings, none grave') ELSE 'no finding on secrets' END
  WHEN 'coverage' THEN concat(printf('%.1f', round(cov, 1)), CASE WHEN cov >= 60 THEN '% of lines covered, 60% asked for' WHEN cov >= 48 THEN '% of lines covered, close to the 60% asked for' ELSE '% of lines covered, less than the 60% asked for' END)
  WHEN 'duplication' THEN concat(printf('%.1f', round(dup, 1)), CASE WHEN dup <= 5 THEN '% copied, 5.0% allowed' WHEN dup <= 7.5 THEN '% copied, a little more than the 5.0% allowed' ELSE '% copied, more than the 5.0% allowed' END)
  WHEN 'complexity' THEN CASE WHEN n = 0 THEN 'nothing too complex' WHEN c + h = 0 THEN concat(n, ' findings on complexity, none grave') ELSE concat(c + h, ' grave findings on complexity of ', n, ' in all') END
  ELSE CASE WHEN n = 0 THEN 'nothing against the architecture' WHEN c + h = 0 THEN concat(n, ' findings on architecture, none grave') ELSE concat(c + h, ' grave findings on architecture of ', n, ' in all') END END AS details
FROM ({_tier_sql()}), (SELECT coverage_line_pct AS cov, duplication_pct AS dup FROM health))"""
# Graver findings of some rules count as low, so that tiers end in different states.
GATED = "SELECT * REPLACE (CASE WHEN severity IN ('CRITICAL', 'HIGH') AND (rule IN ('R02', 'R03', 'R10') OR rule = 'R14' AND line > 2) THEN 'LOW' ELSE severity END AS severity) FROM findings"
GATE = dict(gated=GATED, health=HEALTH, tiers=TIERS)


def eased(found):
    light = F.col("severity").isin("CRITICAL", "HIGH") & (F.col("rule").isin("R02", "R03", "R10") | ((F.col("rule") == "R14") & (F.col("line") > 2)))
    return found.withColumn("severity", F.when(light, "LOW").otherwise(F.col("severity")))


def gated(spark, folder):
    return eased(V.findings(spark, folder))


@query("gate_tiers", V.sql("findings", "SELECT * FROM tiers", **GATE))
def gate_tiers(spark, folder):
    return gate.tiers(gated(spark, folder), health(spark, folder))


@query("gate_blockers", V.sql("findings", f"""SELECT t.tier, g.id FROM tiers t JOIN gated g ON g.severity IN ('CRITICAL', 'HIGH') AND ({' OR '.join(f"t.tier = '{t}' AND g.rule IN ({', '.join(chr(39) + r + chr(39) for r in rules)})" for t, rules in M.TIER_RULES.items())})
  WHERE t.status = 'FAIL' AND t.blockers > 0 AND (t.tier <> 'security' OR t.critical = 0 OR g.severity = 'CRITICAL')""", **GATE))
def gate_blockers(spark, folder):
    found = gated(spark, folder)
    return gate.blockers(found, gate.tiers(found, health(spark, folder)))


@query("gate_overall", V.sql("findings parts", f"""SELECT readiness_score, failed_tiers, CASE WHEN worst = 2 THEN 'FAIL' WHEN readiness_score < 80 AND readiness_score >= 64 THEN 'CONDITIONAL' WHEN readiness_score < 80 THEN 'FAIL' WHEN worst = 1 THEN 'CONDITIONAL' ELSE 'PASS' END AS overall FROM
  (SELECT max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS worst, count(*) FILTER (WHERE status = 'FAIL') AS failed_tiers FROM tiers),
  (SELECT {SCORE.format(w=WEIGHTED, loc='(SELECT sum(loc) * 100 FROM parts)')} AS readiness_score FROM gated)""", **GATE))
def gate_overall(spark, folder):
    found = gated(spark, folder)
    loc = V.parts(spark, folder).agg((F.sum("loc") * 100).alias("loc"))
    return gate.overall(gate.tiers(found, health(spark, folder)), gate.readiness(found, loc))


RUNS = "SELECT user_id AS repo, event_type AS tool, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'timeout' ELSE 'success' END AS status, event_id % 13 AS findings FROM events"


def runs(spark, folder):
    key = F.col("event_id")
    return V.table(spark, folder, "events").select(
        F.col("user_id").alias("repo"), F.col("event_type").alias("tool"),
        F.when(key % 5 == 0, "failed").when(key % 5 == 1, "skipped").when(key % 5 == 2, "timeout").otherwise("success").alias("status"), (key % 13).alias("findings"))


TOOL_COUNTS = """count(*) AS tools_available, count(*) FILTER (WHERE status = 'success') AS tools_succeeded, count(*) FILTER (WHERE status = 'skipped') AS tools_skipped,
  count(*) FILTER (WHERE status = 'failed') AS tools_failed, count(*) FILTER (WHERE status = 'timeout') AS tools_timed_out, cast(sum(findings) AS bigint) AS total_deterministic_findings"""


@query("gate_summary", V.sql("findings", f"SELECT count(*) AS total_findings, {', '.join(f'count(*) FILTER (WHERE severity = {chr(39)}{s}{chr(39)}) AS {s.lower()}' for s in M.SEVERITIES[:4])}, (SELECT count(*) FILTER (WHERE status IN ('success', 'skipped', 'failed')) FROM runs) AS tools_run FROM findings", runs=RUNS))
def gate_summary(spark, folder):
    return gate.summary(V.findings(spark, folder), runs(spark, folder))


@query("tool_health", f"SELECT {TOOL_COUNTS} FROM ({RUNS})")
def tool_health(spark, folder):
    return gate.tool_health(runs(spark, folder))


@query("tool_health_per_repo", f"SELECT repo, {TOOL_COUNTS} FROM ({RUNS}) GROUP BY repo")
def tool_health_per_repo(spark, folder):
    return gate.tool_health(runs(spark, folder), "repo")


@query("readiness_trend", V.sql("history", """SELECT repo, current, previous, delta, CASE WHEN delta > 0 THEN 'improving' WHEN delta < 0 THEN 'declining' ELSE 'stable' END AS direction FROM (
  SELECT repo, current, previous, round(current - previous, 2) AS delta FROM (SELECT repo, max(CASE WHEN n = 1 THEN score END) AS current, max(CASE WHEN n = 2 THEN score END) AS previous FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, event_id DESC) AS n FROM history) WHERE n <= 2 GROUP BY repo) WHERE previous IS NOT NULL)"""))
def readiness_trend(spark, folder):
    return gate.trend(V.history(spark, folder), "repo", ["ts", "event_id"])


@query("null_fix", V.sql("findings", """SELECT n > 0 AS triggered, n AS null_fix_count, w AS non_review_count, round(n * 100.0 / w, 4) AS percent FROM (
  SELECT count(*) FILTER (WHERE severity <> 'REVIEW' AND target_code IS NULL AND line % 7 <> 0) AS n, count(*) FILTER (WHERE severity <> 'REVIEW') AS w FROM findings)"""))
def null_fix(spark, folder):
    plan = F.when(F.col("line") % 7 == 0, F.array(F.lit("step")))
    return gate.null_fix(V.findings(spark, folder).withColumn("fix_plan", plan))


@query("verdict_errors", """SELECT id, CASE WHEN e = '' THEN 'OK' ELSE e END AS errors FROM (SELECT conv_id * 1000 + turn AS id, concat_ws('|',
  CASE WHEN conv_id % 4 > 1 THEN concat('Gate 0: ', conv_id % 4 - 1, ' hard failures') END, CASE WHEN turn > 2 THEN concat('Gate 1: ', turn - 2, ' missing items') END,
  CASE WHEN conv_id % 7 = 3 THEN 'Gate 1: 2 stub items' END, CASE WHEN conv_id % 11 = 5 THEN 'Gate 2: 1 failures' END, CASE WHEN role = 'assistant' THEN 'Gate 3: independent verifier not completed' END,
  CASE WHEN conv_id % 5 = 1 THEN concat('Gate 3: ', conv_id % 3, ' shell + 1 missing') END, CASE WHEN conv_id % 9 = 2 THEN 'Gate 3: 4 unrated requirements' END,
  CASE WHEN turn % 2 = 1 THEN 'Gate 5: status is MISSING, not APPROVED' END) AS e FROM conversations)""")
def verdict_errors(spark, folder):
    conv, turn = F.col("conv_id"), F.col("turn")
    made = V.table(spark, folder, "conversations").select(
        (conv * 1000 + turn).alias("id"), F.greatest(conv % 4 - 1, F.lit(0)).alias("hard_failures"), F.greatest(turn - 2, F.lit(0)).alias("missing"),
        F.when(conv % 7 == 3, 2).alias("stubs"), F.when(conv % 11 == 5, 1).alias("failures"), (F.col("role") != "assistant").alias("verifier_completed"),
        F.when(conv % 5 == 1, conv % 3).otherwise(0).alias("shell"), F.when(conv % 5 == 1, 1).otherwise(0).alias("verifier_missing"),
        F.when(conv % 9 == 2, 4).alias("unrated"), F.when(turn % 2 == 0, "APPROVED").alias("status"))
    return gate.verdict_errors(made).select("id", "errors")
