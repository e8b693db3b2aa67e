"""Tasks, progress, relocation, batches, ledgers and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog import maps as M
from lintlake.functions import severity as S
from lintlake.operators import groups, scan, stats, tasks as T, verify
from lintlake.queries import views as V
from lintlake.queries.findings import FAMILIES, FAMILY, FAMILY_KEYS, ROOT_RULES
from lintlake.queries.registry import query
from lintlake.queries.reports import GATE, eased, health
from lintlake.queries.scan import LISTED, listed
from lintlake.operators import gate
from lintlake.session import cut, stored

EVERY_PHASE = "(SELECT cast(unnest(range(0, 11)) AS int) AS phase)"


# -------------------------------------------------------------------------------- tasks
PHASED = f"CASE WHEN line % 9 = 0 THEN coalesce({V.map_sql(M.RULE_PHASE, 'rule')}, 10) ELSE phase END"


@query("phase_tasks", V.sql("findings", f"""SELECT id, phase, row_number() OVER (PARTITION BY phase ORDER BY file, line, id) AS position, confidence, imports FROM (
  SELECT id, file, line, {PHASED} AS phase, confidence, CASE WHEN line % 5 = 0 THEN 'import x' ELSE '' END AS imports FROM findings)"""))
def phase_tasks(spark, folder):
    found = (V.findings(spark, folder).withColumn("phase", F.when(F.col("line") % 9 == 0, 77).otherwise(F.col("phase")))
             .withColumn("target_import", F.when(F.col("line") % 5 == 0, " import x ").when(F.col("line") % 5 == 1, "  ")))
    return T.phase_tasks(found).select("id", "phase", "position", "confidence", F.array_join("imports_needed", ",").alias("imports"))


@query("phase_files", V.sql("tasks", f"SELECT p.phase, {V.map_sql(M.PHASE_NAME, 'p.phase')} AS name, coalesce(n, 0) AS total_tasks, CASE WHEN n IS NULL THEN 'clear' ELSE 'not_started' END AS status FROM {EVERY_PHASE} p LEFT JOIN (SELECT CASE phase WHEN 4 THEN 5 ELSE phase END AS phase, count(*) AS n FROM tasks GROUP BY 1) t ON p.phase = t.phase"))
def phase_files(spark, folder):
    return T.phase_files(V.tasks(spark, folder).withColumn("phase", F.expr("CASE phase WHEN 4 THEN 5 ELSE phase END")))


COUNTED = """count(*) AS total, count(*) FILTER (WHERE status = 'completed' AND resolution IN ('applied', 'already_resolved', 'line-shifted')) AS resolved, count(*) FILTER (WHERE resolution = 'skipped') AS skipped,
  count(*) FILTER (WHERE resolution = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending"""


# Phase 4 has no task, all of phase 2 are open and all of phase 0 are done.
STAGED = """SELECT * REPLACE (CASE phase WHEN 4 THEN 5 ELSE phase END AS phase, CASE WHEN phase = 2 THEN 'pending' WHEN phase = 0 THEN 'completed' ELSE status END AS status,
  CASE WHEN phase = 2 THEN NULL WHEN phase = 0 THEN coalesce(resolution, 'applied') ELSE resolution END AS resolution) FROM tasks"""


def staged(spark, folder):
    phase = F.col("phase")
    return (V.tasks(spark, folder).withColumn("resolution", F.when(phase == 2, F.lit(None)).when(phase == 0, F.coalesce("resolution", F.lit("applied"))).otherwise(F.col("resolution")))
            .withColumn("status", F.when(phase == 2, "pending").when(phase == 0, "completed").otherwise(F.col("status")))
            .withColumn("phase", F.when(phase == 4, 5).otherwise(phase)))


@query("phase_progress", V.sql("tasks", f"""SELECT p.phase, coalesce(total, 0) AS total, coalesce(resolved, 0) AS resolved, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending,
  CASE WHEN total IS NULL THEN 'EMPTY' WHEN pending = total THEN 'NOT STARTED' WHEN pending = 0 THEN 'COMPLETE' ELSE 'IN PROGRESS' END AS status
  FROM {EVERY_PHASE} p LEFT JOIN (SELECT phase, {COUNTED} FROM staged GROUP BY 1) t ON p.phase = t.phase""", staged=STAGED))
def phase_progress(spark, folder):
    return T.progress(staged(spark, folder))


@query("task_tallies", V.sql("tasks", f"""SELECT total, resolved, skipped, failed, (SELECT 11 - count(DISTINCT phase) FROM t WHERE status = 'pending') AS phases_completed, (SELECT min(phase) FROM t WHERE status = 'pending') AS current_phase
  FROM (SELECT {COUNTED} FROM t)""", t=STAGED))
def task_tallies(spark, folder):
    return T.tallies(staged(spark, folder))


@query("status_table", V.sql("tasks", """SELECT phase, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE resolution = 'already_resolved') AS already_resolved, count(*) FILTER (WHERE resolution = 'skipped') AS skipped, count(*) FILTER (WHERE resolution = 'failed') AS failed FROM tasks GROUP BY phase"""))
def status_table(spark, folder):
    return T.status_table(V.tasks(spark, folder))


SHOWN = {"applied": "applied", "line-shifted": "line-shifted", "already_resolved": "already-resolved", "skipped": "skipped", "failed": "failed"}


@query("phase_message", V.sql("tasks", "SELECT phase, concat('fix(phase-', phase, '): ', " + V.map_sql(M.PHASE_NAME, "phase") + ", ' - ', CASE WHEN parts = '' THEN 'no changes' ELSE parts END) AS message FROM (SELECT phase, concat_ws(', ', "
       + ", ".join(f"CASE WHEN count(*) FILTER (WHERE resolution = '{r}') > 0 THEN concat(count(*) FILTER (WHERE resolution = '{r}'), ' {w}') END" for r, w in SHOWN.items()) + ") AS parts FROM staged GROUP BY phase)", staged=STAGED))
def phase_message(spark, folder):
    return T.phase_message(staged(spark, folder))


@query("remediation_summary", V.sql("tasks", """SELECT count(*) AS total, count(*) FILTER (WHERE resolution = 'applied') AS applied, count(*) FILTER (WHERE resolution = 'line-shifted') AS line_shifted, count(*) FILTER (WHERE resolution = 'already_resolved') AS already_resolved,
  count(*) FILTER (WHERE resolution = 'skipped') AS skipped, count(*) FILTER (WHERE resolution = 'failed') AS failed, round(count(*) FILTER (WHERE resolution IN ('applied', 'already_resolved', 'line-shifted')) / count(*), 4) AS resolution_rate,
  min(CASE WHEN status = 'completed' THEN completed_at END) AS first_completed, max(CASE WHEN status = 'completed' THEN completed_at END) AS last_completed FROM tasks"""))
def remediation_summary(spark, folder):
    return T.remediation(V.tasks(spark, folder))


DECIDED = "SELECT c_custkey * 10 AS task_id, CASE c_custkey % 3 WHEN 0 THEN 'skip' ELSE 'fix' END AS action FROM customer"
BULK = "SELECT r_name AS rule, CASE r_regionkey WHEN 0 THEN 'skip-all-low' WHEN 1 THEN 'fix-all-low' WHEN 2 THEN 'skip' END AS action FROM region WHERE r_regionkey < 3"
RULED = "SELECT t.*, r.r_name AS rule FROM tasks t JOIN region r ON t.task_id % 5 = r.r_regionkey"


@query("decision_routing", V.sql("tasks", """SELECT t.task_id, CASE WHEN confidence <> 'low' THEN 'auto' WHEN d.action = 'skip' THEN 'skip' WHEN d.action IS NOT NULL THEN 'fix' WHEN b.action IN ('skip', 'skip-all-low') THEN 'skip' WHEN b.action IN ('fix', 'fix-all-low') THEN 'fix' ELSE 'undecided' END AS route
  FROM ruled t LEFT JOIN decided d ON t.task_id = d.task_id LEFT JOIN bulk b ON t.rule = b.rule WHERE status = 'pending'""", decided=DECIDED, bulk=BULK, ruled=RULED))
def decision_routing(spark, folder):
    region = V.table(spark, folder, "region")
    ruled = V.tasks(spark, folder).join(region, F.expr("task_id % 5 = r_regionkey")).withColumnRenamed("r_name", "rule")
    decided = V.table(spark, folder, "customer").select((F.col("c_custkey") * 10).alias("task_id"), F.when(F.col("c_custkey") % 3 == 0, "skip").otherwise("fix").alias("action"))
    key = F.col("r_regionkey")
    bulk = region.where("r_regionkey < 3").select(F.col("r_name").alias("rule"), F.when(key == 0, "skip-all-low").when(key == 1, "fix-all-low").otherwise("skip").alias("action"))
    return T.route(ruled, decided, bulk).select("task_id", "route")


@query("order_violations", V.sql("tasks", "SELECT DISTINCT phase, file FROM (SELECT *, lag(line) OVER (PARTITION BY phase, file ORDER BY task_id) AS before FROM tasks WHERE status = 'pending') WHERE before < line"))
def order_violations(spark, folder):
    return T.order_violations(V.tasks(spark, folder))


@query("application_order", V.sql("tasks", "SELECT task_id, row_number() OVER (PARTITION BY file ORDER BY line DESC, task_id) AS position FROM tasks WHERE status = 'pending'"))
def application_order(spark, folder):
    return T.application_order(V.tasks(spark, folder)).select("task_id", "position")


@query("next_task", V.sql("tasks", "SELECT task_id, phase, file, line FROM tasks WHERE status = 'pending' ORDER BY phase, task_id LIMIT 1"))
def next_task(spark, folder):
    return T.next_task(V.tasks(spark, folder))


# ------------------------------------------------------------------------ scan batches
ELIGIBLE = f"SELECT path, layer, loc FROM listed WHERE tag <> 'GENERATED' AND NOT nominal AND NOT is_meta_file"
SIZE = "greatest(5, least(30, floor(570000 / (floor((SELECT sum(loc) FROM listed) / greatest((SELECT count(*) FROM eligible), 1)) * 5 + 500))))"
BATCHES = f"SELECT path, layer, cast(ceil(row_number() OVER (ORDER BY path) / {SIZE}) AS int) AS batch FROM eligible"
BATCHED = dict(listed=LISTED, eligible=ELIGIBLE, batches=BATCHES)


@query("scan_batches", V.sql("code_files", "SELECT * FROM batches", **BATCHED))
def scan_batches(spark, folder):
    return T.scan_batches(listed(spark, folder))


@query("remaining_batches", V.sql("code_files", """SELECT path, layer, cast((SELECT max(batch) FROM batches) + ceil(row_number() OVER (ORDER BY path) / 10) AS int) AS batch, batch AS parent FROM batches
  WHERE path NOT IN (SELECT path FROM code_files WHERE p_partkey % 3 <> 0)""", **BATCHED))
def remaining_batches(spark, folder):
    plan = T.scan_batches(listed(spark, folder))
    scanned = V.code_files(spark, folder).where("p_partkey % 3 <> 0")
    return T.remaining_batches(plan, scanned, 10)


@query("batch_progress", """SELECT user_id AS repo, count(*) AS batches, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') = 0 AS all_done
  FROM (SELECT user_id, CASE WHEN value < 1 THEN 'pending' WHEN value > 40 THEN 'failed' ELSE 'complete' END AS status FROM events) GROUP BY 1""")
def batch_progress(spark, folder):
    value = F.col("value")
    batches = V.table(spark, folder, "events").select(F.col("user_id").alias("repo"), F.when(value < 1, "pending").when(value > 40, "failed").otherwise("complete").alias("status"))
    return T.batch_progress(batches, "repo")


# ---------------------------------------------------------------- relocation and snippets
# Each line of each document is cited, at a line that is off by some lines; some citations name a file that is
# gone or a text that is nowhere.
CITED = """SELECT l.doc_id * 100000 + l.line AS task_id, CASE WHEN l.doc_id % 14 = 0 THEN concat(path, '.gone') ELSE path END AS file, cast(greatest(l.line + CASE WHEN l.line % 4 = 0 THEN 0 WHEN l.line % 4 = 1 THEN l.doc_id % 5 WHEN l.line % 4 = 2 THEN -(l.doc_id % 9) ELSE 60 END, 1) AS int) AS cited,
  CASE WHEN l.doc_id % 13 = 0 THEN 'nowhere to be found' ELSE text END AS code FROM lines l"""


def cited(spark, folder):
    rows = scan.lines(V.files(spark, folder), "doc_id", "path")
    line, doc = F.col("line"), F.col("doc_id")
    off = F.when(line % 4 == 0, 0).when(line % 4 == 1, doc % 5).when(line % 4 == 2, -(doc % 9)).otherwise(60)
    return cut(rows.select((doc * 100000 + line).alias("task_id"), F.when(doc % 14 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("file"),
                           F.greatest(line + off, F.lit(1)).cast("int").alias("line"), F.when(doc % 13 == 0, "nowhere to be found").otherwise(F.col("text")).alias("code")))


NEEDLES = "SELECT task_id, file, cited, trim(string_split(trim(code, concat(' ', chr(9), chr(10), chr(13))), chr(10))[1], concat(' ', chr(9), chr(10), chr(13))) AS needle FROM cited"


@query("line_relocation", V.sql("files lines", f"""
WITH hits AS (SELECT n.task_id, l.line AS at_, l.line - n.cited AS off FROM needles n JOIN lines l ON n.file = l.path AND contains(l.text, n.needle) WHERE length(needle) >= 5),
best AS (SELECT task_id, arg_min(at_, (CASE WHEN off = 0 THEN 0 WHEN abs(off) <= 20 THEN 1 ELSE 2 END, CASE WHEN abs(off) <= 20 THEN abs(off) ELSE at_ END, CASE WHEN off >= 0 THEN 0 ELSE 1 END)) AS found FROM hits GROUP BY 1),
m AS (SELECT n.task_id, n.cited, CASE WHEN length(needle) < 5 THEN n.cited ELSE found END AS found_line,
  CASE WHEN length(needle) < 5 THEN 'exact' WHEN found = cited THEN 'exact' WHEN abs(found - cited) <= 20 THEN 'nearby' WHEN found IS NOT NULL THEN 'file_wide' WHEN file IN (SELECT path FROM files) THEN 'not_found' ELSE 'file_missing' END AS match
  FROM needles n LEFT JOIN best b ON n.task_id = b.task_id)
SELECT task_id, match, cast(found_line AS int) AS found_line, cast(abs(found_line - cited) AS int) AS shift, CASE WHEN match IN ('file_missing', 'not_found') THEN 'already_resolved' WHEN match = 'exact' THEN 'valid' WHEN abs(found_line - cited) > 50 THEN 'needs_rescan' ELSE 'line_updated' END AS outcome FROM m""",
                              cited=CITED, needles=NEEDLES))
def line_relocation(spark, folder):
    return T.relocate(cited(spark, folder), V.files(spark, folder))


@query("snippet_check", V.sql("lines", """SELECT c.task_id AS id, count(l.line) > 0 AS valid FROM cited c LEFT JOIN lines l ON c.file = l.path AND l.line BETWEEN c.cited - 5 AND c.cited + 5 AND contains(l.text, c.code) GROUP BY 1""", cited=CITED))
def snippet_check(spark, folder):
    wanted = cited(spark, folder).select(F.col("task_id").alias("id"), "file", "line", F.col("code").alias("snippet"))
    return T.snippet_check(wanted, V.files(spark, folder))


@query("changed_tasks", V.sql("tasks parts", "SELECT task_id FROM tasks WHERE file IN (SELECT path FROM parts WHERE loc > 500)"))
def changed_tasks(spark, folder):
    return T.changed_only(V.tasks(spark, folder), V.parts(spark, folder).where("loc > 500")).select("task_id")


# ------------------------------------------------------------------------------- ledgers
@query("last_progress", V.sql("history", "SELECT event_id, score FROM history ORDER BY ts DESC, event_id DESC LIMIT 5"))
def last_progress(spark, folder):
    return T.last_entries(V.history(spark, folder), ["ts", "event_id"]).select("event_id", "score")


@query("usage_ledger", "SELECT user_id AS repo, used, 500000 - used AS remaining, 500000 - used >= 30000 AS ok FROM (SELECT user_id, cast(sum(event_id % 9000) AS bigint) AS used FROM events GROUP BY 1)")
def usage_ledger(spark, folder):
    ledger = V.table(spark, folder, "events").select(F.col("user_id").alias("repo"), (F.col("event_id") % 9000).alias("tokens"))
    return T.usage(ledger, per="repo")


NOW = "SELECT user_id AS key, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE event_id % 2 = 0 GROUP BY 1"
THEN_ = "SELECT user_id AS key, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE event_id % 2 = 1 AND user_id % 5 <> 0 GROUP BY 1"


@query("baseline_delta", f"""SELECT n.key, n.errors, b.errors AS baseline, greatest(n.errors - coalesce(b.errors, n.errors), 0) AS new_errors, CASE WHEN n.errors > b.errors THEN 'BLOCKED' ELSE 'PASS' END AS verdict,
  CASE WHEN b.errors IS NULL OR n.errors = 0 THEN n.errors END AS store FROM ({NOW}) n LEFT JOIN ({THEN_}) b ON n.key = b.key""")
def baseline_delta(spark, folder):
    events = V.table(spark, folder, "events")

    def errors(frame):
        return frame.groupBy(F.col("user_id").alias("key")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))

    return T.baseline_delta(errors(events.where("event_id % 2 = 0")), errors(events.where("event_id % 2 = 1 AND user_id % 5 <> 0")))


# -------------------------------------------------------------------------- reconciliation
RECONCILED = """SELECT coalesce(c.req_id, r.req_id) AS req_id, coalesce(status, 'NOT_CHECKED') AS status, coalesce(rating, 'NOT_CHECKED') AS rating,
  CASE WHEN status = 'VERIFIED' AND rating IN ('SHELL', 'MISSING', 'PARTIAL') THEN 'disagreement' WHEN status = 'VERIFIED' AND rating IS NULL THEN 'unrated' END AS issue FROM claims c FULL OUTER JOIN ratings r ON c.req_id = r.req_id"""


@query("reconcile", V.sql("claims ratings", RECONCILED))
def reconcile(spark, folder):
    return verify.reconcile(V.claims(spark, folder), V.ratings(spark, folder))


@query("reconcile_verdict", V.sql("claims ratings", """SELECT *, 0 AS hard_failures, (SELECT count(*) FROM events WHERE event_type = 'error') AS runtime_failures, CASE WHEN rated = 0 OR shell + missing + partial > 0 OR unrated > 0 THEN 'gate_3' ELSE 'gate_4' END AS blocked_at, 'BLOCKED' AS verdict FROM (
  SELECT count(*) AS requirements, count(*) FILTER (WHERE rating <> 'NOT_CHECKED') AS rated, count(*) FILTER (WHERE rating = 'SHELL') AS shell, count(*) FILTER (WHERE rating = 'MISSING') AS missing, count(*) FILTER (WHERE rating = 'PARTIAL') AS partial,
    count(*) FILTER (WHERE issue = 'unrated') AS unrated, count(*) FILTER (WHERE issue = 'disagreement') AS disagreements FROM x)""", x=RECONCILED))
def reconcile_verdict(spark, folder):
    failed = V.table(spark, folder, "events").where("event_type = 'error'")
    return verify.verdict(V.claims(spark, folder), V.ratings(spark, folder), failed)


@query("rating_summary", V.sql("ratings", "SELECT rating, count(*) AS requirements FROM ratings GROUP BY 1"))
def rating_summary(spark, folder):
    return verify.rating_summary(V.ratings(spark, folder))


@query("unrated_requirements", V.sql("claims ratings", "SELECT req_id FROM claims WHERE status = 'VERIFIED' AND req_id NOT IN (SELECT req_id FROM ratings)"))
def unrated_requirements(spark, folder):
    return verify.unrated(V.claims(spark, folder), V.ratings(spark, folder))


CHECKS = """SELECT user_id AS repo, event_type AS gate, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS position, value > 60 AS blocked FROM events"""


@query("first_blocking_gate", f"SELECT repo, arg_min(gate, (position, gate)) AS blocked_at FROM ({CHECKS}) WHERE blocked GROUP BY repo")
def first_blocking_gate(spark, folder):
    kind = F.col("event_type")
    checks = V.table(spark, folder, "events").select(
        F.col("user_id").alias("repo"), kind.alias("gate"),
        F.struct(F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).when(kind == "error", 4).otherwise(5).alias("p"), kind.alias("g")).alias("position"),
        (F.col("value") > 60).alias("blocked"))
    return verify.first_blocking(checks, "repo")


# ---------------------------------------------------------------------- referential checks
# References are broken on purpose where the line is a multiple of some number.
LINKED = """SELECT f.id, f.line, CASE WHEN f.id <> m.root THEN CASE WHEN f.line % 50 = 0 THEN concat(m.root, '?') ELSE m.root END END AS parent_finding_id, f.id = m.root AND f.line % 3 <> 0 AS is_root_cause,
  CASE WHEN f.line % 40 = 1 THEN NULL WHEN f.line % 40 = 2 THEN 'CLU-X' ELSE f.layer END AS cluster_id FROM findings f LEFT JOIN (SELECT k.id, x.root_finding_id AS root FROM keyed k JOIN families x ON k.rule = x.rule AND k.pattern_key = x.pattern_key) m ON f.id = m.id"""


@query("integrity_violations", V.sql("findings", """
SELECT 'missing_parent' AS "check", id, parent_finding_id AS detail FROM linked WHERE parent_finding_id IS NOT NULL AND parent_finding_id NOT IN (SELECT id FROM findings)
UNION ALL SELECT 'parent_not_root', id, parent_finding_id FROM linked WHERE parent_finding_id IS NOT NULL AND parent_finding_id NOT IN (SELECT id FROM linked WHERE is_root_cause)
UNION ALL SELECT 'missing_family_root', family_id, 'gone' FROM families WHERE family_size > 300
UNION ALL SELECT 'no_cluster', id, '' FROM linked WHERE cluster_id IS NULL UNION ALL SELECT 'unknown_cluster', id, cluster_id FROM linked WHERE cluster_id = 'CLU-X'
UNION ALL SELECT 'missing_blocker', concat(id, '!'), tier FROM b WHERE id LIKE '%:7'
UNION ALL SELECT 'fail_without_blocker', tier, '' FROM tiers t WHERE status = 'FAIL' AND tier NOT IN (SELECT tier FROM b)""", **FAMILY, **GATE, linked=LINKED,
    b="SELECT t.tier, g.id FROM tiers t JOIN gated g ON g.severity IN ('CRITICAL', 'HIGH') AND (t.tier = 'security' AND g.rule = 'R05' AND g.severity = 'CRITICAL' OR t.tier = 'complexity' AND g.rule IN ('R02', 'R09')) WHERE t.status = 'FAIL' AND t.blockers > 0"))
def integrity_violations(spark, folder):
    # Families, members, tiers and references all read the findings, so these are made once.
    found = stored(V.findings(spark, folder).select("id", "rule", "severity", "file", "line", "layer", "phase", "search_pattern", "current_code", "description"))
    made = stored(groups.families(found, ROOT_RULES))
    member = groups.collapse(found, made, ROOT_RULES)
    line = F.col("line")
    root = F.coalesce("parent_finding_id", "id")
    linked = stored(member.select(
        "id", F.when(F.col("parent_finding_id").isNotNull(), F.when(line % 50 == 0, F.concat(root, F.lit("?"))).otherwise(root)).alias("parent_finding_id"),
        (F.coalesce("is_root_cause", F.lit(False)) & (line % 3 != 0)).alias("is_root_cause"),
        F.when(line % 40 == 1, F.lit(None)).when(line % 40 == 2, "CLU-X").otherwise(F.col("layer")).alias("cluster_id")))
    broken = made.withColumn("root_finding_id", F.when(F.col("family_size") > 300, "gone").otherwise(F.col("root_finding_id")))
    ready = eased(found)
    judged = stored(gate.tiers(ready, health(spark, folder)))
    blockers = gate.blockers(ready, judged).where("tier IN ('security', 'complexity')").withColumn(
        "id", F.when(F.col("id").endswith(":7"), F.concat("id", F.lit("!"))).otherwise(F.col("id")))
    clusters = found.select(F.col("layer").alias("cluster_id")).distinct()
    return verify.violations(linked, broken, clusters, judged, blockers)


PUBLISHED = """SELECT 'total' AS measure, '' AS value, count(*) + 1 AS n FROM findings UNION ALL SELECT 'affected_files', '', count(DISTINCT file) FROM findings
  UNION ALL SELECT 'severity', severity, count(*) - CASE severity WHEN 'LOW' THEN 2 ELSE 0 END FROM findings GROUP BY severity
  UNION ALL SELECT 'phase', cast(phase AS varchar), count(*) FROM findings WHERE phase <> 5 GROUP BY phase"""


@query("stats_reconciliation", V.sql("findings", """
SELECT 'stats' AS source, 'total' AS measure, '' AS value, count(*) + 1 AS declared, count(*) AS derived FROM findings
UNION ALL SELECT 'stats', 'severity', 'LOW', count(*) - 2, count(*) FROM findings WHERE severity = 'LOW'
UNION ALL SELECT 'stats', 'phase', '5', 0, count(*) FROM findings WHERE phase = 5
UNION ALL SELECT 'tasks', 'phase', cast(phase AS varchar), count(*) FILTER (WHERE line <> 11), count(*) FROM findings GROUP BY phase HAVING count(*) FILTER (WHERE line = 11) > 0"""))
def stats_reconciliation(spark, folder):
    found = V.findings(spark, folder)

    def rows(measure, frame, value, n):
        return frame.select(F.lit(measure).alias("measure"), value.cast("string").alias("value"), n.cast("long").alias("n"))

    count = F.count(F.lit(1)).alias("n")
    published = (rows("total", found.agg(count), F.lit(""), F.col("n") + 1)
                 .unionByName(rows("affected_files", found.agg(F.countDistinct("file").alias("n")), F.lit(""), F.col("n")))
                 .unionByName(rows("severity", found.groupBy("severity").agg(count), F.col("severity"), F.col("n") - F.when(F.col("severity") == "LOW", 2).otherwise(0)))
                 .unionByName(rows("phase", found.where("phase <> 5").groupBy("phase").agg(count), F.col("phase"), F.col("n"))))
    return verify.stats_mismatches(found, published, found.where("line <> 11").select("phase"))


# ---------------------------------------------------------------------------- impact parts
# An order stands for a cluster: its line items are the findings of the part.  Some parts are broken.
PARTS = """SELECT o_orderkey, o_orderpriority, o_orderdate, concat('CLU-', cast(o_orderkey AS varchar)) AS cluster_id, o_orderkey % 10 AS broken FROM orders"""


def impact_parts(spark, folder):
    orders = V.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    broken = key % 10

    def finding(n):
        return F.struct(F.concat(F.lit("F"), key.cast("string"), F.lit(f"-{n}")).alias("finding_id"),
                        F.concat(F.lit("src/p"), F.col("o_custkey").cast("string"), F.lit(".ts")).alias("file"),
                        (key % 300 + n - F.when(broken == 3, 400).otherwise(0)).cast("int").alias("line"))

    found = F.when(key % 3 == 0, F.array(finding(1))).otherwise(F.array(finding(1), finding(2)))
    return orders.where(broken != 0).select(
        F.concat(F.lit("CLU-"), key.cast("string")).alias("cluster_id"), F.when(broken == 1, " ").otherwise(F.col("o_orderpriority")).alias("cluster_label"),
        F.col("o_orderdate").cast("string").alias("analyzed_at"), F.array(F.lit("a.ts")).alias("source_files_read"), F.when(broken == 2, 0).otherwise(1).alias("read_count"),
        found.alias("findings"), F.when(broken == 4, "guess").otherwise("inline_fix").alias("strategy"),
        F.when(broken == 5, F.array(F.lit("F0"))).otherwise(F.array(F.concat(F.lit("F"), key.cast("string"), F.lit("-1")))).alias("fix_order"))


@query("impact_part_status", f"SELECT cluster_id, CASE WHEN broken = 0 THEN 'missing' WHEN broken <= 5 THEN 'invalid' ELSE 'completed' END AS status FROM ({PARTS})")
def impact_part_status(spark, folder):
    expected = V.table(spark, folder, "orders").select(F.concat(F.lit("CLU-"), F.col("o_orderkey").cast("string")).alias("cluster_id"))
    return verify.part_status(expected, impact_parts(spark, folder))


@query("impact_part_summary", f"""SELECT count(*) AS expected, count(*) FILTER (WHERE broken > 5) AS completed, count(*) FILTER (WHERE broken BETWEEN 1 AND 5) AS invalid, count(*) FILTER (WHERE broken = 0) AS missing, false AS complete FROM ({PARTS})""")
def impact_part_summary(spark, folder):
    return verify.part_summary(impact_part_status(spark, folder))


IMPACTS = f"""SELECT concat('F', cast(o_orderkey AS varchar), '-', cast(n AS varchar)) AS finding_id, cluster_id, cast(o_orderkey % 300 + n - CASE WHEN broken = 3 THEN 400 ELSE 0 END AS int) AS line
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [1] ELSE [1, 2] END) AS n FROM ({PARTS}) WHERE broken <> 0)"""


@query("impact_rows", IMPACTS)
def impact_rows(spark, folder):
    return verify.impact_rows(impact_parts(spark, folder)).select("finding_id", "cluster_id", "line")


@query("cluster_impacts", f"""SELECT c.cluster_id, i.finding_id, CASE WHEN i.finding_id IS NULL THEN NULL WHEN i.line % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM ({PARTS}) c LEFT JOIN ({IMPACTS}) i ON c.cluster_id = i.cluster_id""")
def cluster_impacts(spark, folder):
    rows = verify.impact_rows(impact_parts(spark, folder)).select("finding_id", "cluster_id", "line")
    clusters = V.table(spark, folder, "orders").select(F.concat(F.lit("CLU-"), F.col("o_orderkey").cast("string")).alias("cluster_id"))
    known = rows.where("line % 2 = 0").select(F.col("finding_id").alias("id"), F.lit("HIGH").alias("severity"))
    return verify.cluster_impacts(clusters, rows, known).select("cluster_id", "finding_id", "severity")


@query("impact_staleness", f"""SELECT p.*, m.*, newest_part > merged_at OR parts_findings <> merged_findings OR part_clusters <> merged_clusters AS stale FROM
  (SELECT cast(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END) AS bigint) AS parts_findings, count(DISTINCT cluster_id) AS part_clusters, max(o_orderdate) AS newest_part FROM ({PARTS}) WHERE broken <> 0) p,
  (SELECT count(*) AS merged_findings, count(DISTINCT cluster_id) AS merged_clusters, timestamp '1999-06-01' AS merged_at FROM ({IMPACTS})) m""")
def impact_staleness(spark, folder):
    parts = impact_parts(spark, folder).withColumn("modified", F.col("analyzed_at").cast("timestamp"))
    merged = verify.impact_rows(impact_parts(spark, folder)).select("cluster_id", F.expr("timestamp '1999-06-01'").alias("modified"))
    return verify.stale(parts, merged)


# -------------------------------------------------------------------------------- evidence
EVIDENCE = """SELECT doc_id AS req_id, CASE WHEN doc_id % 19 = 0 THEN concat(path, '.gone') ELSE path END AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(content, '!') ELSE content END) AS content_sha256 FROM files"""


def evidence(spark, folder):
    doc = F.col("doc_id")
    return V.files(spark, folder).select(doc.alias("req_id"), F.when(doc % 19 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
                                         F.sha2(F.when(doc % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("content_sha256"))


@query("evidence_freshness", V.sql("files", "SELECT req_id, e.path, CASE WHEN f.path IS NULL THEN 'FILE NOT FOUND' WHEN sha256(content) <> content_sha256 THEN 'HASH MISMATCH' ELSE 'OK' END AS state FROM e LEFT JOIN files f ON e.path = f.path", e=EVIDENCE))
def evidence_freshness(spark, folder):
    return verify.evidence_freshness(evidence(spark, folder), V.files(spark, folder))


@query("evidence_sample", V.sql("files", "SELECT req_id, path FROM e ORDER BY sha256(cast(req_id AS varchar)), req_id LIMIT 20", e=EVIDENCE))
def evidence_sample(spark, folder):
    return verify.sampled(evidence(spark, folder).select("req_id", "path"), "req_id", verify.evidence_sample_size)


@query("snippet_sample", V.sql("findings", "SELECT id FROM findings ORDER BY sha256(id), id LIMIT 50"))
def snippet_sample(spark, folder):
    return verify.sampled(V.findings(spark, folder).select("id"), "id", verify.snippet_sample_size)


@query("unverified_phases", V.sql("tasks", "SELECT phase, phase = min(phase) OVER () AS next FROM (SELECT DISTINCT phase FROM tasks WHERE status = 'completed' AND phase NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))"))
def unverified_phases(spark, folder):
    verified = V.table(spark, folder, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("phase"))
    return verify.unverified_phases(V.tasks(spark, folder).where("status = 'completed'"), verified)
