"""Validation, de-duplication, ids, groups and families over the findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.catalog import maps as M
from lintlake.functions import severity as S, text as X
from lintlake.operators import dedup, groups, validate, verify
from lintlake.queries import views as V
from lintlake.queries.registry import query
from lintlake.queries.scan import _q
from lintlake.session import checkpoint_folder, cut
from lintlake.sources import sinks


# ---------------------------------------------------------------- raw JSON lines from orders
# One JSON text per line item; every so many are broken in one of the ways a scanner breaks them.
KIND = "(l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 40"


def raw_lines(spark, folder):
    """(source, line_no, part, value): scanner output as text."""
    # Written down, as a scanner would have: the text is made once and then read.
    return cut(as_lines(V.spread(V.table(spark, folder, "lineitem"))))


def as_lines(li):
    """The same of line items, not written down."""
    kind = F.expr(KIND)
    rule = F.element_at(F.expr("array(" + ",".join(f"'{r}'" for r in V.RULE_BY_PART) + ")"), (F.col("l_partkey") % 14).cast("int") + 1)
    line = (F.col("l_orderkey") % 400 + F.col("l_linenumber")).cast("int")
    body = F.concat(
        F.lit('{"rule":"'), F.when(kind == 3, "").otherwise(rule),
        F.lit('","file":"src/p'), F.col("l_partkey").cast("string"), F.lit('.ts","line":'),
        F.when(kind == 4, "0").when(kind == 5, "-3").when(kind == 6, '"12"').when(kind == 7, "1.5").otherwise(line.cast("string")),
        F.when(kind == 8, "").otherwise(F.concat(F.lit(',"description":"issue '), F.col("l_suppkey").cast("string"), F.lit('"'))),
        F.lit(',"severity":"'), F.when(kind == 9, "urgent").when(kind == 10, "high").otherwise(
            F.when(F.col("l_discount") >= 0.075, "CRITICAL").when(F.col("l_discount") >= 0.035, "MEDIUM").otherwise("LOW")),
        F.lit('","category":"'), F.when(kind % 3 == 0, "Code Quality").when(kind % 3 == 1, "type safety").otherwise("security"),
        F.lit('","confidence":"'), F.when(F.col("l_tax") >= 0.055, "high").when(F.col("l_tax") >= 0.025, "medium").otherwise("low"),
        F.lit('"}'))
    value = F.when(kind == 0, F.concat(F.lit("{broken "), body)).when(kind == 1, "[1, 2]").when(kind == 2, "   ").otherwise(body)
    return li.select(F.when(F.col("l_returnflag") == "A", "grep-scanner").when(F.col("l_returnflag") == "N", "tool-scanner")
                     .otherwise("layer-scanner").alias("source"),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.col("l_partkey").alias("part"),
                     value.alias("value"))


RAW = f"""SELECT CASE l_returnflag WHEN 'A' THEN 'grep-scanner' WHEN 'N' THEN 'tool-scanner' ELSE 'layer-scanner' END AS source,
  l_orderkey * 10 + l_linenumber AS line_no, {KIND} AS kind, l_partkey,
  {V.map_sql(dict(enumerate(V.RULE_BY_PART)), 'l_partkey % 14')} AS rule, concat('src/p', cast(l_partkey AS varchar), '.ts') AS file,
  cast(l_orderkey % 400 + l_linenumber AS int) AS line, concat('issue ', cast(l_suppkey AS varchar)) AS description,
  CASE WHEN l_discount >= 0.075 THEN 'CRITICAL' WHEN l_discount >= 0.035 THEN 'MEDIUM' ELSE 'LOW' END AS given,
  CASE WHEN l_tax >= 0.055 THEN 'high' WHEN l_tax >= 0.025 THEN 'medium' ELSE 'low' END AS confidence
FROM lineitem"""
REASON = """CASE WHEN kind = 0 THEN 'invalid_json' WHEN kind = 1 THEN 'not_a_dict' WHEN kind = 3 THEN 'missing_fields:rule'
  WHEN kind = 4 THEN 'missing_fields:line' WHEN kind = 8 THEN 'missing_fields:description'
  WHEN kind = 5 THEN 'invalid_line_number:-3' WHEN kind = 6 THEN 'invalid_line_number:12' WHEN kind = 7 THEN 'invalid_line_number:1.5'
  WHEN l_partkey % 17 = 0 THEN concat('phantom_file:', file) END"""


def tested(spark, folder):
    return validate.checked(validate.parsed(raw_lines(spark, folder)), V.parts(spark, folder))


@query("validate_rejects", V.sql("", f"SELECT source, line_no AS _line, {REASON} AS _reason FROM raw WHERE kind <> 2 AND {REASON} IS NOT NULL", raw=RAW))
def validate_rejects(spark, folder):
    return validate.split(tested(spark, folder))[1].select("source", F.col("line_no").alias("_line"), "_reason")


@query("validate_reject_reasons", V.sql("", f"SELECT source, split_part({REASON}, ':', 1) AS reason, count(*) AS lines FROM raw WHERE kind <> 2 AND {REASON} IS NOT NULL GROUP BY 1, 2", raw=RAW))
def validate_reject_reasons(spark, folder):
    return validate.split(tested(spark, folder))[1].groupBy("source", F.substring_index("_reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


LEVEL = "CASE WHEN kind = 9 THEN 'MEDIUM' WHEN kind = 10 THEN 'HIGH' ELSE given END"
CEILED = f"""SELECT *, {V.rank_sql('level')} AS r, CASE confidence WHEN 'low' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS top
  FROM (SELECT *, {LEVEL} AS level FROM raw WHERE kind <> 2 AND {REASON} IS NULL)"""
NAMES = "CASE {} WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'REVIEW' END"


@query("normalize_findings", V.sql("", f"""SELECT line_no, rule, file, line, {V.map_sql(M.RULE_CATEGORY, 'rule')} AS category,
  CASE WHEN r < top THEN {NAMES.format('top')} ELSE level END AS severity, CASE WHEN r < top THEN level END AS severity_capped_from FROM ceiled""", raw=RAW, ceiled=CEILED))
def normalize_findings(spark, folder):
    valid, _ = validate.split(tested(spark, folder))
    return validate.normalised(valid).select("line_no", "rule", "file", "line", "category", "severity", "severity_capped_from")


@query("confidence_ceiling", V.sql("items", f"""SELECT confidence, severity, CASE WHEN r < top THEN {NAMES.format('top')} ELSE severity END AS capped, count(*) AS findings
  FROM (SELECT *, {V.rank_sql('severity')} AS r, CASE confidence WHEN 'low' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS top FROM items) GROUP BY 1, 2, 3"""))
def confidence_ceiling(spark, folder):
    capped, _ = S.ceiling(F.col("severity"), F.col("confidence"))
    return V.items(spark, folder).groupBy("confidence", "severity", capped.alias("capped")).agg(F.count(F.lit(1)).alias("findings"))


# Category spellings from event types and values.
SPELLINGS = sorted(M.CATEGORY_SYNONYM)
SPELLED = f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'R99' ELSE 'R07' END AS rule,
  CASE WHEN event_id % 5 = 0 THEN concat(' ', upper({V.map_sql(dict(enumerate(SPELLINGS)), f'event_id % {len(SPELLINGS)}')}), ' ')
       WHEN event_id % 5 = 1 THEN 'Security' WHEN event_id % 5 = 2 THEN event_type ELSE {V.map_sql(dict(enumerate(SPELLINGS)), f'event_id % {len(SPELLINGS)}')} END AS raw FROM events"""


@query("normalize_category", f"""SELECT event_id, CASE WHEN rule = 'R07' THEN 'typing' WHEN lower(trim(raw)) = 'security' THEN 'security'
  ELSE {V.map_sql(M.CATEGORY_SYNONYM, 'lower(trim(raw))', "'clean-code'")} END AS category FROM ({SPELLED})""")
def normalize_category(spark, folder):
    key = F.col("event_id")
    spelling = F.element_at(F.expr("array(" + ",".join(f"'{s}'" for s in SPELLINGS) + ")"), (key % len(SPELLINGS)).cast("int") + 1)
    raw = (F.when(key % 5 == 0, F.concat(F.lit(" "), F.upper(spelling), F.lit(" "))).when(key % 5 == 1, "Security")
           .when(key % 5 == 2, F.col("event_type")).otherwise(spelling))
    rule = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, "R99").otherwise("R07")
    return V.table(spark, folder, "events").select("event_id", S.normal_category(raw, rule).alias("category"))


def _confidence_sql(what: int) -> str:
    cases = []
    for rule, table in S.CONFIDENCE_CASES.items():
        for at, (words, more, level) in enumerate(table, 1):
            tests = [f"rule = '{rule}'"]
            for group in (words, more):
                if group:
                    tests.append("(" + " OR ".join(f"contains(text, {_q(w)})" for w in group) + ")")
            cases.append(f"WHEN {' AND '.join(tests)} THEN {_q((level, S.confidence_reason(rule, at, words, level))[what])}")
    rest = "'high'" if what == 0 else "concat('high for every finding of ', rule)"
    return "CASE " + " ".join(cases) + f" ELSE {rest} END"


WORDED = """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'R04' WHEN 1 THEN 'R11' WHEN 2 THEN 'R13' WHEN 3 THEN 'R09' ELSE 'R05' END AS rule,
  CASE WHEN o_orderkey % 6 = 0 THEN 'low' WHEN o_orderkey % 6 = 1 THEN '' END AS given,
  concat(CASE o_orderkey % 9 WHEN 0 THEN 'Loop over ' WHEN 1 THEN 'useEffect stale ' WHEN 2 THEN 'inline handler prop ' WHEN 3 THEN 'inline ' WHEN 4 THEN 'memo '
    WHEN 5 THEN 'commented block ' WHEN 6 THEN 'console.error token ' WHEN 7 THEN 'retry limit ' ELSE 'css padding ' END, o_orderpriority) AS description FROM orders"""


@query("fill_confidence", f"""SELECT o_orderkey, CASE WHEN given <> '' THEN given ELSE {_confidence_sql(0)} END AS confidence,
  CASE WHEN given <> '' THEN 'as given' ELSE {_confidence_sql(1)} END AS confidence_reason FROM (SELECT *, lower(description) AS text FROM ({WORDED}))""")
def fill_confidence(spark, folder):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rule = F.when(cust % 5 == 0, "R04").when(cust % 5 == 1, "R11").when(cust % 5 == 2, "R13").when(cust % 5 == 3, "R09").otherwise("R05")
    words = ["Loop over ", "useEffect stale ", "inline handler prop ", "inline ", "memo ", "commented block ", "console.error token ", "retry limit ", "css padding "]
    start = F.element_at(F.array(*[F.lit(w) for w in words]), (key % 9).cast("int") + 1)
    orders = V.table(spark, folder, "orders").select(
        "o_orderkey", rule.alias("rule"), F.when(key % 6 == 0, "low").when(key % 6 == 1, "").alias("given"),
        F.concat(start, "o_orderpriority").alias("description"))
    level, why = S.filled_confidence(F.col("given"), F.lit("as given"), F.col("rule"), F.col("description"))
    return orders.select("o_orderkey", level.alias("confidence"), why.alias("confidence_reason"))


@query("phantom_findings", V.sql("items parts", "SELECT file, line, rule, count(*) AS findings FROM items WHERE file NOT IN (SELECT path FROM parts) GROUP BY ALL"))
def phantom_findings(spark, folder):
    return validate.phantom_files(V.items(spark, folder), V.parts(spark, folder)).groupBy("file", "line", "rule").agg(F.count(F.lit(1)).alias("findings"))


SCOPE = "SELECT CASE p_size % 3 WHEN 0 THEN 'grep-scanner' WHEN 1 THEN 'tool-scanner' ELSE 'layer-scanner' END AS scanner, concat('src/p', cast(p_partkey AS varchar), '.ts') AS file FROM part"


@query("scope_violations", V.sql("items", "SELECT scanner, count(*) AS findings, count(DISTINCT file) AS files FROM items i WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.scanner = i.scanner AND s.file = i.file) GROUP BY scanner", scope=SCOPE))
def scope_violations(spark, folder):
    size = F.col("p_size") % 3
    scope = V.table(spark, folder, "part").select(
        F.when(size == 0, "grep-scanner").when(size == 1, "tool-scanner").otherwise("layer-scanner").alias("scanner"),
        F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file"))
    return validate.out_of_scope(V.items(spark, folder), scope).groupBy("scanner").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file").alias("files"))


OVER = "SELECT concat('u', cast(user_id AS varchar)) AS scanner, CASE WHEN user_id % 7 = 0 AND event_id % 4 <> 0 THEN 'R09' ELSE event_type END AS rule FROM events"


@query("scanner_overreport", f"""SELECT scanner, rule, findings, cast(total AS bigint) AS total FROM (
  SELECT scanner, rule, count(*) AS findings, sum(count(*)) OVER (PARTITION BY scanner) AS total FROM ({OVER}) GROUP BY 1, 2) WHERE findings / total > 0.6""")
def scanner_overreport(spark, folder):
    user = F.col("user_id")
    made = V.table(spark, folder, "events").select(
        F.concat(F.lit("u"), user.cast("string")).alias("scanner"),
        F.when((user % 7 == 0) & (F.col("event_id") % 4 != 0), "R09").otherwise(F.col("event_type")).alias("rule"))
    return validate.over_reporting(made)


@query("scanner_degraded", V.sql("", f"""SELECT scanner, count(*) AS lines, count(reason) AS discarded,
  CASE WHEN count(*) = count(reason) THEN 'missing' WHEN count(reason) * 2 > count(*) THEN 'degraded' ELSE 'ok' END AS health
  FROM (SELECT concat(source, '-', cast(line_no % 97 AS varchar)) AS scanner, CASE WHEN line_no % 97 < 10 OR line_no % 97 < 20 AND line_no % 5 > 0 THEN 'lost' ELSE {REASON} END AS reason FROM raw WHERE kind <> 2) GROUP BY 1""", raw=RAW))
def scanner_degraded(spark, folder):
    # Of ninety-seven shares ten lose all lines and ten most of them, as with a broken scanner.
    share = F.col("line_no") % 97
    lost = (share < 10) | ((share < 20) & (F.col("line_no") % 5 > 0))
    rows = tested(spark, folder).withColumn("scanner", F.concat("source", F.lit("-"), share.cast("string")))
    return validate.scanner_health(rows.withColumn("_reason", F.when(lost, "lost").otherwise(F.col("_reason"))))


@query("scanner_completeness", """
WITH signals AS (SELECT event_type AS scanner, count(*) AS scanned FROM events WHERE event_type <> 'view' GROUP BY 1),
expected AS (SELECT DISTINCT event_type AS scanner FROM events UNION SELECT 'audit'),
reported AS (SELECT DISTINCT event_type AS scanner FROM events WHERE value > 1)
SELECT 'no_output' AS "check", scanner FROM expected WHERE scanner NOT IN (SELECT scanner FROM reported UNION SELECT scanner FROM signals)
UNION ALL SELECT 'no_completion_signal', scanner FROM expected WHERE scanner NOT IN (SELECT scanner FROM signals)
UNION ALL SELECT 'files_not_covered', '' FROM signals HAVING sum(scanned) < 1000000000""")
def scanner_completeness(spark, folder):
    events = V.table(spark, folder, "events")
    signals = events.where("event_type <> 'view'").groupBy(F.col("event_type").alias("scanner")).agg(F.count(F.lit(1)).alias("scanned"))
    expected = events.select(F.col("event_type").alias("scanner")).distinct().unionByName(spark.range(1).select(F.lit("audit").alias("scanner")))
    return validate.completeness_gate(events.where("value > 1").select(F.col("event_type").alias("scanner")), signals, expected, 1_000_000_000)


@query("aggregation_completeness", V.sql("items findings", """SELECT f.n AS findings, r.n AS scanner_lines, r.s AS scanners, round(f.n / r.n, 3) AS ratio, f.n >= r.n * 0.5 AS complete
  FROM (SELECT count(*) AS n FROM findings) f, (SELECT count(*) AS n, count(DISTINCT scanner) AS s FROM items) r"""))
def aggregation_completeness(spark, folder):
    return validate.aggregation_completeness(V.findings(spark, folder), V.items(spark, folder))


@query("enrichment_completeness", V.sql("findings", """SELECT layer, count(*) AS expected, count(*) FILTER (WHERE e) AS enriched, count(*) FILTER (WHERE e) > 0 AND count(*) FILTER (WHERE e) >= count(*) * 0.8 AS complete
  FROM (SELECT *, (length(layer) % 2 = 0 OR severity <> 'LOW') AS e FROM findings) GROUP BY layer"""))
def enrichment_completeness(spark, folder):
    found = V.findings(spark, folder)
    return validate.enrichment_completeness(found, found.where((F.length("layer") % 2 == 0) | (F.col("severity") != "LOW")))


@query("jsonl_integrity", V.sql("", """SELECT source, count(*) AS lines, min(CASE WHEN kind = 0 THEN line_no END) AS first_bad,
  count(*) FILTER (WHERE first IS NULL OR line_no < first) AS valid_before, min(CASE WHEN kind = 0 THEN line_no END) IS NULL AS ok
FROM (SELECT *, min(CASE WHEN kind = 0 THEN line_no END) OVER (PARTITION BY source) AS first FROM (SELECT * REPLACE (concat(source, '/', cast(l_partkey % 50 AS varchar)) AS source) FROM raw WHERE kind <> 2))
GROUP BY source""", raw=RAW))
def jsonl_integrity(spark, folder):
    # Fifty files per scanner, told apart by the part.
    raw = raw_lines(spark, folder).withColumn("source", F.concat("source", F.lit("/"), (F.col("part") % 50).cast("string")))
    return validate.integrity(raw)


# -------------------------------------------------------------------------------- severity rules
@query("severity_adjustment", V.sql("findings", f"""SELECT id, {NAMES.format('least(greatest(r - raises + lowers, 0), floor_)')} AS adjusted_severity FROM (
  SELECT id, {V.rank_sql('severity')} AS r, CASE WHEN service = 'ASIA' THEN 1 ELSE 0 END + CASE WHEN category = 'security' THEN 2 ELSE 0 END AS raises,
    CASE WHEN line % 10 = 0 THEN 2 WHEN line % 10 = 1 THEN 1 ELSE 0 END AS lowers, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'REVIEW' THEN 4 ELSE 3 END AS floor_ FROM findings)"""))
def severity_adjustment(spark, folder):
    raises = F.when(F.col("service") == "ASIA", 1).otherwise(0) + F.when(F.col("category") == "security", 2).otherwise(0)
    lowers = F.when(F.col("line") % 10 == 0, 2).when(F.col("line") % 10 == 1, 1).otherwise(0)
    return verify.adjusted_severity(V.findings(spark, folder), raises, lowers).select("id", "adjusted_severity")


@query("content_minimums", V.sql("files", """SELECT doc_id, concat_ws(',', CASE WHEN len(string_split_regex(trim(content), '\\s+')) < 30 THEN 'explanation' END,
  CASE WHEN len(string_split_regex(trim(d), '\\s+')) < 8 THEN 'description' END, CASE WHEN length(d) < 40 THEN 'snippet' END, CASE WHEN doc_id % 3 = 0 THEN 'target_code' END) AS short
FROM (SELECT *, string_split(content, chr(10))[1] AS d FROM files)
WHERE len(string_split_regex(trim(content), '\\s+')) < 30 OR len(string_split_regex(trim(d), '\\s+')) < 8 OR length(d) < 40 OR doc_id % 3 = 0"""))
def content_minimums(spark, folder):
    first = F.substring_index("content", "\n", 1)
    made = V.files(spark, folder).select("doc_id", F.col("content").alias("explanation"), first.alias("description"), first.alias("snippet"),
                                         F.when(F.col("doc_id") % 3 != 0, "fix").alias("target_code"), F.lit("HIGH").alias("severity"))
    return validate.content_minimums(made).select("doc_id", "short")


@query("lowest_phase", V.sql("items", f"SELECT file, line, min({V.map_sql(M.RULE_PHASE, 'r')}) AS phase FROM (SELECT file, line, unnest([rule, CASE WHEN line % 2 = 0 THEN 'R14' ELSE 'R11' END]) AS r FROM items) GROUP BY 1, 2"))
def lowest_phase(spark, folder):
    rules = F.array("rule", F.when(F.col("line") % 2 == 0, "R14").otherwise("R11"))
    return V.items(spark, folder).select("file", "line", S.lowest_phase(rules).alias("phase")).groupBy("file", "line").agg(F.min("phase").alias("phase"))


# --------------------------------------------------------------------------- de-duplication
@query("dedup_same_line", V.sql("items", f"""SELECT file, line, rule, min({V.rank_sql('severity')}) AS rank, string_agg(DISTINCT scanner, ',' ORDER BY scanner) AS scanner FROM items GROUP BY 1, 2, 3"""))
def dedup_same_line(spark, folder):
    return dedup.same_line(V.items(spark, folder)).select("file", "line", "rule", S.rank(F.col("severity")).alias("rank"), "scanner")


NEAR_WORDS = """SELECT file, rule, line, list_distinct(list_filter(string_split_regex(lower(description), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '' AND w NOT IN ('the', 'a', 'is', 'in', 'of'))) AS words, description FROM findings"""


@query("near_duplicate_pairs", V.sql("findings", """SELECT a.file, a.rule, a.line AS low, b.line AS high FROM w a JOIN w b ON a.file = b.file AND a.rule = b.rule AND b.line > a.line AND b.line - a.line <= 5
  WHERE len(list_intersect(a.words, b.words)) >= 4""", w=NEAR_WORDS))
def near_duplicate_pairs(spark, folder):
    return dedup.near_pairs(V.findings(spark, folder))


@query("near_duplicate_groups", V.sql("findings", """SELECT file, rule, line, first_line FROM (
  SELECT *, min(line) OVER (PARTITION BY file, rule, g) AS first_line, count(*) OVER (PARTITION BY file, rule, g) AS n FROM (
    SELECT file, rule, line, sum(CASE WHEN line - before <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY file, rule ORDER BY line) AS g FROM (
      SELECT *, lag(line) OVER (PARTITION BY file, rule ORDER BY line) AS before FROM w WHERE len(words) >= 4))) WHERE n > 1""", w=NEAR_WORDS))
def near_duplicate_groups(spark, folder):
    # All findings of a file share their description here, so a group is a run of close lines.
    return dedup.near_groups(V.findings(spark, folder))


# Every third finding has its own line as snippet, the others their code.
SNIPPET = "CASE WHEN line % 3 = 0 THEN concat('line ', cast(line AS {text})) ELSE current_code END"


@query("merge_near_duplicates", V.sql("findings", f"""SELECT file, rule, min(line) AS line, max(line) AS end_line, {NAMES.format('min(r)')} AS severity, count(*) AS merged,
    concat_ws(chr(10), CASE WHEN min(CASE WHEN line % 3 <> 0 THEN line END) = min(line) THEN min(current_code) END, string_agg(CASE WHEN line % 3 = 0 AND line < coalesce(first_code, 1000000) THEN concat('line ', line) END, chr(10) ORDER BY line),
      CASE WHEN min(CASE WHEN line % 3 <> 0 THEN line END) > min(line) THEN min(current_code) END, string_agg(CASE WHEN line % 3 = 0 AND line > first_code THEN concat('line ', line) END, chr(10) ORDER BY line)) AS snippet FROM (
  SELECT *, min(CASE WHEN line % 3 <> 0 THEN line END) OVER (PARTITION BY file, rule, g) AS first_code FROM (
    SELECT file, rule, line, current_code, r, sum(CASE WHEN line - before <= 5 AND long THEN 0 ELSE 1 END) OVER (PARTITION BY file, rule ORDER BY line) AS g FROM (
      SELECT w.*, f.current_code, len(words) >= 4 AS long, lag(w.line) OVER (PARTITION BY w.file, w.rule ORDER BY w.line) AS before, {V.rank_sql('severity')} AS r
      FROM w JOIN findings f ON w.file = f.file AND w.line = f.line AND w.rule = f.rule))) GROUP BY file, rule, g""", w=NEAR_WORDS))
def merge_near_duplicates(spark, folder):
    found = V.findings(spark, folder).withColumn("snippet", F.expr(SNIPPET.format(text="string")))
    return dedup.merge_near(found).select("file", "rule", "line", "end_line", "severity", "merged", "snippet")


@query("findings_with_layer", V.sql("findings parts", "SELECT coalesce(p.layer, 'unclassified') AS layer, count(*) AS findings FROM findings f LEFT JOIN parts p ON f.file = p.path GROUP BY 1"))
def findings_with_layer(spark, folder):
    return dedup.with_layer(V.findings(spark, folder), V.parts(spark, folder)).groupBy("layer").agg(F.count(F.lit(1)).alias("findings"))


IDS = f"""SELECT id AS key, concat(prefix, '-', CASE WHEN n < 1000 THEN lpad(cast(n AS varchar), 3, '0') ELSE cast(n AS varchar) END) AS id FROM (
  SELECT id, prefix, row_number() OVER (PARTITION BY prefix ORDER BY phase, file, line, rule, description) AS n FROM (SELECT *, {V.map_sql(M.CATEGORY_PREFIX, 'category')} AS prefix FROM findings))"""


@query("assign_ids", V.sql("findings", IDS))
def assign_ids(spark, folder):
    found = V.findings(spark, folder).withColumnRenamed("id", "key")
    return dedup.assign_ids(found).select("key", "id")


@query("processing_summary", V.sql("items findings parts", """SELECT r AS raw_input, r - v AS discarded_invalid, v - f AS duplicates_removed, f AS final_count FROM (
  SELECT (SELECT count(*) FROM items) AS r, (SELECT count(*) FROM items WHERE file IN (SELECT path FROM parts)) AS v, (SELECT count(*) FROM findings WHERE file IN (SELECT path FROM parts)) AS f)"""))
def processing_summary(spark, folder):
    known = V.parts(spark, folder).select(F.col("path").alias("file"))
    steps = {"valid": lambda raw: raw.join(known, "file", "left_semi"), "final": dedup.same_line}
    return dedup.processing_summary(spark, sinks.processed(V.items(spark, folder), steps, f"{checkpoint_folder(spark)}/processed-{uuid.uuid4().hex}"))


@query("merged_scanner_outputs", V.sql("items", """SELECT scanner, count(*) AS findings, count(target_code) AS with_code, count(service) AS with_service FROM (
  SELECT scanner, target_code, NULL AS service FROM items WHERE scanner = 'grep-scanner' UNION ALL SELECT scanner, NULL, service FROM items WHERE scanner <> 'grep-scanner') GROUP BY 1"""))
def merged_scanner_outputs(spark, folder):
    raw = V.items(spark, folder)
    a = raw.where("scanner = 'grep-scanner'").select("scanner", "target_code")
    b = raw.where("scanner <> 'grep-scanner'").select("scanner", "service")
    return validate.merged([a, b]).groupBy("scanner").agg(F.count(F.lit(1)).alias("findings"), F.count("target_code").alias("with_code"), F.count("service").alias("with_service"))


@query("loss_guard", V.sql("findings", "SELECT severity, count(*) AS findings FROM findings GROUP BY severity"))
def loss_guard(spark, folder):
    # The second version has lost rows, so the first one stays; the third has all of them.
    home = f"{checkpoint_folder(spark)}/guarded-{uuid.uuid4().hex}"
    sinks.publish(V.findings(spark, folder), home)
    found = sinks.table(spark, home)
    sinks.publish(found.where("severity <> 'LOW'"), home, no_loss=True)
    sinks.publish(found.withColumn("enriched", F.lit(True)), home, no_loss=True)
    return sinks.table(spark, home).where("enriched").groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


# ------------------------------------------------------------------------------------ groups
# Findings grouped by the words before " in ": one pattern per part name and type.
CROSS = """SELECT *, coalesce(nullif(search_pattern, ''), description) AS pattern FROM findings"""
GROUPS = """SELECT rule, pattern, count(*) AS count, count(DISTINCT file) AS files, min(substr(description, 1, 60)) AS description, concat(rule, ' across ', cast(count(DISTINCT file) AS varchar), ' files') AS "group",
  concat(rule, '|', pattern) AS group_key FROM crossed GROUP BY rule, pattern HAVING count(DISTINCT file) >= 3"""
GROUPED = dict(crossed=CROSS, groups=GROUPS)


@query("cross_cutting_groups", V.sql("findings", "SELECT * FROM groups", **GROUPED))
def cross_cutting_groups(spark, folder):
    return groups.cross_cutting_groups(V.findings(spark, folder))


@query("cross_cutting_findings", V.sql("findings", """SELECT id, g."group" IS NOT NULL AS cross_cutting, g."group" AS cross_cutting_group FROM crossed c LEFT JOIN groups g ON c.rule = g.rule AND c.pattern = g.pattern""", **GROUPED))
def cross_cutting_findings(spark, folder):
    return groups.cross_cutting(V.findings(spark, folder)).select("id", "cross_cutting", "cross_cutting_group")


WORDINGS = """SELECT DISTINCT rule, concat(rule, '|', array_to_string(words, ' ')) AS key, words FROM (
  SELECT rule, list_sort(list_distinct(list_filter(string_split_regex(lower(description), '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''))) AS words FROM findings)"""


SIMILAR = """SELECT a.key AS a, b.key AS b FROM wordings a JOIN wordings b ON a.rule = b.rule AND a.key <> b.key
WHERE len(list_intersect(a.words, b.words)) > 0.6 * len(list_distinct(list_concat(a.words, b.words)))"""


@query("jaccard_groups", V.sql("findings", """
WITH RECURSIVE reach(a, b) AS (SELECT key, key FROM wordings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
named AS (SELECT a AS key, min(b) AS similar_group FROM reach GROUP BY a)
SELECT similar_group, rule, count(*) AS findings, count(DISTINCT file) AS files FROM (
  SELECT f.rule, f.file, n.similar_group FROM (SELECT rule, file, concat(rule, '|', array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(description), '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''))), ' ')) AS key FROM findings) f
  JOIN named n ON f.key = n.key) GROUP BY 1, 2 HAVING count(DISTINCT file) >= 3""", wordings=WORDINGS, pairs=SIMILAR))
def jaccard_groups(spark, folder):
    return groups.similar_groups(V.findings(spark, folder))


@query("similar_findings", V.sql("findings", """
WITH RECURSIVE reach(a, b) AS (SELECT key, key FROM wordings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
named AS (SELECT a AS key, min(b) AS similar_group FROM reach GROUP BY a),
grouped AS (SELECT f.*, n.similar_group FROM (SELECT *, concat(rule, '|', array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(description), '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''))), ' ')) AS key FROM findings) f JOIN named n ON f.key = n.key),
wide AS (SELECT similar_group, min(phase) AS p, row_number() OVER (PARTITION BY min(phase) ORDER BY count(*) DESC, similar_group) AS at_, arg_min(substr(description, 1, 60), (length(description), description)) AS t FROM grouped GROUP BY similar_group HAVING count(DISTINCT file) >= 3)
SELECT id, p IS NOT NULL AS cross_cutting, CASE WHEN p IS NOT NULL THEN concat(p, '.', at_, ' ', t) END AS cross_cutting_group FROM grouped g LEFT JOIN wide w ON g.similar_group = w.similar_group""", wordings=WORDINGS, pairs=SIMILAR))
def similar_findings(spark, folder):
    return groups.tag_similar(V.findings(spark, folder)).select("id", "cross_cutting", "cross_cutting_group")


# ---------------------------------------------------------------------------------- families
FAMILY_KEYS = """SELECT *, coalesce(nullif(n1, ''), nullif(n2, ''), nullif(n3, ''), '') AS pattern_key FROM (SELECT *, """ + ", ".join(
    f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '`[^`]+`', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\b\\d+\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS n{i + 1}"
    for i, c in enumerate(("search_pattern", "current_code", "description"))) + " FROM findings WHERE rule IN ('R01', 'R05') AND severity <> 'REVIEW')"
FAMILIES = f"""SELECT concat('FAM-', lpad(cast(row_number() OVER (ORDER BY rule, pattern_key) AS varchar), 3, '0')) AS family_id, rule, pattern_key, root.id AS root_finding_id, root.severity AS root_severity,
  family_size, distinct_files, root.description AS description FROM (
  SELECT rule, pattern_key, arg_min({{'id': id, 'severity': severity, 'description': description}}, ({V.rank_sql('severity')}, phase, file, line, id)) AS root, count(*) AS family_size, count(DISTINCT file) AS distinct_files
  FROM keyed GROUP BY rule, pattern_key HAVING count(DISTINCT file) >= 2)"""
FAMILY = dict(keyed=FAMILY_KEYS, families=FAMILIES)
ROOT_RULES = ("R01", "R05")


@query("families", V.sql("findings", "SELECT * FROM families", **FAMILY))
def families(spark, folder):
    return groups.families(V.findings(spark, folder), ROOT_RULES)


@query("family_members", V.sql("findings", f"""SELECT f.id, m.family_id, CASE WHEN m.family_id IS NOT NULL THEN f.id = m.root_finding_id END AS is_root_cause,
  CASE WHEN f.id <> m.root_finding_id THEN m.root_finding_id END AS parent_finding_id, CASE WHEN f.id <> m.root_finding_id THEN f.severity END AS original_severity,
  CASE WHEN f.id <> m.root_finding_id THEN {V.map_sql(M.DEMOTION, 'f.severity')} ELSE f.severity END AS severity
FROM findings f LEFT JOIN (SELECT k.id, x.family_id, x.root_finding_id FROM keyed k JOIN families x ON k.rule = x.rule AND k.pattern_key = x.pattern_key) m ON f.id = m.id""", **FAMILY))
def family_members(spark, folder):
    found = V.findings(spark, folder)
    return groups.collapse(found, groups.families(found, ROOT_RULES), ROOT_RULES).select("id", "family_id", "is_root_cause", "parent_finding_id", "original_severity", "severity")


@query("family_summary", V.sql("findings", "SELECT count(*) AS families_created, count(*) AS root_causes, coalesce(cast(sum(family_size - 1) AS bigint), 0) AS subordinate_findings FROM families", **FAMILY))
def family_summary(spark, folder):
    return groups.family_summary(groups.families(V.findings(spark, folder), ROOT_RULES))


@query("pattern_keys", V.sql("findings", """SELECT DISTINCT description, trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g'), '\\b\\d+\\b', ' ', 'g')) AS key,
  trim(regexp_replace(lower(description), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS variant FROM (SELECT description FROM findings)"""))
def pattern_keys(spark, folder):
    return V.findings(spark, folder).select("description", X.pattern_text(F.col("description")).alias("key"),
                                            X.variant_key(F.col("description"), fallback=F.col("id")).alias("variant")).distinct()
