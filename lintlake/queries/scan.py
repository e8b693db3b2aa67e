"""Inventory, rule scan and line scans over the documents and the source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog import layers as L, maps as M, rules as R
from lintlake.functions import paths, text
from lintlake.operators import inventory as inv, scan
from lintlake.queries import views as V
from lintlake.queries.registry import query


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(f)})" for f in fragments) + ")"


def _starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {_q(f)})" for f in prefixes) + ")"


# ------------------------------------------------------------------------- inventory
def listed(spark, folder):
    return inv.inventory(V.code_files(spark, folder))


def _layer_sql() -> str:
    cases = []
    for stack, table in L.STACK_LAYERS.items():
        cases += [f"WHEN stack = '{stack}' AND {_any('lower(path)', marks)} THEN '{name}'" for name, marks in table.items()]
    cases += [f"WHEN {_any('lower(path)', marks)} THEN '{name}'" for name, marks in L.GENERIC_LAYERS.items()]
    return "CASE " + " ".join(cases) + f" ELSE '{L.DEFAULT_LAYER}' END"


HEAD = "array_to_string(list_slice(string_split(content, chr(10)), 1, {n}), chr(10))"
LOC = "cast(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - (CASE WHEN suffix(content, chr(10)) THEN 1 ELSE 0 END) END AS int)"

LISTED = f"""SELECT *, CASE WHEN tag = 'GENERATED' THEN 'Generated source file' END AS skip_reason,
      loc < {L.NOMINAL_LOC} AS nominal
FROM (SELECT *, CASE WHEN loc > {L.MAX_LOC} THEN 'OVERSIZED' WHEN {_any('lower(path)', L.TEST_MARKS)} THEN 'TEST'
      WHEN {_any('lower(path)', L.GENERATED_PATHS)} OR {_any('lower(' + HEAD.format(n=5) + ')', L.GENERATED_MARKS)} THEN 'GENERATED'
      ELSE 'SOURCE' END AS tag
FROM (SELECT *, {LOC} AS loc, {_layer_sql()} AS layer,
      regexp_matches(path, {_q(L.META_DIRS)}) AND regexp_matches(path, {_q(L.META_NAMES)})
        AND regexp_matches({HEAD.format(n=L.META_HEAD)}, {_q(L.META_MARKS)}) AS is_meta_file
      FROM code_files))"""


@query("nominal_files", V.sql("code_files", "SELECT path, nominal AND NOT starts_with(path, 'src/lib/') AND NOT starts_with(path, 'app/') AS nominal FROM listed", listed=LISTED))
def nominal_files(spark, folder):
    """Small files count as nominal unless they lie below a folder that has the say."""
    return inv.inventory(V.code_files(spark, folder), ["src/lib/", "app/"]).select("path", "nominal")


@query("file_inventory", V.sql("code_files", "SELECT path, stack, loc, layer, tag, nominal, is_meta_file, skip_reason FROM listed", listed=LISTED))
def file_inventory(spark, folder):
    return listed(spark, folder).select("path", "stack", "loc", "layer", "tag", "nominal", "is_meta_file", "skip_reason")


@query("document_inventory", V.sql("files", f"""
SELECT path, {LOC} AS loc, CASE WHEN {LOC} > {L.MAX_LOC} THEN 'OVERSIZED'
  WHEN {_any('lower(path)', L.TEST_MARKS)} THEN 'TEST'
  WHEN {_any('lower(path)', L.GENERATED_PATHS)} OR {_any('lower(' + HEAD.format(n=5) + ')', L.GENERATED_MARKS)} THEN 'GENERATED'
  ELSE 'SOURCE' END AS tag, {LOC} < {L.NOMINAL_LOC} AS nominal FROM files"""))
def document_inventory(spark, folder):
    return inv.inventory(V.files(spark, folder)).select("path", "loc", "tag", "nominal")


@query("source_tree_files", V.sql("code_files", """
SELECT path FROM mixed WHERE (ends_with(path, '.ts') AND stack = 'typescript' OR ends_with(path, '.py') AND stack = 'python'
  OR ends_with(path, '.java') AND stack = 'java' OR ends_with(path, '.go') AND stack = 'go' OR ends_with(path, '.rs') AND stack = 'rust')
  AND NOT regexp_matches(path, '(^|/)(dist|node_modules)/')""", mixed="""
SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('dist/', path) WHEN p_partkey % 3 = 1 THEN concat('a/node_modules/b/', path) ELSE path END AS path,
  CASE WHEN p_partkey % 8 = 0 THEN 'python' ELSE stack END AS stack FROM code_files"""))
def source_tree_files(spark, folder):
    key = F.col("p_partkey")
    mixed = V.code_files(spark, folder).select(
        F.when(key % 3 == 0, F.concat(F.lit("dist/"), "path")).when(key % 3 == 1, F.concat(F.lit("a/node_modules/b/"), "path"))
        .otherwise(F.col("path")).alias("path"),
        F.when(key % 8 == 0, "python").otherwise(F.col("stack")).alias("stack"))
    return inv.source_tree(mixed).select("path")


@query("inventory_layer_totals", V.sql("code_files", "SELECT layer, count(*) AS files, cast(sum(loc) AS bigint) AS loc FROM listed GROUP BY layer", listed=LISTED))
def inventory_layer_totals(spark, folder):
    return inv.layer_totals(listed(spark, folder))


@query("inventory_totals", V.sql("code_files", "SELECT count(*) AS total_files, cast(sum(loc) AS bigint) AS total_loc, count(DISTINCT layer) AS layers FROM listed", listed=LISTED))
def inventory_totals(spark, folder):
    return inv.totals(listed(spark, folder))


@query("line_reader", V.sql("lines", "SELECT path, count(*) AS lines, cast(sum(length(text)) AS bigint) AS chars FROM lines GROUP BY path"))
def line_reader(spark, folder):
    return scan.lines(V.files(spark, folder), "path").groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


# Repos made of customers: marker files whose content follows from the key.
MARKERS = """SELECT concat('r', cast(c_custkey AS varchar)) AS repo, path, content FROM (
  SELECT c_custkey, 'package.json' AS path, CASE c_custkey % 5 WHEN 0 THEN '{"dependencies":{"next":"1","react":"2"}}'
     WHEN 1 THEN '{"dependencies":{"react":"2"},"devDependencies":{"x":"1"}}' WHEN 2 THEN '{"devDependencies":{"vue":"3"}}'
     WHEN 3 THEN '{"dependencies":{"express":"3"}}' ELSE '{"name":"n"}' END AS content FROM customer WHERE c_nationkey % 4 = 0
  UNION ALL SELECT c_custkey, 'pyproject.toml', CASE c_custkey % 4 WHEN 0 THEN 'deps = [FastAPI]' WHEN 1 THEN 'deps = [django]'
     WHEN 2 THEN 'deps = [flask]' ELSE 'deps = []' END FROM customer WHERE c_nationkey % 4 IN (1, 0)
  UNION ALL SELECT c_custkey, 'pom.xml', '<project/>' FROM customer WHERE c_nationkey % 4 = 2
  UNION ALL SELECT c_custkey, 'src/package.json', '{"dependencies":{"next":"1"}}' FROM customer)"""


def markers(spark, folder):
    customer = V.table(spark, folder, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey") % 4
    package = (F.when(key % 5 == 0, '{"dependencies":{"next":"1","react":"2"}}')
               .when(key % 5 == 1, '{"dependencies":{"react":"2"},"devDependencies":{"x":"1"}}')
               .when(key % 5 == 2, '{"devDependencies":{"vue":"3"}}')
               .when(key % 5 == 3, '{"dependencies":{"express":"3"}}').otherwise('{"name":"n"}'))
    project = (F.when(key % 4 == 0, "deps = [FastAPI]").when(key % 4 == 1, "deps = [django]")
               .when(key % 4 == 2, "deps = [flask]").otherwise("deps = []"))
    found = F.array_compact(F.array(
        F.when(nation == 0, F.struct(F.lit("package.json").alias("path"), package.alias("content"))),
        F.when(nation.isin(0, 1), F.struct(F.lit("pyproject.toml").alias("path"), project.alias("content"))),
        F.when(nation == 2, F.struct(F.lit("pom.xml").alias("path"), F.lit("<project/>").alias("content"))),
        F.struct(F.lit("src/package.json").alias("path"), F.lit('{"dependencies":{"next":"1"}}').alias("content"))))
    return customer.select(F.concat(F.lit("r"), key.cast("string")).alias("repo"), F.explode(found).alias("f")).select("repo", "f.*")


@query("stack_detection", f"""
SELECT concat('r', cast(c_custkey AS varchar)) AS repo,
  CASE c_nationkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'java' ELSE 'unknown' END AS stack,
  CASE c_nationkey % 4 WHEN 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'react' WHEN 2 THEN 'vue' WHEN 3 THEN 'express' ELSE 'unknown' END
       WHEN 1 THEN CASE c_custkey % 4 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'django' WHEN 2 THEN 'flask' ELSE 'unknown' END
       ELSE 'unknown' END AS framework FROM customer""")
def stack_detection(spark, folder):
    return inv.stacks(markers(spark, folder))


# ------------------------------------------------------------------------- rule scan
PROSE = {"en": R.PROSE, "de": R.PROSE, "fr": R.PROSE, "es": R.PROSE}


def prose_files(spark, folder):
    return V.files(spark, folder).withColumn("is_meta_file", F.lit(False))


def prose_findings(spark, folder):
    return scan.rule_scan(prose_files(spark, folder), PROSE)


def _match_sql(rule: R.Rule) -> str:
    """The rule's test on ``text``; a lookahead becomes a second test on the whole line."""
    for pattern, yes, no in _LOOKAHEADS:
        if rule.pattern == pattern:
            return f"(regexp_matches(text, {_q(yes)}) AND NOT regexp_matches(text, {_q(no)}))"
    return f"regexp_matches(text, {_q(rule.pattern)})"


_LOOKAHEADS = [
    (r"https?://(?!localhost)[^\s\"']+", r"https?://[^\s\"']+", r"https?://localhost"),
    (r"@RequestParam\b(?!.*@Valid)", r"@RequestParam\b", r"@RequestParam\b.*@Valid"),
    (r"unsafe\b(?!.*//\s*SAFETY)", r"unsafe\b", r"unsafe\b.*//\s*SAFETY"),
]


def _extract_sql(rule: R.Rule) -> str:
    for pattern, yes, _ in _LOOKAHEADS:
        if rule.pattern == pattern:
            return f"regexp_extract(code, {_q(yes)}, 0)"
    return f"regexp_extract(code, {_q(rule.pattern)}, 0)"


def _rule_sql(rule: R.Rule, stacks: list[str], source: str) -> str:
    where = [_match_sql(rule), f"stack IN ({', '.join(_q(s) for s in stacks)})", f"NOT {_any('path', L.SCAN_SKIP)}"]
    if rule.rule in L.COMMENT_RULES:
        where.append(f"NOT {_starts('code', L.COMMENT_STARTS)}")
    if rule.not_on_import:
        where.append(f"NOT regexp_matches(code, {_q(L.IMPORT_LINE)})")
    if rule.code_only:
        where.append(f"regexp_matches(regexp_replace(code, {_q(L.LITERALS)}, ' ', 'g'), {_q(rule.pattern)})")
    if "innerHTML" in rule.pattern:
        where.append(f"NOT regexp_matches(code, {_q(L.SAFE_CLEAR)})")
    if rule.rule in L.META_SKIPPED_RULES:
        where.append("NOT is_meta_file")
    if rule.not_in_layers:
        where.append(f"layer NOT IN ({', '.join(_q(x) for x in rule.not_in_layers)})")
    where += [f"NOT regexp_matches(path, {_q(paths.glob_regex(g))})" for g in rule.not_in_paths]
    target = "''" if rule.removable else "cast(NULL AS varchar)"
    return (f"SELECT {_q(rule.rule)} AS rule, {_q(rule.severity)} AS severity, {_q(rule.category)} AS category, path AS file, "
            f"line, code, layer, {_q(rule.description)} AS description, {rule.phase} AS phase, {target} AS target_code, "
            f"{_q(rule.confidence)} AS confidence, {_q(rule.reason)} AS confidence_reason, {_extract_sql(rule)} AS search_pattern "
            f"FROM {source} WHERE {' AND '.join(where)}")


def _scan_sql(by_stack, source: str) -> str:
    done, out = [], []
    for table in by_stack.values():
        if any(table is t for t in done):
            continue
        done.append(table)
        out += [_rule_sql(r, [s for s, t in by_stack.items() if t is table], source) for r in table]
    return " UNION ALL ".join(out)


PROSE_LINES = """SELECT path, layer, stack, line, text, trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS code, false AS is_meta_file FROM lines"""
CODE_SOURCE = f"""SELECT l.path, layer, l.stack, line, text, trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS code, is_meta_file
FROM code_lines l JOIN listed i ON l.path = i.path WHERE tag IN ('SOURCE', 'OVERSIZED')"""
FINDING_COLUMNS = """rule, severity, category, file, line, substr(code, 1, 200) AS snippet, description, phase, target_code, layer,
  confidence, confidence_reason, search_pattern"""
SPARK_COLUMNS = ["rule", "severity", "category", "file", "line", "snippet", "description", "phase", "target_code", "layer",
                 "confidence", "confidence_reason", "search_pattern"]


@query("rule_scan_findings", V.sql("lines", f"SELECT {FINDING_COLUMNS} FROM hits", source=PROSE_LINES, hits=_scan_sql(PROSE, "source")))
def rule_scan_findings(spark, folder):
    return prose_findings(spark, folder).select(*SPARK_COLUMNS)


@query("rule_scan_hits", V.sql("lines", "SELECT rule, description, count(*) AS hits, count(DISTINCT file) AS files FROM hits GROUP BY 1, 2",
                              source=PROSE_LINES, hits=_scan_sql(PROSE, "source")))
def rule_scan_hits(spark, folder):
    return prose_findings(spark, folder).groupBy("rule", "description").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("file").alias("files"))


def code_findings(spark, folder):
    return scan.rule_scan(listed(spark, folder))


CODE_HITS = dict(listed=LISTED, source=CODE_SOURCE, hits=_scan_sql(R.BY_STACK, "source"))


@query("code_scan_findings", V.sql("code_lines", f"SELECT {FINDING_COLUMNS} FROM hits", **CODE_HITS))
def code_scan_findings(spark, folder):
    return code_findings(spark, folder).select(*SPARK_COLUMNS)


@query("code_scan_counters", V.sql("code_lines", f"""SELECT {V.map_sql(M.CATEGORY_PREFIX, 'category', "'GEN'")} AS prefix,
  count(*) AS findings, count(target_code) AS removable FROM hits GROUP BY 1""", **CODE_HITS))
def code_scan_counters(spark, folder):
    return scan.scan_counters(code_findings(spark, folder))


@query("rule_recall_misses", V.sql("code_lines", """SELECT rule, path AS file FROM expected WHERE NOT EXISTS
  (SELECT 1 FROM hits WHERE hits.rule = expected.rule AND hits.file = expected.path)""",
                                   expected="""SELECT path, 'R14' AS rule FROM code_lines WHERE contains(text, 'TODO') GROUP BY path""", **CODE_HITS))
def rule_recall_misses(spark, folder):
    from lintlake.operators import verify
    marked = scan.lines(V.code_files(spark, folder), "path").where(F.col("text").contains("TODO"))
    expected = marked.select(F.lit("R14").alias("rule"), F.col("path").alias("file")).distinct()
    return verify.recall_misses(expected, code_findings(spark, folder))


def _fix_sql() -> str:
    out = []
    for stack, rule, pattern, excuse, message in R.FIX_CHECKS:
        skip = f" AND NOT regexp_matches(text, {_q(excuse)})" if excuse else ""
        out.append(f"SELECT path, {_q(rule)} AS rule, {_q(message)} AS message, line, row_number() OVER (PARTITION BY path ORDER BY line) AS n "
                   f"FROM code_lines WHERE stack = '{stack}' AND regexp_matches(text, {_q(pattern)}){skip}")
    return " UNION ALL ".join(out)


@query("fix_compliance", V.sql("code_lines", f"SELECT path, rule, message, line, cast(n AS int) AS n FROM ({_fix_sql()})"))
def fix_compliance(spark, folder):
    return scan.fix_compliance(V.code_files(spark, folder))


def _unsafe_sql() -> str:
    return " OR ".join(f"(stack = '{s}' AND regexp_matches(text, {_q(p)}))" for s, ps in R.UNSAFE.items() for p in ps)


@query("changed_file_markers", V.sql("code_lines", f"""
SELECT path, 'stub' AS kind, line, text FROM touched WHERE regexp_matches(text, {_q(R.STUB)})
UNION ALL SELECT path, 'unsafe-type' AS kind, line, text FROM touched WHERE {_unsafe_sql()}""",
                                     touched="SELECT * FROM code_lines WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"))
def changed_file_markers(spark, folder):
    code = V.code_files(spark, folder)
    changed = V.table(spark, folder, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey").distinct()
    return scan.changed_markers(code, code.join(changed, F.expr("p_partkey = l_partkey"), "left_semi"))


# Pages as component files: the markup a page renders, or none.
COMPONENTS = """SELECT concat('src/components/c', cast(page_id AS varchar), CASE WHEN page_id % 4 = 0 THEN '.ts' ELSE '.tsx' END) AS path,
  concat(CASE WHEN page_id % 5 = 0 THEN 'const A = () => {' ELSE 'export default function A() {' END, chr(10), '  // ', url, chr(10),
  CASE WHEN page_id % 3 = 0 THEN '  return null' WHEN page_id % 3 = 1 THEN '  return (' ELSE '  return <div/>' END, chr(10), '}') AS content FROM pages"""


@query("component_without_return", f"""SELECT path FROM ({COMPONENTS}) WHERE ends_with(path, '.tsx')
  AND regexp_matches(content, '(?m){R.COMPONENT_EXPORT}') AND NOT regexp_matches(content, '(?m)return[ ]*[(]?[ ]*<|return[ ]+<|return[ ]*[(][ ]*$')""")
def component_without_return(spark, folder):
    key = F.col("page_id")
    made = V.table(spark, folder, "pages").select(
        F.concat(F.lit("src/components/c"), key.cast("string"), F.when(key % 4 == 0, ".ts").otherwise(".tsx")).alias("path"),
        F.concat(F.when(key % 5 == 0, "const A = () => {").otherwise("export default function A() {"), F.lit("\n  // "), F.col("url"), F.lit("\n"),
                 F.when(key % 3 == 0, "  return null").when(key % 3 == 1, "  return (").otherwise("  return <div/>"), F.lit("\n}")).alias("content"))
    return scan.components_without_return(made)


def _heads_sql() -> str:
    kind = V.map_sql(R.HEAD_KIND, "regexp_extract(path, '[.]([^./]+)$', 1)")
    test = " OR ".join(f"(kind = '{k}' AND regexp_matches(text, {_q(p)}))" for k, p in R.FUNCTION_HEAD.items())
    return f"SELECT * FROM (SELECT *, {kind} AS kind FROM code_lines) WHERE {test}"


@query("empty_functions", V.sql("code_lines", """
SELECT path, line, cast(sum(CASE WHEN counts THEN 1 ELSE 0 END) AS int) AS body_lines FROM (
  SELECT *, min(CASE WHEN ends THEN pos END) OVER (PARTITION BY path, line) AS stop, bool_or(opened) OVER (PARTITION BY path, line) AS any_open FROM (
    SELECT *, CASE WHEN kind = 'py' THEN i > 1 AND bare <> '' AND NOT starts_with(text, ' ') AND NOT starts_with(text, chr(9)) ELSE opened AND depth <= 0 END AS ends,
      CASE WHEN kind = 'py' THEN i > 0 AND bare <> '' AND NOT starts_with(bare, '#')
           ELSE opened AND bare <> '' AND NOT starts_with(bare, '//') AND NOT starts_with(bare, '#') AND bare NOT IN ('{', '}', '};', '},') END AS counts FROM (
      SELECT h.path, h.line, h.kind, l.line AS pos, l.line - h.line AS i, l.text, trim(l.text, concat(' ', chr(9), chr(13))) AS bare,
        sum(length(regexp_replace(l.text, '[^{]', '', 'g')) - length(regexp_replace(l.text, '[^}]', '', 'g'))) OVER w AS depth,
        CASE WHEN h.kind = 'py' THEN contains(h.text, ':') ELSE bool_or(contains(l.text, '{')) OVER w END AS opened
      FROM heads h JOIN code_lines l ON h.path = l.path AND l.line >= h.line AND l.line < h.line + 50
      WINDOW w AS (PARTITION BY h.path, h.line ORDER BY l.line)))) 
WHERE (stop IS NULL OR pos <= stop) GROUP BY path, line HAVING bool_or(any_open) AND sum(CASE WHEN counts THEN 1 ELSE 0 END) <= 3""", heads=_heads_sql()))
def empty_functions(spark, folder):
    return scan.empty_functions(V.code_files(spark, folder))


MESSAGES = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 'src/a.ts' ELSE 'docs/POLICY.md' END AS path,
  concat(text, chr(10), CASE conv_id % 4 WHEN 0 THEN concat('Co-Authored-By: ', role, ' AI bot') WHEN 1 THEN 'Generated with [AI tools]'
    WHEN 2 THEN 'this part is ai-written' ELSE 'reviewed by hand' END) AS content FROM conversations"""


@query("attribution_scan", f"""SELECT conv_id * 1000 + turn AS id, path, cast(line AS int) AS line, text FROM (
  SELECT conv_id, turn, path, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS line FROM
    (SELECT *, string_split(content, chr(10)) AS parts FROM ({MESSAGES})))
WHERE (path IS NULL OR NOT regexp_matches(path, 'POLICY.md$')) AND ({' OR '.join(f"regexp_matches(text, {_q(p)})" for p in scan.attribution_patterns())})""")
def attribution_scan(spark, folder):
    conv, turn = F.col("conv_id"), F.col("turn")
    made = V.table(spark, folder, "conversations").select(
        (conv * 1000 + turn).alias("id"),
        F.when(turn % 3 == 0, F.lit(None)).when(turn % 3 == 1, "src/a.ts").otherwise("docs/POLICY.md").alias("path"),
        F.concat("text", F.lit("\n"), F.when(conv % 4 == 0, F.concat(F.lit("Co-Authored-By: "), "role", F.lit(" AI bot")))
                 .when(conv % 4 == 1, "Generated with [AI tools]").when(conv % 4 == 2, "this part is ai-written")
                 .otherwise("reviewed by hand")).alias("content"))
    return scan.attribution_hits(made, excluded="POLICY.md$")


# ---------------------------------------------------------------------------- triage
BARE = "trim(text, concat(' ', chr(9), chr(13)))"
TRIAGE = dict(CODE_HITS, facts=f"""SELECT path,
    count(*) FILTER (WHERE {BARE} <> '' AND NOT {_starts(BARE, ['//', '#', '/*', '*'])}) AS meaningful,
    count(*) FILTER (WHERE {BARE} <> '' AND NOT {_starts(BARE, ['//', '#', '/*', '*'])} AND regexp_matches({BARE}, {_q(L.STRUCTURAL_LINE)})) AS shaped,
    count(*) FILTER (WHERE regexp_matches(text, {_q(L.IMPORT_LINE)})) AS imports FROM code_lines GROUP BY path""")


@query("file_triage", V.sql("code_lines", f"""
SELECT path, layer, CASE WHEN flagged THEN 'flagged' WHEN meaningful = 0 OR shaped / meaningful >= 0.9 THEN 'structural_only'
    WHEN always OR entry OR imports >= {L.MIN_IMPORTS} THEN 'always_scan' ELSE 'llm_scan' END AS class,
  CASE WHEN flagged THEN 'grep_finding' WHEN meaningful = 0 OR shaped / meaningful >= 0.9 THEN 'type_decl_or_reexport'
    WHEN always THEN concat('always_scan_layer:', layer) WHEN entry THEN 'entry_point_pattern' WHEN imports >= {L.MIN_IMPORTS} THEN 'high_import_count' ELSE 'default' END AS reason
FROM (SELECT i.path, layer, coalesce(meaningful, 0) AS meaningful, coalesce(shaped, 0) AS shaped, coalesce(imports, 0) AS imports,
    i.path IN (SELECT file FROM hits WHERE rule = 'R05') AS flagged, layer IN ({', '.join(_q(x) for x in L.ALWAYS_LAYERS)}) AS always,
    regexp_extract(i.path, '[^/]*$', 0) IN ({', '.join(_q(x) for x in L.ENTRY_POINTS)}) AS entry
  FROM listed i LEFT JOIN facts f ON i.path = f.path)""", **TRIAGE))
def file_triage(spark, folder):
    files = listed(spark, folder)
    return scan.triage(files, scan.rule_scan(files).where("rule = 'R05'"))


@query("file_shape", V.sql("code_lines", """SELECT i.path, coalesce(meaningful, 0) = 0 OR shaped / meaningful >= 0.9 AS structural_only,
  cast(coalesce(imports, 0) AS int) AS imports FROM listed i LEFT JOIN facts f ON i.path = f.path""", **TRIAGE))
def file_shape(spark, folder):
    content = F.col("content")
    return V.code_files(spark, folder).select("path", scan.structural_only(content).alias("structural_only"),
                                              scan.import_count(content).alias("imports"))


@query("shared_definitions", V.sql("code_lines", """
SELECT name, count(DISTINCT path) AS files, count(*) AS uses FROM (
  SELECT path, regexp_extract(text, '^\\s*(?:export\\s+)?(?:async\\s+)?(?:def|function|func|fn|class|interface)\\s+([A-Za-z_]\\w*)', 1) AS name FROM code_lines)
WHERE name <> '' GROUP BY name HAVING count(DISTINCT path) >= 2"""))
def shared_definitions(spark, folder):
    return scan.in_several_files(scan.definitions(V.code_files(spark, folder)))


@query("shared_numeric_literals", V.sql("lines", """
SELECT name, count(DISTINCT path) AS files, count(*) AS uses FROM (SELECT path, unnest(regexp_extract_all(text, '\\b(\\d{3,})\\b', 1)) AS name FROM lines)
GROUP BY name HAVING count(DISTINCT path) >= 2"""))
def shared_numeric_literals(spark, folder):
    return scan.in_several_files(scan.numeric_literals(V.files(spark, folder)))


# -------------------------------------------------------------------- path expressions
@query("file_language", V.sql("code_files", """SELECT path, CASE WHEN ends_with(path, '.ts') THEN 'ts' WHEN ends_with(path, '.py') THEN 'python'
  WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.go') THEN 'go' ELSE '' END AS language FROM code_files"""))
def file_language(spark, folder):
    return V.code_files(spark, folder).select("path", paths.language(F.col("path")).alias("language"))


ROUTES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('src/app/u', cast(page_id AS varchar), '/page.tsx') WHEN 1 THEN concat('app/api/u', cast(page_id AS varchar), '/route.ts')
  WHEN 2 THEN concat('pages/u', cast(page_id AS varchar), '.jsx') WHEN 3 THEN 'src/pages/index.tsx' WHEN 4 THEN concat('src/routes/u', cast(page_id AS varchar), '/+page.svelte')
  ELSE concat('lib/u', cast(page_id AS varchar), '.ts') END AS path FROM pages"""


@query("runtime_routes", f"""SELECT path, CASE page_id % 6 WHEN 1 THEN 'api' WHEN 5 THEN NULL ELSE 'page' END AS kind,
  CASE page_id % 6 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'nextjs-api' WHEN 2 THEN 'pages-router' WHEN 3 THEN 'pages-router' WHEN 4 THEN 'sveltekit' END AS framework,
  CASE page_id % 6 WHEN 0 THEN concat('/u', cast(page_id AS varchar)) WHEN 1 THEN concat('/api/u', cast(page_id AS varchar))
    WHEN 2 THEN concat('/u', cast(page_id AS varchar)) WHEN 3 THEN '/' WHEN 4 THEN concat('/u', cast(page_id AS varchar)) END AS url FROM ({ROUTES})""")
def runtime_routes(spark, folder):
    key = F.col("page_id")
    text_key = key.cast("string")
    made = V.table(spark, folder, "pages").select(
        F.when(key % 6 == 0, F.concat(F.lit("src/app/u"), text_key, F.lit("/page.tsx")))
        .when(key % 6 == 1, F.concat(F.lit("app/api/u"), text_key, F.lit("/route.ts")))
        .when(key % 6 == 2, F.concat(F.lit("pages/u"), text_key, F.lit(".jsx")))
        .when(key % 6 == 3, "src/pages/index.tsx")
        .when(key % 6 == 4, F.concat(F.lit("src/routes/u"), text_key, F.lit("/+page.svelte")))
        .otherwise(F.concat(F.lit("lib/u"), text_key, F.lit(".ts"))).alias("path"))
    kind, framework = paths.runtime_kind(F.col("path"))
    return made.select("path", kind.alias("kind"), framework.alias("framework")).withColumn(
        "url", paths.route(F.col("path"), F.col("framework")))


@query("parsed_counts", "SELECT o_orderkey, cast(o_orderkey * 1037 AS bigint) AS n, cast(NULL AS bigint) AS none FROM orders")
def parsed_counts(spark, folder):
    shown = F.format_number(F.col("o_orderkey") * 1037, 0)
    return V.table(spark, folder, "orders").select("o_orderkey", text.parsed_count(shown).alias("n"), text.parsed_count(F.concat(shown, F.lit(" rows"))).alias("none"))


@query("text_slugs", """SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""")
def text_slugs(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))
