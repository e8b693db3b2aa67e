"""Reports of other checkers, environment files, tests and duplicates.

The report texts are made by Spark from the given tables, one report per row, so that they
grow with the tables; the oracle computes the expected findings from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog import maps as M, rules as R
from lintlake.operators import assertions, duplicates, environment
from lintlake.queries import views as V
from lintlake.queries.registry import query
from lintlake.queries.scan import _q
from lintlake.sources import readers, reports, sinks

SHOWN = ["rule", "severity", "category", "file", "line", "snippet", "description", "phase", "scanner", "confidence", "confidence_reason", "tool_rule_id"]


def shown(findings, *more):
    return reports.complete_findings(findings).select(*SHOWN, *more)


def _findings_sql(source: str, *, rule, severity, category, file, line, snippet, description, scanner, reason, confidence="'high'", tool="''", phase=None, more="") -> str:
    phase = phase or V.map_sql(M.RULE_PHASE, "rule", "5")
    return (f"SELECT rule, severity, category, file, line, substr(snippet, 1, 200) AS snippet, description, {phase} AS phase, '{scanner}' AS scanner, confidence, confidence_reason, tool_rule_id{', ' + more if more else ''} FROM ("
            f"SELECT *, {rule} AS rule, {severity} AS severity, {category} AS category, {file} AS file, cast({line} AS int) AS line, {snippet} AS snippet, {description} AS description, "
            f"{confidence} AS confidence, {reason} AS confidence_reason, {tool} AS tool_rule_id FROM ({source}))")


def _pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)


def _pick_sql(values, by):
    return V.map_sql(dict(enumerate(values)), f"{by} % {len(values)}")


def _mapped_sql(table, default, key, part):
    cases = [f"WHEN {key} = '{k}' THEN '{v[part]}'" for k, v in table.items() if not k.endswith("*")]
    cases += [f"WHEN starts_with({key}, '{k[:-1]}') THEN '{v[part]}'" for k, v in table.items() if k.endswith("*")]
    return f"CASE {' '.join(cases)} ELSE '{default[part]}' END"


def _path():
    return F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts"))


PATH_SQL = "concat('src/p', cast(p_partkey AS varchar), '.ts')"


def part(spark, folder):
    return V.table(spark, folder, "part")


# ---------------------------------------------------------------------------------- linters
ESLINT_IDS = ["no-unused-vars", "react-hooks/exhaustive-deps", "no-console", "jsx-a11y/alt-text", "semi", ""]


@query("report_eslint", _findings_sql(f"SELECT *, unnest([0, 1]) AS n FROM part", rule=_mapped_sql(M.ESLINT_RULES, M.ESLINT_DEFAULT, "id", 0), category=_mapped_sql(M.ESLINT_RULES, M.ESLINT_DEFAULT, "id", 1),
       severity=_mapped_sql(M.ESLINT_RULES, M.ESLINT_DEFAULT, "id", 2), file=PATH_SQL, line="p_size + n", snippet="concat(p_name, ' is wrong')", description="concat(p_name, ' is wrong')", scanner="eslint",
       reason="concat('checked by ESLint, rule ', id)", tool="id").replace("FROM (SELECT *, unnest([0, 1]) AS n FROM part)", f"FROM (SELECT *, CASE WHEN x = '' THEN 'parse-error' ELSE x END AS id FROM (SELECT *, {_pick_sql(ESLINT_IDS, '(p_partkey + n)')} AS x FROM (SELECT *, unnest([0, 1]) AS n FROM part)))"))
def report_eslint(spark, folder):
    def message(n):
        return F.struct(_pick(ESLINT_IDS, F.col("p_partkey") + n).alias("ruleId"), (F.col("p_size") + n).alias("line"), F.concat(F.col("p_name"), F.lit(" is wrong")).alias("message"))
    report = F.to_json(F.array(F.struct(F.concat(F.lit("/work/app/"), _path()).alias("filePath"), F.array(message(0), message(1)).alias("messages"))))
    return shown(reports.eslint(part(spark, folder).select(report.alias("content")), "/work/app"))


@query("report_tsc", _findings_sql("SELECT *, concat(CASE WHEN p_partkey % 3 = 0 THEN 'Type ' ELSE 'Cannot find ' END, p_name) AS m FROM part WHERE p_partkey % 7 <> 0", rule="CASE WHEN p_partkey % 3 = 0 THEN 'R07' ELSE 'R14' END",
       severity="CASE WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END", category="CASE WHEN p_partkey % 3 = 0 THEN 'typing' ELSE 'build' END", file=PATH_SQL, line="p_size", snippet="m", description="m", scanner="tsc",
       reason="concat('checked by the TypeScript compiler, code TS', cast(p_partkey AS varchar))", tool="concat('TS', cast(p_partkey AS varchar))"))
def report_tsc(spark, folder):
    text = F.concat(_path(), F.lit("("), F.col("p_size").cast("string"), F.lit(",3): "), F.when(F.col("p_partkey") % 2 == 0, "error").otherwise("warning"), F.lit(" TS"), F.col("p_partkey").cast("string"), F.lit(": "),
                    F.when(F.col("p_partkey") % 3 == 0, "Type ").otherwise("Cannot find "), F.col("p_name"))
    lines = part(spark, folder).select(F.when(F.col("p_partkey") % 7 == 0, "Found 3 errors.").otherwise(text).alias("value"))
    return shown(reports.tsc(lines))


RUFF_IDS = ["F401", "E501", "S608", "B006", "XYZ1"]


@query("report_ruff", _findings_sql(f"SELECT *, {_pick_sql(RUFF_IDS, 'p_partkey')} AS id FROM part", rule=_mapped_sql(M.RUFF_RULES, M.RUFF_DEFAULT, "id", 0), category=_mapped_sql(M.RUFF_RULES, M.RUFF_DEFAULT, "id", 1),
       severity=_mapped_sql(M.RUFF_RULES, M.RUFF_DEFAULT, "id", 2), file=PATH_SQL, line="p_size", snippet="p_brand", description="p_brand", scanner="ruff", reason="concat('checked by Ruff, rule ', id)", tool="id"))
def report_ruff(spark, folder):
    row = F.struct(_pick(RUFF_IDS, F.col("p_partkey")).alias("code"), _path().alias("filename"), F.col("p_brand").alias("message"), F.struct(F.col("p_size").alias("row")).alias("location"))
    return shown(reports.ruff(part(spark, folder).select(F.to_json(F.array(row)).alias("content"))))


MYPY_IDS = ["assignment", "name-defined", "override", "misc"]


@query("report_mypy", _findings_sql(f"SELECT *, {_pick_sql(MYPY_IDS, 'p_partkey')} AS id FROM part WHERE p_partkey % 5 > 1", rule=_mapped_sql(M.MYPY_RULES, M.MYPY_DEFAULT, "id", 0), category=_mapped_sql(M.MYPY_RULES, M.MYPY_DEFAULT, "id", 1),
       severity=_mapped_sql(M.MYPY_RULES, M.MYPY_DEFAULT, "id", 2), file=PATH_SQL, line="p_size", snippet="p_name", description="p_name", scanner="mypy", reason="concat('checked by mypy, code ', id)", tool="id"))
def report_mypy(spark, folder):
    row = F.to_json(F.struct(_path().alias("file"), F.col("p_size").alias("line"), F.col("p_name").alias("message"), _pick(MYPY_IDS, F.col("p_partkey")).alias("code"),
                             F.when(F.col("p_partkey") % 5 == 0, "note").otherwise("error").alias("severity")))
    return shown(reports.mypy(part(spark, folder).select(F.when(F.col("p_partkey") % 5 == 1, "{not json").otherwise(row).alias("value"))))


@query("report_semgrep", _findings_sql("SELECT *, concat('rule.', p_brand) AS id FROM part", rule="CASE WHEN p_partkey % 2 = 0 THEN 'R05' ELSE 'R14' END", category="CASE WHEN p_partkey % 2 = 0 THEN 'security' ELSE 'build' END",
       severity="CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END", file=PATH_SQL, line="p_size", snippet="p_brand", description="p_name", scanner="semgrep", reason="concat('matched by Semgrep, rule ', id)", tool="id",
       more="CASE p_partkey % 3 WHEN 0 THEN 'CWE-1,CWE-2' WHEN 1 THEN 'CWE-79' ELSE '' END AS cwes"))
def report_semgrep(spark, folder):
    meta = F.when(F.col("p_partkey") % 3 == 0, '"cwe":["CWE-1","CWE-2"],').when(F.col("p_partkey") % 3 == 1, '"cwe":"CWE-79",').otherwise("")
    level = F.when(F.col("p_partkey") % 4 == 0, '"severity":"ERROR",').when(F.col("p_partkey") % 4 == 1, '"severity":"WARNING",').when(F.col("p_partkey") % 4 == 2, '"severity":"ODD",').otherwise("")
    report = F.concat(F.lit('{"results":[{"check_id":"rule.'), F.col("p_brand"), F.lit('","path":"'), _path(), F.lit('","start":{"line":'), F.col("p_size").cast("string"), F.lit('},"extra":{'), level,
                      F.lit('"message":"'), F.col("p_name"), F.lit('","lines":"'), F.col("p_brand"), F.lit('","metadata":{'), meta, F.lit('"category":"'), F.when(F.col("p_partkey") % 2 == 0, "Security").otherwise("style"), F.lit('"}}}]}'))
    return shown(reports.semgrep(part(spark, folder).select(report.alias("content"))), F.array_join("cwe", ",").alias("cwes"))


@query("report_checkstyle", _findings_sql("SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 'JavadocMethod' ELSE 'Indentation' END AS id FROM part", rule="CASE WHEN p_partkey % 4 = 0 THEN 'R11' ELSE 'R14' END",
       category="CASE WHEN p_partkey % 4 = 0 THEN 'documentation' ELSE 'build' END", severity="CASE WHEN p_partkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END", file=PATH_SQL, line="p_size", snippet="p_name", description="p_name", scanner="checkstyle",
       reason="concat('checked by Checkstyle, module ', id)", tool="id"))
def report_checkstyle(spark, folder):
    report = F.concat(F.lit('<?xml version="1.0"?><checkstyle version="9"><file name="/p/'), _path(), F.lit('"><error line="'), F.col("p_size").cast("string"), F.lit('" severity="'),
                      F.when(F.col("p_partkey") % 3 == 0, "error").otherwise("warning"), F.lit('" message="'), F.col("p_name"), F.lit('" source="com.checks.'), F.when(F.col("p_partkey") % 4 == 0, "javadoc.JavadocMethod").otherwise("indent.Indentation"),
                      F.lit('"/></file></checkstyle>'))
    return shown(reports.checkstyle(part(spark, folder).select(report.alias("content")), "/p"))


# ------------------------------------------------------------------------ structure checkers
@query("report_jscpd", _findings_sql("SELECT *, cast(p_size AS varchar) AS n, concat('lib/q', cast(p_partkey AS varchar)) AS other FROM part", rule="'R01'", category="'ssot-dry'", severity="CASE WHEN p_size > 20 THEN 'MEDIUM' ELSE 'LOW' END",
       file=PATH_SQL, line="p_partkey % 90", snippet="concat(n, ' lines, also in ', other, ':7')", description=f"concat('Copied code: ', n, ' lines are the same in ', {PATH_SQL}, ' and ', other)", scanner="jscpd",
       reason="concat('same tokens found by jscpd (', n, ' lines)')"))
def report_jscpd(spark, folder):
    dup = F.struct(F.col("p_size").alias("lines"), F.struct(_path().alias("name"), (F.col("p_partkey") % 90).alias("start")).alias("firstFile"),
                   F.struct(F.concat(F.lit("lib/q"), F.col("p_partkey").cast("string")).alias("name"), F.lit(7).alias("start")).alias("secondFile"))
    return shown(reports.jscpd(part(spark, folder).select(F.to_json(F.struct(F.array(dup).alias("duplicates"))).alias("content"))))


@query("report_knip", _findings_sql("SELECT * FROM part", rule="'R09'", category="'clean-code'", severity="'MEDIUM'", file=PATH_SQL, line="1", snippet="'no import of this file'",
       description=f"concat('Nothing imports ', {PATH_SQL}, ' from elsewhere')", scanner="knip", reason="'no import found by knip'") + " UNION ALL " + _findings_sql(
       "SELECT * FROM part", rule="'R09'", category="'clean-code'", severity="'LOW'", file=PATH_SQL, line="p_size", snippet="concat('export without use: ', p_name)", description="concat('Nobody imports the exported name ''', p_name, '''')",
       scanner="knip", reason="'no use of the export found by knip'") + " UNION ALL " + _findings_sql("SELECT * FROM part", rule="'R14'", category="'build'", severity="'LOW'", file="'package.json'", line="1", snippet="concat('package without use: ', p_brand)",
       description="concat('package.json names ''', p_brand, ''', which no file imports')", scanner="knip", reason="'no use of the package found by knip'"))
def report_knip(spark, folder):
    dependency = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"name":"'), F.col("p_brand"), F.lit('"}'))).otherwise(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')))
    export = F.struct(_path().alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("line"))
    report = F.concat(F.lit('{"files":["'), _path(), F.lit('"],"exports":['), F.to_json(export), F.lit('],"dependencies":['), dependency, F.lit("]}"))
    return shown(reports.knip(part(spark, folder).select(report.alias("content"))))


CHAIN_SQL = f"concat({PATH_SQL}, ' -> ', p_name, ' -> ', p_brand)"


@query("report_madge", _findings_sql("SELECT * FROM part", rule="'R10'", category="'refactoring'", severity="'MEDIUM'", file=PATH_SQL, line="1", snippet=f"concat('circle: ', {CHAIN_SQL})", description=f"concat('Imports run in a circle: ', {CHAIN_SQL})",
       scanner="madge", reason="'circle found by madge'"))
def report_madge(spark, folder):
    report = F.to_json(F.array(F.array(_path(), F.col("p_name"), F.col("p_brand")), F.array(F.col("p_name"))))
    return shown(reports.madge(part(spark, folder).select(report.alias("content"))))


@query("report_radon", _findings_sql("SELECT *, cast(p_size AS varchar) AS n, chr(cast(65 + p_size % 6 AS int)) AS k FROM part WHERE p_size >= 10", rule="'R02'", category="'architecture'", severity="CASE WHEN p_size >= 20 THEN 'HIGH' ELSE 'MEDIUM' END",
       file=PATH_SQL, line="p_partkey % 70", snippet="concat(p_name, ': complexity ', n, ' (rank ', k, ')')",
       description="concat('Function ''', p_name, ''' branches a lot: complexity ', n, ' (rank ', k, '); shorter functions would help')", scanner="radon",
       reason="concat('measured by radon: ', n, ', ten or more')"))
def report_radon(spark, folder):
    row = F.struct(F.col("p_size").alias("complexity"), F.col("p_name").alias("name"), (F.col("p_partkey") % 70).alias("lineno"), F.char(65 + F.col("p_size") % 6).alias("rank"))
    return shown(reports.radon(part(spark, folder).select(F.to_json(F.create_map(_path(), F.array(row))).alias("content"))))


@query("report_vulture", _findings_sql("SELECT *, concat('(', cast(60 + p_size % 41 AS varchar), '% confidence)') AS sure FROM part WHERE p_partkey % 6 <> 0", rule="'R09'", category="'clean-code'", severity="'LOW'", file=PATH_SQL, line="p_size",
       snippet="concat('unused function ''', p_name, ''' ', sure)", description="concat('Unused function: ''', p_name, ''' has no caller ', sure)", scanner="vulture",
       confidence="CASE WHEN 60 + p_size % 41 < 90 THEN 'medium' ELSE 'high' END", reason="concat('no use found by vulture ', sure)"))
def report_vulture(spark, folder):
    text = F.concat(_path(), F.lit(":"), F.col("p_size").cast("string"), F.lit(": unused function '"), F.col("p_name"), F.lit("' ("), (60 + F.col("p_size") % 41).cast("string"), F.lit("% confidence)"))
    return shown(reports.vulture(part(spark, folder).select(F.when(F.col("p_partkey") % 6 == 0, "done").otherwise(text).alias("value"))))


# --------------------------------------------------------------------------------- security
NPM_WHAT = "CASE p_partkey % 3 WHEN 0 THEN concat('Title of ', p_name, '; other; third') WHEN 1 THEN p_brand ELSE concat('weakness in ', p_name) END"
NPM_LEVEL = "CASE p_partkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'HIGH' END"


@query("report_npm_audit", _findings_sql(f"SELECT *, {NPM_WHAT} AS what FROM part", rule="'R05'", category="'security'", severity=NPM_LEVEL, file="'package.json'", line="1", snippet="concat(p_name, ': ', what)",
       description="concat('Known weakness in a package: ', p_name, ' — ', what)", scanner="npm-audit", reason=f"concat('listed by npm audit (', {NPM_LEVEL}, ')')"))
def report_npm_audit(spark, folder):
    via = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('[{"title":"Title of '), F.col("p_name"), F.lit('"},{"name":"other"},"third","fourth"]')))
           .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]'))).otherwise("[]"))
    level = F.when(F.col("p_partkey") % 5 == 0, "critical").when(F.col("p_partkey") % 5 == 1, "moderate").when(F.col("p_partkey") % 5 == 2, "info").when(F.col("p_partkey") % 5 == 3, "").otherwise("high")
    report = F.concat(F.lit('{"vulnerabilities":{"'), F.col("p_name"), F.lit('":{"severity":"'), level, F.lit('","via":'), via, F.lit("}}}"))
    return shown(reports.npm_audit(part(spark, folder).select(report.alias("content"))))


@query("report_gitleaks", _findings_sql("SELECT * FROM part", rule="'R05'", category="'security'", severity="'CRITICAL'", file=PATH_SQL, line="p_size", snippet="concat('[REDACTED] ', p_name)",
       description="concat('Secret in the text: ', p_name, ' (rule: ', p_brand, ')')", scanner="gitleaks", reason="concat('matched by gitleaks, rule ', p_brand)", tool="p_brand"))
def report_gitleaks(spark, folder):
    row = F.struct(_path().alias("File"), F.col("p_size").alias("StartLine"), F.col("p_name").alias("Description"), F.col("p_brand").alias("RuleID"))
    return shown(reports.gitleaks(part(spark, folder).select(F.to_json(F.array(row)).alias("content"))))


@query("report_pip_audit", _findings_sql("SELECT *, concat('PYSEC-', cast(p_partkey AS varchar)) AS vuln, concat(CASE WHEN p_partkey % 4 = 0 THEN 'A critical flaw in ' ELSE 'A flaw in ' END, p_brand) AS what, concat(p_name, '==1.', cast(p_size AS varchar)) AS pkg FROM part WHERE p_partkey % 5 <> 0",
       rule="'R05'", category="'security'", severity="CASE WHEN p_partkey % 3 = 0 THEN 'LOW' WHEN p_partkey % 4 = 0 THEN 'HIGH' ELSE 'MEDIUM' END", file="'requirements.txt'", line="1", snippet="concat(pkg, ': ', vuln)",
       description="concat('Known weakness in a package: ', pkg, ' — ', vuln, ': ', what)", scanner="pip-audit", reason="concat('listed by pip-audit (', vuln, ')')"))
def report_pip_audit(spark, folder):
    vuln = F.struct(F.concat(F.lit("PYSEC-"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.when(F.col("p_partkey") % 4 == 0, "A critical flaw in ").otherwise("A flaw in "), F.col("p_brand")).alias("description"),
                    F.when(F.col("p_partkey") % 3 == 0, "low").alias("severity"))
    dep = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), F.when(F.col("p_partkey") % 5 == 0, F.array().cast(
        "array<struct<id:string,description:string,severity:string>>")).otherwise(F.array(vuln)).alias("vulns"))
    report = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array(dep))).otherwise(F.to_json(F.struct(F.array(dep).alias("dependencies"))))
    return shown(reports.pip_audit(part(spark, folder).select(report.alias("content"))))


# --------------------------------------------------------------------------------- coverage
def _cover_sql(source, file, line, what):
    return _findings_sql(f"SELECT * FROM {source}", rule="'R08'", category="'build'", severity="'MEDIUM'", file=file, line=line, snippet=what, description=what, scanner="coverage-analyzer",
                         reason="'taken from the coverage report'", tool="'zero-coverage'", phase="9")


@query("coverage_istanbul", _cover_sql("(SELECT *, unnest([0, 1]) AS n FROM part)", PATH_SQL, "CASE WHEN n = 1 THEN 1 WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END",
       "concat('Function ''', CASE WHEN n = 1 THEN 'anonymous_1' ELSE p_name END, ''' has zero test coverage')").replace("(SELECT *, unnest([0, 1]) AS n FROM part)", "(SELECT * FROM (SELECT *, unnest([0, 1]) AS n FROM part) WHERE n = 1 AND p_size % 3 = 0 OR n = 0 AND p_size % 2 = 0)"))
def coverage_istanbul(spark, folder):
    place = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"line":'), F.col("p_size").cast("string"))).otherwise('"loc":{"start":{"line":7}}')
    report = F.concat(F.lit('{"/w/'), _path(), F.lit('":{"fnMap":{"0":{"name":"'), F.col("p_name"), F.lit('",'), place, F.lit('}},"f":{"0":'), (F.col("p_size") % 2).cast("string"), F.lit(',"1":'), (F.col("p_size") % 3).cast("string"), F.lit("}}}"))
    return shown(reports.istanbul(part(spark, folder).select(report.alias("content")), "/w"))


@query("coverage_py", _cover_sql("part WHERE p_size % 4 = 0", PATH_SQL, "CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END", "concat('Function ''', p_name, ''' has zero test coverage')"))
def coverage_py(spark, folder):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"line":'), F.col("p_size").cast("string"), F.lit(","))).otherwise("")
    report = F.concat(F.lit('{"files":{"'), _path(), F.lit('":{"functions":{"'), F.col("p_name"), F.lit('":{'), line, F.lit('"summary":{"percent_covered":'), (F.col("p_size") % 4 * 25.0).cast("string"),
                      F.lit('}},"whole":{"summary":{}}}}}}'))
    return shown(reports.coverage_py(part(spark, folder).select(report.alias("content"))))


@query("coverage_jacoco", _cover_sql("part WHERE p_size % 3 = 0", "concat('src/main/java/com/x/P', cast(p_partkey AS varchar), '.java')", "p_size", "concat('Method ''com.x.P', cast(p_partkey AS varchar), '.', p_type, ''' has zero test coverage')"))
def coverage_jacoco(spark, folder):
    key = F.col("p_partkey").cast("string")
    report = F.concat(F.lit('<report name="r"><package name="com/x"><class name="com/x/P'), key, F.lit('" sourcefilename="P'), key, F.lit('.java"><method name="'), F.col("p_type"), F.lit('" desc="()V" line="'), F.col("p_size").cast("string"),
                      F.lit('"><counter type="LINE" missed="1" covered="0"/><counter type="METHOD" missed="1" covered="'), (F.col("p_size") % 3).cast("string"), F.lit('"/></method></class></package></report>'))
    return shown(reports.jacoco(part(spark, folder).select(report.alias("content"))))


@query("coverage_no_report", "SELECT concat('r', cast(c_custkey AS varchar)) AS repo, 'no-coverage-report' AS tool_rule_id, '' AS current_code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def coverage_no_report(spark, folder):
    repos = V.table(spark, folder, "customer").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repo"))
    found = V.table(spark, folder, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo"))
    return reports.no_report(repos, found).select("repo", "tool_rule_id", "current_code")


@query("tool_findings", _findings_sql("SELECT * FROM part", rule="'R05'", category="'security'", severity="'CRITICAL'", file=PATH_SQL, line="p_size", snippet="''", description="''", scanner="gitleaks", reason="''")
       .replace("SELECT rule,", "SELECT scanner, rule, phase, count(*) AS findings FROM (SELECT rule,", 1) + f""") GROUP BY 1, 2, 3
  UNION ALL SELECT 'radon', 'R02', 4, count(*) FROM part WHERE p_size >= 10 UNION ALL SELECT 'madge', 'R10', 8, count(*) FROM part""")
def tool_findings(spark, folder):
    parts = part(spark, folder)
    one = F.to_json(F.array(F.struct(_path().alias("File"), F.col("p_size").alias("StartLine"), F.col("p_name").alias("Description"), F.col("p_brand").alias("RuleID"))))
    two = F.to_json(F.create_map(_path(), F.array(F.struct(F.col("p_size").alias("complexity"), F.col("p_name").alias("name")))))
    three = F.to_json(F.array(F.array(_path(), F.col("p_name"))))
    from lintlake.operators import validate
    merged = validate.merged([reports.gitleaks(parts.select(one.alias("content"))), reports.radon(parts.select(two.alias("content"))), reports.madge(parts.select(three.alias("content")))])
    return reports.complete_findings(merged).groupBy("scanner", "rule", "phase").agg(F.count(F.lit(1)).alias("findings"))


# ------------------------------------------------------------------------------ environment
# Repos r0..r10 hold the source files; an example file per repo is put together from supplier rows.
EXAMPLES = """SELECT concat('repo', cast(s_suppkey % 10 AS varchar)) AS repo, concat('.env.example') AS path, s_suppkey AS n,
  concat('# settings', chr(10), 'KEY_', cast(s_suppkey % 50 AS varchar), ' = x', chr(10), chr(10), 'MODE_', cast(s_suppkey % 30 AS varchar), '=a=b', chr(10), 'KEY_', cast(s_suppkey % 50 + s_suppkey % 2 AS varchar), '=2', chr(10), 'loose text') AS content FROM supplier"""


def env_files(spark, folder):
    key = F.col("s_suppkey")

    def text(c):
        return c.cast("string")

    example = V.table(spark, folder, "supplier").select(
        F.concat(F.lit("repo"), text(key)).alias("repo"), F.lit(".env.example").alias("path"),
        F.concat(F.lit("# settings\nKEY_"), text(key % 50), F.lit(" = x\n\nMODE_"), text(key % 30), F.lit("=a=b\nKEY_"), text(key % 50 + key % 2), F.lit("=2\nloose text")).alias("content"),
        F.lit(True).alias("tracked"))
    return example.unionByName(V.code_files(spark, folder).select("repo", "path", "content", F.lit(True).alias("tracked")))


@query("env_keys", "SELECT concat('repo', cast(s_suppkey AS varchar)) AS repo, n AS line, key FROM (SELECT s_suppkey, unnest([2, 4, 5]) AS n, unnest([concat('KEY_', cast(s_suppkey % 50 AS varchar)), concat('MODE_', cast(s_suppkey % 30 AS varchar)), concat('KEY_', cast(s_suppkey % 50 + s_suppkey % 2 AS varchar))]) AS key FROM supplier)")
def env_keys(spark, folder):
    return environment.keys(env_files(spark, folder))


REFERENCED = "SELECT DISTINCT repo, key FROM (" + " UNION ALL ".join(
    f"SELECT repo, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS key FROM code_files WHERE regexp_matches(path, '[.](py|ts)$')" for p in R.ENV_REFERENCES) + ")"


@query("env_references", V.sql("code_files", REFERENCED))
def env_references(spark, folder):
    return environment.references(V.code_files(spark, folder))


DECLARED = """SELECT concat('repo', cast(s_suppkey AS varchar)) AS repo, unnest([concat('KEY_', cast(s_suppkey % 50 AS varchar)), concat('MODE_', cast(s_suppkey % 30 AS varchar)), concat('KEY_', cast(s_suppkey % 50 + s_suppkey % 2 AS varchar))]) AS key FROM supplier"""


@query("env_undeclared", V.sql("code_files", "SELECT repo, key FROM referenced WHERE repo IN (SELECT repo FROM declared) AND (repo, key) NOT IN (SELECT (repo, key) FROM declared)", referenced=REFERENCED, declared=DECLARED))
def env_undeclared(spark, folder):
    return environment.undeclared(env_files(spark, folder))


@query("duplicate_keys", "SELECT concat('repo', cast(s_suppkey AS varchar)) AS repo, concat('KEY_', cast(s_suppkey % 50 AS varchar)) AS key, 5 AS line, 2 AS first_line FROM supplier WHERE s_suppkey % 2 = 0")
def duplicate_keys(spark, folder):
    return environment.duplicate_keys(env_files(spark, folder))


REPO_FILES = """SELECT c_custkey, concat('c', cast(c_custkey AS varchar)) AS repo FROM customer"""


@query("env_findings", """SELECT repo, 'R05' AS rule, '.env' AS file, 'CRITICAL' AS severity, 1 AS phase FROM c WHERE c_custkey % 3 = 0 UNION ALL SELECT repo, 'R12', '.gitignore', 'MEDIUM', 7 FROM c WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0
UNION ALL SELECT repo, 'R12', '.env.example', 'LOW', 7 FROM c WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 0 UNION ALL SELECT repo, 'R09', '.env.example', 'LOW', 5 FROM c WHERE c_custkey % 5 = 0 AND c_custkey % 7 = 0""".replace("FROM c ", f"FROM ({REPO_FILES}) c "))
def env_findings(spark, folder):
    key = F.col("c_custkey")

    def file(when, path, content, tracked=True):
        return F.when(when, F.struct(F.lit(path).alias("path"), F.lit(content).alias("content") if isinstance(content, str) else content.alias("content"), F.lit(tracked).alias("tracked")))

    everything = F.lit(True)
    made = F.array_compact(F.array(
        file(key % 3 == 0, ".env", "A=1"), file(key % 3 == 1, ".env", "A=1", False), file(key % 2 == 0, ".gitignore", "node_modules\n .env \n"), file(key % 2 == 1, ".gitignore", "# .env"),
        file(key % 5 == 0, ".env.example", F.concat(F.when(key % 4 == 0, "A=1").otherwise("B=1"), F.when(key % 7 == 0, "\nC=1\nC=2").otherwise("\nC=1"))),
        file(everything, "src/a.ts", "const a = process.env.A"), file(everything, "node_modules/a.ts", "process.env.ZZ")))
    files = V.table(spark, folder, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("repo"), F.explode(made).alias("f")).select("repo", "f.*")
    return environment.env_findings(files).select("repo", "rule", "file", "severity", "phase")


# ------------------------------------------------------------------------------------ tests
STARTS = "regexp_matches(text, '(?:test|it)\\s*\\(\\s*(?:[''\"`])')"
EXPECTS = "regexp_matches(text, 'expect\\s*\\(')"


@query("assertion_free_blocks", V.sql("code_lines", f"""
WITH t AS (SELECT path, line, text, {STARTS} AS starts, {EXPECTS} AS expects FROM code_lines WHERE ends_with(path, '.test.ts')),
b AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS block FROM t)
SELECT path, cast(min(line) AS int) AS line, regexp_extract(arg_min(text, line), '(?:test|it)\\s*\\(\\s*[''\"`]([^''\"`]+)[''\"`]', 1) AS test_name FROM b WHERE block > 0 GROUP BY path, block HAVING NOT bool_or(expects)"""))
def assertion_free_blocks(spark, folder):
    return assertions.brace_tests(V.code_files(spark, folder))


# One Python test file per document: some of its functions assert, in one way or another.
PYTEST_SQL = """SELECT concat('tests/test_', cast(doc_id AS varchar), '.py') AS path, line, concat('test_', name) AS test_name FROM (
  SELECT doc_id, 1 AS line, 'a' AS name, doc_id % 2 = 0 AS free FROM documents UNION ALL SELECT doc_id, 4, 'b', doc_id % 3 = 0 FROM documents UNION ALL SELECT doc_id, 8, 'c', doc_id % 5 = 0 FROM documents) WHERE free AND doc_id % 11 <> 0"""


@query("assertion_free_python", PYTEST_SQL)
def assertion_free_python(spark, folder):
    doc = F.col("doc_id")
    text = F.concat(
        F.lit("def test_a():\n"), F.when(doc % 2 == 0, "    run()\n").otherwise("    assert run()\n"), F.lit("\nasync def test_b(self):\n    with ctx():\n"),
        F.when(doc % 3 == 0, "        self.check()\n").when(doc % 3 == 1, "        self.assertEqual(1, 1)\n").otherwise("        pytest.raises(E, f)\n"), F.lit("\ndef test_c(mock):\n"),
        F.when(doc % 5 == 0, "    mock.called()\n").otherwise("    mock.assert_called_once_with(1)\n"), F.lit("def helper():\n    pass\n"), F.when(doc % 11 == 0, "def broken(:\n").otherwise(""))
    files = V.table(spark, folder, "documents").select(F.concat(F.lit("tests/test_"), doc.cast("string"), F.lit(".py")).alias("path"), text.alias("content"))
    return assertions.python_tests(files)


# ------------------------------------------------------------------------------- duplicates
DUP = """WITH r AS (SELECT path, line, trim(text, ' ') AS text FROM lines),
s AS (SELECT path, line, string_agg(text, chr(10)) OVER w AS block, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
d AS (SELECT path, line FROM s WHERE n = 5 AND block IN (SELECT block FROM s WHERE n = 5 GROUP BY block HAVING count(DISTINCT path) > 1)),
g AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM d),
blocks AS (SELECT path, cast(min(line) AS int) AS start_line, cast(max(line) + 4 AS int) AS end_line, cast(max(line) + 5 - min(line) AS int) AS lines FROM g GROUP BY path, island)
"""


@query("duplicate_blocks", V.sql("lines", DUP + "SELECT * FROM blocks"))
def duplicate_blocks(spark, folder):
    return duplicates.blocks(V.files(spark, folder))


@query("duplication_percent", V.sql("lines", DUP + "SELECT (SELECT count(*) FROM lines) AS lines, coalesce(cast(sum(b.lines) AS bigint), 0) AS duplicated_lines, round(coalesce(sum(b.lines), 0) * 100.0 / (SELECT count(*) FROM lines), 2) AS duplication_pct FROM blocks b"))
def duplication_percent(spark, folder):
    return duplicates.duplication(V.files(spark, folder))


# ------------------------------------------------------------------------- logs and manifests
@query("history_reader", "SELECT concat('u', cast(user_id AS varchar)) AS repo, value AS score, ts FROM events WHERE event_id % 9 > 1")
def history_reader(spark, folder):
    key = F.col("event_id")
    row = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                             F.when(key % 9 != 1, F.col("value")).alias("score")))
    lines = V.table(spark, folder, "events").select(F.when(key % 9 == 0, F.concat(row, F.lit("}"))).otherwise(row).alias("value"))
    broken = lines.withColumn("value", F.when(F.col("value").endswith("}}"), F.expr("substring(value, 1, length(value) - 4)")).otherwise(F.col("value")))
    return readers.usable_history(broken).select("repo", "score", "ts")


@query("artifact_manifest", V.sql("files", "SELECT path, sha256(content) AS sha256, cast(strlen(content) AS int) AS size_bytes, cast(length(content) - length(replace(content, chr(10), '')) AS int) AS line_count FROM files"))
def artifact_manifest(spark, folder):
    return sinks.manifest(V.files(spark, folder).select("path", F.encode("content", "UTF-8").alias("content")))


@query("artifact_completeness", V.sql("files", "SELECT path, cast(lines AS int) AS lines, cast(CASE WHEN doc_id % 7 <> 0 THEN n END AS int) AS line_count, doc_id % 7 <> 0 AND lines = n AS complete FROM (SELECT doc_id, path, length(content) - length(replace(content, chr(10), '')) AS n, length(content) - length(replace(content, chr(10), '')) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS lines FROM files)"))
def artifact_completeness(spark, folder):
    files = V.files(spark, folder)
    # Every seventh file is listed under another name.
    made = sinks.manifest(files.select(F.when(F.col("doc_id") % 7 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.encode("content", "UTF-8").alias("content")))
    declared = files.select("path", (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("lines"))
    return sinks.complete(made, declared)
