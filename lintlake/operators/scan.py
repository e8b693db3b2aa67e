"""The rule scan and the smaller line scans.

All of them read the files once.  A file is exploded to lines in the task that holds it,
each line is tried against the rules of its stack as literal ``rlike`` tests in one
projection, and only the hits leave the task: no shuffle, no join with a rule table, and
no pattern that changes from row to row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.catalog import layers as L, rules as R
from lintlake.functions import guard, paths, severity, text
from lintlake.functions.lookup import contains_any, either, first_match, literal_map, quoted, starts_with_any


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line: the kept columns, ``line`` (from 1) and ``text``."""
    return (files.select(*keep, F.posexplode(text.real_lines(F.col("content"))).alias("at", "text"))
            .withColumn("line", F.col("at") + 1).drop("at"))


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n\f\x0b"))


def _applies(rule: R.Rule) -> str:
    """SQL condition for a rule to hit a line (``text``, stripped ``code``) of a file."""
    def like(column, pattern):
        return f"{column} RLIKE {quoted(pattern)}"

    needed = guard.needed_text(rule.pattern)
    tests = [f"contains(text, {quoted(needed)})"] if needed else []
    tests.append(like("text", rule.pattern))
    if rule.rule in L.META_SKIPPED_RULES:
        tests.append("NOT is_meta_file")
    if rule.rule in L.COMMENT_RULES:
        tests.append("NOT " + like("code", "^" + either(L.COMMENT_STARTS)))
    if rule.not_on_import:
        tests.append("NOT " + like("code", L.IMPORT_LINE))
    if rule.code_only:
        tests.append(like(f"regexp_replace(code, {quoted(L.LITERALS)}, ' ')", rule.pattern))
    if "innerHTML" in rule.pattern:
        tests.append("NOT " + like("code", L.SAFE_CLEAR))
    if rule.not_in_layers:
        tests.append(f"layer NOT IN ({', '.join(quoted(x) for x in rule.not_in_layers)})")
    tests += ["NOT " + like("path", paths.glob_regex(glob)) for glob in rule.not_in_paths]
    return " AND ".join(tests)


def _rule_table(rules: list[R.Rule]) -> Column:
    """The rules as one constant array of rows."""
    rows = [dict(rule=r.rule, severity=r.severity, category=r.category, phase=r.phase, pattern=r.pattern,
                 description=r.description, confidence=r.confidence, confidence_reason=r.reason,
                 target_code="" if r.removable else None) for r in rules]
    return F.from_json(F.lit(json.dumps(rows)),
                       "array<struct<rule:string,severity:string,category:string,phase:int,pattern:string,"
                       "description:string,confidence:string,confidence_reason:string,target_code:string>>")


def rule_hits(files: DataFrame, by_stack: dict[str, list[R.Rule]], *keep: str) -> DataFrame:
    """(kept columns, line, code, hit) with one row per rule and line it matches.

    ``files`` has path, stack, layer, content and is_meta_file.  ``hit`` is the rule's row."""
    usable = files.where(~contains_any(F.col("path"), L.SCAN_SKIP) & F.col("stack").isin(list(by_stack)))
    found = (lines(usable, *dict.fromkeys([*keep, "path", "stack", "layer", "is_meta_file"]))
             .withColumn("code", stripped(F.col("text"))))
    # Stacks that share a rule list are tried together.
    tables: list[list[R.Rule]] = []
    for table in by_stack.values():
        if not any(table is t for t in tables):
            tables.append(table)
    rules: list[R.Rule] = []
    cases = []
    for table in tables:
        stacks = ", ".join(quoted(s) for s, t in by_stack.items() if t is table)
        tests = ", ".join(f"CASE WHEN {_applies(r)} THEN {len(rules) + i + 1} END" for i, r in enumerate(table))
        cases.append(f"WHEN stack IN ({stacks}) THEN array_compact(array({tests}))")
        rules += table
    return (found.withColumn("number", F.explode(F.expr(f"CASE {' '.join(cases)} END")))
            .withColumn("hit", F.element_at(_rule_table(rules), F.col("number")))
            .select(*keep, "line", "code", "hit"))


def rule_scan(files: DataFrame, by_stack: dict[str, list[R.Rule]] = R.BY_STACK) -> DataFrame:
    """Findings of the line rules over files(path, stack, layer, tag, content, is_meta_file)."""
    # A long file is scanned like any other: its lines are rows.
    source = files.where(F.col("tag").isin("SOURCE", "OVERSIZED")) if "tag" in files.columns else files
    repo = [c for c in ("repo",) if c in source.columns]
    hits = rule_hits(source, by_stack, *repo, "path", "layer")
    return hits.select(
        *repo, F.col("hit.rule").alias("rule"), F.col("hit.severity").alias("severity"),
        F.col("hit.category").alias("category"), F.col("path").alias("file"), "line",
        F.col("line").alias("end_line"), F.substring("code", 1, 200).alias("snippet"),
        F.col("code").alias("current_code"), F.col("hit.description").alias("description"),
        F.concat(F.col("hit.description"), F.lit(": "), F.col("hit.confidence_reason")).alias("explanation"),
        F.coalesce(F.regexp_substr("code", F.col("hit.pattern")), F.col("hit.pattern")).alias("search_pattern"),
        F.col("hit.target_code").alias("target_code"), F.col("hit.phase").alias("phase"),
        F.lit("low").alias("effort"), "layer", F.lit("grep-scanner").alias("scanner"),
        F.col("hit.confidence").alias("confidence"), F.col("hit.confidence_reason").alias("confidence_reason"))


def scan_counters(findings: DataFrame) -> DataFrame:
    """Findings per id prefix, and how many come with a fix."""
    return (findings.groupBy(severity.prefix(F.col("category")).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("findings"), F.count("target_code").alias("removable")))


def _fix_test(pattern: str, excuse: str):
    if not excuse:
        return lambda row: row["text"].rlike(pattern)
    return lambda row: row["text"].rlike(pattern) & ~row["text"].rlike(excuse)


def _fix_row(rule: str, message: str):
    return lambda row, i: F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"), row["line"].alias("line"), (i + 1).alias("n"))


def fix_compliance(files: DataFrame, checks=R.FIX_CHECKS) -> DataFrame:
    """Hits per check and file, numbered: (path, rule, message, line, n).

    The hits of one file are found and numbered inside its row, so no window is needed."""
    numbered = F.transform(text.real_lines(F.col("content")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    per_check = []
    for stack, rule, pattern, excuse, message in checks:
        test = _fix_test(pattern, excuse)
        matching = F.filter(F.col("numbered"), test)
        per_check.append(F.when(F.col("stack") == stack, F.transform(matching, _fix_row(rule, message))))
    found = files.select("path", "stack", numbered.alias("numbered"))
    return (found.select("path", F.explode(F.flatten(F.array_compact(F.array(*per_check)))).alias("hit"))
            .select("path", "hit.*"))


def changed_markers(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Unfinished-work markers and unsafe types in changed files: (path, kind, line, text)."""
    touched = files.join(changed.select("path").distinct(), "path", "left_semi")
    rows = lines(touched, "path", "stack")
    unsafe = F.lit(False)
    for stack, patterns in R.UNSAFE.items():
        for pattern in patterns:
            unsafe = unsafe | ((F.col("stack") == stack) & F.col("text").rlike(pattern))
    kinds = F.array_compact(F.array(F.when(F.col("text").rlike(R.STUB), F.lit("stub")),
                                    F.when(unsafe, F.lit("unsafe-type"))))
    return rows.select("path", F.explode(kinds).alias("kind"), "line", "text")


def components_without_return(files: DataFrame) -> DataFrame:
    """.tsx files that export something but never return markup."""
    rows = text.real_lines(F.col("content"))
    return files.where(
        F.col("path").endswith(".tsx")
        & F.exists(rows, lambda l: l.rlike(R.COMPONENT_EXPORT))
        & ~F.exists(rows, lambda l: l.rlike(R.COMPONENT_RETURN))).select("path")


def empty_functions(files: DataFrame) -> DataFrame:
    """Functions whose body has at most a few substantive lines: (path, line, body_lines).

    Braces are counted line by line from the head to the end of the body, as a fold over the file's own
    line array: over a first stretch of lines, and on over the rest where that does not settle it."""
    kind = literal_map(R.HEAD_KIND)[F.regexp_extract("path", r"\.([^./]+)$", 1)]
    typed = files.withColumn("kind", kind).where(F.col("kind").isNotNull())
    rows = typed.select("path", "kind", text.lines(F.col("content")).alias("rows"))
    heads = rows.select("path", "kind", "rows", F.posexplode("rows").alias("at", "head"))
    is_head = F.lit(False)
    for name, pattern in R.FUNCTION_HEAD.items():
        is_head = is_head | ((F.col("kind") == name) & F.col("head").rlike(pattern))

    def span(skip, length):
        return F.transform(F.slice("rows", F.col("at") + 1 + skip, length), lambda l, i: F.struct(l.alias("text"), (i + skip).alias("i")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("body"), F.lit(False).alias("done"))

    def braces(state, row):
        line = row["text"]
        bare = stripped(line)
        depth = state["depth"] + F.length(F.regexp_replace(line, r"[^{]", "")) - F.length(F.regexp_replace(line, r"[^}]", ""))
        opened = state["open"] | line.contains("{")
        counts = (opened & (bare != "") & ~bare.startswith("//") & ~bare.startswith("#")
                  & ~bare.isin("{", "}", "};", "},"))
        after = F.struct(depth.alias("depth"), opened.alias("open"),
                         (state["body"] + F.when(counts, 1).otherwise(0)).alias("body"),
                         (opened & (depth <= 0)).alias("done"))
        return F.when(state["done"], state).otherwise(after)

    def indents(state, row):
        line = row["text"]
        bare = stripped(line)
        counts = (row["i"] > 0) & (bare != "") & ~bare.startswith("#")
        ends = (row["i"] > 1) & (bare != "") & ~line.startswith(" ") & ~line.startswith("\t")
        after = F.struct(state["depth"].alias("depth"),
                         (state["open"] | ((row["i"] == 0) & line.contains(":"))).alias("open"),
                         (state["body"] + F.when(counts, 1).otherwise(0)).alias("body"), ends.alias("done"))
        return F.when(state["done"], state).otherwise(after)

    def result(rows, state):
        return F.when(F.col("kind") == "py", F.aggregate(rows, state, indents)).otherwise(F.aggregate(rows, state, braces))

    folded = heads.where(is_head).select("path", (F.col("at") + 1).alias("line"), "kind", "at", "rows", result(span(0, F.lit(R.BODY_HORIZON)), start).alias("first"))
    settled = F.col("first.done") | (F.col("first.body") > R.BODY_MIN)
    return (folded.withColumn("end", F.when(settled, F.col("first")).otherwise(result(span(R.BODY_HORIZON, F.size("rows")), F.col("first"))))
            .where(F.col("end.open") & (F.col("end.body") <= R.BODY_MIN))
            .select("path", "line", F.col("end.body").alias("body_lines")))


def attribution_patterns(names=("ai",)) -> list[str]:
    """Patterns for texts that credit an automated author; ``names`` are the names to look for."""
    named = "|".join(names)
    return [rf"(?i)co-authored-by:.*({named})", rf"(?i)generated (by|with) [\[\(]?({named})",
            r"(?i)ai-(generated|written|authored)"]


def attribution_hits(messages: DataFrame, names=("ai",), excluded: str = "") -> DataFrame:
    """Lines of messages(id, path, content) that credit an automated author: (id, path, line, text)."""
    kept = messages.where(F.col("path").isNull() | ~F.col("path").rlike(excluded)) if excluded else messages
    test = F.lit(False)
    for pattern in attribution_patterns(names):
        test = test | F.col("text").rlike(pattern)
    return lines(kept, "id", "path").where(test)


def meaningful(line: Column) -> Column:
    bare = F.trim(line)
    return (bare != "") & ~starts_with_any(bare, ["//", "#", "/*", "*"])


def structural_only(content: Column) -> Column:
    """At least nine tenths of the lines that matter are type declarations or re-exports."""
    rows = F.filter(text.real_lines(content), meaningful)
    shaped = F.size(F.filter(rows, lambda l: F.trim(l).rlike(L.STRUCTURAL_LINE)))
    return (F.size(rows) == 0) | (shaped / F.greatest(F.size(rows), F.lit(1)) >= L.STRUCTURAL_SHARE)


def import_count(content: Column) -> Column:
    return F.size(F.filter(text.real_lines(content), lambda l: l.rlike(L.IMPORT_LINE)))


def triage(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files(path, layer, content) -> (path, layer, class, reason): what to read more closely.

    What the text says is settled before the join, so that texts do not travel."""
    content = F.col("content")
    facts = files.select("path", "layer", structural_only(content).alias("structural"), (import_count(content) >= L.MIN_IMPORTS).alias("many_imports"))
    flagged = findings.select(F.col("file").alias("path")).distinct().withColumn("flagged", F.lit(True))
    path = F.col("path")
    ext = paths.extension(path)
    cases = [
        (F.col("flagged").isNotNull(), "flagged", F.lit("grep_finding")),
        (ext.isin(L.SKIP_EXTENSIONS), "structural_only", F.concat(F.lit("skip_extension:"), ext)),
        (F.col("structural"), "structural_only", F.lit("type_decl_or_reexport")),
        (F.col("layer").isin(L.ALWAYS_LAYERS), "always_scan", F.concat(F.lit("always_scan_layer:"), F.col("layer"))),
        (paths.basename(path).isin(L.ENTRY_POINTS), "always_scan", F.lit("entry_point_pattern")),
        (F.col("many_imports"), "always_scan", F.lit("high_import_count")),
    ]
    return (facts.join(flagged, "path", "left")
            .select("path", "layer", first_match([(c, k) for c, k, _ in cases], "llm_scan").alias("class"),
                    first_match([(c, r) for c, _, r in cases], "default").alias("reason")))


def definitions(files: DataFrame) -> DataFrame:
    """Names defined at the start of a line: (path, name)."""
    pattern = r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function|func|fn|class|interface)\s+([A-Za-z_]\w*)"
    rows = lines(files, "path")
    return rows.select("path", F.regexp_extract("text", pattern, 1).alias("name")).where(F.col("name") != "")


def numeric_literals(files: DataFrame) -> DataFrame:
    """Numbers of three and more digits: (path, name)."""
    rows = lines(files, "path")
    return rows.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{3,})\b"), 1)).alias("name"))


def in_several_files(named: DataFrame, at_least: int = 2) -> DataFrame:
    """Names that occur in at least so many files: (name, files, uses)."""
    per_file = named.groupBy("name", "path").agg(F.count(F.lit(1)).alias("uses"))
    return (per_file.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("uses").alias("uses"))
            .where(F.col("files") >= at_least))
