"""Severity, confidence, category and phase expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lintlake.catalog import maps as M
from lintlake.functions.lookup import contains_any, first_match, literal_array, literal_map, lookup


def rank(severity: Column, missing: int = 99) -> Column:
    """0 for CRITICAL up to 4 for REVIEW; ``missing`` for anything else."""
    return lookup(M.SEVERITY_RANK, severity, missing)


def of_rank(position: Column) -> Column:
    """The severity name at a rank."""
    return F.element_at(literal_array(M.SEVERITIES), position + 1)


def counted(severity: Column, level: str) -> Column:
    """How many rows of a group carry the level (missing severities count as MEDIUM)."""
    return F.count_if(F.coalesce(severity, F.lit("MEDIUM")) == level)


def normal_severity(raw: Column) -> Column:
    """Upper-cased; an unknown or missing level becomes MEDIUM."""
    upper = F.upper(raw)
    return F.when(upper.isin(M.SEVERITIES), upper).otherwise("MEDIUM")


def ceiling(severity: Column, confidence: Column) -> tuple[Column, Column]:
    """Cap a severity by its confidence: (severity, the level it was capped from or null)."""
    level = F.lower(F.coalesce(confidence, F.lit("low")))
    top = rank(lookup(M.CONFIDENCE_CEILING, level, M.CONFIDENCE_CEILING["low"]))
    over = rank(severity, 2) < top
    return F.when(over, of_rank(top)).otherwise(severity), F.when(over, severity)


def normal_category(raw: Column, rule: Column) -> Column:
    """The rule's category; for an unknown rule the category its spelling stands for."""
    spelling = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    own = F.when(spelling.isin(M.CATEGORIES), spelling)
    return F.coalesce(lookup(M.RULE_CATEGORY, rule), own, lookup(M.CATEGORY_SYNONYM, spelling),
                      F.lit(M.DEFAULT_CATEGORY))


def prefix(category: Column) -> Column:
    return lookup(M.CATEGORY_PREFIX, category, M.DEFAULT_PREFIX)


def tool_phase(rule: Column) -> Column:
    """Phase of a checker's finding: the rule's, else the default for tools."""
    return lookup(M.RULE_PHASE, rule, M.TOOL_DEFAULT_PHASE)


def task_phase(phase: Column, rule: Column) -> Column:
    """A finding's own phase when it is valid, else its rule's, else the last one."""
    own = F.when(phase.between(0, M.LAST_PHASE), phase)
    return F.coalesce(own, lookup(M.RULE_PHASE, rule), F.lit(M.LAST_PHASE))


def lowest_phase(rules: Column) -> Column:
    """The most foundational phase among several rules."""
    phases = literal_map(M.RULE_PHASE)
    return F.array_min(F.transform(rules, lambda r: F.coalesce(phases[r], F.lit(M.LAST_PHASE))))


def phase_name(phase: Column) -> Column:
    return lookup(M.PHASE_NAME, phase, F.concat(F.lit("Phase "), phase.cast("string")))


def rule_name(rule: Column) -> Column:
    return lookup(M.RULE_NAME, rule, rule)


def adjusted(severity: Column, raises: Column, lowers: Column) -> Column:
    """Move a severity by factor levels: never below LOW, CRITICAL loses at most one level,
    nothing rises above CRITICAL.  REVIEW stays REVIEW unless it is raised."""
    base = rank(severity, 2)
    floor = F.when(severity == "CRITICAL", 1).when(severity == "REVIEW", 4).otherwise(3)
    return of_rank(F.greatest(F.lit(0), F.least(base - raises + lowers, floor)))


# How a missing confidence is filled in.  Per rule, tried in order:
# (words one of which must occur, words one of which must also occur, confidence).
CONFIDENCE_CASES = {
    "R04": [
        ([".map(", "loop", "n+1", "foreach"], [], "high"),
        (["useeffect", "missing dep", "stale", "infinite"], [], "high"),
        (["inline", "handler"], ["prop"], "high"),
        (["inline", "handler"], [], "medium"),
        (["type assertion", "as record", "as unknown"], [], "high"),
        (["duplicate", "regex", "large", "usememo", "usecallback"], [], "medium"),
        (["react.memo", "memo"], [], "low"),
        ([], [], "medium"),
    ],
    "R11": [
        (["hook", "side effect", ">3 param", "complex"], [], "high"),
        (["component", "prop", "forwardref"], [], "medium"),
        (["context", "provider"], [], "medium"),
        ([], [], "low"),
    ],
    "R13": [
        (["business", "timeout", "limit", "retry", "threshold"], [], "high"),
        (["duplicate", "appears in", "ssot"], [], "high"),
        (["url", "port", "endpoint", "localhost"], [], "medium"),
        (["css", "style", "padding", "margin", "gap", "px", "selector"], [], "low"),
        ([], [], "medium"),
    ],
    "R09": [
        (["secret", "token", "password", "key"], [], "high"),
        (["commented"], ["block", "dead", ">5"], "high"),
        (["console.error"], [], "low"),
        (["console"], [], "medium"),
        (["unicode", "ternary"], [], "low"),
        ([], [], "medium"),
    ],
}


def confidence_reason(rule: str, at: int, words: list[str], level: str) -> str:
    """Why a confidence was filled in: the case of the rule that the wording meets."""
    return f"{level} by the wording: {rule}, case {at} ({words[0] if words else 'any other'})"


def filled_confidence(confidence: Column, reason: Column, rule: Column, description: Column) -> tuple[Column, Column]:
    """(confidence, reason): kept where a confidence is given, else derived from the wording."""
    text = F.lower(F.coalesce(description, F.lit("")))
    levels, reasons = [], []
    for name, cases in CONFIDENCE_CASES.items():
        for at, (words, more, level) in enumerate(cases, 1):
            test = rule == name
            if words:
                test = test & contains_any(text, words)
            if more:
                test = test & contains_any(text, more)
            levels.append((test, level))
            reasons.append((test, confidence_reason(name, at, words, level)))
    other = F.concat(F.lit("high for every finding of "), F.coalesce(rule, F.lit("")))
    given = F.nullif(confidence, F.lit(""))
    return (F.coalesce(given, first_match(levels, "high")),
            F.when(given.isNotNull(), reason).otherwise(first_match(reasons, other)))
