"""Checks of environment files against the code that reads them, per repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.catalog import layers as L, rules as R
from lintlake.functions import paths
from lintlake.functions.lookup import ends_with_any, literal_map
from lintlake.operators.scan import lines
from lintlake.sources.reports import as_findings

# Environment files that must not be tracked, lines that ignore them, source extensions.
ENV_FILES = [".env", ".env.local", ".env.production"]
IGNORES = [".env", ".env*", ".env.*"]
EXTENSIONS = [".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
PHASES = {"R05": 1, "R09": 5, "R12": 7}


def keys(files: DataFrame, name: str = ".env.example") -> DataFrame:
    """(repo, line, key): the keys an environment file declares."""
    rows = lines(files.where(F.col("path") == name), "repo")
    text = F.trim("text")
    declared = rows.where((text != "") & ~text.startswith("#") & text.contains("="))
    return declared.select("repo", "line", F.trim(F.substring_index(text, "=", 1)).alias("key"))


def references(files: DataFrame) -> DataFrame:
    """(repo, key): the variables a repo's sources read."""
    sources = files.where(ends_with_any(F.col("path"), EXTENSIONS) & ~paths.under_any_dir(F.col("path"), L.ENV_PRUNED_DIRS))
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in R.ENV_REFERENCES])
    return sources.select("repo", F.explode(F.array_distinct(found)).alias("key")).distinct()


def undeclared(files: DataFrame) -> DataFrame:
    """(repo, key): variables read in code that the repo's example file does not name; repos without one are left out."""
    have = files.where(F.col("path") == ".env.example").select("repo").distinct()
    declared = keys(files).where(F.col("key") != "").select("repo", "key")
    return references(files).join(have, "repo", "left_semi").exceptAll(declared.distinct())


def duplicate_keys(files: DataFrame) -> DataFrame:
    """(repo, key, line, first_line): every later declaration of a key."""
    rows = keys(files)
    first = rows.groupBy("repo", "key").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, ["repo", "key"]).where(F.col("line") > F.col("first_line")).select("repo", "key", "line", "first_line")


def tracked_files(files: DataFrame) -> DataFrame:
    """(repo, path): environment files under version control; files has ``tracked``."""
    return files.where(F.col("path").isin(ENV_FILES) & F.col("tracked")).select("repo", "path")


def missing_example(files: DataFrame) -> DataFrame:
    """Repos that ignore .env but show no example of it."""
    ignored = lines(files.where(F.col("path") == ".gitignore"), "repo").where(F.trim("text").isin(IGNORES)).select("repo").distinct()
    return ignored.join(files.where(F.col("path") == ".env.example").select("repo"), "repo", "left_anti")


def env_findings(files: DataFrame) -> DataFrame:
    """All four checks over files(repo, path, content, tracked) as findings."""
    def made(rows, rule, level, category, file, line, text, reason, confidence="high"):
        phase = literal_map(PHASES)[F.lit(rule)]
        return as_findings(rows, rule=rule, severity=level, category=category, file=file, line=line, snippet=text, description=text,
                           scanner="env-check", confidence=confidence, reason=reason, phase=phase)

    def say(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    path, key = F.col("path"), F.col("key")
    first, line = F.col("first_line").cast("string"), F.col("line").cast("string")
    return (made(tracked_files(files), "R05", "CRITICAL", "security", path, 1,
                 say("The settings file '", path, "' is under version control, with whatever secrets it holds: ignore it and take it out."),
                 say("listed as tracked: '", path, "'"))
            .unionByName(made(missing_example(files), "R12", "MEDIUM", "data-integrity", ".gitignore", 1,
                              "The ignored .env has no .env.example beside it that tells which settings are needed.",
                              "ignored file without an example beside it"))
            .unionByName(made(undeclared(files), "R12", "LOW", "data-integrity", ".env.example", 1,
                              say("The code reads '", key, "', which .env.example does not name."),
                              say("read in source: '", key, "', absent from the example file"), "medium"))
            .unionByName(made(duplicate_keys(files), "R09", "LOW", "clean-code", ".env.example", F.col("line"),
                              say("Key '", key, "' of .env.example is set again (first on line ", first, ")."),
                              say("key '", key, "' stands on lines ", first, " and ", line))))
