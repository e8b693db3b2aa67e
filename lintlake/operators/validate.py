"""Raw findings in, valid findings and named rejects out; completeness checks on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lintlake import schema
from lintlake.catalog import maps as M
from lintlake.functions import severity, text
from lintlake.functions.lookup import first_match
from lintlake.functions.rows import beside
from lintlake.operators import skew
from lintlake.session import cut


def parsed(raw: DataFrame) -> DataFrame:
    """raw(value, ...) with one JSON text per row -> the finding's fields, ``_kind`` of the text
    and ``_line_type`` of its line number.  Blank texts are dropped."""
    # The two parses are columns of their own, so that what is taken from them is not a parse each.
    named = (raw.where(F.trim("value") != "").withColumn("_row", F.from_json("value", schema.RAW_FINDING))
             .withColumn("_any", F.try_parse_json("value")))
    kind = (F.when(F.col("_any").isNull(), "invalid_json")
            .when(~F.trim("value").startswith("{"), "not_a_dict").otherwise("object"))
    line_type = F.schema_of_variant(F.try_variant_get("_any", "$.line", "variant"))
    return named.select(*raw.columns, kind.alias("_kind"), line_type.alias("_line_type"), "_row.*")


def unlisted(found: DataFrame, files: DataFrame) -> DataFrame:
    """The files that findings name and the inventory does not list: (file), each once."""
    named = found.where(F.coalesce("file", F.lit("")) != "").select("file").distinct()
    return named.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti")


def checked(found: DataFrame, files: DataFrame | None = None, phantoms: DataFrame | None = None) -> DataFrame:
    """Adds ``_reason``: null for a valid finding, else the first thing wrong with it.

    Files are told by the inventory, or by a table of those it does not list (see :func:`unlisted`): these are few, as a
    rule, and findings need not be dealt by file to meet them."""
    empty = {name: F.coalesce(F.col(name), F.lit("")) == "" for name in M.REQUIRED_FIELDS}
    empty["line"] = empty["line"] | (F.col("line") == "0")
    missing = F.concat_ws(",", *[F.when(test, name) for name, test in empty.items()])
    whole = F.col("_line_type").isin("BIGINT") if "_line_type" in found.columns else F.lit(True)
    number = F.col("line").try_cast("int")
    reasons = [
        (F.col("_kind") != "object", F.col("_kind")) if "_kind" in found.columns else (F.lit(False), ""),
        (missing != "", F.concat(F.lit("missing_fields:"), missing)),
        (~whole | number.isNull() | (number <= 0), F.concat(F.lit("invalid_line_number:"), F.col("line"))),
    ]
    if files is not None:
        # Rows without a file are rejected anyway; a key of their own keeps them from meeting in one partition.
        own = F.concat(F.lit("#"), F.xxhash64(*found.columns).cast("string"))
        known = files.select(F.col("path").alias("_file")).distinct().withColumn("_known", F.lit(True))
        found = found.withColumn("_file", F.coalesce(F.nullif("file", F.lit("")), own)).join(known, "_file", "left").drop("_file")
        reasons.append((F.col("_known").isNull(), F.concat(F.lit("phantom_file:"), F.col("file"))))
    elif phantoms is not None:
        found = found.join(phantoms.select("file", F.lit(True).alias("_known")), "file", "left").select(*found.columns, "_known")
        reasons.append((F.col("_known").isNotNull(), F.concat(F.lit("phantom_file:"), F.col("file"))))
    return found.withColumn("_reason", first_match(reasons, F.lit(None).cast("string"))).drop("_known", "_kind", "_line_type")


def split(tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)"""
    return tested.where(F.col("_reason").isNull()).drop("_reason"), tested.where(F.col("_reason").isNotNull())


def normalised(valid: DataFrame) -> DataFrame:
    """Canonical category and severity, severity capped by confidence, whole-number line."""
    level = severity.normal_severity(F.col("severity"))
    capped, before = severity.ceiling(F.col("severity"), F.col("confidence"))
    return (valid.withColumn("category", severity.normal_category(F.col("category"), F.col("rule")))
            .withColumn("severity", level)
            .withColumn("severity_capped_from", before).withColumn("severity", capped)
            .withColumn("line", F.col("line").cast("int")))


def phantom_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings in files the inventory does not list."""
    return findings.join(files.select(F.col("path").alias("file")), "file", "left_anti")


def out_of_scope(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Findings in files their scanner was not given; scope(scanner, file)."""
    return findings.join(scope.select("scanner", "file").distinct(), ["scanner", "file"], "left_anti")


def over_reporting(findings: DataFrame, share: float = 0.60) -> DataFrame:
    """Rules that make up more than a share of a scanner's findings."""
    counts = findings.groupBy("scanner", "rule").agg(F.count(F.lit(1)).alias("findings"))
    total = F.sum("findings").over(Window.partitionBy("scanner"))  # one row per scanner and rule
    return counts.withColumn("total", total).where(F.col("findings") / F.col("total") > share)


def scanner_health(tested: DataFrame) -> DataFrame:
    """Per scanner: lines, rejected lines, and whether it is fine, degraded or missing."""
    lines, bad = F.count(F.lit(1)), F.count("_reason")
    return (tested.groupBy("scanner").agg(lines.alias("lines"), bad.alias("discarded"))
            .withColumn("health", F.when(F.col("discarded") == F.col("lines"), "missing")
                        .when(F.col("discarded") * 2 > F.col("lines"), "degraded").otherwise("ok")))


def completeness_gate(findings: DataFrame, signals: DataFrame, expected: DataFrame, total_files: int) -> DataFrame:
    """Which expected scanners did not report or did not finish, and whether enough files were
    read.  signals(scanner, scanned); expected(scanner).  One row per failed check and scanner."""
    reported = findings.select("scanner").unionByName(signals.select("scanner")).distinct()
    silent = expected.join(reported, "scanner", "left_anti").select(F.lit("no_output").alias("check"), "scanner")
    truncated = expected.join(signals, "scanner", "left_anti").select(F.lit("no_completion_signal").alias("check"), "scanner")
    short = (signals.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("n")).where(F.col("n") < total_files)
             .select(F.lit("files_not_covered").alias("check"), F.lit("").alias("scanner")))
    return silent.unionByName(truncated).unionByName(short)


def aggregation_completeness(findings: DataFrame, raw: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of the scanners' lines that reached the findings."""
    made = findings.agg(F.count(F.lit(1)).alias("findings"))
    read = raw.agg(F.count(F.lit(1)).alias("scanner_lines"), F.countDistinct("scanner").alias("scanners"))
    joined = beside(made, read)
    ratio = F.round(F.col("findings") / F.col("scanner_lines"), 3)
    return joined.withColumn("ratio", F.when(F.col("scanner_lines") > 0, ratio)).withColumn(
        "complete", F.coalesce(F.col("findings") >= F.col("scanner_lines") * threshold, F.lit(False)) & (F.col("scanner_lines") > 0))


def enrichment_completeness(findings: DataFrame, enriched: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per layer: findings, enriched findings, and whether enough of them came back."""
    wanted = findings.where(F.coalesce(F.col("layer"), F.lit("")) != "").groupBy("layer").agg(F.count(F.lit(1)).alias("expected"))
    done = enriched.groupBy("layer").agg(F.count(F.lit(1)).alias("enriched"))
    return (wanted.join(done, "layer", "left").withColumn("enriched", F.coalesce("enriched", F.lit(0)))
            .withColumn("complete", (F.col("enriched") > 0) & (F.col("enriched") >= F.col("expected") * threshold)))


def integrity(raw: DataFrame) -> DataFrame:
    """raw(source, line_no, value): per source the non-blank lines, the first bad one, and how many
    good lines come before it."""
    rows = raw.where(F.trim("value") != "").select("source", "line_no", F.try_parse_json("value").isNull().alias("bad"))
    first = cut(rows.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.min(F.when(F.col("bad"), F.col("line_no"))).alias("first_bad")))
    placed = skew.join(rows.select("source", "line_no"), first.select("source", "first_bad"), ["source"], counts=first.select("source", F.col("lines").alias("_n")))
    before = placed.groupBy("source").agg(F.count_if(F.col("first_bad").isNull() | (F.col("line_no") < F.col("first_bad"))).alias("valid_before"))
    return first.join(before, "source").withColumn("ok", F.col("first_bad").isNull())


def content_minimums(findings: DataFrame) -> DataFrame:
    """Findings whose texts are too short, with the names of what is short."""
    has_plan = F.size("fix_plan") > 0 if "fix_plan" in findings.columns else F.lit(False)
    short = [
        (text.word_count(F.col("explanation")) < 30, "explanation"),
        (text.word_count(F.col("description")) < 8, "description"),
        (F.length(F.coalesce("snippet", F.lit(""))) < 40, "snippet"),
        ((F.col("severity") != "REVIEW") & (F.coalesce("target_code", F.lit("")) == "") & ~has_plan, "target_code"),
    ]
    return (findings.withColumn("short", F.concat_ws(",", *[F.when(test, name) for test, name in short]))
            .where(F.col("short") != ""))


def merged(scanners: list[DataFrame]) -> DataFrame:
    """Scanner outputs with differing columns as one table."""
    first, *rest = scanners
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
