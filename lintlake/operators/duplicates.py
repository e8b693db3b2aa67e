"""Blocks of lines that occur in several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lintlake.functions import text
from lintlake.functions.rows import beside

BLOCK = 5


def shingles(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(path, at, hash): every run of ``size`` lines, blanks at line ends trimmed, built inside the file's row."""
    rows = F.transform(text.real_lines(F.col("content")), lambda l: F.trim(l))
    starts = F.when(F.size("rows") >= size, F.sequence(F.lit(1), F.size("rows") - size + 1))
    found = files.select("path", rows.alias("rows")).withColumn("starts", starts)
    hashed = F.transform("starts", lambda s: F.struct(s.alias("at"), F.md5(F.array_join(F.slice("rows", s, size), "\n")).alias("hash")))
    return found.select("path", F.explode(hashed).alias("h")).select("path", "h.at", "h.hash")


def duplicated(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(path, at, hash): runs of lines that occur in more than one file.

    A run copied everywhere is counted per (hash, file) first, and its rows are kept by a semi-join,
    never paired with each other."""
    found = shingles(files, size)
    spread = (found.select("hash", "path").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("files")).where("files > 1"))
    return found.join(spread.select("hash"), "hash", "left_semi")


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(path, start_line, end_line, lines): maximal duplicated stretches per file.

    Starts of runs next to each other belong to one stretch: a stretch starts where the line before
    starts no run, and its last run starts where the line after starts none.  The positions of one
    file are no more than its lines."""
    at = (duplicated(files, size).groupBy("path").agg(F.array_sort(F.collect_list("at")).alias("at")))
    first = F.array_sort(F.array_except("at", F.transform("at", lambda p: p + 1)))
    last = F.array_sort(F.array_except("at", F.transform("at", lambda p: p - 1)))
    rows = at.select("path", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("b"))
    end = F.col("b.last") + size - 1
    return rows.select("path", F.col("b.first").alias("start_line"), end.alias("end_line"), (end - F.col("b.first") + 1).alias("lines"))


def duplication(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row: lines, duplicated lines and their share in percent, as the quality gate reads it."""
    total = files.agg(F.coalesce(F.sum(text.loc(F.col("content"))), F.lit(0)).cast("long").alias("lines"))
    inside = blocks(files, size).agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("duplicated_lines"))
    return beside(total, inside).withColumn("duplication_pct", text.percent(F.col("duplicated_lines"), F.col("lines"), 2))
