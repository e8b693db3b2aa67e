"""File inventory: what each file is, how long it is, and whether it is worth scanning.

A file is one row with its whole text, so every test below is a row expression: the
inventory needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.catalog import layers as L
from lintlake.functions import paths, text
from lintlake.functions.lookup import contains_any, first_match


def generated(content: Column) -> Column:
    """A generator's mark in the first five lines."""
    return contains_any(F.lower(F.substring_index(content, "\n", 5)), L.GENERATED_MARKS)


def meta_file(path: Column, content: Column) -> Column:
    """A file that itself defines checks: directory, name and content must all say so."""
    head = F.substring_index(content, "\n", L.META_HEAD)
    return path.rlike(L.META_DIRS) & path.rlike(L.META_NAMES) & head.rlike(L.META_MARKS)


def tag(path: Column, content: Column, loc: Column) -> Column:
    lower = F.lower(path)
    return first_match([
        (loc > L.MAX_LOC, "OVERSIZED"),
        (contains_any(lower, L.TEST_MARKS), "TEST"),
        (contains_any(lower, L.GENERATED_PATHS) | generated(content), "GENERATED"),
    ], "SOURCE")


def inventory(files: DataFrame, authority=()) -> DataFrame:
    """files(path, stack, content, ...) -> + loc, layer, tag, nominal, is_meta_file, skip_reason."""
    path, content = F.col("path"), F.col("content")
    listed = files.withColumn("loc", text.loc(content))
    loc = F.col("loc")
    return (listed
            .withColumn("layer", paths.layer(path, F.col("stack")))
            .withColumn("tag", tag(path, content, loc))
            .withColumn("nominal", paths.nominal(path, loc, authority))
            .withColumn("is_meta_file", meta_file(path, content))
            .withColumn("skip_reason", F.when(F.col("tag") == "GENERATED", "Generated source file")))


def source_tree(files: DataFrame) -> DataFrame:
    """Keep the files a walk would keep: the stack's extensions outside pruned directories."""
    return files.where(paths.wanted(F.col("path"), F.col("stack")))


def layer_totals(listed: DataFrame) -> DataFrame:
    """Files and lines per layer."""
    return listed.groupBy("layer").agg(F.count(F.lit(1)).alias("files"),
                                       F.sum("loc").cast("long").alias("loc"))


def totals(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count(F.lit(1)).alias("total_files"),
                      F.coalesce(F.sum("loc"), F.lit(0)).cast("long").alias("total_loc"),
                      F.countDistinct("layer").alias("layers"))


def stacks(files: DataFrame) -> DataFrame:
    """files(repo, path, content) -> one row per repo with its stack and framework.

    Only marker files in the root of a repo are looked at."""
    def root(name):
        return F.col("path") == name

    dependencies = F.map_keys(F.map_concat(*[
        F.coalesce(F.from_json(F.get_json_object("content", f"$.{part}"), "map<string,string>"),
                   F.create_map().cast("map<string,string>"))
        for part in ("dependencies", "devDependencies")]))
    package = files.where(root("package.json")).select(
        "repo", *[F.array_contains(dependencies, name).alias(name) for name in ("next", "react", "vue", "express")])
    lower = F.lower("content")
    marks = files.where(F.col("path").isin("package.json", "pyproject.toml", "requirements.txt",
                                           "pom.xml", "build.gradle")).groupBy("repo").agg(
        F.bool_or(root("package.json")).alias("node"),
        F.bool_or(F.col("path").isin("pyproject.toml", "requirements.txt")).alias("python"),
        F.bool_or(F.col("path").isin("pom.xml", "build.gradle")).alias("java"),
        *[F.bool_or(root("pyproject.toml") & lower.contains(name)).alias(name)
          for name in ("fastapi", "django", "flask")])
    repos = files.select("repo").distinct().join(marks, "repo", "left").join(package, "repo", "left")
    node, python, java = (F.coalesce(c, F.lit(False)) for c in ("node", "python", "java"))
    framework = first_match(
        [(node & (F.col(c)), name) for c, name in (("next", "nextjs"), ("react", "react"),
                                                   ("vue", "vue"), ("express", "express"))]
        + [(~node & python & F.col(c), c) for c in ("fastapi", "django", "flask")], "unknown")
    return repos.select(
        "repo", first_match([(node, "typescript"), (python, "python"), (java, "java")], "unknown").alias("stack"),
        framework.alias("framework"))
