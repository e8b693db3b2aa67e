"""De-duplication, layer assignment and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lintlake.functions import severity, text
from lintlake.operators.graph import components
from lintlake.operators.ordering import numbered
from lintlake.session import stored

NEAR = 5          # lines
SHARED_WORDS = 4


def repo_of(*frames: DataFrame) -> list[str]:
    """``repo`` where all frames have it: it is part of every key then, as paths repeat across repos."""
    return ["repo"] if all("repo" in f.columns for f in frames) else []


def same_line(findings: DataFrame) -> DataFrame:
    """One finding per (repo, file, line, rule): the most severe, then the best explained.  ``scanner``
    lists all that reported it.

    The choice is a minimum, so map tasks reduce copies before the shuffle."""
    key = [*repo_of(findings), "file", "line", "rule"]
    rest = [c for c in findings.columns if c not in key]
    explained = F.length(F.coalesce("explanation", F.lit(""))) if "explanation" in findings.columns else F.lit(0)
    order = F.struct(severity.rank(F.col("severity")).alias("rank"), (-explained).alias("explained"),
                     *[F.col(c) for c in rest])
    kept = F.min(order).alias("kept")
    scanners = F.array_join(F.array_sort(F.collect_set("scanner")), ",").alias("scanners")
    return (findings.groupBy(*key).agg(kept, scanners)
            .select(*key, *[F.col(f"kept.{c}").alias(c) for c in rest if c != "scanner"],
                    F.col("scanners").alias("scanner")))


def near_pairs(findings: DataFrame) -> DataFrame:
    """Pairs of findings with one rule and file, at most five lines apart, whose descriptions share
    four words and quote the same names: (low, high) as line numbers with rule and file (and repo).

    Findings are dealt by file and rule, and each looks at those up to five lines further on.  After
    :func:`same_line` these are five at most."""
    key = [*repo_of(findings), "file", "rule"]
    dealt = findings.select(*key, "line", "description").repartition(*key)
    words, names = text.content_words(F.col("description")), text.code_names(F.col("description"))
    rows = dealt.where(F.size(words) >= SHARED_WORDS).select(*key, "line", F.struct("line", words.alias("words"), names.alias("names")).alias("own"))
    ahead = Window.partitionBy(*key).orderBy("line").rangeBetween(1, NEAR)
    seen = rows.withColumn("others", F.collect_list("own").over(ahead)).where(F.size("others") > 0)
    linked = F.filter("others", lambda o: (F.size(F.array_intersect("own.words", o["words"])) >= SHARED_WORDS) & (F.col("own.names") == o["names"]))
    return seen.select(*key, F.col("line").alias("low"), F.explode(F.transform(linked, lambda o: o["line"])).alias("high"))


def near_groups(findings: DataFrame) -> DataFrame:
    """(repo, file, rule, line, first_line): which findings merge, and the line of the merged one.

    Lines that are linked to the one before form a run, found in one pass over a file's lines.  Only links between
    runs, over lines that belong to neither, are left for :func:`components`."""
    key = [*repo_of(findings), "file", "rule"]
    pairs = near_pairs(findings)
    ends = pairs.select(*key, F.explode(F.array(F.struct(F.col("low").alias("line"), F.lit(None).cast("int").alias("back")),
                                                F.struct(F.col("high").alias("line"), F.col("low").alias("back")))).alias("e")).select(*key, "e.*")
    in_order = Window.partitionBy(*key).orderBy("line")
    lines = ends.groupBy(*key, "line").agg(F.collect_set("back").alias("back"))
    opened = ~F.coalesce(F.array_contains("back", F.lag("line").over(in_order)), F.lit(False))
    runs = lines.withColumn("opens", F.when(opened, F.col("line"))).withColumn("run", F.last("opens", ignorenulls=True).over(in_order))
    # A line looks back five lines at most, so over five lines with links at most.
    before = [F.struct(F.lag("line", k).over(in_order).alias("line"), F.lag("run", k).over(in_order).alias("run")) for k in range(1, NEAR + 1)]
    over = F.filter(F.array(*before), lambda b: F.array_contains("back", b["line"]) & (b["run"] != F.col("run")))
    placed = stored(runs.withColumn("over", F.transform(over, lambda b: b["run"])).select(*key, "line", "run", "over"))
    apart = placed.where(F.size("over") > 0).select(*key, "run", F.explode(F.array_distinct("over")).alias("other")).distinct()
    if apart.isEmpty():
        return placed.select(*key, "line", F.col("run").alias("first_line"))
    linked = components(apart.select(F.struct(*key, "run").alias("a"), F.struct(*key, F.col("other").alias("run")).alias("b")))
    named = linked.select(*[F.col(f"node.{c}").alias(c) for c in (*key, "run")], F.col("component.run").alias("_first"))
    return placed.join(named, [*key, "run"], "left").select(*key, "line", F.coalesce("_first", "run").alias("first_line"))


def merge_near(findings: DataFrame) -> DataFrame:
    """Near-identical findings as one: lowest line, highest end, worst severity, longest texts, and their
    snippets one below the other.

    ``merged`` is the number of findings that went in.  Snippets come in the order of their lines; one whose lines are all
    part of another's is left out ("line 3" is no part of "line 30").  They are lines of one file close to each other, so their text is bounded by the file's."""
    groups = near_groups(findings)
    key = [*repo_of(findings), "rule", "file"]
    joined = findings.join(groups, [*key, "line"], "left").withColumn(
        "first_line", F.coalesce("first_line", "line"))
    end = F.coalesce("end_line", "line") if "end_line" in findings.columns else F.col("line")
    rank = severity.rank(F.col("severity"))

    def longest(column):
        size = F.length(F.coalesce(column, F.lit("")))
        return F.max_by(column, F.struct(size, -F.col("line"))).alias(column)

    def stacked(column):
        listed = F.transform(F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct("line", column)))), lambda s: s[column])
        def lined(s):
            return F.concat(F.lit("\n"), s, F.lit("\n"))

        # The first of equal texts stays; whole lines inside a longer text go.
        apart = F.filter(F.array_distinct(listed), lambda s: ~F.exists(listed, lambda t: (t != s) & lined(t).contains(lined(s))))
        return F.when(F.size(listed) > 0, F.array_join(apart, "\n")).alias(column)

    texts = [c for c in ("description", "explanation", "current_code") if c in findings.columns]
    snippets = [stacked("snippet")] if "snippet" in findings.columns else []
    skip = {*key, "line", "end_line", "severity", "snippet", *texts}
    others = [F.min_by(c, F.col("line")).alias(c) for c in findings.columns if c not in skip]
    made = joined.groupBy(*key, "first_line").agg(
        F.max(end).alias("end_line"), severity.of_rank(F.min(rank)).alias("severity"),
        *[longest(c) for c in texts], *snippets, *others, F.count(F.lit(1)).alias("merged"))
    return made.withColumnRenamed("first_line", "line")


def with_layer(findings: DataFrame, files: DataFrame, default: str = "unclassified") -> DataFrame:
    """The layer of each finding's file."""
    key = repo_of(findings, files)
    layers = files.select(*key, F.col("path").alias("file"), F.col("layer").alias("_layer"))
    return (findings.drop("layer").join(layers, [*key, "file"], "left")
            .withColumn("layer", F.coalesce("_layer", F.lit(default))).drop("_layer"))


def assign_ids(findings: DataFrame, name: str = "id") -> DataFrame:
    """Ids such as SEC-001, counted per category prefix in the order phase, repo, file, line, rule, description."""
    prefixed = findings.withColumn("_prefix", severity.prefix(F.col("category")))
    order = [F.col(c) for c in ("phase", *repo_of(findings), "file", "line", "rule", "description")]
    counted = numbered(prefixed, [F.col("_prefix")], order, "_n")
    digits = F.col("_n").cast("string")
    return counted.withColumn(name, F.concat("_prefix", F.lit("-"), F.when(F.col("_n") < 1000, F.lpad(digits, 3, "0")).otherwise(digits))).drop("_prefix", "_n")


def processing_summary(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """How many findings came in, were rejected, were duplicates, and remain, by the counts of the pass that wrote
    them (raw, valid, final)."""
    n = spark.range(1).select(*[F.lit(counts[s]).cast("long").alias(s) for s in ("raw", "valid", "final")])
    return n.select(F.col("raw").alias("raw_input"), (F.col("raw") - F.col("valid")).alias("discarded_invalid"),
                    (F.col("valid") - F.col("final")).alias("duplicates_removed"), F.col("final").alias("final_count"))
