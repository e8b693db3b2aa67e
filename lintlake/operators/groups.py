"""Findings that belong together: cross-cutting groups, similar wording, root-cause families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.catalog import maps as M
from lintlake.functions import severity, text
from lintlake.functions.lookup import lookup
from lintlake.operators import skew
from lintlake.operators.graph import components
from lintlake.operators.ordering import numbered
from lintlake.session import cut, stored


def _padded(number: Column) -> Column:
    digits = number.cast("string")
    return F.when(number < 1000, F.lpad(digits, 3, "0")).otherwise(digits)


# ------------------------------------------------------------------- cross-cutting groups
def _pattern() -> Column:
    return F.coalesce(F.nullif("search_pattern", F.lit("")), F.coalesce("description", F.lit("")))


def cross_cutting_groups(findings: DataFrame, min_files: int = 3) -> DataFrame:
    """Patterns of one rule that occur in several files: (rule, pattern, group, group_key, count,
    files, description).

    Different patterns of a rule may share the display name; ``group_key`` tells them apart."""
    return _patterns(findings).where(F.col("files") >= min_files)


def _n_files(findings: DataFrame) -> Column:
    """Different files, counted per repo where there are several."""
    return F.countDistinct(*[F.coalesce("repo", F.lit(""))] if "repo" in findings.columns else [], "file")


def _patterns(findings: DataFrame) -> DataFrame:
    return (findings.groupBy("rule", _pattern().alias("pattern"))
            .agg(F.count(F.lit(1)).alias("count"), _n_files(findings).alias("files"),
                 F.min(F.substring("description", 1, 60)).alias("description"))
            .withColumn("group", F.concat("rule", F.lit(" across "), F.col("files").cast("string"), F.lit(" files")))
            .withColumn("group_key", F.concat("rule", F.lit("|"), "pattern")))


def cross_cutting(findings: DataFrame, min_files: int = 3) -> DataFrame:
    """Findings with cross_cutting, cross_cutting_group and group_key (null outside a group)."""
    every = cut(_patterns(findings).select("rule", "pattern", "group", "group_key", "files", F.col("count").alias("_n")))
    groups = every.where(F.col("files") >= min_files).select("rule", "pattern", "group", "group_key")
    return (skew.beside_popular(findings.withColumn("pattern", _pattern()), groups, ["rule", "pattern"], every.select("rule", "pattern", "_n")).drop("pattern")
            .withColumn("cross_cutting", F.col("group").isNotNull())
            .withColumnRenamed("group", "cross_cutting_group"))


# ------------------------------------------------------------------------ similar wording
BUCKET = 200


def _overlap(n: Column, m: Column, threshold: float) -> Column:
    """Fewest shared words two sets of n and m words need for a Jaccard similarity above the threshold."""
    exact = (n + m) * F.lit(threshold) / F.lit(1 + threshold)
    return (F.floor(exact + F.lit(1e-9)) + 1).cast("int")


def similar_pairs(findings: DataFrame, threshold: float = 0.6, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between wordings of one rule whose word sets have a Jaccard similarity above the
    threshold; a and b are wording keys of :func:`wordings`.  The links connect exactly the wordings
    that a chain of similar pairs connects.

    Two sets that share k words share, among their words in rare-first order, a combination of
    words near the front; each set is filed under such combinations, first of one word.  A crowded
    file is never compared all against all: its sets are filed again under one more word.  Once the
    combination is as long as the overlap the sizes call for, all sets in a file are similar to those
    of the other size, and a chain through the first of them links them."""
    sets = cut(wordings(findings).select("key", "rule", "words").distinct())
    spread = sets.select("key", "rule", F.explode("words").alias("word"))
    rarity = spread.groupBy("rule", "word").agg(F.count(F.lit(1)).alias("seen"))
    ordered = (spread.join(rarity, ["rule", "word"]).groupBy("key", "rule")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "word"))), lambda p: p["word"]).alias("words"))
               .withColumn("n", F.size("words")))
    # One entry per size the partner may have; (small, big) is the size class of the pair.
    sizes = F.sequence(F.floor(F.col("n") * threshold).cast("int") + 1, F.ceil(F.col("n") / threshold).cast("int") - 1)
    entries = (ordered.withColumn("m", F.explode(F.when(F.col("n") > 0, sizes)))
               .withColumn("small", F.least("n", "m")).withColumn("big", F.greatest("n", "m"))
               .withColumn("need", _overlap(F.col("small"), F.col("big"), threshold))
               .where(F.col("need") <= F.col("small"))
               .select("key", "rule", "words", "n", "small", "big", "need",
                       F.array().cast("array<string>").alias("combo"), F.lit(0).alias("at")))
    links = None
    filed = None
    while True:
        # One more word after the last one taken, early enough that the rest can still follow.
        last = F.col("n") - F.col("need") + F.size("combo") + 1
        grown = (entries.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.greatest(last, F.col("at") + 1))))
                 .where(F.col("at") <= last)
                 .withColumn("combo", F.concat("combo", F.array(F.element_at("words", F.col("at"))))))
        entries = cut(grown)
        place = ["rule", "small", "big", "combo"]
        # Sets of one size are partners only in the class of that size: elsewhere both sizes must meet,
        # and then each set is linked to the others over one of the other size.
        crowd = (entries.groupBy(*place).agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("first"),
                                             (F.min("n") < F.max("n")).alias("mixed"))
                 .where("members > 1 AND (small = big OR mixed)").drop("mixed"))
        placed = entries.join(crowd, place)
        complete = placed.where(F.size("combo") == F.col("need"))
        chain = complete.where(F.col("key") != F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b"))
        few = placed.where((F.size("combo") < F.col("need")) & (F.col("members") <= bucket))
        left = few.where(F.col("n") == F.col("small")).select(*place, F.col("key").alias("a"), F.col("words").alias("wa"))
        right = few.where(F.col("n") == F.col("big")).select(*place, F.col("key").alias("b"), F.col("words").alias("wb"))
        shared = F.size(F.array_intersect("wa", "wb"))
        pairs = (left.join(right, place).where((F.col("a") != F.col("b")) & (
            (F.col("small") < F.col("big")) | (F.col("a") < F.col("b"))))
            .where(shared / (F.size("wa") + F.size("wb") - shared) > threshold).select("a", "b"))
        new = cut(chain.unionByName(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = new if links is None else links.unionByName(new)
        entries = placed.where((F.size("combo") < F.col("need")) & (F.col("members") > bucket)).drop("members", "first")
        if entries.isEmpty():
            return links.distinct()


def wordings(findings: DataFrame) -> DataFrame:
    """Findings with the word set of their description and a key for (rule, word set)."""
    words = F.array_sort(text.word_set(F.col("description")))
    return (findings.withColumn("words", words)
            .withColumn("key", F.concat("rule", F.lit("|"), F.array_join("words", " "))))


def _grouped(findings: DataFrame, threshold: float) -> DataFrame:
    """Findings with ``similar_group``, the smallest wording that theirs is linked to; their own where there is none."""
    keyed = wordings(findings).drop("words")
    linked = components(similar_pairs(findings, threshold)).withColumnsRenamed({"node": "key", "component": "_group"})
    return skew.join(keyed, linked, ["key"], "left").withColumn("similar_group", F.coalesce("_group", "key")).drop("key", "_group")


def similar_groups(findings: DataFrame, threshold: float = 0.6, min_files: int = 3) -> DataFrame:
    """Findings of one rule with similar wording, where a group spans several files:
    (similar_group, rule, findings, files)."""
    grouped = _grouped(_per_file(findings), threshold)
    return (grouped.groupBy("similar_group", "rule").agg(F.sum("_n").alias("findings"), _n_files(findings).alias("files"))
            .where(F.col("files") >= min_files))


def _per_file(findings: DataFrame) -> DataFrame:
    """(rule, description, repo, file, _n, phase): equal wordings of a file count as one row."""
    place = [c for c in ("repo", "file") if c in findings.columns]
    phase = [F.min("phase").alias("phase")] if "phase" in findings.columns else []
    return stored(findings.groupBy("rule", F.coalesce("description", F.lit("")).alias("description"), *place).agg(F.count(F.lit(1)).alias("_n"), *phase))


def tag_similar(findings: DataFrame, threshold: float = 0.6, min_files: int = 3) -> DataFrame:
    """Findings with cross_cutting and cross_cutting_group by similar wording: a finding whose wording is linked with
    others of its rule in several files carries the label '<phase>.<n> <description>'.

    The groups of a phase are numbered by size; the label shows the start of the shortest description."""
    found = findings.drop("cross_cutting", "cross_cutting_group").withColumn("_said", F.coalesce("description", F.lit("")))
    grouped = stored(_grouped(_per_file(found), threshold))
    text_ = F.col("description")
    wide = (grouped.groupBy("similar_group").agg(F.sum("_n").alias("_n"), _n_files(findings).alias("_files"), F.min("phase").alias("_phase"),
                                                F.min_by(F.substring(text_, 1, 60), F.struct(F.length(text_), text_)).alias("_text"))
            .where(F.col("_files") >= min_files))
    counted = numbered(wide, [F.col("_phase")], [-F.col("_n"), F.col("similar_group")], "_at")
    label = F.concat(F.coalesce(F.col("_phase").cast("string"), F.lit("?")), F.lit("."), F.col("_at").cast("string"), F.lit(" "), "_text")
    named = counted.select("similar_group", label.alias("cross_cutting_group"))
    # The label follows from rule and wording, so findings meet it in one join.
    worded = grouped.groupBy("rule", F.col("description").alias("_said"), "similar_group").agg(F.sum("_n").alias("_n"))
    labels = worded.join(named, "similar_group").select("rule", "_said", "cross_cutting_group")
    return (skew.join(found, labels, ["rule", "_said"], "left", counts=worded.where("rule IS NOT NULL").select("rule", "_said", "_n"))
            .withColumn("cross_cutting", F.col("cross_cutting_group").isNotNull()).drop("_said"))


# --------------------------------------------------------------------- root-cause families
def _restored(findings: DataFrame) -> DataFrame:
    """Findings as before an earlier collapse."""
    if "original_severity" in findings.columns:
        original = F.when(F.col("original_severity").isin(M.SEVERITIES), F.col("original_severity"))
        findings = findings.withColumn("severity", F.coalesce(original, F.col("severity")))
    return findings.drop("family_id", "parent_finding_id", "is_root_cause", "original_severity")


def _family_key(findings: DataFrame) -> Column:
    fields = [F.col(c) for c in ("search_pattern", "current_code", "snippet", "description", "id") if c in findings.columns]
    return text.family_key(*fields)


def _sort_level() -> Column:
    """Severity a family member is ranked by; an unknown one counts as MEDIUM."""
    return F.when(F.col("severity").isin(M.SEVERITIES), F.col("severity")).otherwise("MEDIUM")


def families(findings: DataFrame, rules=("R01",), min_files: int = 2) -> DataFrame:
    """One row per root-cause family: (family_id, rule, pattern_key, root_finding_id, root_severity,
    family_size, distinct_files, description)."""
    found = _restored(findings)
    found = found.withColumn("pattern_key", _family_key(found)).where(
        F.col("rule").isin(list(rules)) & (F.coalesce("severity", F.lit("")) != "REVIEW") & (F.col("pattern_key") != ""))
    first = F.struct(severity.rank(_sort_level()).alias("rank"), F.coalesce("phase", F.lit(M.LAST_PHASE)).alias("phase"),
                     F.col("file"), F.coalesce("line", F.lit(0)).alias("line"), F.col("id"))
    grouped = (found.groupBy("rule", "pattern_key")
               .agg(F.min_by(F.struct("id", _sort_level().alias("severity"), "description"), first).alias("root"),
                    F.count(F.lit(1)).alias("family_size"), F.countDistinct(F.nullif("file", F.lit(""))).alias("distinct_files"))
               .where(F.col("distinct_files") >= min_files))
    counted = numbered(grouped, [], [F.col("rule"), F.col("pattern_key")], "n")
    return counted.select(F.concat(F.lit("FAM-"), _padded(F.col("n"))).alias("family_id"), "rule", "pattern_key",
                          F.col("root.id").alias("root_finding_id"), F.col("root.severity").alias("root_severity"),
                          "family_size", "distinct_files", F.col("root.description").alias("description"))


def collapse(findings: DataFrame, made: DataFrame, rules=("R01",)) -> DataFrame:
    """Findings with family_id, parent_finding_id, is_root_cause, original_severity; members that are not
    the root go one severity down.  ``rules`` are those the families were made for."""
    found = _restored(findings)
    # Findings that cannot be members have no key and stay where they are, as do those of large families.
    key = F.when((F.coalesce("severity", F.lit("")) != "REVIEW") & F.col("rule").isin(list(rules)), _family_key(found))
    keyed = found.withColumn("pattern_key", key)
    made = stored(made.select("rule", "pattern_key", "family_id", "root_finding_id", F.col("family_size").alias("_n")))
    joined = skew.beside_popular(keyed, made.drop("_n"), ["rule", "pattern_key"], made.select("rule", "pattern_key", "_n"))
    member = F.col("family_id").isNotNull()
    root = member & (F.col("id") == F.col("root_finding_id"))
    below = member & ~root
    return (joined.withColumn("is_root_cause", F.when(member, root))
            .withColumn("parent_finding_id", F.when(below, F.col("root_finding_id")))
            .withColumn("original_severity", F.when(below, _sort_level()))
            .withColumn("severity", F.when(below, lookup(M.DEMOTION, F.col("severity"), "LOW")).otherwise(F.col("severity")))
            .drop("pattern_key", "root_finding_id"))


def family_summary(made: DataFrame) -> DataFrame:
    return made.agg(F.count(F.lit(1)).alias("families_created"), F.count(F.lit(1)).alias("root_causes"),
                    F.coalesce(F.sum(F.col("family_size") - 1), F.lit(0)).alias("subordinate_findings"))
