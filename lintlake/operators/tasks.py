"""Findings as phase-ordered tasks: making them, tracking them, finding their line again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.catalog import maps as M
from lintlake.functions import severity, text
from lintlake.functions.lookup import first_match, literal_map
from lintlake.operators import skew
from lintlake.operators.marks import only_marked
from lintlake.operators.ordering import numbered, with_previous
from lintlake.session import cut

RADIUS = 20


def phase_tasks(findings: DataFrame, default_confidence: str = "high") -> DataFrame:
    """One pending task per finding with its place in the phase's order (file, line, id)."""
    def has(name, default=None):
        return F.col(name) if name in findings.columns else F.lit(default)

    imports = has("target_import").cast("string")
    made = findings.select(
        "id", F.lit("pending").alias("status"), "rule", "severity", "file", F.coalesce("line", F.lit(0)).alias("line"),
        has("current_code").cast("string").alias("current_code"), has("target_code").cast("string").alias("target_code"),
        F.when(F.trim(imports) != "", F.array(F.trim(imports))).otherwise(F.array().cast("array<string>")).alias("imports_needed"),
        F.coalesce(has("search_pattern").cast("string"), F.lit("")).alias("search_pattern"),
        F.coalesce(has("confidence").cast("string"), F.lit(default_confidence)).alias("confidence"),
        severity.task_phase(F.col("phase"), F.col("rule")).alias("phase"))
    return numbered(made, [F.col("phase")], [F.col("file"), F.col("line"), F.col("id")], "position")


def phase_files(tasks: DataFrame) -> DataFrame:
    """Every phase with its name, size and status, also phases without tasks."""
    every = tasks.sparkSession.range(len(M.PHASE_NAME)).select(F.col("id").cast("int").alias("phase"))
    counts = tasks.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce("n", F.lit(0))
    return every.join(counts, "phase", "left").select(
        "phase", literal_map(M.PHASE_NAME)[F.col("phase")].alias("name"), total.alias("total_tasks"),
        F.when(total == 0, "clear").otherwise("not_started").alias("status"))


def progress(tasks: DataFrame) -> DataFrame:
    """Per phase: tasks, resolved, skipped, failed, pending and a status; all phases are listed."""
    every = tasks.sparkSession.range(len(M.PHASE_NAME)).select(F.col("id").cast("int").alias("phase"))
    status, resolution = F.coalesce("status", F.lit("pending")), F.coalesce("resolution", F.lit(""))
    resolved = (status == "completed") & resolution.isin(M.DONE_RESOLUTIONS)
    skipped = ~resolved & ((status == "skipped") | (resolution == "skipped"))
    failed = ~resolved & ~skipped & (resolution == "failed")
    counts = tasks.groupBy("phase").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(resolved).alias("resolved"), F.count_if(skipped).alias("skipped"),
        F.count_if(failed).alias("failed"), F.count_if(status == "pending").alias("pending"))
    names = ("total", "resolved", "skipped", "failed", "pending")
    zero = every.join(counts, "phase", "left").select("phase", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    total, pending = F.col("total"), F.col("pending")
    return zero.withColumn("status", first_match([
        (total == 0, "EMPTY"), (pending == total, "NOT STARTED"), (pending == 0, "COMPLETE")], "IN PROGRESS"))


def tallies(tasks: DataFrame) -> DataFrame:
    """One row: totals over all phases, completed phases and the current one."""
    per = progress(tasks)  # eleven rows
    busy = F.col("pending") > 0
    return per.agg(*[F.sum(c).alias(c) for c in ("total", "resolved", "skipped", "failed")],
                   F.count_if(~busy).alias("phases_completed"), F.min(F.when(busy, F.col("phase"))).alias("current_phase"))


def status_table(tasks: DataFrame) -> DataFrame:
    """Per phase the counts of each status and of the resolutions shown next to them."""
    return tasks.groupBy("phase").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "completed")],
        *[F.count_if(F.col("resolution") == r).alias(r) for r in ("already_resolved", "skipped", "failed")])


def phase_message(tasks: DataFrame) -> DataFrame:
    """Per phase a line such as 'fix(phase-1): Security - 3 applied, 1 skipped'."""
    shown = {"applied": "applied", "line-shifted": "line-shifted", "already_resolved": "already-resolved", "skipped": "skipped", "failed": "failed"}
    counts = tasks.groupBy("phase").agg(*[F.count_if(F.col("resolution") == r).alias(r) for r in shown])
    parts = F.concat_ws(", ", *[F.when(F.col(f"`{r}`") > 0, F.concat(F.col(f"`{r}`").cast("string"), F.lit(" " + word))) for r, word in shown.items()])
    return counts.select("phase", F.concat(F.lit("fix(phase-"), F.col("phase").cast("string"), F.lit("): "), severity.phase_name(F.col("phase")),
                                           F.lit(" - "), F.when(parts == "", "no changes").otherwise(parts)).alias("message"))


def remediation(tasks: DataFrame) -> DataFrame:
    """One row: counts per resolution, resolution rate, first and last completion."""
    def n(name):
        return F.count_if(F.col("resolution") == name)

    done = F.count_if(F.col("resolution").isin(M.DONE_RESOLUTIONS))
    finished = F.when(F.col("status") == "completed", F.col("completed_at"))
    return tasks.agg(F.count(F.lit(1)).alias("total"), n("applied").alias("applied"), n("line-shifted").alias("line_shifted"),
                     n("already_resolved").alias("already_resolved"), n("skipped").alias("skipped"), n("failed").alias("failed"),
                     F.round(done / F.count(F.lit(1)), 4).alias("resolution_rate"),
                     F.min(finished).alias("first_completed"), F.max(finished).alias("last_completed"))


def route(tasks: DataFrame, decided: DataFrame, bulk: DataFrame, default_confidence: str = "high") -> DataFrame:
    """Where each pending task goes: auto, skip, fix or undecided.

    decided(task_id, action) names single tasks, bulk(rule, action) whole rules; both only matter for
    low confidence, and a single decision comes first."""
    pending = tasks.where("status = 'pending'").withColumn("confidence", F.coalesce("confidence", F.lit(default_confidence)))
    joined = skew.join(pending.join(decided.withColumnRenamed("action", "one"), "task_id", "left"), bulk.withColumnRenamed("action", "all"), ["rule"], "left")
    low = F.col("confidence") == "low"
    return joined.withColumn("route", first_match([
        (~low, "auto"), (F.col("one") == "skip", "skip"), (F.col("one").isNotNull(), "fix"),
        (F.col("all").isin("skip", "skip-all-low"), "skip"), (F.col("all").isin("fix", "fix-all-low"), "fix")], "undecided")).drop("one", "all")


def order_violations(tasks: DataFrame, order: str = "task_id") -> DataFrame:
    """Files whose pending tasks do not go down from the last line to the first: (phase, file)."""
    pending = tasks.where("status = 'pending'").select("phase", "file", "line", order)
    seen = with_previous(pending, [F.col("phase"), F.col("file")], [F.col(order)], F.col("line"), "before")
    return seen.where(F.col("before") < F.col("line")).select("phase", "file").distinct()


def application_order(tasks: DataFrame) -> DataFrame:
    """Pending tasks numbered per file from the last line up, so that a fix does not move the next one."""
    pending = tasks.where("status = 'pending'")
    return numbered(pending, [F.col("file")], [-F.col("line"), F.col("task_id")], "position")


def next_task(tasks: DataFrame) -> DataFrame:
    """The first pending task of the first phase that has one."""
    first = F.min_by(F.struct("task_id", "phase", "file", "line"), F.struct("phase", "task_id")).alias("t")
    return tasks.where("status = 'pending'").agg(first).where(F.col("t").isNotNull()).select("t.*")


def batch_progress(batches: DataFrame, per: str | None = None) -> DataFrame:
    """Counts of scan batches by status."""
    grouped = batches.groupBy(per) if per else batches.groupBy()
    status = F.col("status")
    return grouped.agg(F.count(F.lit(1)).alias("batches"), *[F.count_if(status == s).alias(s) for s in ("complete", "pending", "failed")]).withColumn(
        "all_done", F.col("pending") == 0)


def batch_size(total_loc: Column, files: Column) -> Column:
    """Files per batch from the average length of a file."""
    usable = int(M.WINDOW_TOKENS * M.WINDOW_SHARE) - M.PROMPT_TOKENS
    average = F.floor(total_loc / F.greatest(files, F.lit(1)))
    return F.greatest(F.lit(M.MIN_BATCH), F.least(F.lit(M.MAX_BATCH), F.floor(F.lit(usable) / (average * M.TOKENS_PER_LOC + M.TOKENS_PER_FILE)))).cast("int")


def scan_batches(listed: DataFrame) -> DataFrame:
    """Files worth a close scan, in path order, cut into batches: (path, layer, batch)."""
    usable = (F.col("tag") != "GENERATED") & ~F.col("nominal") & ~F.col("is_meta_file")
    size = listed.agg(batch_size(F.sum("loc"), F.count_if(usable)).alias("size")).scalar()
    placed = numbered(listed.where(usable).select("path", "layer"), [], [F.col("path")], "at")
    return placed.select("path", "layer", F.ceil(F.col("at") / size).cast("int").alias("batch"))


def remaining_batches(plan: DataFrame, scanned: DataFrame, size: int) -> DataFrame:
    """Planned files nobody scanned, batched again after the last batch: (path, layer, batch, parent)."""
    left = plan.join(scanned.select("path").distinct(), "path", "left_anti")
    last = plan.agg(F.coalesce(F.max("batch"), F.lit(0)).alias("n")).scalar()
    placed = numbered(left, [], [F.col("path")], "at")
    return placed.select("path", "layer", (last + F.ceil(F.col("at") / size)).cast("int").alias("batch"), F.col("batch").alias("parent"))


# ------------------------------------------------------------------------ lines and snippets
def _first_line(code: str) -> Column:
    blank = F.lit(" \t\r\n")
    return F.btrim(F.substring_index(F.btrim(F.coalesce(code, F.lit("")), blank), "\n", 1), blank)


TOGETHER = 256  # places of one file that are looked up in one row


def _by_file(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(file, ...) gathered to rows (file, wanted, content) of about ``TOGETHER`` each, with the text of the file;
    null where there is none.  A file with very many is several rows, dealt out by a hash."""
    fields = [c for c in wanted.columns if c != "file"]
    counts = wanted.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_parts"))
    dealt = skew.join(wanted, counts, ["file"], "left").withColumn("_part", F.pmod(F.xxhash64(*fields), F.coalesce("_parts", F.lit(1))))
    rows = cut(dealt.groupBy("file", "_part").agg(F.collect_list(F.struct(*fields)).alias("wanted")).drop("_part"))
    named = only_marked(files.select(F.col("path").alias("file"), F.coalesce("content", F.lit("")).alias("content")), "file", rows, "file")
    return skew.join(rows, named, ["file"], "left")


def _lines_around(at: Column, around: int, holds) -> Column:
    """Numbers of the lines of ``_lines`` within some lines of one, that pass the test."""
    first, last = F.greatest(at - around, F.lit(1)), F.least(at + around, F.size("_lines"))
    return F.filter(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda i: holds(F.element_at("_lines", i)))


def relocate(tasks: DataFrame, files: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Where each task's code is now: (task_id, match, found_line, shift, outcome).

    tasks(task_id, file, line, code); files(path, content).  The cited line wins, then the nearest
    within the radius (forward first), then the first in the file.  Only files that tasks name travel, each with
    rows of its tasks, which look into the file's lines by number; no line becomes a row."""
    wanted = tasks.select("task_id", "file", "line", _first_line("code").alias("needle"))
    short = wanted.where(F.length("needle") < 5)
    rows = _by_file(wanted.where(F.length("needle") >= 5), files).withColumn("_lines", text.real_lines(F.coalesce("content", F.lit(""))))

    def found(task: Column) -> Column:
        near = _lines_around(task["line"], radius, lambda text_: text_.contains(task["needle"]))
        best = F.array_min(F.transform(near, lambda i: F.struct(F.abs(i - task["line"]).alias("far"), (i < task["line"]).alias("back"), i.alias("at"))))
        return F.struct(task["task_id"].alias("task_id"), task["line"].alias("line"), task["needle"].alias("needle"), best["at"].alias("near_line"))

    looked = rows.select("content", F.explode(F.transform("wanted", found)).alias("t")).select("content", "t.*")
    # The first line that holds it has as many line breaks before it as the text up to there.
    before = F.expr("left(content, instr(content, needle))")
    far = F.when(F.col("near_line").isNull() & F.expr("instr(content, needle) > 0"), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)
    looked = looked.withColumn("far_line", far)
    match = first_match([(F.col("near_line") == F.col("line"), "exact"), (F.col("near_line").isNotNull(), "nearby"),
                         (F.col("far_line").isNotNull(), "file_wide"), (F.col("content").isNotNull(), "not_found")], "file_missing")
    every = (looked.select("task_id", "line", match.alias("match"), F.coalesce("near_line", "far_line").alias("found_line"))
             .unionByName(short.select("task_id", "line", F.lit("exact").alias("match"), F.col("line").alias("found_line"))))
    shift = F.abs(F.col("found_line") - F.col("line"))
    outcome = first_match([(F.col("match").isin("file_missing", "not_found"), "already_resolved"), (F.col("match") == "exact", "valid"),
                           (shift > 50, "needs_rescan")], "line_updated")
    return every.select("task_id", "match", "found_line", shift.alias("shift"), outcome.alias("outcome"))


def snippet_check(findings: DataFrame, files: DataFrame, around: int = 5) -> DataFrame:
    """Whether the first line of a finding's snippet stands within a few lines of where it was cited:
    (id, valid).  findings(id, file, line, snippet); files(path, content)."""
    wanted = findings.select("id", "file", "line", F.substring_index("snippet", "\n", 1).alias("needle"))
    rows = _by_file(wanted, files).withColumn("_lines", text.real_lines(F.coalesce("content", F.lit(""))))

    def checked(row: Column) -> Column:
        near = _lines_around(row["line"], around, lambda text_: text_.contains(row["needle"]))
        return F.struct(row["id"].alias("id"), (F.size(near) > 0).alias("valid"))

    return rows.select(F.explode(F.transform("wanted", checked)).alias("r")).select("r.*")


def changed_only(tasks: DataFrame, changed: DataFrame) -> DataFrame:
    """Tasks in changed files(path)."""
    return tasks.join(changed.select(F.col("path").alias("file")), "file", "left_semi")


def last_entries(log: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last rows of a log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def usage(ledger: DataFrame, budget: int = 500_000, reserve: int = 30_000, per: str | None = None) -> DataFrame:
    """Units used and left, and whether another run fits; ledger(tokens)."""
    grouped = ledger.groupBy(per) if per else ledger.groupBy()
    used = F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")
    return grouped.agg(used.alias("used")).withColumn("remaining", F.lit(budget) - F.col("used")).withColumn("ok", F.col("remaining") >= reserve)


def baseline_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Error counts per key against a stored baseline: (key, errors, baseline, new_errors, verdict,
    store).  Only an increase blocks; without a baseline the count is stored."""
    joined = current.join(baseline.withColumnRenamed("errors", "baseline"), "key", "left")
    more = F.greatest(F.col("errors") - F.col("baseline"), F.lit(0))
    return joined.select("key", "errors", "baseline", F.coalesce(more, F.lit(0)).alias("new_errors"),
                         F.when(F.col("errors") > F.col("baseline"), "BLOCKED").otherwise("PASS").alias("verdict"),
                         F.when(F.col("baseline").isNull() | (F.col("errors") == 0), F.col("errors")).alias("store"))
