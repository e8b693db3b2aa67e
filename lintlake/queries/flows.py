"""Streams, sinks and whole plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.catalog import maps as M
from lintlake.operators import gate, tasks, validate
from lintlake.plans import analysis, audit
from lintlake.queries import views as V
from lintlake.queries.findings import RAW, REASON, as_lines, raw_lines, tested
from lintlake.queries.registry import query
from lintlake.queries.reports import LEVELS
from lintlake.queries.scan import PROSE, PROSE_LINES, _scan_sql, prose_files
from lintlake.session import checkpoint_folder, released
from lintlake.sources import readers, sinks
from lintlake.streaming import intake as S


def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------------- streams
@query("stream_intake", V.sql("", f"SELECT coalesce(split_part({REASON}, ':', 1), 'valid') AS state, count(*) AS findings FROM raw WHERE kind <> 2 GROUP BY 1", raw=RAW))
def stream_intake(spark, folder):
    home = scratch(spark, "intake")
    # Line items are dealt to the files, and their texts made there.  A packed file is read by one task, so there are as many
    # as a shuffle has partitions, four at least; they come in two batches.
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    as_lines(V.table(spark, folder, "lineitem").repartition(files)).select("value").write.option("compression", "gzip").text(f"{home}/in")
    released(spark)
    S.intake(spark, f"{home}/in", f"{home}/valid", f"{home}/rejected", f"{home}/done", V.parts(spark, folder), files_per_batch=-(-files // 2))
    # Running it again finds nothing new.
    S.intake(spark, f"{home}/in", f"{home}/valid", f"{home}/rejected", f"{home}/done", V.parts(spark, folder))
    good = spark.read.parquet(f"{home}/valid").select(F.lit("valid").alias("state"))
    bad = spark.read.parquet(f"{home}/rejected").select(F.substring_index("_reason", ":", 1).alias("state"))
    return good.unionByName(bad).groupBy("state").agg(F.count(F.lit(1)).alias("findings"))


EVENT_SEVERITY = "CASE WHEN value > 60 THEN 'CRITICAL' WHEN value > 30 THEN 'HIGH' WHEN value > 10 THEN 'MEDIUM' ELSE 'LOW' END"


def event_stream(spark, folder):
    return S.table_stream(spark, folder, "events", V.table(spark, folder, "events").schema)


@query("stream_severity_totals", f"SELECT {EVENT_SEVERITY} AS severity, count(*) AS findings FROM events GROUP BY 1")
def stream_severity_totals(spark, folder):
    home = scratch(spark, "totals")
    S.severity_totals(event_stream(spark, folder).select(F.expr(EVENT_SEVERITY).alias("severity")), f"{home}/out", f"{home}/done")
    return spark.read.parquet(f"{home}/out")


@query("stream_usage_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id AS repo, cast(sum(event_id % 9000) AS bigint) AS used, count(*) AS runs FROM events GROUP BY 1, 2")
def stream_usage_windows(spark, folder):
    home = scratch(spark, "windows")
    ledger = event_stream(spark, folder).select(F.col("user_id").alias("repo"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 9000).alias("tokens"))
    S.usage_windows(ledger, f"{home}/out", f"{home}/done")
    return S.latest_windows(spark, f"{home}/out").drop("late_runs")


# ------------------------------------------------------------------------------------ sinks
@query("sink_json_lines", V.sql("findings", "SELECT layer, severity, count(*) AS findings, cast(sum(line) AS bigint) AS lines FROM findings GROUP BY 1, 2"))
def sink_json_lines(spark, folder):
    """Findings written as JSON lines, one folder per layer, and read back."""
    home = scratch(spark, "jsonl")
    found = V.findings(spark, folder).select("rule", "severity", "file", "line", "layer", "description", F.col("layer").alias("part"))
    sinks.json_lines(found, home, "part")
    return readers.findings(spark, home).groupBy("layer", "severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("line").alias("lines"))


@query("sink_numbered_lines", "SELECT user_id, count(*) AS lines, cast(sum(line_no) AS bigint) AS numbers, count(DISTINCT line_no) AS distinct_numbers FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id) AS line_no FROM events) GROUP BY user_id")
def sink_numbered_lines(spark, folder):
    """One text file per user, written by many tasks and read back with line numbers."""
    home = scratch(spark, "lines")
    row = V.table(spark, folder, "events").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"), F.col("user_id").alias("part"))
    sinks.text_files(row, home, "part")
    user = F.get_json_object("value", "$.user_id").cast("long").alias("user_id")
    return readers.numbered_json_lines(spark, home).groupBy(user).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("line_no").cast("long").alias("numbers"), F.countDistinct("line_no").alias("distinct_numbers"))


@query("sink_phase_tables", V.sql("findings", "SELECT phase, count(*) AS tasks, max(n) AS last_position FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY file, line, id) AS n FROM findings) GROUP BY phase"))
def sink_phase_tables(spark, folder):
    """Tasks in one folder per phase; a reader of one phase touches that folder alone."""
    home = scratch(spark, "phases")
    sinks.publish(tasks.phase_tasks(V.findings(spark, folder)), home, "phase")
    return sinks.table(spark, home).groupBy("phase").agg(F.count(F.lit(1)).alias("tasks"), F.max("position").alias("last_position"))


@query("published_files", "SELECT concat('part=', s_suppkey, '/') AS folder, sha256(concat(s_name, chr(10), s_acctbal::DOUBLE, chr(10))) AS sha256, cast(length(s_name) + length(concat(s_acctbal::DOUBLE)) + 2 AS int) AS size_bytes, 2::INTEGER AS line_count FROM supplier")
def published_files(spark, folder):
    """The manifest of written text files, one per supplier, read back as bytes."""
    home = scratch(spark, "files")
    text = F.concat("s_name", F.lit("\n"), F.col("s_acctbal").cast("double").cast("string")).alias("value")
    rows = V.table(spark, folder, "supplier").select(text, F.col("s_suppkey").alias("part"))
    sinks.text_files(rows, home, "part")
    made = sinks.published(spark, home)
    return made.select(F.regexp_extract("path", "part=[0-9]+/", 0).alias("folder"), "sha256", "size_bytes", "line_count")


@query("json_documents", "SELECT s_suppkey AS supplier, s_name AS name, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier WHERE s_suppkey % 7 <> 0")
def json_documents(spark, folder):
    """One JSON document per file over several lines; every seventh is broken and left out."""
    home = scratch(spark, "documents")
    key = F.col("s_suppkey")
    row = F.concat(F.lit('{\n "supplier": '), key.cast("string"), F.lit(',\n "name": "'), "s_name", F.lit('",\n "balance": '), F.col("s_acctbal").cast("string"), F.when(key % 7 == 0, "").otherwise("\n}"))
    sinks.text_files(V.table(spark, folder, "supplier").select(row.alias("value")), home)
    return readers.json_object(spark, home, "supplier long, name string, balance double").select("supplier", "name", "balance")


@query("sink_rejects", V.sql("", f"SELECT split_part({REASON}, ':', 1) AS reason, count(*) AS findings FROM raw WHERE kind <> 2 GROUP BY 1", raw=RAW))
def sink_rejects(spark, folder):
    home = scratch(spark, "rejects")
    sinks.split_rejects(tested(spark, folder), f"{home}/valid", f"{home}/rejected")
    good = spark.read.parquet(f"{home}/valid").select(F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(f"{home}/rejected").select(F.substring_index("_reason", ":", 1).alias("reason"))
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("findings"))


@query("sink_history", V.sql("findings parts", "SELECT 'app' AS repo, 2::BIGINT AS entries, (SELECT count(*) FROM findings) AS findings"))
def sink_history(spark, folder):
    """Two readiness results appended to a history, read back as the log they form."""
    home = scratch(spark, "history")
    found = V.findings(spark, folder)
    loc = V.parts(spark, folder).agg((F.sum("loc") * 100).alias("loc"))
    for _ in range(2):
        sinks.append(sinks.history_row(gate.readiness(found, loc), "app"), home)
    return spark.read.parquet(home).groupBy("repo").agg(F.count(F.lit(1)).alias("entries"), F.max("findings").alias("findings"))


# ------------------------------------------------------------------------------------ plans
# One finding per (file, line, rule), the worst and best explained one.
PICKED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule ORDER BY {V.rank_sql('severity')}, length(description) + length(confidence_reason) DESC, severity, category) AS pick FROM hits) WHERE pick = 1"""
SEVERITY_PER_LAYER = f"SELECT layer, {LEVELS}, count(*) AS findings, count(DISTINCT file) AS files FROM picked GROUP BY layer"


@query("document_audit", V.sql("lines", SEVERITY_PER_LAYER, source=PROSE_LINES, hits=_scan_sql(PROSE, "source"), picked=PICKED))
def document_audit(spark, folder):
    """Scan every document, number the findings, and count severities per layer."""
    made = audit.scanned(prose_files(spark, folder), PROSE)
    return audit.per_layer(made)


@query("document_finding_ids", V.sql("lines", f"""SELECT concat(prefix, '-', CASE WHEN n < 1000 THEN lpad(cast(n AS varchar), 3, '0') ELSE cast(n AS varchar) END) AS id, file, line, rule, description FROM (
  SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY phase, file, line, rule, description) AS n FROM (SELECT *, {V.map_sql(M.CATEGORY_PREFIX, 'category')} AS prefix FROM picked))""",
       source=PROSE_LINES, hits=_scan_sql(PROSE, "source"), picked=PICKED))
def document_finding_ids(spark, folder):
    return audit.scanned(prose_files(spark, folder), PROSE).select("id", "file", "line", "rule", "description")


@query("code_audit_summary")
def code_audit_summary(spark, folder):
    """The whole first stage over the source files: (measure, value)."""
    return audit.overview(audit.run(V.code_files(spark, folder)))


@query("code_analysis_summary")
def code_analysis_summary(spark, folder):
    """The second stage: clusters of the audited findings with their blast radius."""
    files = V.code_files(spark, folder)
    return analysis.run(audit.run(files)["findings"], files.drop("repo"), {"@/": "src/"})["clusters"].select("cluster_id", "type", "max_severity", "finding_count", "rules")


@query("raw_text_findings", V.sql("", "SELECT source, count(*) AS lines FROM raw WHERE kind <> 2 GROUP BY 1", raw=RAW))
def raw_text_findings(spark, folder):
    return validate.parsed(raw_lines(spark, folder)).groupBy("source").agg(F.count(F.lit(1)).alias("lines"))
