"""Scanner output as it arrives, and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lintlake.operators import validate
from lintlake.session import Tables, released, remove


def _drain(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    """Process everything that is there now, batch by batch, and stop."""
    query = (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def intake(spark: SparkSession, source: str, valid: str, rejected: str, checkpoint: str, files: DataFrame | None = None,
           files_per_batch: int = 1000) -> StreamingQuery:
    """Validate each new JSONL file once: good findings to one table, rejects with their reason to another.

    The checkpoint remembers which files are done.  A batch writes its own folder and replaces it when
    it has to run again, so nothing is counted twice.  Its texts are parsed once, into a table that goes when both folders
    are written; so do the files of its shuffles."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
             .select(F.col("_metadata.file_name").alias("source"), "value"))

    def write(batch: DataFrame, number: int) -> None:
        tables = Tables(spark)
        try:
            found = tables.put("found", validate.parsed(batch))
            phantoms = None if files is None else tables.put("phantoms", validate.unlisted(found, files))
            kept, refused = validate.split(validate.checked(found, phantoms=phantoms))
            validate.normalised(kept).write.mode("overwrite").parquet(f"{valid}/batch={number}")
            refused.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            remove(spark, tables.folder)
            released(spark)

    return _drain(lines, write, checkpoint, "append")


def severity_totals(findings: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running counts per severity over a stream of findings; ``out`` always holds the latest totals.

    The state is one row per severity."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    return _drain(counts, lambda batch, number: batch.write.mode("overwrite").parquet(out), checkpoint, "complete")


def usage_windows(ledger: DataFrame, out: str, checkpoint: str, width: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Units per repo and time window over a stream(repo, ts, tokens).

    Each batch writes what it adds to every window it touches, and :func:`latest_windows` sums that up, so a row counts
    however late it comes and however the rows are dealt into batches.  A batch that has to run again replaces its own
    folder.  Rows whose window had been closed for ``late`` when their batch began (by the newest time of the batches
    before) are counted on their own as well.  No state is kept but that table; :func:`compact_windows` keeps it short."""
    spark = ledger.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        newest = None
        if number:
            newest = spark.read.schema("newest timestamp, batch int").parquet(out).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        closed = F.col("w.end") + F.expr(f"INTERVAL {late}") <= F.lit(newest) if newest is not None else F.lit(False)
        added = (batch.withColumn("w", F.window("ts", width)).withColumn("closed", F.coalesce(closed, F.lit(False)))
                 .groupBy(F.col("w.start").alias("window_start"), "repo")
                 .agg(F.sum("tokens").cast("long").alias("used"), F.count(F.lit(1)).alias("runs"), F.count_if("closed").alias("late_runs"), F.max("ts").alias("newest")))
        added.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _drain(ledger, write, checkpoint, "append")


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """The total of every window and repo: (window_start, repo, used, runs, late_runs)."""
    return spark.read.parquet(out).groupBy("window_start", "repo").agg(*[F.sum(c).alias(c) for c in ("used", "runs", "late_runs")])


def compact_windows(spark: SparkSession, out: str, into: str) -> None:
    """The same totals as one batch in a new folder, to go on from when the stream stands still."""
    whole = spark.read.parquet(out)
    last = whole.agg(F.max("batch")).first()[0]
    (whole.groupBy("window_start", "repo").agg(*[F.sum(c).alias(c) for c in ("used", "runs", "late_runs")], F.max("newest").alias("newest"))
     .write.mode("overwrite").parquet(f"{into}/batch={last}"))


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream over one table in a folder of tables, be it one file or a folder of part files.

    A stream takes a single file only by a pattern, so the last letter is one."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
