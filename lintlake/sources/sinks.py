"""Sinks.

A published table is a folder of versions and a log of pointers.  A write fills a new version folder; only when all of it is
there a pointer row is added, as one file.  Readers follow the last pointer, so they see a whole version, old or new, and
a write that fails leaves the old one.  The other writers here replace or extend a folder in place: a reader that comes
while they write can find it empty or in part."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lintlake.operators import validate
from lintlake.session import remove

POINTER = "version long, folder string, rows long, at timestamp"


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """The versions of a published table: (version, folder, rows, at); empty before the first."""
    log = f"{path}/pointers"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in POINTER.split(", "))])
    return spark.read.schema(POINTER).json(log)


def _current(spark: SparkSession, path: str):
    return pointers(spark, path).agg(F.max(F.struct("version", "folder", "rows")).alias("p")).first()["p"]


def publish(frame: DataFrame, path: str, partition: str | None = None, no_loss: bool = False) -> int | None:
    """Writes a table as the next version and returns its number; one writer at a time.

    The rows are counted by the write itself.  With ``no_loss`` a version with fewer rows than the current one is not
    pointed at but removed, and None is returned."""
    spark = frame.sparkSession
    before = _current(spark, path)
    version = before["version"] + 1 if before else 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = frame.observe(seen, F.count(F.lit(1)).alias("rows")).write
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/versions/{folder}")
    rows = seen.get["rows"]
    if no_loss and before and rows < before["rows"]:
        remove(spark, f"{path}/versions/{folder}")
        return None
    pointer = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("at"))
    pointer.coalesce(1).write.mode("append").json(f"{path}/pointers")
    return version


def table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of a published table, or an earlier one."""
    found = pointers(spark, path).where(F.col("version") == version).first() if version else _current(spark, path)
    if not found:
        raise LookupError(f"nothing published at {path}")
    return spark.read.parquet(f"{path}/versions/{found['folder']}")


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the last versions' files and returns how many went; their pointers stay as a log."""
    old = pointers(spark, path).orderBy(F.desc("version")).offset(keep).collect()  # a row per version
    for row in old:
        remove(spark, f"{path}/versions/{row['folder']}")
    return len(old)


def processed(raw: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> dict[str, int]:
    """Publishes what is left of ``raw`` after the steps, and tells the rows after each, by name, and of ``raw``: all
    counted in the one pass that writes."""
    seen = {"raw": Observation()}
    frame = raw.observe(seen["raw"], F.count(F.lit(1)).alias("rows"))
    for name, step in steps.items():
        seen[name] = Observation()
        frame = step(frame).observe(seen[name], F.count(F.lit(1)).alias("rows"))
    publish(frame, path)
    return {name: found.get["rows"] for name, found in seen.items()}


def replace(frame: DataFrame, path: str, partition: str | None = None) -> None:
    """Overwrite a folder in place, one folder per value of ``partition`` when given."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append(frame: DataFrame, path: str) -> None:
    """Add rows to a log."""
    frame.write.mode("append").parquet(path)


def history_row(scored: DataFrame, repo: str, critical: int | None = None, coverage: float | None = None) -> DataFrame:
    """A readiness result as a row for the history log."""
    return scored.select(F.lit(repo).alias("repo"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
                         F.round("readiness_score", 2).alias("score"), F.col("findings").cast("long").alias("findings"),
                         F.lit(critical).cast("long").alias("critical"), F.round(F.lit(coverage).cast("double"), 2).alias("coverage"))


def split_rejects(tested: DataFrame, valid_path: str, rejected_path: str) -> None:
    """Valid findings to one table, rejects with their reason to another."""
    valid, rejected = validate.split(tested)
    replace(validate.normalised(valid), valid_path)
    replace(rejected, rejected_path)


def json_lines(frame: DataFrame, path: str, partition: str | None = None) -> None:
    """The same rows as JSON lines, for tools that read those."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def text_files(frame: DataFrame, path: str, part: str | None = None) -> None:
    """The column ``value`` as many small text files: one per row, or one per value of ``part`` in a folder named by it.

    What costs here is the file, not its bytes.  So rows are dealt to as many tasks as a shuffle has partitions, where adaptive
    execution would join them to a few by their size.  A folder is moved in place as one when the job ends.  Files without
    folders are moved by the task that wrote them, as the driver would move one after another; a task that runs again writes
    the same names, and a write that fails can leave some of its files."""
    spark = frame.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if part:
        frame.select("value", part).repartition(tasks, part).write.partitionBy(part).text(path)
    else:
        once = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
        frame.select("value").repartition(tasks).write.options(**once).text(path)


def manifest(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, sha256, size_bytes, line_count): what was published."""
    content = F.col("content")
    text = content.cast("string")
    size = F.octet_length(content)
    return files.select("path", F.sha2(content, 256).alias("sha256"), size.alias("size_bytes"),
                        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("line_count"))


def published(spark, root: str) -> DataFrame:
    """The manifest of every file under a root, hashed where it is read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return manifest(read.select("path", "content"))


def complete(made: DataFrame, declared: DataFrame) -> DataFrame:
    """declared(path, lines) against a manifest: (path, lines, line_count, complete)."""
    return declared.join(made, "path", "left").select("path", "lines", "line_count", F.coalesce(F.col("lines") == F.col("line_count"), F.lit(False)).alias("complete"))
