"""Readers: source trees, findings files, reports, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from lintlake import schema
from lintlake.catalog import layers as L
from lintlake.functions import paths
from lintlake.session import stored


def _relative(root: str) -> Column:
    """Path of the file a row came from, below the root."""
    full = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
    return F.regexp_replace(full, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")


def source_tree(spark: SparkSession, root: str, stack: str, repo: str = "") -> DataFrame:
    """files(repo, path, stack, content) under a root: one row per file of the stack's extensions."""
    glob = "*{" + ",".join(L.STACK_EXTENSIONS.get(stack, L.STACK_EXTENSIONS["unknown"])) + "}"
    read = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True))
    files = read.select(F.lit(repo).alias("repo"), _relative(root).alias("path"), F.lit(stack).alias("stack"), F.col("value").alias("content"))
    return files.where(~paths.under_any_dir(F.col("path"), L.PRUNED_DIRS))


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """files(path, content) under a root, whatever they are."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return read.select(_relative(root).alias("path"), F.col("value").alias("content"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw(source, value): the non-blank lines of JSONL files with the file's name.  Large files are split."""
    return (spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), "value").where(F.trim("value") != ""))


def numbered_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw(source, line_no, value), blank lines counted.  A file's lines keep their order across its splits.

    Lines are numbered where they are read.  A file too small to be split is one block.  The lines of others are stored with their
    place in their block, and blocks, of which there is one per some megabytes, learn what comes before them."""
    read = spark.read.text(path)
    size_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    whole = F.col("_metadata.file_size") <= min(size_of(spark.conf.get(f"spark.sql.files.{k}")) for k in ("openCostInBytes", "maxPartitionBytes"))

    def positions(batches):
        """Adds ``at``, the 1-based place of a line in its block: a task reads a block's lines one after another."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last, seen = None, 0  # the block that the lines before were of, and how many they were
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.select(["_file", "_block"])
            new = np.zeros(batch.num_rows, dtype=bool)
            for column in block.columns:
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[0] = block.slice(0, 1).to_pylist() != last
            at = np.arange(batch.num_rows)
            starts = np.flatnonzero(new)
            first = np.repeat(np.concatenate([[-seen], starts]), np.diff(np.concatenate([[0], starts, [batch.num_rows]])))
            at = at - first + 1
            last, seen = block.slice(batch.num_rows - 1, 1).to_pylist(), int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])

    def placed(which):
        rows = read.where(which).select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")
        return rows.mapInArrow(positions, "source string, _file string, _block long, value string, at long")

    split = stored(placed(~whole))
    blocks = split.groupBy("_file", "_block").agg(F.max("at").alias("n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    later = split.join(blocks, ["_file", "_block"]).withColumn("at", F.col("at") + F.col("_before"))
    return placed(whole).select("source", F.col("at").alias("line_no"), "value").unionByName(later.select("source", F.col("at").alias("line_no"), "value"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSONL files with their source; lines that are no JSON object are left out."""
    typed = StructType([*schema.RAW_FINDING.fields]).add("_corrupt_record", "string")
    read = spark.read.schema(typed).option("mode", "PERMISSIVE").json(path)
    return (read.select("*", F.col("_metadata.file_name").alias("source")).where(F.col("_corrupt_record").isNull())
            .drop("_corrupt_record").withColumn("line", F.col("line").try_cast("int")).withColumn("phase", F.col("phase").try_cast("int")))


def json_object(spark: SparkSession, path: str, fields: StructType | str) -> DataFrame:
    """One JSON document per file; no row for a malformed one."""
    typed = fields if isinstance(fields, StructType) else StructType.fromDDL(fields)
    read = spark.read.schema(StructType([*typed.fields]).add("_corrupt_record", "string")).option("multiLine", "true").json(path)
    # A malformed document has its text in _corrupt_record; caching is not needed as other columns are read too.
    return read.select("*", F.col("_metadata.file_name").alias("source")).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def history(spark: SparkSession, path: str) -> DataFrame:
    """A score log that may hold broken lines: those, and lines without a score, are left out."""
    typed = StructType([*schema.HISTORY.fields]).add("_corrupt_record", "string")
    read = spark.read.schema(typed).option("mode", "PERMISSIVE").json(path)
    return (read.where(F.col("_corrupt_record").isNull() & F.col("score").isNotNull()).drop("_corrupt_record")
            .withColumn("ts", F.col("timestamp").try_cast("timestamp")))


def usable_history(raw: DataFrame) -> DataFrame:
    """The same for lines(value) that are already read: (repo, ts, score, ...)."""
    row = F.from_json("value", schema.HISTORY)
    return (raw.where(F.try_parse_json("value").isNotNull()).select(row.alias("r")).select("r.*")
            .where(F.col("score").isNotNull()).withColumn("ts", F.col("timestamp").try_cast("timestamp")))
