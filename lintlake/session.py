"""Session settings and the folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of frames that are gone go too.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Building wide expressions is several times faster without call-site capture.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "lintlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="lintlake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the checkpoint folder and forget how it was computed."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a table of compressed columns: texts that repeat take a fraction of a checkpoint's bytes, and
    who reads some of the columns reads no others.  It stays as long as the folder."""
    return Tables(frame.sparkSession).put("stored", frame)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are gone.

    It learns of them when the driver collects its garbage, which a driver with memory to spare does
    too seldom for a job of many steps on small disks."""
    spark.sparkContext._jvm.System.gc()


class Tables:
    """The tables of a loop in the shared folder, by name.

    A table that is put again replaces the one before, whose files go: no round reads what the round before it has
    rewritten.  Unlike a checkpoint, a table that is read again has its true size for the planner, however many joins it
    went through.  The last tables stay, as results are read from them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.at: dict[str, int] = {}

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        number = self.at.get(name, 0)
        frame.write.parquet(f"{self.folder}/{name}-{number + 1}")
        if number:
            remove(self.spark, f"{self.folder}/{name}-{number}")
        self.at[name] = number + 1
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}-{number + 1}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    context = spark.sparkContext
    gone = context._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(context._jsc.hadoopConfiguration()).delete(gone, True)
