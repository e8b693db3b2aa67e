"""From raw documents to a training mix, in five stages that each apply one operator.

    quality          documents that the quality classifier rejects go
    near_duplicates  one document of each class of near-duplicates stays
    decontaminate    documents that hold a window of the benchmark go
    secrets          the reported parts of credentials are replaced by their kind
    mix              documents are sampled by calibrated probabilities

A stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame with
the columns of docs.  ``run`` writes what a stage returns as Parquet and reads it again for the next one, so
that no lineage grows and a lost executor costs tasks of one stage only.

Defined cases: an empty table passes all stages and stays empty; null and empty texts are scored by the
classifier like others, are equal to nothing, clean and without secrets, and are never sampled; rows without
doc_id are never near-duplicates' losers; other columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import bagminhash, decontaminate as leaks, mixing, quality as classifier, secret_links
from lintlake.llm.common import table
from lintlake.session import checkpoint_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_links.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: SQL can express neither the classifier nor the signatures; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents.  What a stage returns lies in the shared folder until the next stage has
    been written; the last stage's files stay, as the result is read from them."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _drop(spark, before)
        before = path
    return docs


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a stage has written, wherever Spark keeps it."""
    context = spark.sparkContext
    gone = context._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(context._jsc.hadoopConfiguration()).delete(gone, True)
