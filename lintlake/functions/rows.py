"""Frames of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def beside(frame: DataFrame, single: DataFrame) -> DataFrame:
    """The frame with the columns of a one-row frame, as a scalar subquery; null when it has no row."""
    packed = single.select(F.struct("*").alias("s")).scalar()
    return frame.withColumn("_single", packed).select("*", "_single.*").drop("_single")
