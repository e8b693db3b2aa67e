"""Ordered numbering without ever holding one group in one task.

A window ``row_number() OVER (PARTITION BY g ORDER BY k)`` sends a whole group to one
task, which fails when a group holds a third of the data.  Here the rows are
range-partitioned by (group, key) into slices of even size, sorted and written to the
checkpoint folder together with their slice number and position.  What then has to be
known about a group is one row per (group, slice), and a row's number is its position
plus what came before its slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.session import stored

_POSITION_BITS = 33  # monotonically_increasing_id(): partition in the high bits


def slices(frame: DataFrame, group: list[Column], order: list[Column]) -> DataFrame:
    """The frame sorted by (group, order), with ``_group``, ``_slice`` and ``_pos``.

    The order must be total within a group; rows that are equal in all keys may come in
    either order."""
    grouped = frame.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0).alias("all")))
    keys = [F.col("_group"), *order]
    placed = (grouped.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    return (stored(placed)
            .withColumn("_slice", F.shiftright("_at", _POSITION_BITS))
            .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
            .drop("_at"))


def numbered(frame: DataFrame, group: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based position of each row within its group."""
    placed = slices(frame, group, order)
    blocks = placed.groupBy("_group", "_slice").agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # Without a group there is one block per slice, and rows need not move to meet theirs.
    return (placed.join(blocks if group else F.broadcast(blocks), ["_group", "_slice"])
            .withColumn(name, F.col("_before") + F.col("_pos") - F.col("_from") + 1)
            .drop("_group", "_slice", "_pos", "_from", "_before"))


def with_previous(frame: DataFrame, group: list[Column], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the value of the row before, within the group; null for a group's first row."""
    placed = slices(frame, group, order).withColumn("_value", value)
    inside = Window.partitionBy("_slice").orderBy("_pos")
    placed = (placed.withColumn("_old_group", F.lag("_group").over(inside))
              .withColumn("_old", F.lag("_value").over(inside)))
    # The first row of a slice follows the last row of the nearest slice before it.
    ends = placed.groupBy("_slice").agg(F.max_by(F.struct("_group", "_value"), "_pos").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.orderBy("_slice")))
    joined = placed.join(ends, "_slice")
    first = F.col("_pos") == 0
    old_group = F.when(first, F.col("_end._group")).otherwise(F.col("_old_group"))
    old_value = F.when(first, F.col("_end._value")).otherwise(F.col("_old"))
    return (joined.withColumn(name, F.when(old_group == F.col("_group"), old_value))
            .drop("_group", "_slice", "_pos", "_value", "_old_group", "_old", "_end"))
