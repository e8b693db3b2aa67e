"""What a join need not shuffle: a filter by hashed keys whose size does not depend on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARKS = 1 << 22  # places for hashed keys: 128 bitmaps of 4 KB


def only_marked(large: DataFrame, key: str, wanted: DataFrame, other: str, marks: int = MARKS) -> DataFrame:
    """Rows of ``large`` whose key occurs among ``wanted``'s, and some others that share a hash with one.

    The hashes are marked in bitmaps, ``marks`` bits in all, which are broadcast.  Very many keys fill them; then more rows
    pass, and the join that follows, which decides, is none the worse for it.  Rows with a null key go."""
    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(marks))

    bits = (wanted.select(place(other).alias("_id")).select(F.expr("bitmap_bucket_number(_id)").alias("_bucket"), F.expr("bitmap_bit_position(_id)").alias("_bit"))
            .groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits")))
    placed = large.where(F.col(key).isNotNull()).withColumn("_id", place(key)).withColumn("_bucket", F.expr("bitmap_bucket_number(_id)")).withColumn("_bit", F.expr("bitmap_bit_position(_id)"))
    is_set = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) div cast(power(2, _bit % 8) as int) % 2 = 1")
    return placed.join(F.broadcast(bits), "_bucket").where(is_set).drop("_id", "_bucket", "_bit", "_bits")
