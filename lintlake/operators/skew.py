"""Joins that find their hot keys themselves and split them, whatever the session's settings.

A counted pre-pass names the keys that hold more than one row in ``HOT`` of the large side; there are fewer than
``HOT`` of them, so their table can be broadcast.  Rows of a hot key are dealt to ``SALTS`` parts by a
hash of the whole row, and the few rows of the other side with that key are copied to each part.  Rows with a
null in the key match nothing; they are dealt out too, so a left join does not gather them in one task.  Rows
that are equal in all columns stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.session import cut

HOT = 64
SALTS = 128
POPULAR = 4096


def hot_keys(large: DataFrame, keys: list[str], hot: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """The keys with more than one in ``hot`` of the rows: fewer than ``hot`` rows."""
    if counts is None:
        counts = cut(large.where(~_any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n").alias("_all"))
    return cut(counts.join(F.broadcast(total)).where(F.col("_n") * hot > F.col("_all")).select(*keys))


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, hot: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """``large`` joined (inner, left, left_semi or left_anti) with ``small``, which has few rows per key.

    ``counts`` are the keys with their numbers of rows (``_n``), where they are known already.  Otherwise ``large`` is
    read twice: hand in a table, or something as cheap to make again."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no such join here: {how}")
    flags = F.broadcast(hot_keys(large, keys, hot, counts).withColumn("_hot", F.lit(True)))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(salts)).cast("int")
    dealt = (large.join(flags, keys, "left")
             .withColumn("_salt", F.when(F.col("_hot") | _any_null(keys), part).otherwise(0)).drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = small.join(flags, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def beside_popular(large: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, popular: int = POPULAR) -> DataFrame:
    """``large`` joined (left) with ``small``, which has few rows per key, where most rows have one of a few thousand keys.

    The keys with more than one row in ``popular`` are fewer than that, so what ``small`` has for them is broadcast and
    their rows stay where they are, as do those with a null in the key.  Only the others are shuffled.  ``counts`` are
    keys with their numbers of rows (``_n``); ``large`` is read twice."""
    flags = hot_keys(large, keys, popular, counts)
    near = cut(flags.join(small, keys, "left").withColumn("_hot", F.lit(True)))
    here = large.join(F.broadcast(near), keys, "left")
    stays = F.col("_hot").isNotNull() | _any_null(keys)
    # Two plain filters: columns of ``small`` are null in the rows that are joined again.
    done = here.where(stays).drop("_hot")
    rest = large.join(F.broadcast(near.select(*keys).distinct()), keys, "left_anti").where(~_any_null(keys)).join(small, keys, "left")
    return done.unionByName(rest)
