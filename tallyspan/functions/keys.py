"""Texts that stand for several cells at once, and joins on keys that a few values hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_if_small, hot_rows, materialize


def canonical(*cells: Column | str) -> Column:
    """One text for a list of cells, and different lists give different texts: each cell carries its length, and null has a form no text can take."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]
    return F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts])


def join_split(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner equi-join on ``key``; ``right`` has one row per key, ``left`` may have very many.

    Keys above ``tallyspan.hotRows`` rows on the left are dealt over as many parts as keep each
    part at that size, and their one row on the right is replicated to the parts.  At most
    ``rows / hotRows`` keys can be that large, so their list is short.
    """
    limit = hot_rows(left.sparkSession)
    sizes = left.groupBy(key).count().where(F.col("count") > limit)
    large = materialize(sizes.select(F.col(key).alias("__large"), F.ceil(F.col("count") / limit).cast("int").alias("__parts")), "hot-keys")
    if large.isEmpty():
        return left.join(right, key)
    large, parts = broadcast_if_small(large), F.coalesce("__parts", F.lit(1))
    dealt = left.join(large, F.col(key) == F.col("__large"), "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts).cast("int"))
    copies = right.join(large, F.col(key) == F.col("__large"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__large", "__parts").join(copies.drop("__large", "__parts"), [key, "__part"]).drop("__part")
