"""Ordered computations that never put one entity's whole history in a task.

Two building blocks: neighbouring rows of an entity series, and running totals
over a value order.  Both take the plain window when every group is of checked
size, and otherwise split groups into contiguous ranges whose borders are
stitched together from a small edge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, join_on, materialize, split_hot

_CHUNK = "__chunk"


def _range_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition and pin each row's range number in a written table."""
    ranged = df.repartitionByRange(*order).withColumn(_CHUNK, F.spark_partition_id())
    return materialize(ranged, "ranges")


def _offset(col: Column, offset: int, window) -> Column:
    return F.lag(col, -offset).over(window) if offset < 0 else F.lead(col, offset).over(window)


def neighbours(df: DataFrame, keys: list[str], order: list[str], spec: dict[str, tuple[Column, int]],
               bounded: bool = False) -> DataFrame:
    """Add ``name -> value of column at row offset`` within each entity.

    Negative offsets look back.  ``order`` must be total within an entity.
    ``bounded`` skips the size check when the caller already made it.
    """
    ordinary, hot = (df, None) if bounded else split_hot(df, keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    plain = ordinary.select("*", *[_offset(c, o, window).alias(n) for n, (c, o) in spec.items()])
    if hot is None:
        return plain
    return plain.unionByName(_neighbours_split(hot, keys, order, spec))


def _neighbours_split(df: DataFrame, keys: list[str], order: list[str], spec) -> DataFrame:
    reach = max(abs(o) for _, o in spec.values())
    columns = df.columns
    ranged = _range_chunks(df, [*keys, *order])
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    back = Window.partitionBy(*keys, _CHUNK).orderBy(*[F.col(o).desc() for o in order])
    numbered = ranged.select(
        "*",
        F.row_number().over(back).alias("__last"),
        F.row_number().over(local).alias("__first"),
        *[_offset(c, o, local).alias(n) for n, (c, o) in spec.items()],
    )
    is_edge = (F.col("__first") <= reach) | (F.col("__last") <= reach)
    inner = numbered.where(~is_edge).select(*columns, *spec)
    # An edge row's own neighbours lie within `reach` rows on both sides of a
    # border, so the window over edge rows needs twice that many per range.
    wide = numbered.where((F.col("__first") <= 2 * reach) | (F.col("__last") <= 2 * reach))
    across = Window.partitionBy(*keys).orderBy(*order)
    edges = wide.select(
        *columns, is_edge.alias("__edge"),
        *[_offset(c, o, across).alias(n) for n, (c, o) in spec.items()],
    ).where("__edge").select(*columns, *spec)
    return inner.unionByName(edges)


def running_totals(df: DataFrame, by: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """Add ``name -> sum of column over earlier rows`` for rows unique in (by, order).

    Rows should already be aggregated to one per (by, order); the prefix sums
    are then formed per contiguous range, and the range totals are added.
    """
    ranged = _range_chunks(df, [*by, *order])
    sums = ranged.groupBy(*by, _CHUNK).agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
    # Rows of this table: groups + number of ranges, so few per group.
    before = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, _CHUNK, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals]
    )
    local = Window.partitionBy(*by, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(n) for n, c in totals.items()])
    joined = join_on(inner, broadcast_if_small(offsets), [*by, _CHUNK])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in totals])
