"""Half-open bands and ordered case chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_label(value: Column, bands: list[tuple[str, float | None, float | None]]) -> Column:
    """Label of the first ``[lo, hi)`` band that holds the value, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, lo, hi in bands:
        test = value.isNotNull()
        test = test if lo is None else test & (value >= lo)
        test = test if hi is None else test & (value < hi)
        out = out.when(test, F.lit(label))
    return out


def closed_bands(bands: list[tuple[str, int, int | None]]) -> list[tuple[str, int, int | None]]:
    """Whole-number bands with both ends included, as half-open ones; an end of None stays open."""
    return [(label, lo, None if hi is None else hi + 1) for label, lo, hi in bands]


def with_bands(df: DataFrame, value: str, bands, name: str = "band") -> DataFrame:
    """Add the band and drop rows outside every band."""
    return df.withColumn(name, band_label(F.col(value), bands)).where(F.col(name).isNotNull())


def all_bands(value: Column, bands) -> Column:
    """Array of every band that holds the value; bands may overlap."""
    labels = F.array(*[
        F.when(value.isNotNull() & (value >= lo) & (value < hi), F.lit(label)) for label, lo, hi in bands
    ])
    return F.array_compact(labels)


def step_value(value: Column, steps: list[tuple[float, float]], default: float, inclusive: bool = True) -> Column:
    """Piecewise-constant lookup: first bound the value does not exceed."""
    out = F.when(F.lit(False), F.lit(None))
    for bound, result in steps:
        out = out.when(value <= bound if inclusive else value < bound, F.lit(result))
    return out.otherwise(F.lit(default))
