"""Reference-grid scores: piecewise-linear L, M, S per sex, and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import normal_cdf


def segments(grid: DataFrame, key: str) -> DataFrame:
    """One row per (sex, unit bucket, segment) of the interpolated grid.

    The grid holds a few hundred knots per sex; each segment is repeated for
    the integer buckets it touches, which turns the range lookup into an
    equi-join on (sex, bucket).
    """
    w = Window.partitionBy("Sex").orderBy(key)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    cut = grid.select(
        F.col("Sex").alias("__sex"), F.col(key).cast("double").alias("__lo"), nxt(key).cast("double").alias("__hi"),
        F.lead(key).over(w).isNull().alias("__end"),
        *[F.col(c).cast("double").alias(f"__{c}0") for c in "LMS"],
        *[F.coalesce((nxt(c) - F.col(c)) / F.nullif(nxt(key) - F.col(key), F.lit(0.0)), F.lit(0.0)).alias(f"__{c}d") for c in "LMS"],
    )
    return cut.withColumn(
        "__bucket", F.explode(F.sequence(F.floor("__lo").cast("long"), F.floor("__hi").cast("long")))
    )


def attach_parameters(df: DataFrame, key: Column, sex: Column, grid: DataFrame, grid_key: str,
                      clamp_high: bool = True) -> DataFrame:
    """Join interpolated ``__L, __M, __S``; null off the grid, clamped above it if asked.

    Both lookups are equi-joins with the grid's own size as the only guide for
    broadcasting: one on (sex, bucket), one on sex for keys beyond the last knot.
    """
    cut = segments(grid, grid_key)
    tail = cut.where("__end").groupBy("__sex").agg(
        F.max("__lo").alias("__top"), *[F.max_by(f"__{c}0", "__lo").alias(f"__{c}t") for c in "LMS"]).withColumnRenamed("__sex", "__tsex")
    x = F.when(~F.isnan(key.cast("double")), key.cast("double"))
    keyed = df.withColumn("__s", sex).withColumn("__k", key.cast("double")).withColumn("__x", x).withColumn("__b", F.floor("__x"))
    hit = keyed.join(
        cut, (F.col("__s") == F.col("__sex")) & (F.col("__b") == F.col("__bucket"))
        & (F.col("__x") >= F.col("__lo")) & ((F.col("__x") < F.col("__hi")) | (F.col("__end") & (F.col("__x") == F.col("__lo")))), "left")
    value = lambda c: F.col(f"__{c}0") + F.col(f"__{c}d") * (F.col("__x") - F.col("__lo"))
    if not clamp_high:
        return hit.select(*[F.col(c) for c in df.columns], *[value(c).alias(f"__{c}") for c in "LMS"])
    hit = hit.join(tail, (F.col("__s") == F.col("__tsex")) & (F.col("__k") > F.col("__top")), "left")
    return hit.select(*[F.col(c) for c in df.columns], *[F.coalesce(value(c), F.col(f"__{c}t")).alias(f"__{c}") for c in "LMS"])


def z_from_parameters(v: Column) -> Column:
    l, m, s = F.col("__L"), F.col("__M"), F.col("__S")
    boxcox = (F.pow(v / m, l) - 1) / (l * s)
    z = F.when(F.abs(l) < 1e-6, F.log(v / m) / s).otherwise(boxcox)
    return F.when((m > 0) & (s > 0) & (v > 0), F.round(z, 4))


def lms_zscore(df: DataFrame, value: str, key: str, sex: str, grid: DataFrame, grid_key: str,
               name: str = "z_score", when: Column | None = None) -> DataFrame:
    """Add the reference z-score of ``value`` at ``key``; ``when`` limits the rows scored."""
    with_lms = attach_parameters(df, F.col(key), F.col(sex), grid, grid_key)
    z = z_from_parameters(F.col(value))
    return with_lms.withColumn(name, z if when is None else F.when(when, z)).drop("__L", "__M", "__S")


def lms_value(df: DataFrame, z: str, key: str, sex: str, grid: DataFrame, grid_key: str,
              name: str = "value", clamp: tuple[float, float] | None = None) -> DataFrame:
    """Inverse score: value at a z; keys outside the grid give null."""
    with_lms = attach_parameters(df, F.col(key), F.col(sex), grid, grid_key, clamp_high=False)
    l, m, s = F.col("__L"), F.col("__M"), F.col("__S")
    score = F.col(z) if clamp is None else F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), F.col(z)))
    base = 1 + l * s * score
    out = F.when(F.abs(l) < 1e-6, m * F.exp(s * score)).when(base > 0, m * F.pow(base, 1 / l))
    return with_lms.withColumn(name, F.when(F.col(z).isNotNull(), out)).drop("__L", "__M", "__S")


def percentile_from_z(z: Column) -> Column:
    return F.round(100 * normal_cdf(z), 2)
