"""Reference grids and code dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_lms(df: DataFrame, key: str) -> DataFrame:
    """Recode sex 1/2 to M/F and keep (Sex, key, L, M, S) as numbers."""
    sex = F.col("Sex").cast("string")
    return df.select(
        F.when(sex == "1", "M").when(sex == "2", "F").otherwise(sex).alias("Sex"),
        *[F.col(c).cast("double").alias(c) for c in (key, "L", "M", "S")],
    ).where(F.col(key).isNotNull())


def code_lookup(df: DataFrame, code: str, description: str) -> DataFrame:
    """One description per dotless code; the smallest text wins, so runs agree."""
    return df.groupBy(F.replace(F.col(code), F.lit("."), F.lit("")).alias("code")).agg(
        F.min(description).alias("description"))


def chronic_codes(df: DataFrame, code: str, flag: str) -> DataFrame:
    """Distinct codes whose flag is set."""
    return df.where(F.col(flag) == 1).select(F.col(code).alias("code")).distinct()
