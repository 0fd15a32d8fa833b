"""Exact quantiles, rank AUC, intervals and the normal distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals
from .storage import join_on


def ratio(part: Column, whole: Column) -> Column:
    """Share that is null, not an error, for an empty denominator."""
    return F.when(whole != 0, part / whole)


def exact_quantiles(df: DataFrame, by: list[str], values: dict[str, Column], probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, one row per (by, metric).

    Equal values are first folded into counts; ranks then come from running
    totals over ranges, so a group of any size is spread over many tasks.
    """
    tall = df.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in values.items()
        ])).alias("__m"),
    ).select(*by, "__m.metric", "__m.value").where("value is not null")
    keys = [*by, "metric"]
    counted = tall.groupBy(*keys, "value").agg(F.count("*").alias("__n"))
    ranked = running_totals(counted, keys, ["value"], {"__before": "__n"})
    sizes = ranked.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    both = join_on(ranked, sizes, keys)
    out = []
    for name, p in probs.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        covers = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
        lo = F.max(F.when(covers(low), F.col("value")))
        hi = F.max(F.when(covers(high), F.col("value")))
        out.append((lo + (hi - lo) * F.max(position - low)).alias(name))
    return both.groupBy(*keys).agg(F.max("__total").alias("n"), *out)


def rank_auc(df: DataFrame, by: list[str], label: str, score: str = "value", weight: str | None = None) -> DataFrame:
    """Mid-rank AUC per group from counts per distinct score, plus separation; ``weight`` is how many rows a row stands for."""
    n = F.lit(1) if weight is None else F.col(weight)
    counts = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, score)
        .agg(F.sum(F.col(label).cast("long") * n).alias("__pos"), F.sum(n.cast("long")).alias("__all"))
    )
    ranked = running_totals(counts, by, [score], {"__before": "__all"})
    midrank = F.col("__before") + (F.col("__all") + 1) / 2.0
    sums = ranked.groupBy(*by).agg(
        F.sum(midrank * F.col("__pos")).alias("__ranksum"),
        F.sum("__pos").alias("n_pos"),
        (F.sum("__all") - F.sum("__pos")).alias("n_neg"),
    )
    n1, n0 = F.col("n_pos"), F.col("n_neg")
    auc = F.when((n1 > 0) & (n0 > 0), (F.col("__ranksum") - n1 * (n1 + 1) / 2.0) / (n1 * n0))
    return sums.select(*by, "n_pos", "n_neg", auc.alias("auc"), F.abs(2 * auc - 1).alias("separation"))


def wilson_interval(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson bounds, six decimals; null for an empty sample."""
    z = 1.959963984540054
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = (z / denom) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lower = F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - half), 6))
    upper = F.when(n > 0, F.round(F.least(F.lit(1.0), centre + half), 6))
    return lower, upper


def suppress(n: Column, below: int = 10) -> Column:
    """Hide counts 1..below-1; zero is shown."""
    return F.when(~n.between(1, below - 1), n)


def stabilize(c: Column, digits: int = 8) -> Column:
    """Keep ``digits`` significant digits, so that summation order does not show; null stays null."""
    x = c.cast("double")
    # A null is formatted as the word null, which is no number.
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x)).cast("double")


# Rational approximation of the normal tail (Hart's algorithm 5666), highest power first.
TAIL_P = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_Q = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _poly(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function from Column arithmetic (|error| < 1e-12)."""
    x = F.abs(z)
    tail = F.when(x < 7.07, F.exp(-x * x / 2) * _poly(TAIL_P, x) / _poly(TAIL_Q, x)).otherwise(F.lit(0.0))
    return 0.5 + F.signum(z) * (0.5 - tail)
