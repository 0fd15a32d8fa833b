"""Iterative peak removal on entity series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import step_value
from ..functions.ordering import neighbours
from ..functions.storage import fresh_path, join_on, materialize, split_hot

# Largest plausible slope (kg per year) below each age in years.
WEIGHT_THRESHOLDS = ([(3, 3.0), (4, 3.3), (5, 3.7), (6, 4.0), (7, 4.4), (8, 5.2), (9, 6.0), (10, 6.8), (11, 7.3),
                      (12, 7.2), (13, 6.5), (14, 5.3), (15, 4.0), (16, 2.7), (17, 1.8)], 1.3)
TINY_AGE = 0.001


def outlier_preclean(df: DataFrame, keys: list[str], age: str, value: str, tie: str) -> DataFrame:
    """Flag all copies of a repeated (series, age, value) and rows with a zero slope.

    ``keys`` name a series: the entity, or entity and channel.  Both tests work
    on folded rows: copies on (series, age, value) groups, the slope on the
    first and last value of each age, because within one age the slope is
    undefined.  Group sizes are bounded by the age axis.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(age).isNotNull()).select(*keys, age, tie, value)
    copies = rows.groupBy(*keys, age, value).agg(F.count("*").alias("__c")).where("__c > 1").drop("__c")
    days = rows.groupBy(*keys, age).agg(
        F.min(F.struct(F.col(tie).alias("t"), F.col(value).alias("v"))).alias("first"),
        F.max(F.struct(F.col(tie).alias("t"), F.col(value).alias("v"))).alias("final"))
    before = F.lag("final").over(Window.partitionBy(*keys).orderBy(age))
    flat = days.select(*keys, F.col("first.t").alias(tie), (F.col("first.v") == before["v"]).alias("__flat")).where("__flat")
    out = join_on(rows, copies.withColumn("__copy", F.lit(True)), [*keys, age, value], "left")
    out = join_on(out, flat, [*keys, tie], "left")
    return out.select(*keys, age, tie, value, F.coalesce("__copy", "__flat", F.lit(False)).alias("flagged"))


def _slope(later: Column, earlier: Column) -> Column:
    run = later["a"] - earlier["a"]
    return (later["v"] - earlier["v"]) / F.when(run == 0, F.lit(TINY_AGE)).otherwise(run)


def find_peaks(df: DataFrame, keys: list[str], age: str, value: str, tie: str, limit: Column | None = None,
               bounded: bool = False) -> DataFrame:
    """Add ``peak``: the row is a cap or a cup of its series.

    One ordered pass fetches the rows from three before to two after; every
    slope, sign sum and magnitude of the test is arithmetic on those six rows.
    ``limit`` is the slope a peak must exceed; where null, none applies.
    """
    point = F.struct(F.col(age).cast("double").alias("a"), F.col(value).cast("double").alias("v"))
    offsets = {f"__m{i}": (point, -i) for i in (1, 2, 3)} | {f"__p{i}": (point, i) for i in (1, 2)}
    near = neighbours(df, keys, [age, tie], offsets, bounded).withColumn("__p0", point)
    at = lambda i: F.col(f"__m{-i}") if i < 0 else F.col(f"__p{i}")
    true = lambda c: F.coalesce(c, F.lit(False))
    # Stages keep each quantity a column of its own, so expressions stay small.
    near = near.withColumns({f"__s{i + 2}": _slope(at(i), at(i - 1)) for i in (-2, -1, 0, 1, 2)} | {
        f"__c{i + 1}": _slope(at(i + 2), at(i)) for i in (-1, 0)} | {f"__u{i}": _slope(at(i), at(i - 2)) for i in (0, 1)})
    slope = lambda i: F.col(f"__s{i + 2}")
    # Slope sign plus the previous one's; null on a series' first row.
    near = near.withColumns({
        f"__t{i + 1}": F.signum(slope(i)) + F.coalesce(F.signum(slope(i - 1)), F.lit(0.0)) for i in (-1, 0, 1)} | {
        f"__cap{i + 1}": F.col(f"__c{i + 1}") - slope(i) for i in (-1, 0)} | {f"__cup{i}": F.col(f"__u{i}") - slope(i + 1) for i in (0, 1)})
    sums = lambda i: F.col(f"__t{i + 1}")
    start = sums(0).isNull() & true(sums(1) == 0)
    near = near.withColumns({"__cap": true((F.abs(sums(0)) == 2) & (sums(1) == 0)) | start, "__cup": true((sums(0) == 0) & (F.abs(sums(-1)) == 2)) | start})
    cap, cup = F.col("__cap"), F.col("__cup")
    peak = (cap & cup) | (cap & true(F.col("__cap1") <= F.col("__cup1"))) | (cup & true(F.col("__cup0") <= F.col("__cap0")))
    if limit is not None:
        peak = peak & (limit.isNull() | true(F.abs(slope(0)) > limit))
    return near.select(*df.columns, peak.alias("peak"))


def slope_limit(age: str, thresholds) -> Column:
    """Age-banded slope limit from (steps below each age, default)."""
    return step_value(F.col(age), thresholds[0], thresholds[1], inclusive=False)


# Peeling rounds in one plan; they share one shuffle and one written table.
ROUNDS = 4
# A removal changes the test of rows at most this many places away, and a test looks no further.
REACH = 3


def _peel(df: DataFrame, keys: list[str], age: str, value: str, tie: str, limit: Column | None, bounded: bool, number: int) -> DataFrame:
    """One round: the peaks among the dirty rows still alive get the round's number.

    Removed rows stay in the frame under a series of their own, so the rows keep
    the partitioning by ``keys`` and no round shuffles again.
    """
    gone = F.col("round").isNotNull()
    marked = find_peaks(df.withColumn("__gone", gone), [*keys, "__gone"], age, value, tie, limit, bounded)
    # Each round carries a change REACH places further.
    hit = F.col("peak") & ~F.col("__gone") & (F.col("far") <= REACH * number)
    return marked.withColumn("round", F.when(hit, F.lit(number)).otherwise(F.col("round"))).drop("peak", "__gone")


def _worklist(df: DataFrame, keys: list[str], age: str, tie: str, rounds: int) -> DataFrame:
    """Set ``far``: how many living rows lie between a living row and the nearest one removed in the last round; null where no later round of the next plan can look.

    Places are counted among the living rows, so a row that only now comes near a removal is near it.
    """
    last, alive = F.col("round") == rounds, F.col("round").isNull()
    order = [age, tie]
    away = df
    for name, by in (("__b", [F.asc(c) for c in order]), ("__f", [F.desc(c) for c in order])):
        seen = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        away = away.withColumn("__n", F.count_if(alive).over(seen)).withColumn(name, F.col("__n") - F.max(F.when(last, F.col("__n"))).over(seen))
    far = F.least("__b", "__f")
    return away.withColumn("far", F.when(alive & (far <= REACH * (ROUNDS + 1)), far)).drop("__n", "__b", "__f")


def outlier_fixpoint(df: DataFrame, keys: list[str], age: str, value: str, tie: str, limit: Column | None = None,
                     bounded: bool = False) -> DataFrame:
    """Rows removed by the pre-clean (round 0) and by each peeling round.

    The first round tests every row.  Later ones work off a list: only rows within reach of a removal can have a
    new result, so the next plan reads those and the few places around them that their test looks at, and writes
    the removed rows and the next list.  A list shrinks with the removals, long series included; it ends
    because each plan removes a row or ends it.  Where series are split over tasks the list holds whole
    series.  Every list is a written table: the loop keeps no lineage and survives lost executors.
    """
    spark, columns = df.sparkSession, [*keys, age, tie, value]
    # The pre-clean reads the narrow series three times, so it is written once.
    rows = materialize(df.where(F.col(value).isNotNull() & F.col(age).isNotNull()).select(*columns), "series")
    cleaned = materialize(outlier_preclean(rows, keys, age, value, tie), "preclean")
    active = cleaned.where(~F.col("flagged")).select(*columns, F.lit(0).cast("long").alias("far"))
    bounded = bounded or split_hot(active, keys)[1] is None
    root, done = fresh_path(spark, "peeling"), []
    while True:
        state, rounds = active.withColumn("round", F.lit(None).cast("int")), ROUNDS if bounded and done else 1
        for number in range(1, rounds + 1):
            state = _peel(state, keys, age, value, tie, limit, bounded, number)
        if bounded:
            state = _worklist(state, keys, age, tie, rounds)
        else:
            hit = state.where(F.col("round") == rounds).select(*keys).distinct().withColumn("__hit", F.lit(0).cast("long"))
            state = join_on(state, hit, keys, "left").withColumn("far", F.when(F.col("round").isNull(), F.col("__hit")))
        state = state.select(*columns, "far", "round").where("far IS NOT NULL OR round IS NOT NULL")
        path = f"{root}/{len(done)}"
        state.write.parquet(path)
        stored = spark.read.schema(state.schema).parquet(path)
        # Rounds are numbered within a plan, so later plans are the same and their compiled code is found again.
        done.append((stored, rounds))
        active = stored.where("far IS NOT NULL").select(*columns, "far")
        if active.isEmpty():
            break
    before, parts = 0, [cleaned.where("flagged").select(*keys, age, tie, F.lit(0).alias("round"))]
    for stored, rounds in done:
        parts.append(stored.where("round IS NOT NULL").select(*keys, age, tie, (F.col("round") + before).alias("round")))
        before += rounds
    return reduce(DataFrame.unionByName, parts)


def outlier_flags(df: DataFrame, pid: str, age: str, tie: str, specs: dict[str, tuple[str, tuple | None]],
                  bounded: bool = False) -> DataFrame:
    """Flag columns: null where unmeasured, 0 plausible, 1 removed by the fixpoint.

    All channels are peeled in the same rounds, as one tall table of
    (entity, channel) series.
    """
    tall = df.select(pid, age, tie, F.explode(F.array(*[
        F.struct(F.lit(n).alias("channel"), F.col(v).cast("double").alias("value")) for n, (v, _) in specs.items()
    ])).alias("m")).select(pid, age, tie, "m.*").where("value is not null")
    limit = F.when(F.lit(False), F.lit(0.0))
    for name, (_, thresholds) in specs.items():
        if thresholds is not None:
            limit = limit.when(F.col("channel") == name, slope_limit(age, thresholds))
    gone = outlier_fixpoint(tall, [pid, "channel"], age, "value", tie, limit, bounded).groupBy(pid, tie).agg(
        *[F.max(F.when(F.col("channel") == n, 1)).alias(f"__{n}") for n in specs])
    out = join_on(df, gone, [pid, tie], "left")
    return out.withColumns({
        n: F.when(F.col(v).isNotNull(), F.coalesce(F.col(f"__{n}"), F.lit(0))) for n, (v, _) in specs.items()
    }).drop(*[f"__{n}" for n in specs])
