"""Partitioned aggregate targets, disclosure and comparison.

Targets are tall: (partition, stratum, name, family, statistic, value, support,
denominator).  Every builder aggregates all partitions in the same pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import all_bands
from ..functions.partition import partition_label
from ..functions.stats import exact_quantiles, ratio
from ..functions.storage import join_on

COLUMNS = ["partition", "stratum", "name", "family", "statistic", "value", "support", "denominator"]


def assign_partition(df: DataFrame, pid: str, key: bytes, basis_points: int) -> DataFrame:
    return df.withColumn("partition", partition_label(F.col(pid), key, basis_points))


def mark_partition(df: DataFrame, pid: str, key: bytes, basis_points: int) -> DataFrame:
    """The same as ``assign_partition``, for tables of many rows per entity: each id is hashed once and joined back."""
    return join_on(df, assign_partition(df.select(pid).distinct(), pid, key, basis_points), [pid], "left")


def partition_counts(tables: dict[str, DataFrame], pid: str, label: Column) -> DataFrame:
    """Rows per table and partition; ``label`` is worked out once per entity, of whom one count each leaves the tasks."""
    return reduce(DataFrame.unionByName, [
        df.groupBy(pid).agg(F.count("*").alias("rows")).groupBy(label.alias("partition")).agg(F.sum("rows").alias("rows")).select(
            F.lit(n).alias("table_name"), "partition", "rows") for n, df in tables.items()])


def _target(name: str, family: str, statistic: str, value: Column, support: Column, denominator: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"), F.lit(family).alias("family"), F.lit(statistic).alias("statistic"), value.cast("double").alias("value"),
        support.cast("long").alias("support"), (F.lit(None) if denominator is None else denominator).cast("long").alias("denominator"))


def _proportion(name: str, family: str, part: str, whole: str) -> Column:
    return _target(name, family, "proportion", ratio(F.col(part), F.col(whole)), F.col(part), F.col(whole))


def _rows(agg: DataFrame, stratum: Column, targets: list[Column]) -> DataFrame:
    return agg.select("partition", stratum.alias("stratum"), F.explode(F.array(*targets)).alias("t")).select("partition", "stratum", "t.*")


def _slug(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text.lower())


def demographic_targets(entities: DataFrame, registry: dict[str, list[str]], multi: list[str]) -> DataFrame:
    """Category shares, zero-support registry categories included, and the multi-select share.

    The registry is a short declared list, so each category is one conditional
    count of a single pass.
    """
    aggs, targets = [F.count("*").alias("n")], []
    for field, categories in registry.items():
        for category in categories:
            name = f"{field}_{_slug(category)}"
            aggs.append(F.count_if(F.col(field) == category).alias(name))
            targets.append(_proportion(name, "demographics", name, "n"))
    chosen = reduce(Column.__add__, [F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in multi])
    aggs.append(F.count_if(chosen > 1).alias("multi"))
    targets.append(_proportion("multi_select", "demographics", "multi", "n"))
    return _rows(entities.groupBy("partition").agg(*aggs), F.lit("all"), targets)


def outcome_targets(entities: DataFrame, flags: list[str], index_age: str) -> DataFrame:
    """Flag shares, and mean, median and 90 % quantile of the index age."""
    agg = entities.groupBy("partition").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f) == 1).alias(f) for f in flags], F.count(index_age).alias("aged"), F.avg(index_age).alias("mean"),
        F.percentile(index_age, 0.5).alias("q50"), F.percentile(index_age, 0.9).alias("q90"))
    targets = [_proportion(f"flag_{f}", "outcome", f, "n") for f in flags]
    targets += [_target(f"{index_age}_{s}", "outcome", kind, F.col(s), F.col("aged")) for s, kind in [("mean", "mean"), ("q50", "quantile"), ("q90", "quantile")]]
    return _rows(agg, F.lit("all"), targets)


def use_targets(entities: DataFrame, events: DataFrame, pid: str, age: str, kind: str, kinds: list[str], source: str) -> DataFrame:
    """Events and span per entity, encounter mix over a registry, and the source share."""
    per = events.groupBy("partition", pid).agg(F.count("*").alias("c"), (F.max(age) - F.min(age)).alias("s"))
    whole = join_on(entities.select("partition", pid), per.drop("partition"), [pid], "left").fillna(0, ["c"])
    use = whole.groupBy("partition").agg(F.count("*").alias("n"), *[x for c in "cs" for x in (
        F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.5).alias(f"{c}_q50"), F.percentile(c, 0.9).alias(f"{c}_q90"))])
    names = {"c": "events_per_entity", "s": "span_days"}
    targets = [_target(f"{names[c]}_{s}", "utilization", k, F.col(f"{c}_{s}"), F.col("n")) for c in "cs" for s, k in [("mean", "mean"), ("q50", "quantile"), ("q90", "quantile")]]
    mix = events.groupBy("partition").agg(F.count("*").alias("n"), *[F.count_if(F.col(kind) == k).alias(f"kind_{_slug(k)}") for k in kinds],
                                          F.count_if(F.col(source) == "Y").alias("source_share"))
    shares = [_proportion(f"kind_{_slug(k)}", "utilization", f"kind_{_slug(k)}", "n") for k in kinds] + [_proportion("source_share", "utilization", "source_share", "n")]
    return _rows(use, F.lit("all"), targets).unionByName(_rows(mix, F.lit("all"), shares))


def link_targets(tables: dict[str, DataFrame], events: DataFrame, pid: str, vid: str, label: Column) -> DataFrame:
    """Share of rows whose (entity, visit) link resolves, per table.

    Rows fold to their links, and links to entities, before ``label`` gives the partition of an entity.
    """
    known = events.select(pid, vid).distinct().withColumn("__hit", F.lit(1))
    parts = []
    for name, df in tables.items():
        keys = df.groupBy(pid, vid).agg(F.count("*").alias("__n"))
        per = keys.join(known, [pid, vid], "left").groupBy(pid).agg(
            F.sum("__n").alias("n"), F.coalesce(F.sum(F.when(F.col("__hit").isNotNull(), F.col("__n"))), F.lit(0)).alias("k"))
        agg = per.groupBy(label.alias("partition")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        parts.append(_rows(agg, F.lit("all"), [_proportion(f"{name}_link", "observation", "k", "n")]))
    return reduce(DataFrame.unionByName, parts)


def _windowed(df: DataFrame, age: str, windows) -> DataFrame:
    return df.withColumn("window", F.explode(all_bands(F.col(age), windows)))


def availability_targets(events: DataFrame, age: str, windows, cols: list[str]) -> DataFrame:
    """Share of events with a finite measure per half-open age window."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    agg = _windowed(events, age, windows).groupBy("partition", "window").agg(F.count("*").alias("n"), *[F.count_if(finite(c)).alias(c) for c in cols])
    return _rows(agg, F.col("window"), [_proportion(f"{c}_available", "observation", c, "n") for c in cols])


def interval_targets(events: DataFrame, pid: str, age: str, windows) -> DataFrame:
    """Gaps between consecutive events, placed by the later event's age.

    Events fold to one row per entity and day before the lag: a day with n
    events has one gap to the day before it and n - 1 gaps of zero.
    """
    days = events.groupBy("partition", pid, age).agg(F.count("*").alias("n"))
    lagged = days.withColumn("gap", (F.col(age) - F.lag(age).over(Window.partitionBy("partition", pid).orderBy(age))).cast("long"))
    steps = lagged.select("partition", age, F.explode(F.array(
        F.struct("gap", F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("w")))).alias("s")
    ).select("partition", age, "s.*").where("gap is not null and w > 0")
    agg = _windowed(steps, age, windows).groupBy("partition", "window").agg(
        F.sum("w").alias("n"), (F.sum(F.col("gap") * F.col("w")) / F.sum("w")).alias("mean"), F.percentile("gap", 0.5, F.col("w")).alias("q50"),
        F.percentile("gap", 0.9, F.col("w")).alias("q90"))
    return _rows(agg, F.col("window"), [_target(f"interval_days_{s}", "utilization", k, F.col(s), F.col("n")) for s, k in [("mean", "mean"), ("q50", "quantile"), ("q90", "quantile")]])


def physiology_targets(events: DataFrame, age: str, sex: str, windows, metrics: dict[str, list[str]]) -> DataFrame:
    """Mean, sample deviation and quantiles of clean values by window, sex and metric.

    ``metrics`` maps a value to the flags that must be 0; a null flag excludes.
    """
    clean = {m: F.when(reduce(Column.__and__, [F.col(f) == 0 for f in flags], F.col(m).isNotNull()), F.col(m)) for m, flags in metrics.items()}
    rows = _windowed(events, age, windows).select("partition", "window", F.col(sex).alias("sex"), *[c.alias(m) for m, c in clean.items()])
    keys = ["partition", "window", "sex"]
    q = exact_quantiles(rows, keys, {m: F.col(m) for m in metrics}, {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    tall = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("p")).select(*keys, "p.*")
    stats = tall.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    both = join_on(stats, q, [*keys, "metric"]).where("n >= 2")
    cells = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(k).alias("statistic"), F.col(s).alias("value")) for s, k in [
        ("mean", "mean"), ("sd", "sd"), ("q10", "quantile"), ("q50", "quantile"), ("q90", "quantile")]])
    return both.select(*keys, "metric", "n", F.explode(cells).alias("c")).select(
        "partition", F.concat_ws("/", "window", "sex").alias("stratum"), F.concat_ws("_", "metric", "c.suffix").alias("name"), F.lit("physiology").alias("family"),
        "c.statistic", "c.value", F.col("n").alias("support"), F.lit(None).cast("long").alias("denominator"))


def raw_targets(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def duplicate_targets(targets: DataFrame) -> DataFrame:
    """Cells that occur more than once; an empty result means a valid registry."""
    return targets.groupBy("partition", "stratum", "name", "statistic").agg(F.count("*").alias("n")).where("n > 1")


def disclose(targets: DataFrame, min_cell: int = 10, decimals: int = 3) -> DataFrame:
    """Suppress thin cells, then round; a suppressed cell loses value, support and denominator."""
    ok = F.col("support") >= min_cell
    value = F.when(F.col("statistic") == "count", F.col("value")).otherwise(F.round("value", decimals))
    return targets.select(
        "partition", "stratum", "name", "family", "statistic", F.when(ok, value).alias("value"), F.when(ok, F.col("support")).alias("support"),
        F.when(ok, F.col("denominator")).alias("denominator"), F.when(ok, "released").otherwise("suppressed").alias("status"))


def compare_targets(left: DataFrame, right: DataFrame, min_support: int, floor: float, z: float, count_tolerance: float, tolerances: dict[str, float]) -> DataFrame:
    """Full outer comparison of disclosed targets under fixed tolerances."""
    keys = ["stratum", "name", "family", "statistic"]
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("value", "support", "denominator", "status")])
    j = side(left, "l").join(side(right, "r"), keys, "full")
    proportion = F.col("statistic") == "proportion"

    def usable(s: str) -> Column:
        has = (F.col(f"{s}_status") == "released") & (F.col(f"{s}_support") >= min_support) & F.col(f"{s}_value").isNotNull()
        return F.coalesce(has & (~proportion | F.col(f"{s}_denominator").isNotNull()), F.lit(False))

    error = lambda s: F.sqrt(F.col(f"{s}_value") * (1 - F.col(f"{s}_value")) / F.col(f"{s}_denominator"))
    family = F.create_map(*[F.lit(x) for kv in tolerances.items() for x in kv])[F.col("family")] if tolerances else F.lit(None)
    tolerance = F.when(proportion, F.greatest(F.lit(floor), F.lit(z) * F.greatest(error("l"), error("r")))).when(
        F.col("statistic") == "count", F.lit(float(count_tolerance))).otherwise(family)
    ok = usable("l") & usable("r")
    difference = F.abs(F.col("l_value") - F.col("r_value"))
    return j.select(
        *keys, F.when(~ok, "UNEVALUABLE").when(difference <= tolerance, "PASS").otherwise("FAIL").alias("status"), F.when(ok, F.col("l_value")).alias("left_value"),
        F.when(ok, F.col("r_value")).alias("right_value"), F.when(ok, difference).alias("difference"), F.when(ok, tolerance).alias("tolerance"))


def fidelity_status(comparisons: DataFrame, required: list[str], max_unevaluable: int) -> DataFrame:
    """Counts per family and overall, with the global verdict on the overall row."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = comparisons.groupBy("family").agg(is_("PASS").alias("passed"), is_("FAIL").alias("failed"), is_("UNEVALUABLE").alias("unevaluable"))
    evaluable = F.collect_set(F.when(F.col("passed") + F.col("failed") > 0, F.col("family")))  # one entry per family
    whole = counts.agg(F.lit("all").alias("family"), *[F.sum(c).alias(c) for c in ("passed", "failed", "unevaluable")], evaluable.alias("__e"))
    missing = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("__e"))) > 0
    verdict = F.when(F.col("failed") > 0, "FAIL").when((F.col("unevaluable") > max_unevaluable) | missing, "UNEVALUABLE").otherwise("PASS")
    own = F.when(F.col("failed") > 0, "FAIL").when(F.col("unevaluable") > 0, "UNEVALUABLE").otherwise("PASS")
    return counts.withColumn("status", own).unionByName(whole.withColumn("status", verdict).drop("__e"))


def evidence_across_runs(runs: DataFrame, required: DataFrame) -> DataFrame:
    """Aggregate per-run comparisons: (run, keys, status, left/right value, difference, tolerance).

    Required keys missing from a run count as UNEVALUABLE there.  Runs that
    disagree on the held-out value get the status INCONSISTENT.
    """
    keys = ["stratum", "name", "family", "statistic"]
    names = runs.select("run").distinct()  # a handful of declared runs
    wanted = runs.select(*keys).unionByName(required.select(*keys)).distinct().crossJoin(F.broadcast(names))
    filled = join_on(wanted, runs, [*keys, "run"], "left").withColumn("status", F.coalesce("status", F.lit("UNEVALUABLE")))
    ok = F.col("status") != "UNEVALUABLE"
    on = lambda c: F.when(ok, F.col(c))
    agg = filled.groupBy(*keys).agg(
        F.min(on("left_value")).alias("held_out"), F.max(on("left_value")).alias("__hi"), F.min(on("right_value")).alias("generated_min"), F.max(on("right_value")).alias("generated_max"),
        F.max(on("difference")).alias("max_difference"), F.max(F.when(ok, F.col("difference") - F.col("tolerance"))).alias("max_excess"), F.count_if(ok).alias("evaluable"),
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count("*").alias("__runs"))
    status = F.when(F.col("held_out") != F.col("__hi"), "INCONSISTENT").when(F.col("failed") > 0, "FAIL").when(
        F.col("evaluable") < F.col("__runs"), "UNEVALUABLE").otherwise("PASS")
    return agg.withColumn("status", status).drop("__hi", "__runs")
