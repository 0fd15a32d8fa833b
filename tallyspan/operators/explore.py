"""Exploratory operators over measurements and layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band_label, closed_bands, step_value
from ..functions.ordering import running_totals
from ..functions.stats import exact_quantiles, ratio, suppress
from ..functions.storage import deal, join_on
from .derive import as_of

MEDIAN_P95 = {"median": 0.5, "p95": 0.95}


def one_quantile(df: DataFrame, by: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    return exact_quantiles(df, by, {"v": value}, probs).drop("metric")


def layer_agreement(raw: DataFrame, derived: DataFrame, key: str, pairs: list[tuple[str, str]], tol: float = 0.01) -> DataFrame:
    """Per shared column: distinct rows (null-safe), one-sided nulls and numeric differences."""
    left = raw.select(key, *[F.col(a).alias(f"a{i}") for i, (a, _) in enumerate(pairs)])
    right = derived.select(key, *[F.col(b).alias(f"b{i}") for i, (_, b) in enumerate(pairs)])
    row = left.join(right, key).agg(F.count("*").alias("rows"), *[x for i in range(len(pairs)) for x in (
        F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"d{i}"),
        F.count_if(F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNull()).alias(f"l{i}"),
        F.count_if(F.col(f"a{i}").isNull() & F.col(f"b{i}").isNotNull()).alias(f"r{i}"),
        F.count_if(F.abs(F.col(f"a{i}").try_cast("double") - F.col(f"b{i}").try_cast("double")) > tol).alias(f"t{i}"))])
    return row.select("rows", F.explode(F.array(*[
        F.struct(F.lit(a if a == b else f"{a}/{b}").alias("field"), F.col(f"d{i}").alias("differs"), F.col(f"l{i}").alias("left_only"),
                 F.col(f"r{i}").alias("right_only"), F.col(f"t{i}").alias("beyond_tolerance"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select("rows", "r.*", ratio(100.0 * F.col("r.differs"), F.col("rows")).alias("share"))


def category_loss(raw: DataFrame, derived: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Values lost between layers: (field, value, raw rows, derived rows, lost to null)."""
    pair = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"r_{c}").alias("raw"), F.col(f"d_{c}").alias("derived")) for c in cols])
    both = raw.select(key, *[F.col(c).alias(f"r_{c}") for c in cols]).join(derived.select(key, *[F.col(c).alias(f"d_{c}") for c in cols]), key)
    cells = both.select(F.explode(pair).alias("p")).select("p.*").groupBy("field", "raw", "derived").agg(F.count("*").alias("n"))
    n = F.col("n")
    return cells.groupBy("field").agg(
        F.sum(F.when(~F.col("raw").eqNullSafe(F.col("derived")), n).otherwise(0)).alias("differs"),
        F.sum(F.when(F.col("raw").isNotNull() & F.col("derived").isNull(), n).otherwise(0)).alias("lost"),
        F.countDistinct("raw").alias("raw_distinct"), F.countDistinct("derived").alias("derived_distinct"),
        F.countDistinct(F.when(F.col("derived").isNull(), F.col("raw"))).alias("dropped_values"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Successive filters counted in one pass: (step, label, remaining, excluded)."""
    passed, aggs = F.lit(True), [F.count("*").alias("s0")]
    for i, (_, cond) in enumerate(steps, 1):
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"s{i}"))
    rows = [F.struct(F.lit(0).alias("step"), F.lit("all").alias("label"), F.col("s0").alias("remaining"), F.lit(0).cast("long").alias("excluded"))]
    rows += [F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"s{i}").alias("remaining"),
                      (F.col(f"s{i - 1}") - F.col(f"s{i}")).alias("excluded")) for i, (label, _) in enumerate(steps, 1)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def surviving_codes(codes: DataFrame, code: str, expected: int) -> DataFrame:
    return codes.agg(F.countDistinct(code).alias("observed")).withColumn("expected", F.lit(expected).cast("long")).withColumn(
        "status", F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL"))


def day_values(df: DataFrame, pid: str, age: str, value: str, *extra: Column) -> DataFrame:
    """One row per entity and day with the row count and value range."""
    return df.where(F.col(value).isNotNull()).groupBy(pid, age).agg(
        F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), *extra)


def same_period_spread(df: DataFrame, pid: str, age: str, cols: dict[str, float | None]) -> DataFrame:
    """Days with several values, with differing values, and how far apart they are.

    ``cols`` maps a column to an optional bound: days whose largest value is
    above it are counted apart from the spread below it.
    """
    parts = [day_values(df, pid, age, c).select(
        F.lit(c).alias("channel"), "n", (F.col("hi") - F.col("lo")).alias("spread"),
        (F.col("hi") > F.lit(bound)).alias("above") if bound is not None else F.lit(False).alias("above")) for c, bound in cols.items()]
    days = reduce(DataFrame.unionByName, parts)
    differ = F.col("spread") > 0
    counts = days.groupBy("channel").agg(
        F.count_if(F.col("n") > 1).alias("multi"), F.count_if(differ).alias("disagree"), F.count_if(differ & F.col("above")).alias("above_bound"))
    q = one_quantile(days.where(differ), ["channel"], F.col("spread"), {**MEDIAN_P95, "max_spread": 1.0}).drop("n")
    return join_on(counts, q, ["channel"], "left")


def spread_by_band(df: DataFrame, pid: str, age: str, value: str, bands) -> DataFrame:
    """Differing days per life stage against all measured days of the stage."""
    days = day_values(df, pid, age, value).withColumn("band", band_label(F.col(age), bands)).where("band is not null")
    spread = F.col("hi") - F.col("lo")
    counts = days.groupBy("band").agg(F.count("*").alias("all_days"), F.count_if(spread > 0).alias("days"))
    q = one_quantile(days.where(spread > 0), ["band"], spread, {"median": 0.5}).drop("n")
    return join_on(counts, q, ["band"], "left")


def entity_codes(coded: list[DataFrame], parts: int | None = None) -> DataFrame:
    """Distinct (entity, code) over all coded sources, blanks excluded; ``parts`` tasks hold the distinct rows."""
    rows = reduce(DataFrame.unionByName, coded).where(F.trim("code") != "")
    return deal(rows, parts, *rows.columns).distinct()


def entity_counts(pairs: DataFrame, by: Column, name: str, pid: str, parts: int | None = None) -> DataFrame:
    """Entities per value: (value, entity) folds first, over ``parts`` tasks, and the counts leave these tasks."""
    held = pairs.select(by.alias(name), pid)
    return deal(held, parts, name, pid).distinct().groupBy(name).agg(F.count(pid).alias("n"))


def code_hierarchy(pairs: DataFrame, pid: str, shape: str, parts: int | None = None) -> DataFrame:
    """Codes, three-character categories, silent categories and the roll-up ratio."""
    cat, shaped = F.substring("code", 1, 3), F.col("code").rlike(shape)
    vocabulary = pairs.select("code").distinct()
    head = vocabulary.agg(
        F.count_if(shaped).alias("codes"), F.count_if(shaped & (F.length("code") == 3)).alias("bare_codes"),
        F.countDistinct(F.when(shaped, cat)).alias("categories"), F.count_if(~shaped).alias("unshaped"))
    held = pairs.where(shaped & F.col(pid).isNotNull()).select(cat.alias("cat"), pid, (F.col("code") == cat).alias("bare"))
    per = deal(held, parts, "cat", pid).groupBy("cat", pid).agg(F.max("bare").alias("bare")).groupBy("cat").agg(
        F.count("*").alias("sub"), F.count_if("bare").alias("lit"))
    share = F.when(F.col("lit") > 0, F.col("sub") / F.col("lit"))
    # Categories are at most 36^3, so this aggregate is small.
    tail = per.agg(F.count_if(F.col("lit") == 0).alias("silent"), F.count_if(F.col("lit") > 0).alias("visible"),
                   F.percentile(share, 0.5).alias("ratio_p50"), F.percentile(share, 0.9).alias("ratio_p90"), F.max(share).alias("ratio_max"))
    return head.crossJoin(tail)  # one row each


def _top(counts: DataFrame, name: str, k: int) -> DataFrame:
    order = [F.col("n").desc(), F.col(name)]
    return counts.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def literal_vs_rolled(pairs: DataFrame, pid: str, k: int = 6, parts: int | None = None) -> DataFrame:
    """Most frequent literal codes beside the most frequent categories, by rank."""
    literal = _top(entity_counts(pairs, F.col("code"), "code", pid, parts), "code", k)
    rolled = _top(entity_counts(pairs, F.substring("code", 1, 3), "category", pid, parts), "category", k)
    return literal.withColumnRenamed("n", "code_n").join(rolled.withColumnRenamed("n", "category_n"), "rank", "full")


def subtree(pairs: DataFrame, pid: str, category: str, k: int = 5, parts: int | None = None) -> DataFrame:
    """Entities under one category and its largest members."""
    return _top(entity_counts(pairs.where(F.col("code").startswith(category)), F.col("code"), "code", pid, parts), "code", k)


def grain_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that hold more than one row, and the rows in them."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"),
                 F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeated"), F.max("n").alias("largest"))


def capture_by_type(df: DataFrame, kind: str, cols: list[str], below: int = 10) -> DataFrame:
    """Share of rows with each measure per type; small cells keep only their name."""
    agg = df.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in cols])
    shown = suppress(F.col("n"), below)
    return agg.select(kind, shown.alias("visits"), *[F.when(shown.isNotNull(), 100.0 * F.col(f"n_{c}") / F.col("n")).alias(c) for c in cols])


def capture_by_source(df: DataFrame, source: str, cols: list[str]) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("visits"), *[(100.0 * F.count(c) / F.count("*")).alias(c) for c in cols])


def carry_forward(df: DataFrame, pid: str, age: str, value: str, kind: str, excluded: list[str], days: int = 7) -> DataFrame:
    """Per type: rows whose value recurs in another eligible row of the entity within ``days``.

    Rows fold to counts per (entity, value, day, type); a range frame then sums
    eligible rows around each day, so no pairs are formed.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(pid, value, age, kind).agg(F.count("*").alias("n"))
    eligible = ~F.col(kind).isin(*excluded)
    around = Window.partitionBy(pid, value).orderBy(age).rangeBetween(-days, days)
    others = F.coalesce(F.sum(F.when(eligible, F.col("n"))).over(around), F.lit(0)) - F.when(eligible, 1).otherwise(0)
    found = cells.select(kind, "n", (others > 0).alias("hit"))
    return found.groupBy(kind).agg(F.sum("n").alias("candidates"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("carried")).withColumn(
        "share", ratio(100.0 * F.col("carried"), F.col("candidates")))


def supply_curve(df: DataFrame, pid: str, age: str, value: str) -> DataFrame:
    """Entities with at least k measured days, for every k that occurs."""
    per = df.where(F.col(value).isNotNull()).groupBy(pid).agg(F.countDistinct(age).alias("k"))
    counts = per.groupBy("k").agg(F.count("*").alias("n"))  # k is bounded by the days of a lifetime
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("k", F.sum("n").over(w).alias("entities"))


def row_day_inflation(df: DataFrame, pid: str, age: str, raw: str, derived: str) -> DataFrame:
    """Entities whose rows exceed their days, and what the derived layer loses."""
    cells = df.groupBy(pid, age).agg(F.count(raw).alias("r"), F.count(derived).alias("d"))
    per = cells.groupBy(pid).agg(F.sum("r").alias("raw_n"), F.sum("d").alias("der_n"), F.count_if(F.col("d") > 0).alias("days"))
    return per.agg(
        F.count_if(F.col("der_n") > F.col("days")).alias("inflated"), F.count_if(F.col("raw_n") > 0).alias("raw_entities"),
        F.count_if(F.col("der_n") > 0).alias("derived_entities"), F.count_if((F.col("raw_n") > 0) & (F.col("der_n") == 0)).alias("raw_only"),
        F.count_if(F.col("raw_n") > F.col("der_n")).alias("lost_some"), (F.sum("raw_n") - F.sum("der_n")).alias("removed"))


def on_grid(value: Column, step: float) -> Column:
    return value % step == 0


def heaping(df: DataFrame, specs: list[tuple[str, str, float]]) -> DataFrame:
    """Share of values on each grid: (label, column, step), in one pass."""
    row = df.agg(*[x for i, (_, c, step) in enumerate(specs) for x in (
        F.count(c).alias(f"n{i}"), F.count_if(on_grid(F.col(c), step)).alias(f"h{i}"))])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("grid"), F.col(f"n{i}").alias("n"), F.col(f"h{i}").alias("on_grid"), ratio(100.0 * F.col(f"h{i}"), F.col(f"n{i}")).alias("share"))
        for i, (label, _, _) in enumerate(specs)])).alias("r")).select("r.*")


def heaping_by_band(df: DataFrame, column: str, step: float, age: str, bands) -> DataFrame:
    return df.withColumn("band", band_label(F.col(age), bands)).where("band is not null").groupBy("band").agg(
        F.count(column).alias("n"), F.round(F.coalesce(ratio(100.0 * F.count_if(on_grid(F.col(column), step)), F.count(column)), F.lit(0.0)), 1).alias("share"))


def conversion_error(df: DataFrame, pairs: list[tuple[str, str, str, float]], tol: float = 0.001) -> DataFrame:
    """(label, converted, source, factor): pairs, pairs over tolerance, largest deviation, verdict."""
    row = df.agg(*[x for i, (_, a, b, k) in enumerate(pairs) for x in (
        F.count(F.col(a) - F.col(b) * k).alias(f"n{i}"), F.count_if(F.abs(F.col(a) - F.col(b) * k) > tol).alias(f"b{i}"),
        F.max(F.abs(F.col(a) - F.col(b) * k)).alias(f"m{i}"))])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("conversion"), F.col(f"n{i}").alias("pairs"), F.col(f"b{i}").alias("over"), F.col(f"m{i}").alias("largest"),
                 F.when(F.col(f"b{i}") > 0, "FAIL").otherwise("PASS").alias("status")) for i, (label, *_) in enumerate(pairs)])).alias("r")).select("r.*")


def saturation(df: DataFrame, z_cols: list[str], pct_cols: list[str], limit: float = 5.0, below: int = 10) -> DataFrame:
    """Support of each score and how often percentiles sit exactly at 0 or 100."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in [*z_cols, *pct_cols]])).alias("p")).select("p.*")
    z = F.col("channel").isin(*z_cols)
    return tall.where("v is not null").groupBy("channel").agg(
        F.count("*").alias("n"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        suppress(F.count_if(z & (F.abs("v") > limit)), below).alias("beyond"), F.count_if(~z & (F.col("v") == 0)).alias("at_0"),
        F.count_if(~z & (F.col("v") == 100)).alias("at_100"))


def tail_truncation(df: DataFrame, z: str, cuts: tuple[float, float] = (2.5, 3.0)) -> DataFrame:
    """Tail counts on both sides and the upper tail that symmetry predicts."""
    near, far = cuts
    c = F.col(z)
    agg = df.agg(F.count_if(c <= -near).alias("lower_near"), F.count_if(c <= -far).alias("lower_far"),
                 F.count_if(c >= near).alias("upper_near"), F.count_if(c >= far).alias("upper_far"))
    return agg.withColumn("expected_upper_far", ratio(F.col("upper_near") * F.col("lower_far"), F.col("lower_near")))


def band_repair(df: DataFrame, column: str, bands: list[tuple[str, float | None, float | None]], lo: float, hi: float,
                divisor: float, below: int = 10) -> DataFrame:
    """Bands (lo, hi] of a channel, and the share returned to range by one or two divisions."""
    c, label = F.col(column), F.when(F.lit(False), F.lit(""))
    for name, a, b in bands:
        test = F.lit(True)
        test = test if a is None else test & (c > a)
        test = test if b is None else test & (c <= b)
        label = label.when(test, name)
    rows = df.where(c.isNotNull()).select(c.alias("v"), label.alias("band")).where("band is not null")
    once, twice = F.col("v") / divisor, F.col("v") / divisor / divisor
    agg = rows.groupBy("band").agg(
        suppress(F.count("*"), below).alias("visits"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.count_if(once.between(lo, hi)).alias("repaired_once"), F.count_if(twice.between(lo, hi)).alias("repaired_twice"))
    return join_on(agg, one_quantile(rows, ["band"], F.col("v"), {"median": 0.5}).drop("n"), ["band"], "left")


def single_day_values(df: DataFrame, pid: str, age: str, value: str, *extra: Column) -> DataFrame:
    """Days on which the entity has exactly one distinct value."""
    return day_values(df, pid, age, value, *extra).where("lo = hi").drop("hi", "n").withColumnRenamed("lo", "v")


def neighbour_expectation(df: DataFrame, pid: str, age: str, value: str, lo: float, hi: float, span: int = 1460,
                          slack: float | None = None) -> DataFrame:
    """Value expected from the entity's previous and next day, by linear interpolation.

    The window runs over one row per day, so it is bounded by the age axis.
    """
    w = Window.partitionBy(pid).orderBy(age)
    s = single_day_values(df, pid, age, value).select(
        pid, age, "v", F.lag("v").over(w).alias("vp"), F.lag(age).over(w).alias("ap"), F.lead("v").over(w).alias("vn"), F.lead(age).over(w).alias("an"))
    ok = F.col("vp").between(lo, hi) & F.col("vn").between(lo, hi) & (F.col("an") - F.col("ap") <= span)
    if slack is not None:
        ok = ok & (F.col("vn") >= F.col("vp") - slack)
    expected = F.col("vp") + (F.col("vn") - F.col("vp")) * (F.col(age) - F.col("ap")) / (F.col("an") - F.col("ap"))
    return s.where(ok).select(pid, age, "v", expected.alias("expected"))


# Names of the entry-error classes.
FEET, CALIBRATION = "height recorded in whole feet", "one digit wrong (calibration class)"
SWAP, OMIT, SHIFT = "adjacent digit transposition", "one digit omitted", "decimal point misplaced"
SHIFTS = (0.01, 0.1, 10.0, 100.0)


def typed_text(value: Column) -> Column:
    """Shortest decimal text of a value, up to six decimals."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")


def _positions(first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def swaps(text: Column) -> Column:
    """Texts with two adjacent, different digits exchanged."""
    at = lambda i: F.substr(text, i, F.lit(1))
    pair = lambda i: F.when(
        at(i).rlike("[0-9]") & at(i + 1).rlike("[0-9]") & (at(i) != at(i + 1)),
        F.concat(F.substr(text, F.lit(1), i - 1), at(i + 1), at(i), F.substr(text, i + 2)))
    return F.array_compact(F.transform(_positions(1, F.length(text) - 1), pair))


def _digits() -> Column:
    return F.array(*[F.lit(str(d)) for d in range(10)])


def _insertions(text: Column) -> Column:
    return F.flatten(F.transform(_positions(1, F.length(text) + 1), lambda p: F.transform(
        _digits(), lambda d: F.concat(F.substr(text, F.lit(1), p - 1), d, F.substr(text, p)))))


def _substitutions(text: Column) -> Column:
    at = lambda i: F.substr(text, i, F.lit(1))
    return F.array_compact(F.flatten(F.transform(_positions(1, F.length(text)), lambda p: F.transform(
        _digits(), lambda d: F.when(at(p).rlike("[0-9]") & (at(p) != d), F.concat(F.substr(text, F.lit(1), p - 1), d, F.substr(text, p + 1)))))))


def _reaches(candidates: Column, value: Column, expected: Column, tol: Column, allow_same: bool = False) -> Column:
    numbers = F.transform(candidates, lambda c: c.try_cast("double"))
    return F.exists(numbers, lambda c: (c > 0) & (F.lit(allow_same) | (c != value)) & (F.abs(c - expected) <= tol))


def entry_mechanisms(df: DataFrame, value: str, expected: str, tol: Column, scales: list[tuple[str, float]], feet: bool = False) -> DataFrame:
    """Add ``hits``: entry errors that would turn the recorded value into the expected one.

    Meant for anomalies only, which are a small part of the rows; candidates are
    array expressions, evaluated beside the row.
    """
    v, e = F.col(value), F.col(expected)
    near = lambda factor: F.abs(v * factor - e) <= tol
    # A column of its own: inside the lambdas the text would be formatted anew for each candidate.
    df, text = df.withColumn("__text", typed_text(v)), F.col("__text")
    tests = [(name, near(k)) for name, k in scales]
    if feet:
        tests.append((FEET, (v == F.floor(v)) & v.between(1, 6) & (F.floor(e / 12) == v)))
    tests.append((SHIFT, reduce(Column.__or__, [near(k) for k in SHIFTS])))
    tests += [(SWAP, _reaches(swaps(text), v, e, tol)), (OMIT, _reaches(_insertions(text), v, e, tol)),
              (CALIBRATION, _reaches(_substitutions(text), v, e, tol, True))]
    return df.withColumn("hits", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))).drop("__text")


def mechanism_null(anomalies: DataFrame, key: str, value: str, expected: str, age: str, score, reps: int = 20, seed: str = "null") -> DataFrame:
    """Replicates whose deviation is drawn from the same year of age.

    Members of a pool are numbered by running totals over value ranges and each
    draw picks one number by a hash, so pools of any size stay distributed.
    ``score`` maps a frame with the shuffled expectation to one with ``hits``.
    """
    pooled = anomalies.select(key, F.col(value).alias("v"), F.least(F.floor(F.col(age) / 365), F.lit(17)).alias("pool"),
                              (F.col(expected) - F.col(value)).alias("deviation"))
    numbered = running_totals(pooled.withColumn("__one", F.lit(1).cast("long")), ["pool"], ["deviation", key], {"number": "__one"})
    sizes = numbered.groupBy("pool").agg(F.count("*").alias("size"))  # at most 18 rows
    draws = numbered.select(key, "v", "pool").join(F.broadcast(sizes), "pool").withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key), F.col("rep"))), 1, 8), 16, 10).cast("long") % F.col("size")
    drawn = draws.withColumn("number", pick).join(numbered.select("pool", "number", "deviation"), ["pool", "number"])
    return score(drawn.select(key, "rep", "v", (F.col("v") + F.col("deviation")).alias("expected")))


def mechanism_rates(hits: DataFrame, null_hits: DataFrame, reps: int, order: list[str]) -> DataFrame:
    """Observed and expected-by-chance counts per class, and their ratio when the null can carry one."""
    count = lambda df, name: df.select(F.explode("hits").alias("mechanism")).groupBy("mechanism").agg(F.count("*").alias(name))
    names = hits.sparkSession.createDataFrame([(n,) for n in order], "mechanism string")
    out = names.join(F.broadcast(count(hits, "observed")), "mechanism", "left").join(F.broadcast(count(null_hits, "__null")), "mechanism", "left")
    null = F.coalesce("__null", F.lit(0)) / F.lit(float(reps))
    return out.select("mechanism", F.coalesce("observed", F.lit(0)).alias("observed"), null.alias("null"),
                      F.when(null >= 0.2, F.coalesce("observed", F.lit(0)) / null).alias("ratio"))


def mechanism_accounting(hits: DataFrame, null_hits: DataFrame, rates: DataFrame, reps: int) -> DataFrame:
    """Split anomalies into enriched class, calibration only or neither; per class, what it alone explains."""
    credible = rates.where((F.col("mechanism") != CALIBRATION) & (F.col("observed") > F.col("null")))
    keep = F.broadcast(credible.agg(F.sort_array(F.collect_list("mechanism")).alias("credible")))  # at most one entry per class
    marked = hits.crossJoin(keep)
    named = F.arrays_overlap("hits", "credible")
    split = marked.agg(F.count_if(named).alias("named"), F.count_if(~named & F.array_contains("hits", CALIBRATION)).alias("calibration_only"),
                       F.count_if(~named & ~F.array_contains("hits", CALIBRATION)).alias("nothing"))
    total = split.unpivot([], ["named", "calibration_only", "nothing"], "item", "observed").withColumn("null", F.lit(None).cast("double"))

    def alone(df: DataFrame, name: str) -> DataFrame:
        one = df.crossJoin(keep).select(F.array_intersect("hits", "credible").alias("c")).where(F.size("c") == 1)
        return one.groupBy(F.concat(F.lit("alone: "), F.get("c", F.lit(0))).alias("item")).agg(F.count("*").alias(name))

    own = alone(hits, "observed").join(alone(null_hits, "__n"), "item", "left")
    return total.unionByName(own.select("item", "observed", (F.coalesce("__n", F.lit(0)) / F.lit(float(reps))).alias("null")))


def gate_sensitivity(df: DataFrame, value: str, gate: float, relative: bool = True) -> DataFrame:
    """Share of all digit swaps that would cross the anomaly gate, over every row."""
    typed = df.select(F.col(value).alias("__v"), typed_text(F.col(value)).alias("__text"))
    moved = typed.select(F.col("__v").alias("v"), F.explode(F.array_distinct(
        F.transform(swaps(F.col("__text")), lambda c: c.try_cast("double")))).alias("c")).where("c > 0 and c <> v")
    gap = F.abs(F.col("c") - F.col("v")) / (F.col("v") if relative else F.lit(1.0))
    return df.agg(F.count("*").alias("sampled")).crossJoin(
        moved.agg(F.count("*").alias("swaps"), F.count_if(gap > gate).alias("caught"), ratio(100.0 * F.count_if(gap > gate), F.count("*")).alias("share")))


def repeat_pairs(df: DataFrame, pid: str, age: str, value: str, carry: list[str] = ()) -> DataFrame:
    """Consecutive single-valued days: previous and next value, change and gap."""
    w = Window.partitionBy(pid).orderBy(age)
    days = single_day_values(df, pid, age, value, *[F.min(c).alias(c) for c in carry])
    return days.select(
        pid, age, *carry, "v", F.lag("v").over(w).alias("v_prev"), F.lag(age).over(w).alias("age_prev"), F.lead("v").over(w).alias("v_next"),
    ).where("v_prev is not null").withColumns({"change": F.col("v") - F.col("v_prev"), "gap": F.col(age) - F.col("age_prev")})


def change_by_gap(pairs: DataFrame, gaps: list[tuple[str, int, int | None]], by: str = "gap") -> DataFrame:
    """Zero-change and decrease rates per gap band with the median loss."""
    rows = pairs.withColumn("band", band_label(F.col(by), closed_bands(gaps))).where("band is not null")
    agg = rows.groupBy("band").agg(
        F.count("*").alias("pairs"), (100.0 * F.count_if(F.col("change") == 0) / F.count("*")).alias("zero"),
        (100.0 * F.count_if(F.col("change") < 0) / F.count("*")).alias("decrease"))
    loss = one_quantile(rows.where("change < 0"), ["band"], -F.col("change"), {"median_loss": 0.5}).drop("n")
    return join_on(agg, loss, ["band"], "left")


def change_by_age(pairs: DataFrame, bands, by: str | None = None, min_pairs: int = 50, gap: tuple[int, int] = (181, 365)) -> DataFrame:
    """Decrease rate and mean change per age band at a fixed gap; thin bands are dropped."""
    keys = ["band"] + ([by] if by else [])
    rows = pairs.where(F.col("gap").between(*gap)).withColumn("band", band_label(F.col("age_prev"), bands)).where("band is not null")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"), (100.0 * F.count_if(F.col("change") < 0) / F.count("*")).alias("rate"),
        F.avg("change").alias("mean_change")).where(F.col("pairs") >= min_pairs)


def rebound(pairs: DataFrame, loss: float = 1.0, slack: float = 0.5, min_gap: int = 365, min_age: int = 730) -> DataFrame:
    """After a loss, does the next value return to the one before it."""
    lost = pairs.where((F.col("gap") > min_gap) & (F.col("age_prev") >= min_age) & (F.col("change") < -loss) & F.col("v_next").isNotNull())
    return lost.agg(F.count("*").alias("losses"), F.count_if(F.col("v_next") >= F.col("v_prev")).alias("back"),
                    F.count_if(F.col("v_next") >= F.col("v_prev") - slack).alias("back_with_slack"))


def velocity_source(df: DataFrame, pid: str, age: str, value: str, rule, keep: list[str] = ()) -> DataFrame:
    """Per measured row: the day and largest value the minimum-gap rule selects.

    Rows fold to one per entity and day, keeping the number of distinct values,
    before the range frames run.
    """
    days = day_values(df, pid, age, value)
    entry = F.struct(F.col(age).alias("a"), F.col("hi").alias("v"), (F.col("n") > 1).alias("dup"))
    steps, default = rule
    prior = as_of(step_value(F.col(age), steps, default), sorted({g for _, g in steps} | {default}), pid, age, entry)
    chosen = days.select(pid, age, prior.alias("p"), (F.col("n") > 1).alias("dup"))
    rows = df.where(F.col(value).isNotNull()).select(pid, age, F.col(value).alias("v"), *keep)
    return join_on(rows, chosen, [pid, age], "left")


def reproduce_velocity(df: DataFrame, pid: str, age: str, value: str, delta: str, gap: str, velocity: str, rule, year: float = 365.0,
                       tol: float = 0.0101, digits: int = 2) -> DataFrame:
    """Recompute published deltas and velocities from the rule and count the agreement."""
    src = velocity_source(df, pid, age, value, rule, [delta, gap, velocity])
    diff = F.abs(F.round(F.col("v") - F.col("p.v"), digits) - F.col(delta))
    from_source = F.round((F.col("v") - F.col("p.v")) / (F.col(age) - F.col("p.a")) * year, digits)
    from_published = lambda y: F.round(F.col(delta) / F.col(gap) * y, digits)
    ok = F.col(delta).isNotNull() & F.col("p").isNotNull()
    return src.agg(
        F.count_if(ok).alias("n"), F.count(delta).alias("published"), F.count_if(ok & (F.col(age) - F.col("p.a") == F.col(gap))).alias("gap_match"),
        F.count_if(ok & (diff < 1e-9)).alias("exact"), F.count_if(ok & (diff < tol)).alias("within"), F.count_if(ok & (diff >= tol)).alias("off"),
        F.count_if(ok & (diff >= tol) & (F.col("dup") | F.col("p.dup"))).alias("off_on_repeated_days"),
        F.count_if(ok & (from_source == F.col(velocity))).alias("velocity_from_source"),
        F.count_if(ok & (from_published(year) == F.col(velocity))).alias("velocity_from_published"),
        F.count_if(ok & (from_published(365.25) == F.col(velocity))).alias("velocity_other_year"),
    ).withColumn("status", F.when(F.col("n") == F.col("published"), "PASS").otherwise("FAIL"))


def naive_velocity(df: DataFrame, pid: str, age: str, value: str, delta: str, tol: float = 0.0101) -> DataFrame:
    """How often the plain previous day explains the published delta."""
    w = Window.partitionBy(pid).orderBy(age)
    days = day_values(df, pid, age, value, F.max(delta).alias("d")).select("d", (F.col("hi") - F.lag("hi").over(w)).alias("dv"))
    return days.agg(F.count("d").alias("published"), F.count_if(F.abs(F.col("dv") - F.col("d")) < tol).alias("lag1"))


def cross_rule(df: DataFrame, pid: str, age: str, value: str, gap: str, rules: dict[str, tuple]) -> DataFrame:
    """Rows whose published gap each rule reproduces: the cost of assuming the wrong one.

    Rows fold to one per entity, day and gap; one sort of these serves a range frame for each distinct
    minimum of all rules, so a further rule costs no further pass.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(pid, age, gap).agg(F.count("*").alias("__n"))
    by_day = Window.partitionBy(pid).orderBy(age)
    least = sorted({g for steps, default in rules.values() for g in [default, *(g for _, g in steps)]})
    cells = cells.withColumns({f"__day{g}": F.max(age).over(by_day.rangeBetween(Window.unboundedPreceding, -g)) for g in least})
    counts = [F.coalesce(F.sum(F.when(F.col(gap).isNotNull(), F.col("__n"))), F.lit(0)).alias("rows")]
    for i, (steps, default) in enumerate(rules.values()):
        row_gap, prior = step_value(F.col(age), steps, default), F.lit(None).cast("long")
        for g in least:
            prior = F.when(row_gap == g, F.col(f"__day{g}")).otherwise(prior)
        counts.append(F.coalesce(F.sum(F.when(F.col(age) - prior == F.col(gap), F.col("__n"))), F.lit(0)).alias(f"m{i}"))
    return cells.agg(*counts).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), "rows", F.col(f"m{i}").alias("matched")) for i, name in enumerate(rules)])).alias("r")).select("r.*")


def smallest_gap(df: DataFrame, age: str, gap: str, bands) -> DataFrame:
    return df.where(F.col(gap).isNotNull()).withColumn("band", band_label(F.col(age), bands)).where("band is not null").groupBy("band").agg(
        F.min(gap).alias("smallest"), F.count("*").alias("n"))


def reference_spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """Spread across alternative references where all are present."""
    all_there = reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])
    return one_quantile(df.where(all_there), [], F.greatest(*cols) - F.least(*cols), {"p50": 0.5, "p95": 0.95})


def common_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    return _top(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", k)


def band_profile(df: DataFrame, pid: str, age: str, bands, by: str, cols: list[str]) -> DataFrame:
    """Rows, entities, means and sample deviations per age band and group."""
    rows = df.withColumn("band", band_label(F.col(age), bands)).where("band is not null")
    return rows.groupBy("band", by).agg(F.count("*").alias("rows"), F.countDistinct(pid).alias("entities"), *[
        x for c in cols for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))])


def variance_components(df: DataFrame, pid: str, age: str, value: str) -> DataFrame:
    """Between- and within-entity spread, ICC and lag-1 correlation over entity days."""
    days = single_day_values(df, pid, age, value)
    per = days.groupBy(pid).agg(F.avg("v").alias("m"), F.var_samp("v").alias("s2"), F.count("*").alias("n")).where("n >= 2")
    parts = per.agg(F.count("*").alias("entities"), F.sum("n").alias("n_values"), F.stddev_samp("m").alias("between"), F.sqrt(F.avg("s2")).alias("within"),
                    F.sqrt(F.sum(F.col("s2") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("within_pooled"))
    lagged = days.select("v", F.lag("v").over(Window.partitionBy(pid).orderBy(age)).alias("pv")).where("pv is not null")
    rho = lagged.agg(F.count("*").alias("pairs"), F.corr("v", "pv").alias("lag1"))
    b2 = F.col("between") * F.col("between")
    icc = b2 / (b2 + F.col("within") * F.col("within"))
    return parts.crossJoin(rho).withColumns({  # one row each
        "icc": icc, "icc_pooled": b2 / (b2 + F.col("within_pooled") * F.col("within_pooled")), "design_factor": 1 / icc})


def recompute_check(df: DataFrame, column: str, expr: Column, tol: float, category: str, rule: Column) -> DataFrame:
    """Deviation of a derived column from its formula, and of a category from its rule."""
    d = F.abs(F.col(column) - expr)
    rows = df.select(d.alias("d"), F.col(category).alias("c"), rule.alias("r"))
    agg = rows.agg(F.count("d").alias("n"), F.max("d").alias("largest"), F.count_if(F.col("d") > tol).alias("off"), F.count("c").alias("categorised"),
                   F.count_if(F.col("c").isNotNull() & ~F.col("c").eqNullSafe(F.col("r"))).alias("wrong_category"))
    return agg.crossJoin(one_quantile(rows, [], F.col("d"), {"median": 0.5}).drop("n")).withColumn(
        "status", F.when((F.col("off") > 0) | (F.col("wrong_category") > 0), "FAIL").otherwise("PASS"))
