"""Domain listings, label evidence and shortcut screens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band_label, closed_bands
from ..functions.stats import rank_auc, ratio, stabilize, suppress
from ..functions.storage import deal, join_on

from .rollup import events_before_index, matched_prefixes


def like_any(columns: list[Column], patterns: list[str]) -> Column:
    return F.coalesce(reduce(Column.__or__, [c.like(p) for c in columns for p in patterns]), F.lit(False))


def matched_patterns(df: DataFrame, columns: list[Column], patterns: dict[str, list[str]], name: str) -> DataFrame:
    """One row per (row, pattern family that matches any of the columns)."""
    labels = F.array_compact(F.array(*[F.when(like_any(columns, p), F.lit(n)) for n, p in patterns.items()]))
    return df.withColumn(name, F.explode(labels))


def slots_filled(df: DataFrame, slots: list[str]) -> DataFrame:
    """Rows by number of filled slots, with the slot total beside it."""
    filled = F.size(F.filter(F.array(*slots), lambda c: F.trim(c) != ""))
    counts = df.select(filled.alias("filled")).groupBy("filled").agg(F.count("*").alias("rows"))
    return counts.withColumn("slots", F.col("filled") * F.col("rows"))


def lines_filled(lines: DataFrame, by: list[str]) -> DataFrame:
    """The same over a tall table with one row per filled slot."""
    counts = lines.groupBy(*by).agg(F.count("*").cast("int").alias("filled")).groupBy("filled").agg(F.count("*").alias("rows"))
    return counts.withColumn("slots", F.col("filled") * F.col("rows"))


def top_codes(codes: DataFrame, pid: str, code: Column, lookup: DataFrame, k: int = 25, parts: int | None = None) -> DataFrame:
    """Most frequent codes with descriptions; the limit precedes the dictionary join.

    Rows fold to (code, entity) first, over ``parts`` tasks; counts alone leave these tasks.
    """
    rows = codes.select(pid, code.alias("code")).where(F.trim("code") != "")
    top = deal(rows, parts, "code", pid).groupBy("code", pid).agg(F.count("*").alias("n")).groupBy("code").agg(
        F.sum("n").alias("n"), F.count(pid).alias("entities")).orderBy(F.col("n").desc(), "code").limit(k)
    key = F.replace(F.col("code"), F.lit("."), F.lit(""))
    book = lookup.select(F.col("code").alias("__key"), "description")
    # The left side is at most k rows, so it is the one to broadcast.
    found = book.join(F.broadcast(top.select(key.alias("__key")).distinct()), "__key", "left_semi")
    return top.withColumn("__key", key).join(found, "__key", "left").select(
        "code", F.coalesce("description", F.lit("[not in the lookup]")).alias("description"), "n", "entities")


def entities_without(entities: DataFrame, events: dict[str, DataFrame], pid: str) -> DataFrame:
    """Entities lacking each kind of event."""
    parts = [entities.select(pid).join(e.select(pid).distinct(), pid, "left_anti").agg(
        F.lit(name).alias("kind"), F.count("*").alias("entities")) for name, e in events.items()]
    return reduce(DataFrame.unionByName, parts)


def pair_uniqueness(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("pairs"))


def component_grain(df: DataFrame, pid: str, order: str, line: str, component: str) -> DataFrame:
    """Rows, orders, resulted components and orders without any."""
    per = df.groupBy(order).agg(F.count("*").alias("rows"), F.count(component).alias("components"))
    orders = per.agg(F.sum("rows").alias("rows"), F.count("*").alias("orders"), F.sum("components").alias("components"),
                     F.count_if(F.col("components") > 0).alias("resulted_orders"), F.count_if(F.col("components") == 0).alias("empty_orders"))
    people = df.agg(F.countDistinct(pid).alias("entities"))
    return orders.crossJoin(people).withColumns({  # one row each
        "rows_per_order": ratio(F.col("rows"), F.col("orders")), "components_per_order": ratio(F.col("components"), F.col("resulted_orders"))})


def top_procedures(df: DataFrame, pid: str, name: str, k: int = 25) -> DataFrame:
    """The ``k`` most frequent procedures with their rows and entities, and how many procedures there are."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name, pid).agg(F.count("*").alias("n")).groupBy(name).agg(
        F.sum("n").alias("procedure_rows"), F.count(pid).alias("procedure_entities"))
    top = counts.orderBy(F.col("procedure_rows").desc(), name).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("procedure_rows").desc(), name)))  # k rows
    return ranked.crossJoin(counts.agg(F.count("*").alias("procedures")))  # one row


def record_types(df: DataFrame, pid: str, kind: str, dates: list[str]) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("rows"), F.countDistinct(pid).alias("entities"),
                                *[(100.0 * F.count(d) / F.count("*")).alias(f"{d}_pct") for d in dates])


def name_shapes(df: DataFrame, name: str) -> DataFrame:
    """Names with emphasised capitals, and names that differ by case only."""
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("n")).distinct()
    variants = names.groupBy(F.lower("n").alias("l")).agg(F.count("*").alias("c"), F.count_if(F.col("n").rlike("[a-z][A-Z]{2,}")).alias("t"))
    return variants.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("emphasised"), F.count_if(F.col("c") > 1).alias("case_variants"))


def listing_with_age(df: DataFrame, pid: str, column: str, age: str, k: int = 25) -> DataFrame:
    """Most frequent values with entities and median age (ages are whole days)."""
    return df.where(F.trim(column) != "").groupBy(column).agg(
        F.count("*").alias("n"), F.countDistinct(pid).alias("entities"), (F.percentile(age, 0.5) / 365.25).alias("median_age")
    ).orderBy(F.col("n").desc(), column).limit(k)


def age_band_counts(df: DataFrame, age: str, bands, missing: list[str]) -> DataFrame:
    rows = df.groupBy(band_label(F.col(age), bands).alias("band")).agg(
        F.count("*").alias("n"), *[(100.0 * F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") / F.count("*")).alias(f"{c}_missing") for c in missing])
    return rows.where("band is not null")


def category_shares(df: DataFrame, cols: list[str], non_response: list[str], below: int = 10) -> DataFrame:
    """Suppressed category counts with non-answers marked."""
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("[blank]"))
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("category")) for c in cols])).alias("p")).select("p.*")
    counts = cells.groupBy("field", "category").agg(F.count("*").alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))  # one row per field
    shown = suppress(F.col("n"), below)
    return counts.join(F.broadcast(totals), "field").select(
        "field", "category", F.when(F.lower("category").isin(*[x.lower() for x in non_response]), "no answer").otherwise("recorded").alias("kind"),
        shown.alias("entities"), F.when(shown.isNotNull(), 100.0 * F.col("n") / F.col("total")).alias("share"))


def utilisation(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, 95 %, mean and maximum of a per-entity count."""
    return df.agg(*[F.percentile(column, p).alias(n) for n, p in [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)]],
                  F.avg(column).alias("mean"), F.max(column).alias("max_value"))


def flag_prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(f) == 1).alias(f) for f in flags])
    return row.unpivot(["total"], flags, "flag", "entities").withColumn("share", ratio(100.0 * F.col("entities"), F.col("total")))


def index_age_summary(df: DataFrame, flag: str, age: str) -> DataFrame:
    return df.where(F.col(flag) == 1).agg(F.count(age).alias("n"), F.percentile(age, 0.5).alias("median"),
                                         F.count_if(F.col(age) <= 1.0 / 12).alias("first_month"), F.count_if(F.col(age) < 0).alias("negative"))


def mean_of_summaries(df: DataFrame, channels: list[str]) -> DataFrame:
    parts = [df.where(F.col(f"count_{c}") > 1).agg(F.lit(c).alias("channel"), F.count("*").alias("entities"), F.avg(f"mean_{c}").alias("mean"),
                                                  F.avg(f"std_{c}").alias("std")) for c in channels]
    return reduce(DataFrame.unionByName, parts)


def recover_threshold(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Boundary between flagged and unflagged values, both ways round."""
    on, off = F.col(flag) == 1, F.col(flag) == 0
    return df.where(F.col(value).isNotNull()).agg(
        F.max(F.when(on, F.col(value))).alias("max_flagged"), F.min(F.when(off, F.col(value))).alias("min_unflagged"),
        F.min(F.when(on, F.col(value))).alias("min_flagged"), F.max(F.when(off, F.col(value))).alias("max_unflagged"))


def tracked_codes(pairs: DataFrame, pid: str, prefixes: list[str], derived: DataFrame, parts: int | None = None) -> DataFrame:
    """Literal, subtree and derived entity counts per tracked code; ``derived``: (prefix, derived)."""
    hit = matched_prefixes(pairs, prefixes).where(F.col(pid).isNotNull()).select("prefix", pid, (F.col("code") == F.col("prefix")).alias("literal"))
    counts = deal(hit, parts, "prefix", pid).groupBy("prefix", pid).agg(F.max("literal").alias("literal")).groupBy("prefix").agg(
        F.count_if("literal").alias("literal"), F.count("*").alias("subtree"))
    out = derived.join(F.broadcast(counts), "prefix", "left").fillna(0, ["literal", "subtree"])  # one row per prefix
    return out.withColumns({
        "hierarchical": F.col("derived") == F.col("subtree"),
        "flat_evidence": (F.col("subtree") > F.col("literal")) & (F.col("derived") == F.col("literal"))})


def pattern_families(df: DataFrame, pid: str, column: str, age: str, patterns: dict[str, list[str]]) -> DataFrame:
    """Rows per pattern family plus the residual of rows no family takes."""
    hit = matched_patterns(df, [F.lower(column)], patterns, "family")
    rows = hit.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct(pid).alias("entities"), (F.percentile(age, 0.5) / 365.25).alias("median_age"))
    none = ~like_any([F.lower(column)], [p for ps in patterns.values() for p in ps])
    rest = df.agg(F.lit("all other").alias("family"), F.count_if(none).alias("n"), F.lit(None).cast("long").alias("entities"), F.lit(None).cast("double").alias("median_age"))
    return rows.unionByName(rest)


def first_age_table(df: DataFrame, ages: dict[str, str], split: float = 2.0, below: int = 10) -> DataFrame:
    """Age at first record per code, suppressed together, with its side of the split."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.col(c).alias("age")) for n, c in ages.items()])).alias("p")).select("p.*")
    agg = tall.groupBy("code").agg(F.count("age").alias("n"), F.min("age").alias("lo"), F.percentile("age", 0.5).alias("med"), F.avg("age").alias("avg"), F.max("age").alias("hi"))
    shown = suppress(F.col("n"), below)
    ok = shown > 0
    return agg.select("code", shown.alias("aged"), *[F.when(ok, F.col(a)).alias(b) for a, b in [("lo", "min_age"), ("med", "median_age"), ("avg", "mean_age"), ("hi", "max_age")]],
                      F.when(ok, F.when(F.col("med") <= split, "early").otherwise("late")).alias("panel"))


def split_band(table: DataFrame) -> DataFrame:
    """The empty band around the split: nearest medians on either side."""
    return table.agg(F.max(F.when(F.col("panel") == "early", F.col("median_age"))).alias("band_lo"), F.min(F.when(F.col("panel") == "late", F.col("median_age"))).alias("band_hi"))


def panel_decomposition(df: DataFrame, age: str, split: float = 2.0) -> DataFrame:
    early, late = F.when(F.col(age) <= split, F.col(age)), F.when(F.col(age) > split, F.col(age))
    return df.agg(F.count(age).alias("n"), F.percentile(age, 0.5).alias("median"), F.avg(age).alias("mean"), F.count(early).alias("early_n"), F.avg(early).alias("early_mean"),
                  F.count(late).alias("late_n"), F.avg(late).alias("late_mean"))


def prior_counts(index: DataFrame, events: DataFrame, pid: str, age: str, index_age: str) -> DataFrame:
    """(entity, index age, n_before) for entities that have an index."""
    dated = index.where(F.col(index_age).isNotNull()).select(pid, index_age)
    return join_on(dated, events_before_index(events, dated, pid, age, index_age, "n_before"), [pid])


def prior_history(prior: DataFrame, index_age: str, bands: list[tuple[str, int, int | None]], split: float = 2.0) -> DataFrame:
    """Entities by number of events before the index, for the whole and both sides of the split."""
    side = F.when(F.col(index_age) <= split, "early").otherwise("late")
    rows = prior.select(F.explode(F.array(F.lit("whole"), side)).alias("stratum"),
                        band_label(F.col("n_before"), closed_bands(bands)).alias("band"), F.col(index_age).alias("age"))
    counts = rows.groupBy("stratum", "band").agg(F.count("*").alias("entities"))
    totals = rows.groupBy("stratum").agg(F.count("*").alias("total"), F.percentile("age", 0.5).alias("median_age"))  # three rows
    return counts.join(F.broadcast(totals), "stratum").withColumn("share", 100.0 * F.col("entities") / F.col("total"))


def use_by_stratum(df: DataFrame, stratum: Column, cols: list[str]) -> DataFrame:
    """Median and mean of per-entity counts per stratum."""
    return df.select(stratum.alias("stratum"), *cols).where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("entities"), *[
        x for c in cols for x in (F.percentile(c, 0.5).alias(f"median_{c}"), F.avg(c).alias(f"mean_{c}"))])


def joint_availability(df: DataFrame, a: str, b: str, age: str, bands) -> DataFrame:
    rows = df.withColumn("band", band_label(F.col(age), bands)).where("band is not null")
    both = 100.0 * F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) / F.count("*")
    return rows.groupBy("band").agg(F.count("*").alias("rows"), (100.0 * F.count(a) / F.count("*")).alias("share_a"), (100.0 * F.count(b) / F.count("*")).alias("share_b"),
                                    both.alias("both"), (100.0 * F.count(b) / F.count("*") - both).alias("gap"))


def flag_cooccurrence(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """Rate of each flag with and without the label, and their ratio."""
    rate = lambda f, v: ratio(100.0 * F.count_if((F.col(label) == v) & (F.col(f) == 1)), F.count_if(F.col(label) == v))
    row = df.agg(*[x for f in flags for x in (rate(f, 1).alias(f"y_{f}"), rate(f, 0).alias(f"n_{f}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"y_{f}").alias("labelled"), F.col(f"n_{f}").alias("unlabelled"),
                                                   ratio(F.col(f"y_{f}"), F.col(f"n_{f}")).alias("ratio")) for f in flags])).alias("r")).select("r.*")


def presence_by_label(entities: DataFrame, pid: str, label: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Share of entities with any record in each source, by label."""
    rows = entities.select(pid, label)
    for name, df in sources.items():
        rows = rows.join(df.select(pid).distinct().withColumn(name, F.lit(1)), pid, "left")
    return rows.groupBy(label).agg(F.count("*").alias("entities"), *[(100.0 * F.count(n) / F.count("*")).alias(n) for n in sources])


def first_marker(events: DataFrame, pid: str, age: str, columns: list[Column], patterns: dict[str, list[str]]) -> DataFrame:
    """First age of each marker per entity."""
    return matched_patterns(events, columns, patterns, "marker").groupBy("marker", pid).agg(F.min(age).alias("first_age"))


def _base_rate(labels: DataFrame, *cols: str) -> DataFrame:
    return labels.agg(*[(100.0 * F.avg(c)).alias(f"base_{c}") for c in cols])  # one row


def marker_lift(first: DataFrame, labels: DataFrame, pid: str, label: str, below: int = 10) -> DataFrame:
    """Entities, labelled share, lift over the base rate and median first age per marker."""
    rows = first.join(labels.select(pid, label), pid).groupBy("marker").agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("labelled"), (F.percentile("first_age", 0.5) / 365.25).alias("median_age"))
    share = 100.0 * F.col("labelled") / F.col("n")
    return rows.crossJoin(F.broadcast(_base_rate(labels, label))).select(
        "marker", suppress(F.col("n"), below).alias("entities"), "labelled", share.alias("share"), (share / F.col(f"base_{label}")).alias("lift"), "median_age")


def alternative_index(sources: list[DataFrame], pid: str, age: str) -> DataFrame:
    """First age over a union of marker events."""
    return reduce(DataFrame.unionByName, [s.select(pid, age) for s in sources]).where(F.col(age).isNotNull()).groupBy(pid).agg(F.min(age).alias("idx"))


def index_contrast(priors: dict[str, DataFrame]) -> DataFrame:
    """Prior history under each index definition."""
    return reduce(DataFrame.unionByName, [p.agg(
        F.lit(n).alias("index_name"), F.count("*").alias("entities"), F.count_if(F.col("n_before") == 0).alias("none"), F.count_if(F.col("n_before") >= 2).alias("two_or_more"),
        F.percentile("n_before", 0.5).alias("median_before")) for n, p in priors.items()])


def two_source_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """First records of two sources side by side: (keys, a, b) with nulls where absent."""
    fold = lambda df, n: df.where(F.col("age").isNotNull()).groupBy(*keys).agg(F.min("age").alias(n))
    return fold(left, "a").join(fold(right, "b"), keys, "full")


def two_source_compare(rows: DataFrame, tol: float = 0.01) -> DataFrame:
    """Which source is first and by how much, in days."""
    lead, lag = F.col("b") < F.col("a") - tol, F.col("b") > F.col("a") + tol
    gap = (F.col("a") - F.col("b")) * 365.25
    return rows.agg(
        F.count("*").alias("either"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if(lead).alias("right_earlier"), F.count_if(F.abs(F.col("a") - F.col("b")) <= tol).alias("same"),
        F.count_if(lag).alias("right_later"), F.percentile(F.when(lead, gap), 0.5).alias("lead_p50"), F.percentile(F.when(lead, gap), 0.9).alias("lead_p90"),
        F.percentile(F.when(lag, -gap), 0.5).alias("lag_p50"), F.percentile(F.when(lag, -gap), 0.9).alias("lag_p90"))


def two_source_by_code(rows: DataFrame, code: str, min_n: int = 10) -> DataFrame:
    return rows.groupBy(code).agg(
        F.count("*").alias("either"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull()).alias("right_only"), F.percentile((F.col("b") - F.col("a")) * 365.25, 0.5).alias("median_diff")).where(F.col("either") >= min_n)


def action_timing(first: DataFrame, index: DataFrame, pid: str, label: str, index_age: str, near: int = 30, below: int = 10) -> DataFrame:
    """Actions against the index: lift, share that came first, share close to it, median gap in days."""
    j = first.withColumn("ra", F.col("first_age") / 365.25).join(index.select(pid, label, index_age), pid)
    gap = (F.col("ra") - F.col(index_age)) * 365.25
    both = F.count(gap)
    rows = j.groupBy("marker").agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("labelled"), F.percentile("ra", 0.5).alias("median_age"), both.alias("both"),
        F.percentile(gap, 0.5).alias("median_gap"), ratio(100.0 * F.count_if(gap < 0), both).alias("first_share"), ratio(100.0 * F.count_if(F.abs(gap) <= near), both).alias("near_share"))
    return rows.crossJoin(F.broadcast(_base_rate(index, label))).select(
        "marker", suppress(F.col("n"), below).alias("entities"), "labelled", (100.0 * F.col("labelled") / F.col("n") / F.col(f"base_{label}")).alias("lift"),
        "median_age", "both", "median_gap", "first_share", "near_share")


def prior_by_presence(prior: DataFrame, action: DataFrame, pid: str) -> DataFrame:
    """Prior history of indexed entities with and without the action."""
    rows = prior.join(action.select(pid).distinct().withColumn("present", F.lit(True)), pid, "left").fillna(False, ["present"])
    return rows.groupBy("present").agg(F.count("*").alias("entities"), (100.0 * F.count_if(F.col("n_before") == 0) / F.count("*")).alias("none"),
                                      (100.0 * F.count_if(F.col("n_before") >= 2) / F.count("*")).alias("two_or_more"), F.percentile("n_before", 0.5).alias("median_before"))


def _scored(pairs: DataFrame, labels: DataFrame, pid: str, keys: list[str], label: str, second: str, below: int, withheld: Column,
            parts: int | None = None) -> DataFrame:
    rows = deal(pairs, parts, pid).join(labels.select(pid, label, second), pid).groupBy(*keys).agg(
        F.count("*").alias("entities"), F.sum(F.col(label).cast("long")).alias("labelled"), F.sum(F.col(second).cast("long")).alias("__second"))
    share = 100.0 * F.col("labelled") / F.col("entities")
    second_lift = F.when((F.col("__second") >= below) & ~withheld, 100.0 * F.col("__second") / F.col("entities") / F.col(f"base_{second}"))
    return rows.crossJoin(F.broadcast(_base_rate(labels, label, second))).select(
        *keys, "entities", "labelled", share.alias("share"), (share / F.col(f"base_{label}")).alias("lift"), second_lift.alias("second_lift"))


def value_screen(sources: dict[str, DataFrame], labels: DataFrame, pid: str, label: str, second: str, support: int = 200, k: int = 5,
                 index_terms: list[str] = (), below: int = 10, parts: int | None = None) -> DataFrame:
    """Every value of every field with enough entities, scored against both labels; top k per field.  ``parts`` tasks hold the distinct cells."""
    cells = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("field"), pid, F.col("value").cast("string").alias("value")) for n, df in sources.items()])
    pairs = deal(cells.where(F.trim("value") != ""), parts, "field", pid, "value").distinct()
    defines = reduce(Column.__or__, [F.upper("value").contains(x) for x in index_terms], F.lit(False))
    scored = _scored(pairs, labels, pid, ["field", "value"], label, second, below, defines, parts).where(F.col("entities") >= support)
    w = Window.partitionBy("field").orderBy(stabilize(F.col("lift")).desc(), "value")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cohort_score(cohorts: dict[str, DataFrame], labels: DataFrame, pid: str, label: str, second: str, below: int = 10) -> DataFrame:
    """Named cohorts scored against both labels."""
    pairs = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("cohort"), pid) for n, df in cohorts.items()]).distinct()
    return _scored(pairs, labels, pid, ["cohort"], label, second, below, F.lit(False)).withColumn("entities", suppress(F.col("entities"), below))


def code_screen(pairs: DataFrame, labels: DataFrame, pid: str, label: str, second: str, prefixes: list[str], support: int = 200,
                parts: int | None = None) -> DataFrame:
    """Codes with enough entities, split by whether the code is part of the label."""
    scored = _scored(pairs, labels, pid, ["code"], label, second, 10, F.lit(False), parts).where(F.col("entities") >= support)
    tracked = reduce(Column.__or__, [F.col("code").startswith(p) for p in prefixes])
    return scored.withColumns({"is_label": tracked, "perfect": tracked & (F.col("share") >= 100)})


def leak_test(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """How well ``a < b`` alone predicts the label."""
    hit, pos = F.col(a) < F.col(b), F.col(label) == 1
    return df.agg(F.count_if(hit).alias("shorter"), F.count_if(hit & pos).alias("shorter_labelled"), F.count_if(~hit).alias("equal"), F.count_if(~hit & pos).alias("equal_labelled"),
                  ratio(100.0 * F.count_if(hit & pos), F.count_if(hit)).alias("precision"),
                  ratio(100.0 * F.count_if(hit & pos), F.count_if(hit & pos) + F.count_if(~hit & pos)).alias("recall"))


def constructed_features(entities: DataFrame, pid: str, order_column: str, visits: DataFrame, age: str, measure: str, late: str, late_age: int, labs: DataFrame,
                         lab_order: str, lab_proc: str, medications: DataFrame, problems: DataFrame, problem_code: str, prefixes: list[str]) -> DataFrame:
    """One row per entity: visit rate, median gap, repeats, order counts and label-free problem counts.

    Visits fold to one row per entity and day; gaps of repeated rows on a day
    are zeros with a weight, so the median needs no row-level window.
    ``order_column`` is the explicit ordinal that stands for file order.
    """
    days = visits.groupBy(pid, age).agg(
        F.count("*").alias("n"), F.count(measure).alias("m"), F.count(F.when(F.col(age) > late_age, F.col(late))).alias("l"))
    gap = F.col(age) - F.lag(age).over(Window.partitionBy(pid).orderBy(age))
    steps = days.select(pid, "n", gap.cast("long").alias("gap")).select(pid, F.explode(F.array(
        F.struct("gap", F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("w")))).alias("s")
    ).select(pid, "s.gap", "s.w").where("gap is not null and w > 0")
    gaps = steps.groupBy(pid).agg(F.percentile("gap", 0.5, F.col("w")).alias("med_gap"))
    base = days.groupBy(pid).agg(
        (F.sum("n") / F.greatest(F.max(age) - F.min(age), F.lit(1)) * 365.25).alias("visits_per_year"), (F.sum("m") / F.sum("n")).alias("measured_share"),
        F.sum("l").alias("late_measures"), F.count_if(F.col("m") >= 2).alias("same_day"))
    lab = labs.groupBy(pid).agg(F.countDistinct(lab_order).alias("lab_orders"), F.countDistinct(lab_proc).alias("lab_procs"))
    med = medications.groupBy(pid).agg(F.count("*").alias("med_orders"))
    tracked = reduce(Column.__or__, [F.col(problem_code).startswith(p) for p in prefixes])
    prob = problems.groupBy(pid).agg(F.count("*").alias("problems_all"), F.count_if(~tracked).alias("problems_untracked"))
    out = entities.select(pid, F.col(order_column).alias("file_order"))
    for part in (base, gaps, lab, med, prob):
        out = out.join(part, pid, "left")
    return out.fillna(0, ["same_day", "lab_orders", "lab_procs", "med_orders", "problems_all", "problems_untracked"])


def auc_screen(df: DataFrame, cols: list[str], label: str, restrict: Column | None = None) -> DataFrame:
    """Rank AUC of every numeric column, for all entities and a restricted cohort."""
    cohort = F.array(F.lit("all")) if restrict is None else F.array_compact(F.array(F.lit("all"), F.when(restrict, F.lit("restricted"))))
    tall = df.select(F.col(label).alias("label"), F.explode(cohort).alias("cohort"), *[F.col(c).cast("double").alias(c) for c in cols]).select(
        "label", "cohort", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("p")).select("label", "cohort", "p.*")
    return rank_auc(tall, ["cohort", "column"], "label")


def split_coverage(df: DataFrame, label: str, age: str, split: float = 2.0) -> DataFrame:
    """How much of the dated positive class lies on the early side of the split."""
    dated = (F.col(label) == 1) & F.col(age).isNotNull()
    return df.agg(F.count_if(dated).alias("aged"), F.count_if(dated & (F.col(age) <= split)).alias("early"),
                  ratio(100.0 * F.count_if(dated & (F.col(age) <= split)), F.count_if(dated)).alias("early_share"))


def artifact_catalogue(parts: list[tuple[str, str, str, str, DataFrame]]) -> DataFrame:
    """One row per measured artifact: (id, name, kind, recoverable, frame with a single count ``n``)."""
    return reduce(DataFrame.unionByName, [df.select(
        F.lit(i).alias("finding_id"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(r).alias("recoverable"), F.col("n").cast("long").alias("scale"))
        for i, n, k, r, df in parts])
