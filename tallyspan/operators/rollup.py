"""Patient layer: one row per entity from its events and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import join_on

# Growth-related code prefixes.
GROWTH_PREFIXES = [
    "E03.9", "E10", "E22.0", "E23.0", "E23.6", "E24", "E30.0", "E30.1", "E34.3", "E34.4", "E72.11", "K50", "K51", "K90.0",
    "N18", "N25.0", "P04.3", "P05", "P07", "P70", "P92.6", "Q77", "Q78.0", "Q78.1", "Q87.1", "Q87.2", "Q87.3", "Q87.4",
    "Q90", "Q96", "Q98.0", "Q98.4", "Q98.5",
]


def ever_flags(df: DataFrame, pid: str, flags: list[str]) -> DataFrame:
    return df.groupBy(pid).agg(*[F.max(f).alias(f"ever_{f}") for f in flags])


def event_stats(df: DataFrame, pid: str, age: str) -> DataFrame:
    return df.groupBy(pid).agg(
        F.count(age).alias("visits_count"), F.min(age).alias("min_visit_age_days"), F.max(age).alias("max_visit_age_days"),
        (F.max(age) - F.min(age)).alias("visits_span_days"))


def channel_stats(df: DataFrame, pid: str, cols: list[str], digits: int = 4) -> DataFrame:
    """Count, mean, sample deviation, min and max of every channel in one aggregate."""
    out = []
    for c in cols:
        out += [F.count(c).alias(f"count_{c}"), F.round(F.avg(c), digits).alias(f"mean_{c}"),
                F.round(F.stddev_samp(c), digits).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(pid).agg(*out)


def all_codes(events: DataFrame, pid: str, age_years: str, slots: list[str], listed: DataFrame, noted_days: str, code: str) -> DataFrame:
    """Tall (entity, age, code) over slot columns and the problem list; undated rows keep a null age."""
    tall = events.select(pid, F.col(age_years).alias("age_in_years"), F.explode(F.array(*slots)).alias("code"))
    noted = listed.select(pid, F.round(F.col(noted_days) / 365.25, 3).alias("age_in_years"), F.col(code).alias("code"))
    return tall.unionByName(noted).where("code is not null")


def exact_code_flag(codes: DataFrame, pid: str, code_set: DataFrame, name: str) -> DataFrame:
    """Entities holding a listed code; unlisted entities are absent (default 0 on assembly)."""
    return codes.join(code_set.select("code").distinct(), "code", "left_semi").select(pid).distinct().withColumn(name, F.lit(1))


def matched_prefixes(codes: DataFrame, prefixes: list[str], code: str = "code", name: str = "prefix") -> DataFrame:
    """One row per (row, matching prefix): equi-join on the prefix text per prefix length.

    The distinct prefix lengths are few, so each code yields a handful of
    candidate heads; no pattern join is needed.
    """
    lengths = sorted({len(p) for p in prefixes})
    table = codes.sparkSession.createDataFrame([(p,) for p in prefixes], f"{name} string")
    # A head shorter than its length would repeat the whole code.
    heads = F.array_compact(F.array(*[F.when(F.length(code) >= n, F.substring(code, 1, n)) for n in lengths]))
    return codes.withColumn(name, F.explode(heads)).join(F.broadcast(table), name)  # len(prefixes) rows


def prefix_code_flag(codes: DataFrame, pid: str, prefixes: list[str], name: str) -> DataFrame:
    return matched_prefixes(codes, prefixes).select(pid).distinct().withColumn(name, F.lit(1))


def prefix_column(prefix: str) -> str:
    return "dx_age_years_" + prefix.lower().replace(".", "_")


def first_age_by_prefix(codes: DataFrame, pid: str, age: str, prefixes: list[str]) -> DataFrame:
    """One first-age column per prefix; undated rows give no age."""
    hit = matched_prefixes(codes.where(F.col(age).isNotNull()), prefixes)
    return hit.groupBy(pid).agg(*[
        F.min(F.when(F.col("prefix") == p, F.col(age))).alias(prefix_column(p)) for p in prefixes])


def first_age_any(df: DataFrame, cols: list[str], name: str = "dx_age_years") -> DataFrame:
    return df.withColumn(name, F.least(*cols) if len(cols) > 1 else F.col(cols[0]))


def events_before_index(events: DataFrame, index: DataFrame, pid: str, age: str, index_age: str,
                        name: str = "visits_count_pre_dx") -> DataFrame:
    """Events strictly before the index age; all events without one, 0 if only an index exists.

    Events fold to counts per (entity, age) before the join, so an entity with
    many events moves few rows.
    """
    folded = events.groupBy(pid, age).agg(F.count("*").alias("__n"))
    j = join_on(index.select(pid, index_age), folded, [pid], "left")
    before = F.sum(F.when(F.col(index_age).isNull() | (F.col(age) < F.col(index_age)), F.col("__n")))
    return j.groupBy(pid).agg(
        F.when(F.max(index_age).isNotNull(), F.coalesce(before, F.lit(0))).otherwise(before).alias(name))


def all_clear_flag(df: DataFrame, flags: list[str], name: str = "healthy_flag") -> DataFrame:
    """1 when every flag is known and 0."""
    clear = reduce(Column.__and__, [F.coalesce(F.col(f) == 0, F.lit(False)) for f in flags])
    return df.withColumn(name, clear.cast("int"))


def entity_summary(entities: DataFrame, pid: str, parts: list[DataFrame], defaults: dict[str, int], order: list[str] | None = None) -> DataFrame:
    """Left-join all parts on the entity key and fill the counted defaults."""
    out = reduce(lambda d, p: join_on(d, p, [pid], "left"), parts, entities).fillna(defaults)
    return out.select(*order) if order else out


def derive_patients(patients: DataFrame, visits: DataFrame, codes: DataFrame, chronic: DataFrame,
                    z_cols: list[str], prefixes: list[str] = GROWTH_PREFIXES) -> DataFrame:
    """Whole patient layer from the derived visits and the tall codes."""
    from .derive import clean_categories

    pid = "patient_id"
    flags = ["stunting_flag", "wasting_flag", "underweight_flag", "obesity_flag"]
    ages = [prefix_column(p) for p in prefixes]
    # Events, flags and channels share one aggregate over the visits.
    events = visits.groupBy(pid).agg(
        F.count("age_in_days").alias("visits_count"), F.min("age_in_days").alias("min_visit_age_days"),
        F.max("age_in_days").alias("max_visit_age_days"),
        (F.max("age_in_days") - F.min("age_in_days")).alias("visits_span_days"),
        *[F.max(f).alias(f"ever_{f}") for f in flags],
        *[a for c in z_cols for a in (
            F.count(c).alias(f"count_{c}"), F.round(F.avg(c), 4).alias(f"mean_{c}"),
            F.round(F.stddev_samp(c), 4).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])
    race = [c for c in patients.columns if c.startswith("race_")]
    people = clean_categories(patients, ["ethnicity", *race])
    summary = entity_summary(people, pid, [
        events, exact_code_flag(codes, pid, chronic, "chronic_dx_flag"),
        prefix_code_flag(codes, pid, prefixes, "growth_dx_flag"),
        first_age_by_prefix(codes, pid, "age_in_years", prefixes)],
        {"visits_count": 0, "chronic_dx_flag": 0, "growth_dx_flag": 0})
    summary = first_age_any(summary, ages)
    pre = events_before_index(visits, summary, pid, "age_in_years", "dx_age_years")
    summary = join_on(summary, pre, [pid], "left")
    return all_clear_flag(summary, ["chronic_dx_flag", "growth_dx_flag", *[f"ever_{f}" for f in flags]])
