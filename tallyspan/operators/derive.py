"""Visit-layer derivation: units, reference scores, plausibility, flags and velocity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import step_value
from ..functions.growthref import lms_zscore, percentile_from_z
from ..functions.storage import broadcast_if_small, join_on, split_hot

# Answers that carry no information, matched exactly.
NON_RESPONSE = ["Choose not to answer", "Choose not to Answer", "Patient does not know", "Unknown", "Unable to collect"]
DAYS_PER_MONTH, DAYS_PER_YEAR = 30.4375, 365.25
OZ_PER_KG, CM_PER_INCH = 35.274, 2.54
# Smallest accepted gap in days, by age at the later measurement.
WEIGHT_GAPS = ([(365, 30), (730, 90), (4380, 180)], 180)
HEIGHT_GAPS = ([(365, 90), (730, 180), (4380, 335)], 180)


def clean_categories(df: DataFrame, cols: list[str], drop: list[str] = NON_RESPONSE) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*drop), F.col(c)) for c in cols})


def attach_entity(events: DataFrame, entities: DataFrame, pid: str, cols: list[str]) -> DataFrame:
    """Left-join entity columns; broadcast only if the entity table was counted small."""
    return join_on(events, broadcast_if_small(entities.select(pid, *cols)), [pid], "left")


def add_ages(df: DataFrame, age: str) -> DataFrame:
    return df.withColumns({"age_in_months": F.round(F.col(age) / DAYS_PER_MONTH, 2),
                           "age_in_years": F.round(F.col(age) / DAYS_PER_YEAR, 3)})


def add_metric_units(df: DataFrame, weight_oz: str = "weight_oz", height_in: str = "height_in") -> DataFrame:
    return df.withColumns({"weight_kg": F.round(F.col(weight_oz) / OZ_PER_KG, 3),
                           "height_cm": F.round(F.col(height_in) * CM_PER_INCH, 3)})


def filter_implausible(df: DataFrame, value: str, z: str, lo: float, hi: float) -> DataFrame:
    """Null both value and score where the score lies outside [lo, hi]."""
    keep = F.col(z).isNull() | F.col(z).between(lo, hi)
    return df.withColumns({value: F.when(keep, F.col(value)), z: F.when(keep, F.col(z))})


def add_bmi(df: DataFrame, kg: str, cm: str, months: str, name: str = "bmi") -> DataFrame:
    ok = (F.col(months) >= 24) & (F.col(cm) > 0)
    return df.withColumn(name, F.when(ok, F.col(kg) / F.pow(F.col(cm) / 100, 2)))


def conditional_zscore(df: DataFrame, value: str, key: str, sex: str, lo: float, hi: float, grid: DataFrame,
                       grid_key: str, name: str) -> DataFrame:
    """Score against a size-for-size grid only inside the inclusive key range."""
    return lms_zscore(df, value, key, sex, grid, grid_key, name, when=F.col(key).between(lo, hi))


def cut_code(df: DataFrame) -> DataFrame:
    """The same rows in the same tasks, with generated code that starts anew.

    Scores on a wide table chain joins and projections; from a certain length on the JVM interprets their code
    instead of compiling it.  Coalescing to more tasks than there are moves nothing and ends the chain.  The tasks
    are no longer known to hold whole entities, so it comes after the windows.
    """
    return df.coalesce(1 << 30)


def channel_zscores(df: DataFrame, sex: str, channels: list[tuple[str, str, DataFrame, str, str]]) -> DataFrame:
    """Several scores in a row: (value, key, grid, grid key, name)."""
    return reduce(lambda d, c: cut_code(lms_zscore(d, c[0], c[1], sex, c[2], c[3], c[4])), channels, df)


def bin_category(col: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bins; edges exclude the two infinite ends."""
    out = F.when(col < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(col < edge, label)
    return F.when(col.isNotNull() & ~F.isnan(col), out.otherwise(labels[-1]))


BMI_EDGES = [5.0, 85.0, 95.0, 120.0]
BMI_LABELS = ["underweight", "normal", "overweight", "obese", "severe_obesity"]


def add_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """0/1 flags; an unknown condition counts as 0."""
    return df.withColumns({n: F.coalesce(c, F.lit(False)).cast("int") for n, c in rules.items()})


def growth_flags() -> dict[str, Column]:
    return {
        "stunting_flag": F.col("height_z_score") < -2,
        "wasting_flag": F.coalesce(F.col("weight_for_length_z_score") < -2, F.lit(False))
        | F.coalesce(F.col("weight_for_stature_z_score") < -2, F.lit(False)),
        "obesity_flag": F.col("bmi_percentile") >= 95,
        "underweight_flag": F.col("bmi_percentile") < 5,
    }


def as_of(row_gap: Column, gaps: list[int], pid: str, age: str, entry: Column) -> Column:
    """Latest entry at least the row's gap earlier: one range frame per distinct gap."""
    w = Window.partitionBy(pid).orderBy(age)
    out = F.when(F.lit(False), F.max(entry).over(w.rangeBetween(Window.unboundedPreceding, -gaps[0])))
    for g in gaps:
        out = out.when(row_gap == g, F.max(entry).over(w.rangeBetween(Window.unboundedPreceding, -g)))
    return out


def min_gap_velocity(df: DataFrame, pid: str, age: str, tie: str, specs: dict[str, tuple[str, tuple]], year: float = 365.0,
                     digits: int = 2, bounded: bool = False) -> DataFrame:
    """Change since the latest measurement at least a minimum gap earlier.

    ``specs``: name -> (value column, (age steps, default gap)).  Adds
    ``delta_<n>``, ``gap_<n>`` and ``velocity_<n>``.  Ordinary entities use
    range frames over their rows; hot ones are folded to one row per day
    first, so a window never holds more than the days of a lifetime.
    ``bounded`` skips the size check when the caller already made it.
    """

    def gap_of(rule) -> tuple[Column, list[int]]:
        steps, default = rule
        return step_value(F.col(age), steps, default), sorted({g for _, g in steps} | {default})

    def finish(rows: DataFrame) -> DataFrame:
        out = {}
        for n, (value, _) in specs.items():
            prior = F.col(f"__p_{n}")
            diff, gap = F.col(value) - prior["v"], F.col(age) - prior["a"]
            out[f"delta_{n}"], out[f"gap_{n}"] = F.round(diff, digits), gap
            out[f"velocity_{n}"] = F.round(diff / gap * year, digits)
        return rows.withColumns(out).drop(*[f"__p_{n}" for n in specs])

    def plain(rows: DataFrame) -> DataFrame:
        cols = {}
        for n, (value, rule) in specs.items():
            entry = F.when(F.col(value).isNotNull(), F.struct(F.col(age).alias("a"), F.col(tie).alias("t"), F.col(value).alias("v")))
            cols[f"__p_{n}"] = F.when(F.col(value).isNotNull(), as_of(*gap_of(rule), pid, age, entry))
        return finish(rows.withColumns(cols))

    def by_day(rows: DataFrame) -> DataFrame:
        days = rows.groupBy(pid, age).agg(*[
            F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(age).alias("a"), F.col(tie).alias("t"), F.col(v).alias("v"))))
            .alias(f"__d_{n}") for n, (v, _) in specs.items()])
        prior = days.select(pid, age, *[
            as_of(*gap_of(rule), pid, age, F.col(f"__d_{n}")).alias(f"__q_{n}") for n, (_, rule) in specs.items()])
        both = join_on(rows, prior, [pid, age], "left")
        return finish(both.withColumns({f"__p_{n}": F.when(F.col(v).isNotNull(), F.col(f"__q_{n}")) for n, (v, _) in specs.items()})
                      .drop(*[f"__q_{n}" for n in specs]))

    ordinary, hot = (df, None) if bounded else split_hot(df, [pid])
    return plain(ordinary) if hot is None else plain(ordinary).unionByName(by_day(hot))


def velocity_zscores(df: DataFrame, velocity: str, years: str, sex: str, grids: dict[str, DataFrame]) -> DataFrame:
    """Score and percentile of a velocity against each alternative reference."""
    for suffix, grid in grids.items():
        z = f"{velocity}_z_score{suffix}"
        df = lms_zscore(df, velocity, years, sex, grid, "Ageyrs", z)
        df = cut_code(df.withColumn(f"{velocity}_percentile{suffix}", percentile_from_z(F.col(z))))
    return df


def derive_visits(visits: DataFrame, patients: DataFrame, grids: dict[str, DataFrame], filter_errors: bool = True) -> DataFrame:
    """The whole visit layer in its fixed order: outlier flags before the
    plausibility filter, velocity after it."""
    from .outliers import WEIGHT_THRESHOLDS, outlier_flags

    # No step changes the rows of an entity, so one size check serves all.
    bounded = split_hot(visits.select("patient_id"), ["patient_id"])[1] is None
    if bounded:
        # The velocity window needs this partitioning anyway; shuffling the raw
        # columns first is cheaper than shuffling the derived ones later.
        visits = visits.repartition("patient_id")
    people = clean_categories(patients, ["ethnicity", "race_1"])
    d = attach_entity(visits.drop("bmi", "bmi_percentile"), people, "patient_id", ["sex", "ethnicity", "race_1"])
    d = add_metric_units(add_ages(d, "age_in_days"))
    d = outlier_flags(d, "patient_id", "age_in_years", "visit_id", {
        "height_outlier_flag": ("height_cm", None), "weight_outlier_flag": ("weight_kg", WEIGHT_THRESHOLDS)}, bounded)
    d = lms_zscore(d, "weight_kg", "age_in_months", "sex", grids["weight_age"], "Agemos", "weight_z_score")
    if filter_errors:
        d = filter_implausible(d, "weight_kg", "weight_z_score", -5, 5)
    d = lms_zscore(d, "height_cm", "age_in_months", "sex", grids["height_age"], "Agemos", "height_z_score")
    if filter_errors:
        d = filter_implausible(d, "height_cm", "height_z_score", -5, 3)
    before = d.columns
    # The velocities need nothing that follows; here the rows still lie by entity.
    d = min_gap_velocity(d, "patient_id", "age_in_days", "visit_id", {
        "weight": ("weight_kg", WEIGHT_GAPS), "height": ("height_cm", HEIGHT_GAPS)}, bounded=bounded)
    velocities = [c for c in d.columns if c not in before]
    d = cut_code(add_bmi(d, "weight_kg", "height_cm", "age_in_months"))
    d = channel_zscores(d, "sex", [
        ("bmi", "age_in_months", grids["bmi_age"], "Agemos", "bmi_z_score"),
        ("head_circ_cm", "age_in_months", grids["head_age"], "Agemos", "head_circ_z_score")])
    d = cut_code(conditional_zscore(d, "weight_kg", "height_cm", "sex", 45, 103.5, grids["weight_length"], "Length", "weight_for_length_z_score"))
    d = cut_code(conditional_zscore(d, "weight_kg", "height_cm", "sex", 77, 121.5, grids["weight_stature"], "Height", "weight_for_stature_z_score"))
    for c in ["weight", "height", "bmi", "head_circ", "weight_for_length", "weight_for_stature"]:
        d = cut_code(d.withColumn(f"{c}_percentile", percentile_from_z(F.col(f"{c}_z_score"))))
    d = d.withColumn("bmi_category", bin_category(F.col("bmi_percentile"), BMI_EDGES, BMI_LABELS))
    d = add_flags(d, growth_flags())
    d = d.select(*[c for c in d.columns if c not in velocities], *velocities)  # the order of the layer
    return velocity_zscores(d, "velocity_height", "age_in_years", "sex", {
        "": grids["velocity_no"], "_ep": grids["velocity_early"], "_ap": grids["velocity_average"], "_lp": grids["velocity_late"]})
