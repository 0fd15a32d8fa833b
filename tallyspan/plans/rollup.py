"""Patient-layer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..operators import derive, rollup as op
from .registry import query
from .roles import Tables, with_roles

PID = "patient_id"
# Prefixes that the bound code vocabulary can hold at three depths.
PREFIXES = op.GROWTH_PREFIXES
CHRONIC = "SELECT DISTINCT code FROM (SELECT code, slot FROM visit_codes) c WHERE substr(code, 2, 2) IN ('10', '20', '30')"
CODES_CTE = """codes AS (SELECT patient_id, round(age_in_days / 365.25e0, 3) AS age_in_years, code FROM visit_codes
    UNION ALL SELECT patient_id, round(noted_age / 365.25e0, 3), pl_diag FROM problem_list WHERE pl_diag IS NOT NULL)"""
FLAGS_CTE = """flagged AS (SELECT *, cast(coalesce(bmi_percentile >= 95, false) AS INT) AS obesity_flag,
      cast(coalesce(bmi_percentile < 5, false) AS INT) AS underweight_flag FROM visits)"""


def codes(t: Tables) -> DataFrame:
    lines = t.visit_codes.withColumn("age_in_years", F.round(F.col("age_in_days") / 365.25, 3))
    return op.all_codes(lines, PID, "age_in_years", ["code"], t.problem_list, "noted_age", "pl_diag")


def chronic(t: Tables) -> DataFrame:
    return t.visit_codes.where(F.substring("code", 2, 2).isin("10", "20", "30")).select("code").distinct()


def flagged(t: Tables) -> DataFrame:
    return derive.add_flags(t.visits, {"obesity_flag": F.col("bmi_percentile") >= 95, "underweight_flag": F.col("bmi_percentile") < 5})


@query("d20_ever_flags", with_roles("""SELECT patient_id, max(obesity_flag) AS ever_obesity_flag, max(underweight_flag) AS ever_underweight_flag
    FROM flagged GROUP BY 1""", "visits", ctes=FLAGS_CTE))
def d20(t: Tables) -> DataFrame:
    return op.ever_flags(flagged(t), PID, ["obesity_flag", "underweight_flag"])


@query("d21_event_stats", with_roles("""SELECT patient_id, count(age_in_days) AS visits_count, min(age_in_days) AS min_visit_age_days,
    max(age_in_days) AS max_visit_age_days, max(age_in_days) - min(age_in_days) AS visits_span_days FROM visits GROUP BY 1""", "visits"))
def d21(t: Tables) -> DataFrame:
    return op.event_stats(t.visits, PID, "age_in_days")


@query("d22_channel_stats", with_roles("SELECT patient_id, " + ", ".join(
    f"count({c}) AS count_{c}, round(avg({c}), 4) AS mean_{c}, round(stddev_samp({c}), 4) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}"
    for c in ("weight_oz", "bmi_percentile")) + " FROM visits GROUP BY 1", "visits"))
def d22(t: Tables) -> DataFrame:
    return op.channel_stats(t.visits, PID, ["weight_oz", "bmi_percentile"])


@query("d23_all_codes", with_roles("SELECT patient_id, age_in_years, code, count(*) AS n FROM codes GROUP BY ALL", "visit_codes", "problem_list", ctes=CODES_CTE))
def d23(t: Tables) -> DataFrame:
    return codes(t).groupBy(PID, "age_in_years", "code").agg(F.count("*").alias("n"))


@query("d24_exact_code_flag", with_roles(f"SELECT DISTINCT patient_id, 1 AS chronic_dx_flag FROM codes WHERE code IN ({CHRONIC})",
                                         "visit_codes", "problem_list", ctes=CODES_CTE))
def d24(t: Tables) -> DataFrame:
    return op.exact_code_flag(codes(t), PID, chronic(t), "chronic_dx_flag")


_ANY = " OR ".join(f"starts_with(code, '{p}')" for p in PREFIXES)


@query("d25_prefix_code_flag", with_roles(f"SELECT DISTINCT patient_id, 1 AS growth_dx_flag FROM codes WHERE {_ANY}",
                                          "visit_codes", "problem_list", ctes=CODES_CTE))
def d25(t: Tables) -> DataFrame:
    return op.prefix_code_flag(codes(t), PID, PREFIXES, "growth_dx_flag")


_FIRST = ", ".join(f"min(age_in_years) FILTER (starts_with(code, '{p}')) AS {op.prefix_column(p)}" for p in PREFIXES)
FIRST_CTE = f"firsts AS (SELECT patient_id, {_FIRST} FROM codes WHERE age_in_years IS NOT NULL AND ({_ANY}) GROUP BY 1)"


@query("d26_first_age_by_prefix", with_roles("SELECT * FROM firsts", "visit_codes", "problem_list", ctes=f"{CODES_CTE}, {FIRST_CTE}"))
def d26(t: Tables) -> DataFrame:
    return op.first_age_by_prefix(codes(t), PID, "age_in_years", PREFIXES)


_LEAST = "least(" + ", ".join(op.prefix_column(p) for p in PREFIXES) + ")"


def index_ages(t: Tables) -> DataFrame:
    first = op.first_age_by_prefix(codes(t), PID, "age_in_years", PREFIXES)
    return op.first_age_any(first, [op.prefix_column(p) for p in PREFIXES])


@query("d27_first_age_any", with_roles(f"SELECT patient_id, {_LEAST} AS dx_age_years FROM firsts", "visit_codes", "problem_list",
                                       ctes=f"{CODES_CTE}, {FIRST_CTE}"))
def d27(t: Tables) -> DataFrame:
    return index_ages(t).select(PID, "dx_age_years")


_PRE = f"""pre AS (SELECT p.patient_id, d.dx AS dx_age_years, CASE WHEN d.dx IS NOT NULL THEN count(v.patient_id) FILTER (v.age_years < d.dx)
      WHEN count(v.patient_id) > 0 THEN count(v.patient_id) END AS visits_count_pre_dx
    FROM patients p LEFT JOIN (SELECT patient_id, {_LEAST} AS dx FROM firsts) d ON p.patient_id = d.patient_id
    LEFT JOIN (SELECT patient_id, round(age_in_days / 365.25e0, 3) AS age_years FROM visits) v ON p.patient_id = v.patient_id GROUP BY p.patient_id, d.dx)"""


@query("d28_events_before_index", with_roles("SELECT patient_id, visits_count_pre_dx FROM pre", "patients", "visits", "visit_codes", "problem_list",
                                             ctes=f"{CODES_CTE}, {FIRST_CTE}, {_PRE}"))
def d28(t: Tables) -> DataFrame:
    people = t.patients.select(PID).join(index_ages(t).select(PID, "dx_age_years"), PID, "left")
    events = derive.add_ages(t.visits, "age_in_days")
    return op.events_before_index(events, people, PID, "age_in_years", "dx_age_years")


_HEALTHY = f"""SELECT p.patient_id, cast(coalesce(chronic, 0) = 0 AND coalesce(growth, 0) = 0 AND coalesce(ob = 0, false) AND coalesce(un = 0, false) AS INT) AS healthy_flag
    FROM patients p LEFT JOIN (SELECT patient_id, 1 AS chronic FROM codes WHERE code IN ({CHRONIC}) GROUP BY 1) c USING (patient_id)
    LEFT JOIN (SELECT patient_id, 1 AS growth FROM codes WHERE {_ANY} GROUP BY 1) g USING (patient_id)
    LEFT JOIN (SELECT patient_id, max(obesity_flag) AS ob, max(underweight_flag) AS un FROM flagged GROUP BY 1) e USING (patient_id)"""


@query("d29_all_clear_flag", with_roles(_HEALTHY, "patients", "visits", "visit_codes", "problem_list", ctes=f"{CODES_CTE}, {FLAGS_CTE}"))
def d29(t: Tables) -> DataFrame:
    c = codes(t)
    rows = op.entity_summary(t.patients.select(PID), PID, [
        op.exact_code_flag(c, PID, chronic(t), "chronic"), op.prefix_code_flag(c, PID, PREFIXES, "growth"),
        op.ever_flags(flagged(t), PID, ["obesity_flag", "underweight_flag"])], {"chronic": 0, "growth": 0})
    return op.all_clear_flag(rows, ["chronic", "growth", "ever_obesity_flag", "ever_underweight_flag"]).select(PID, "healthy_flag")


_SUMMARY = ["patient_id", "sex", "chronic_dx_flag", "visits_count", "visits_count_pre_dx", "min_visit_age_days", "max_visit_age_days", "visits_span_days"]


@query("d30_entity_summary", with_roles(f"""SELECT p.patient_id, sex, coalesce(chronic, 0) AS chronic_dx_flag, coalesce(n, 0) AS visits_count,
      visits_count_pre_dx, a AS min_visit_age_days, b AS max_visit_age_days, b - a AS visits_span_days
    FROM patients p LEFT JOIN (SELECT patient_id, 1 AS chronic FROM codes WHERE code IN ({CHRONIC}) GROUP BY 1) c USING (patient_id)
    LEFT JOIN (SELECT patient_id, count(*) AS n, min(age_in_days) AS a, max(age_in_days) AS b FROM visits GROUP BY 1) e USING (patient_id)
    LEFT JOIN pre USING (patient_id)""", "patients", "visits", "visit_codes", "problem_list", ctes=f"{CODES_CTE}, {FIRST_CTE}, {_PRE}"))
def d30(t: Tables) -> DataFrame:
    c = codes(t)
    index = op.first_age_any(op.first_age_by_prefix(c, PID, "age_in_years", PREFIXES), [op.prefix_column(p) for p in PREFIXES])
    people = t.patients.select(PID).join(index.select(PID, "dx_age_years"), PID, "left")
    pre = op.events_before_index(derive.add_ages(t.visits, "age_in_days"), people, PID, "age_in_years", "dx_age_years")
    return op.entity_summary(t.patients.select(PID, "sex"), PID, [
        op.exact_code_flag(c, PID, chronic(t), "chronic_dx_flag"), op.event_stats(t.visits, PID, "age_in_days"), pre],
        {"visits_count": 0, "chronic_dx_flag": 0}, _SUMMARY)


@query("d31_derived_layers")
def d31(t: Tables) -> DataFrame:
    """Both derived layers end to end: visits, then the patient roll-up."""
    from .derivation import grids

    # Both inputs of the roll-up are read several times, so each is written once.
    visits = materialize(derive.derive_visits(t.visits, t.patients, grids(t)), "visits")
    tall = materialize(codes(t), "codes")
    z = [f"{c}_z_score" for c in ("weight", "height", "bmi", "head_circ", "weight_for_length", "weight_for_stature")]
    return op.derive_patients(t.patients.drop("label", "label2", "balance"), visits, tall, chronic(t), z)
