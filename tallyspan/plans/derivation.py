"""Visit-layer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.growthref import lms_value, lms_zscore
from ..functions.storage import materialize
from ..functions.stats import TAIL_P, TAIL_Q
from ..operators import derive as op
from ..operators import outliers
from .registry import query
from .roles import Tables, with_roles
from .sources import GRIDS, grid, grid_cte

BASE_CTE = """base AS (SELECT v.*, p.sex, round(age_in_days / 30.4375e0, 2) AS age_in_months, round(age_in_days / 365.25e0, 3) AS age_in_years,
    round(weight_oz / 35.274e0, 3) AS weight_kg, round(height_in * 2.54e0, 3) AS height_cm
    FROM visits v LEFT JOIN patients p ON v.patient_id = p.patient_id)"""


def base(t: Tables) -> DataFrame:
    joined = op.attach_entity(t.visits, t.patients, "patient_id", ["sex"])
    return op.add_metric_units(op.add_ages(joined, "age_in_days"))


def grids(t: Tables) -> dict[str, DataFrame]:
    return {kind: grid(t, kind) for kind in GRIDS}


def seg_cte(kind: str, name: str) -> str:
    key = GRIDS[kind][0]
    lead = lambda c: f'coalesce(lead("{c}") OVER w, "{c}")'
    return f"""{grid_cte(kind, 'grid_' + name)},
    seg_{name} AS (SELECT "Sex" AS sx, "{key}" AS lo, {lead(key)} AS hi, lead("{key}") OVER w IS NULL AS fin, "L" AS l0, {lead('L')} AS l1,
      "M" AS m0, {lead('M')} AS m1, "S" AS s0, {lead('S')} AS s1, min("{key}") OVER (PARTITION BY "Sex") AS kmin,
      max("{key}") OVER (PARTITION BY "Sex") AS kmax FROM grid_{name} WINDOW w AS (PARTITION BY "Sex" ORDER BY "{key}"))"""


def lms_cte(source: str, key: str, name: str, out: str, clamp: bool = True) -> str:
    x = f"least(b.{key}, s.kmax)" if clamp else f"b.{key}"
    limit = "" if clamp else f" AND b.{key} <= s.kmax"
    tt = f"CASE WHEN s.hi > s.lo THEN ({x} - s.lo) / (s.hi - s.lo) ELSE 0e0 END"
    return f"""{out} AS (SELECT b.*, s.l0 + (s.l1 - s.l0) * {tt} AS xl, s.m0 + (s.m1 - s.m0) * {tt} AS xm, s.s0 + (s.s1 - s.s0) * {tt} AS xs
      FROM {source} b LEFT JOIN seg_{name} s ON s.sx = b.sex AND {x} >= s.lo AND ({x} < s.hi OR s.fin){limit})"""


def z_sql(v: str) -> str:
    return f"""CASE WHEN xm > 0 AND xs > 0 AND {v} > 0 THEN round(CASE WHEN abs(xl) < 1e-6 THEN ln({v} / xm) / xs
      ELSE (pow({v} / xm, xl) - 1) / (xl * xs) END, 4) END"""


def _poly_sql(c: list[float], x: str) -> str:
    top = len(c) - 1
    return " + ".join(f"{v!r}::DOUBLE * pow({x}, {top - i})" for i, v in enumerate(c))


def phi_sql(z: str) -> str:
    tail = f"(CASE WHEN abs({z}) < 7.07e0 THEN exp(-{z} * {z} / 2) * ({_poly_sql(TAIL_P, f'abs({z})')}) / ({_poly_sql(TAIL_Q, f'abs({z})')}) ELSE 0e0 END)"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


@query("d01_clean_categories", with_roles("""SELECT patient_id,
    CASE WHEN ethnicity NOT IN ('Unknown', 'Choose not to answer') THEN ethnicity END AS ethnicity,
    CASE WHEN race_1 <> 'Unable to collect' THEN race_1 END AS race_1, race_2,
    CASE WHEN race_3 <> 'Unknown' THEN race_3 END AS race_3 FROM patients""", "patients"))
def d01(t: Tables) -> DataFrame:
    return op.clean_categories(t.patients, ["ethnicity", "race_1", "race_2", "race_3"]).select(
        "patient_id", "ethnicity", "race_1", "race_2", "race_3")


@query("d02_attach_entity", with_roles("""SELECT visit_id, v.patient_id, sex, race_1 FROM visits v
    LEFT JOIN patients p ON v.patient_id = p.patient_id""", "visits", "patients"))
def d02(t: Tables) -> DataFrame:
    return op.attach_entity(t.visits, t.patients, "patient_id", ["sex", "race_1"]).select("visit_id", "patient_id", "sex", "race_1")


@query("d03_add_ages", with_roles("SELECT visit_id, age_in_months, age_in_years FROM base", "visits", "patients", ctes=BASE_CTE))
def d03(t: Tables) -> DataFrame:
    return op.add_ages(t.visits, "age_in_days").select("visit_id", "age_in_months", "age_in_years")


@query("d04_add_metric_units", with_roles("SELECT visit_id, weight_kg, height_cm FROM base", "visits", "patients", ctes=BASE_CTE))
def d04(t: Tables) -> DataFrame:
    return op.add_metric_units(t.visits).select("visit_id", "weight_kg", "height_cm")


def _ctes(*parts: str) -> str:
    return ", ".join(parts)


@query("d05_lms_zscore", with_roles(f"SELECT visit_id, {z_sql('weight_kg')} AS weight_z_score FROM l", "visits", "patients",
                                    ctes=_ctes(BASE_CTE, seg_cte("weight_age", "w"), lms_cte("base", "age_in_months", "w", "l"))))
def d05(t: Tables) -> DataFrame:
    return lms_zscore(base(t), "weight_kg", "age_in_months", "sex", grid(t, "weight_age"), "Agemos", "weight_z_score").select(
        "visit_id", "weight_z_score")


@query("d06_percentile_from_z", with_roles(f"SELECT visit_id, z, round(100 * ({phi_sql('z')}), 5) AS p FROM (SELECT visit_id, {z_sql('height_cm')} AS z FROM l) q",
                                           "visits", "patients", ctes=_ctes(
        BASE_CTE, seg_cte("height_age", "h"), lms_cte("base", "age_in_months", "h", "l"))))
def d06(t: Tables) -> DataFrame:
    from ..functions.stats import normal_cdf

    d = lms_zscore(base(t), "height_cm", "age_in_months", "sex", grid(t, "height_age"), "Agemos", "z")
    return d.select("visit_id", "z", F.round(100 * normal_cdf(F.col("z")), 5).alias("p"))


@query("d07_filter_implausible", with_roles(f"""SELECT visit_id, CASE WHEN z IS NULL OR z BETWEEN -5 AND 5 THEN weight_kg END AS weight_kg,
    CASE WHEN z BETWEEN -5 AND 5 THEN z END AS weight_z_score FROM (SELECT *, {z_sql('weight_kg')} AS z FROM l) q""", "visits", "patients",
    ctes=_ctes(BASE_CTE, seg_cte("weight_age", "w"), lms_cte("base", "age_in_months", "w", "l"))))
def d07(t: Tables) -> DataFrame:
    d = lms_zscore(base(t), "weight_kg", "age_in_months", "sex", grid(t, "weight_age"), "Agemos", "weight_z_score")
    return op.filter_implausible(d, "weight_kg", "weight_z_score", -5, 5).select("visit_id", "weight_kg", "weight_z_score")


@query("d08_add_bmi", with_roles("""SELECT visit_id, round(CASE WHEN age_in_months >= 24 AND height_cm > 0 THEN weight_kg / pow(height_cm / 100, 2) END, 6) AS bmi
    FROM base""", "visits", "patients", ctes=BASE_CTE))
def d08(t: Tables) -> DataFrame:
    return op.add_bmi(base(t), "weight_kg", "height_cm", "age_in_months").select("visit_id", F.round("bmi", 6).alias("bmi"))


@query("d09_conditional_zscore", with_roles(f"""SELECT visit_id, CASE WHEN height_cm BETWEEN 45 AND 103.5e0 THEN {z_sql('weight_kg')} END AS z_length FROM l""",
                                            "visits", "patients", ctes=_ctes(
        BASE_CTE, seg_cte("weight_length", "g"), lms_cte("base", "height_cm", "g", "l"))))
def d09(t: Tables) -> DataFrame:
    return op.conditional_zscore(base(t), "weight_kg", "height_cm", "sex", 45, 103.5, grid(t, "weight_length"), "Length", "z_length").select(
        "visit_id", "z_length")


@query("d10_channel_zscores", with_roles(f"""SELECT l.visit_id, l.z AS head_z, {z_sql('m.bmi').replace('m.bmi', 'bmi2')} AS bmi_z FROM (SELECT visit_id, {z_sql('head_circ_cm')} AS z FROM l) l
    JOIN (SELECT *, bmi AS bmi2 FROM m) m USING (visit_id)""", "visits", "patients", ctes=_ctes(
        BASE_CTE, seg_cte("head_age", "h"), seg_cte("bmi_age", "b"), lms_cte("base", "age_in_months", "h", "l"),
        lms_cte("base", "age_in_months", "b", "m"))))
def d10(t: Tables) -> DataFrame:
    return op.channel_zscores(base(t), "sex", [
        ("head_circ_cm", "age_in_months", grid(t, "head_age"), "Agemos", "head_z"),
        ("bmi", "age_in_months", grid(t, "bmi_age"), "Agemos", "bmi_z")]).select("visit_id", "head_z", "bmi_z")


@query("d11_bin_category", with_roles("""SELECT visit_id, CASE WHEN bmi_percentile < 5 THEN 'underweight' WHEN bmi_percentile < 85 THEN 'normal'
    WHEN bmi_percentile < 95 THEN 'overweight' WHEN bmi_percentile < 120 THEN 'obese' WHEN bmi_percentile IS NOT NULL THEN 'severe_obesity' END AS bmi_category FROM visits""", "visits"))
def d11(t: Tables) -> DataFrame:
    return t.visits.select("visit_id", op.bin_category(F.col("bmi_percentile"), op.BMI_EDGES, op.BMI_LABELS).alias("bmi_category"))


@query("d12_add_flags", with_roles("""SELECT visit_id, cast(coalesce(bmi_percentile >= 95, false) AS INT) AS obesity_flag,
    cast(coalesce(bmi_percentile < 5, false) AS INT) AS underweight_flag, cast(coalesce(height_in < 21, false) OR coalesce(weight_oz < 150, false) AS INT) AS small_flag FROM visits""", "visits"))
def d12(t: Tables) -> DataFrame:
    either = F.coalesce(F.col("height_in") < 21, F.lit(False)) | F.coalesce(F.col("weight_oz") < 150, F.lit(False))
    return op.add_flags(t.visits, {"obesity_flag": F.col("bmi_percentile") >= 95, "underweight_flag": F.col("bmi_percentile") < 5,
                                   "small_flag": either}).select("visit_id", "obesity_flag", "underweight_flag", "small_flag")


def gap_sql(rule, age: str = "age_in_days") -> str:
    steps, default = rule
    return "CASE " + " ".join(f"WHEN {age} <= {b} THEN {g}" for b, g in steps) + f" ELSE {default} END"


def velocity_cte(source: str, value: str, rule, name: str, year: str = "365", digits: int = 6) -> str:
    """Latest earlier measurement at the minimum gap, by a plain self-join."""
    return f"""{name} AS (SELECT visit_id, patient_id, age_in_days, v, round(v - p.v, {digits}) AS delta, age_in_days - p.a AS gap,
        round((v - p.v) / (age_in_days - p.a) * {year}, {digits}) AS velocity, v - p.v AS raw
      FROM (SELECT c.visit_id, c.patient_id, c.age_in_days, c.{value} AS v,
          (SELECT max({{'a': e.age_in_days, 't': e.visit_id, 'v': e.{value}}}) FROM {source} e WHERE e.patient_id = c.patient_id
            AND e.{value} IS NOT NULL AND c.{value} IS NOT NULL AND c.age_in_days - e.age_in_days >= {gap_sql(rule, 'c.age_in_days')}) AS p
        FROM {source} c) q)"""


@query("d13_min_gap_velocity", with_roles("""SELECT h.visit_id, h.delta AS delta_height, h.gap AS gap_height, h.velocity AS velocity_height,
    w.delta AS delta_weight, w.gap AS gap_weight, w.velocity AS velocity_weight FROM h JOIN w USING (visit_id)""", "visits", ctes=_ctes(
    velocity_cte("visits", "height_in", op.HEIGHT_GAPS, "h"), velocity_cte("visits", "weight_oz", op.WEIGHT_GAPS, "w"))))
def d13(t: Tables) -> DataFrame:
    v = t.visits.select("patient_id", "visit_id", "age_in_days", "height_in", "weight_oz")
    return op.min_gap_velocity(v, "patient_id", "age_in_days", "visit_id", {
        "height": ("height_in", op.HEIGHT_GAPS), "weight": ("weight_oz", op.WEIGHT_GAPS)}, digits=6).drop(
            "patient_id", "age_in_days", "height_in", "weight_oz")


@query("d14_velocity_zscores", with_roles(f"""
    , a AS (SELECT visit_id, {z_sql('velocity')} AS z FROM l1), b AS (SELECT visit_id, {z_sql('velocity')} AS z FROM l2)
    SELECT a.visit_id, a.z AS velocity_z_score, b.z AS velocity_z_score_lp, round(100 * ({phi_sql('a.z')}), 2) AS velocity_percentile,
      round(100 * ({phi_sql('b.z')}), 2) AS velocity_percentile_lp FROM a JOIN b USING (visit_id)""", "visits", "patients", ctes=_ctes(
    BASE_CTE, velocity_cte("base", "height_cm", op.HEIGHT_GAPS, "h"),
    "hv AS (SELECT b.sex, b.age_in_years, h.* FROM h JOIN base b USING (visit_id))",
    seg_cte("velocity_no", "n"), seg_cte("velocity_late", "p"), lms_cte("hv", "age_in_years", "n", "l1"), lms_cte("hv", "age_in_years", "p", "l2"))))
def d14(t: Tables) -> DataFrame:
    v = op.min_gap_velocity(base(t), "patient_id", "age_in_days", "visit_id", {"h": ("height_cm", op.HEIGHT_GAPS)}, digits=6)
    v = v.withColumnRenamed("velocity_h", "velocity")
    return op.velocity_zscores(v, "velocity", "age_in_years", "sex", {"": grid(t, "velocity_no"), "_lp": grid(t, "velocity_late")}).select(
        "visit_id", "velocity_z_score", "velocity_z_score_lp", "velocity_percentile", "velocity_percentile_lp")


PRECLEAN = """rows AS (SELECT patient_id, age_in_years AS age, age_in_days, visit_id, {v} AS v FROM base WHERE {v} IS NOT NULL),
    pre AS (SELECT *, count(*) OVER (PARTITION BY patient_id, age, v) > 1 OR coalesce(
      (v - lag(v) OVER s) / nullif(age - lag(age) OVER s, 0) = 0, false) AS flagged
      FROM rows WINDOW s AS (PARTITION BY patient_id ORDER BY age, visit_id))"""


@query("d15_outlier_preclean", with_roles("SELECT visit_id, flagged FROM pre", "visits", "patients", ctes=_ctes(
    BASE_CTE, PRECLEAN.format(v="height_cm"))))
def d15(t: Tables) -> DataFrame:
    return outliers.outlier_preclean(base(t), ["patient_id"], "age_in_years", "height_cm", "visit_id").select("visit_id", "flagged")


def peak_ctes(source: str, threshold: bool) -> str:
    steps, default = outliers.WEIGHT_THRESHOLDS
    limit = "CASE " + " ".join(f"WHEN age < {b} THEN {g}" for b, g in steps) + f" ELSE {default} END"
    w = "WINDOW s AS (PARTITION BY patient_id ORDER BY age, visit_id)"
    run = lambda a, b: f"(CASE WHEN {a} - {b} = 0 THEN 1e-3 ELSE {a} - {b} END)"
    extra = f" AND coalesce(abs(slope) > {limit}, false)" if threshold else ""
    return f"""k1 AS (SELECT *, (v - lag(v) OVER s) / {run('age', 'lag(age) OVER s')} AS slope,
        (v - lag(v, 2) OVER s) / {run('age', 'lag(age, 2) OVER s')} AS xb,
        (lead(v, 2) OVER s - v) / {run('lead(age, 2) OVER s', 'age')} AS ay,
        (lead(v) OVER s - v) / {run('lead(age) OVER s', 'age')} AS nxt FROM {source} {w}),
      k2 AS (SELECT *, sign(slope) + coalesce(lag(sign(slope)) OVER s, 0) AS ss, ay - slope AS capd, xb - nxt AS cupd FROM k1 {w}),
      k3 AS (SELECT *, lag(ss) OVER s AS pss, lead(ss) OVER s AS nss, lag(capd) OVER s AS pcap, lead(cupd) OVER s AS ncup FROM k2 {w}),
      k4 AS (SELECT *, coalesce(abs(ss) = 2 AND nss = 0, false) OR (ss IS NULL AND coalesce(nss = 0, false)) AS cap,
        coalesce(ss = 0 AND abs(pss) = 2, false) OR (ss IS NULL AND coalesce(nss = 0, false)) AS cup FROM k3),
      peaks AS (SELECT *, ((cap AND cup) OR (cap AND coalesce(capd <= ncup, false)) OR (cup AND coalesce(cupd <= pcap, false))){extra} AS peak FROM k4)"""


@query("d16_find_peaks", with_roles("SELECT visit_id, peak FROM peaks", "visits", "patients", ctes=_ctes(
    BASE_CTE, PRECLEAN.format(v="weight_kg"), "kept AS (SELECT * FROM pre WHERE NOT flagged)", peak_ctes("kept", True))))
def d16(t: Tables) -> DataFrame:
    clean = outliers.outlier_preclean(base(t), ["patient_id"], "age_in_years", "weight_kg", "visit_id").where(~F.col("flagged"))
    return outliers.find_peaks(clean, ["patient_id"], "age_in_years", "weight_kg", "visit_id",
                               outliers.slope_limit("age_in_years", outliers.WEIGHT_THRESHOLDS)).select(
        "visit_id", "peak")


def peak_select(source: str, keys: str, limit: str) -> str:
    """Nested form of the peak test, for use inside a recursive query."""
    w = f"WINDOW s AS (PARTITION BY {keys} ORDER BY age, visit_id)"
    run = lambda a, b: f"(CASE WHEN {a} - {b} = 0 THEN 1e-3 ELSE {a} - {b} END)"
    k1 = f"""SELECT *, (v - lag(v) OVER s) / {run('age', 'lag(age) OVER s')} AS slope, (v - lag(v, 2) OVER s) / {run('age', 'lag(age, 2) OVER s')} AS xb,
        (lead(v, 2) OVER s - v) / {run('lead(age, 2) OVER s', 'age')} AS ay, (lead(v) OVER s - v) / {run('lead(age) OVER s', 'age')} AS nxt FROM {source} {w}"""
    k2 = f"SELECT *, sign(slope) + coalesce(lag(sign(slope)) OVER s, 0) AS ss, ay - slope AS capd, xb - nxt AS cupd FROM ({k1}) k1 {w}"
    k3 = f"SELECT *, lag(ss) OVER s AS pss, lead(ss) OVER s AS nss, lag(capd) OVER s AS pcap, lead(cupd) OVER s AS ncup FROM ({k2}) k2 {w}"
    k4 = f"""SELECT *, coalesce(abs(ss) = 2 AND nss = 0, false) OR (ss IS NULL AND coalesce(nss = 0, false)) AS cap,
        coalesce(ss = 0 AND abs(pss) = 2, false) OR (ss IS NULL AND coalesce(nss = 0, false)) AS cup FROM ({k3}) k3"""
    return f"""SELECT {keys}, age, visit_id, v, ((cap AND cup) OR (cap AND coalesce(capd <= ncup, false)) OR (cup AND coalesce(cupd <= pcap, false))) AND {limit} AS peak FROM ({k4}) k4"""


def fixpoint_ctes(rows: str, limit: str = "true") -> str:
    """Pre-clean and peeling rounds of (series, age, visit_id, v) rows as a recursive query."""
    return f"""rows AS ({rows}), pre AS (SELECT *, count(*) OVER (PARTITION BY patient_id, channel, age, v) > 1 OR coalesce((v - lag(v) OVER s) / nullif(age - lag(age) OVER s, 0) = 0, false) AS flagged
      FROM rows WINDOW s AS (PARTITION BY patient_id, channel ORDER BY age, visit_id)),
    kept AS (SELECT * FROM pre WHERE NOT flagged),
    peel AS (SELECT 1 AS round, *, bool_or(peak) OVER (PARTITION BY patient_id, channel) AS touched FROM ({peak_select('kept', 'patient_id, channel', limit)}) p0
      UNION ALL SELECT round, patient_id, channel, age, visit_id, v, peak, bool_or(peak) OVER (PARTITION BY patient_id, channel) FROM (SELECT * FROM (SELECT min(round) + 1 AS round FROM peel) n
        CROSS JOIN ({peak_select('(SELECT patient_id, channel, age, visit_id, v FROM peel WHERE touched AND NOT peak)', 'patient_id, channel', limit)}) p1) p2 WHERE round IS NOT NULL),
    gone AS (SELECT patient_id, channel, visit_id, 0 AS round FROM pre WHERE flagged UNION ALL SELECT patient_id, channel, visit_id, round FROM peel WHERE peak)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_SERIES = "SELECT patient_id, '{c}' AS channel, age_in_years AS age, visit_id, {v} AS v FROM base WHERE {v} IS NOT NULL"
_STEPS, _LAST = outliers.WEIGHT_THRESHOLDS
_LIMIT = ("(channel = 'h' OR coalesce(abs(slope) > CASE " + " ".join(f"WHEN age < {b} THEN {g}" for b, g in _STEPS) + f" ELSE {_LAST} END, false))")


@query("d17_outlier_fixpoint", recursive(with_roles("SELECT visit_id, cast(round AS INT) AS round FROM gone", "visits", "patients", ctes=_ctes(
    BASE_CTE, fixpoint_ctes(_SERIES.format(c="h", v="height_cm"))))))
def d17(t: Tables) -> DataFrame:
    return outliers.outlier_fixpoint(base(t), ["patient_id"], "age_in_years", "height_cm", "visit_id").select("visit_id", "round")


@query("d18_outlier_flags", recursive(with_roles("""SELECT b.visit_id, CASE WHEN height_cm IS NOT NULL THEN (h.visit_id IS NOT NULL)::INT END AS height_outlier_flag, CASE WHEN weight_kg IS NOT NULL THEN (w.visit_id IS NOT NULL)::INT END AS weight_outlier_flag
    FROM base b LEFT JOIN (SELECT visit_id FROM gone WHERE channel = 'h') h ON h.visit_id = b.visit_id LEFT JOIN (SELECT visit_id FROM gone WHERE channel = 'w') w ON w.visit_id = b.visit_id""", "visits", "patients", ctes=_ctes(
    BASE_CTE, fixpoint_ctes(_SERIES.format(c="h", v="height_cm") + " UNION ALL " + _SERIES.format(c="w", v="weight_kg"), _LIMIT)))))
def d18(t: Tables) -> DataFrame:
    return outliers.outlier_flags(base(t), "patient_id", "age_in_years", "visit_id", {
        "height_outlier_flag": ("height_cm", None), "weight_outlier_flag": ("weight_kg", outliers.WEIGHT_THRESHOLDS)}).select(
            "visit_id", "height_outlier_flag", "weight_outlier_flag")


@query("d19_lms_value", with_roles("""SELECT visit_id, round(CASE WHEN abs(xl) < 1e-6 THEN xm * exp(xs * zz) WHEN 1 + xl * xs * zz > 0 THEN xm * pow(1 + xl * xs * zz, 1 / xl) END, 6) AS value
    FROM (SELECT *, greatest(-1.880793e0, least(1.880793e0, z)) AS zz FROM l) q""", "visits", "patients", ctes=_ctes(
    BASE_CTE, "zed AS (SELECT *, cast(k % 600 - 300 AS DOUBLE) / 100 AS z FROM base)", seg_cte("weight_age", "w"),
    lms_cte("zed", "age_in_months", "w", "l", clamp=False))))
def d19(t: Tables) -> DataFrame:
    z = base(t).withColumn("z", (F.col("k") % 600 - 300).cast("double") / 100)
    return lms_value(z, "z", "age_in_months", "sex", grid(t, "weight_age"), "Agemos", clamp=(-1.880793, 1.880793)).select(
        "visit_id", F.round("value", 6).alias("value"))
