"""Drift, utility, parity and paired-world queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assurance as op
from ..operators import derive, rollup
from .derivation import BASE_CTE, base
from .exploration import AGE, PID, VID, rounded
from .registry import query
from .roles import Tables, with_roles
from .targets import WINDOWS, _WINDOW_CTE

WM_CTE = f"""{_WINDOW_CTE}, pos AS (SELECT win, lo, hi, row_number() OVER (ORDER BY win) - 1 AS position FROM win),
    pv AS (SELECT win, patient_id, count(*) AS n, max(age_in_days) - min(age_in_days) AS span FROM visits JOIN win ON age_in_days >= lo AND age_in_days < hi GROUP BY 1, 2),
    pg AS (SELECT win, patient_id, count(*) AS n FROM visits JOIN win ON age_in_days >= lo AND age_in_days < hi WHERE height_in IS NOT NULL GROUP BY 1, 2),
    lagged AS (SELECT win, age_in_days - lag(age_in_days) OVER (PARTITION BY win, patient_id ORDER BY age_in_days) AS gap FROM visits JOIN win ON age_in_days >= lo AND age_in_days < hi),
    wm AS (SELECT win AS "window", cast(position AS INT) AS position, (SELECT count(*) FROM patients) AS members, (SELECT count(*) FROM pg WHERE pg.win = p.win AND n >= 2) / m AS growth_coverage,
      (SELECT count(*) FROM pv WHERE pv.win = p.win AND n >= 2) / m AS visit_coverage, (SELECT count(DISTINCT patient_id) FROM medications WHERE order_age >= lo AND order_age < hi) / m AS event_rate,
      (SELECT coalesce(sum(n), 0) FROM pv WHERE pv.win = p.win) / m AS mean_visits, (SELECT count(*) FROM pv WHERE pv.win = p.win AND n >= 2) AS interval_support, (SELECT avg(gap) FROM lagged l WHERE l.win = p.win) AS mean_gap
      FROM pos p CROSS JOIN (SELECT cast(count(*) AS DOUBLE) AS m FROM patients) c)"""
_WM = ["growth_coverage", "visit_coverage", "event_rate", "mean_visits", "mean_gap"]


def metrics(t: Tables) -> DataFrame:
    events = t.medications.select(PID, F.col("order_age").alias(AGE))
    return op.window_metrics(t.patients, t.visits.where("height_in is not null"), t.visits, events, PID, AGE, WINDOWS, 2, 2)


def wm_sql(body: str) -> str:
    return with_roles(body, "patients", "visits", "medications", ctes=WM_CTE)


@query("h01_window_metrics", wm_sql('SELECT "window", position, members, interval_support, ' + ", ".join(f"round({c}, 6) AS {c}" for c in _WM) + " FROM wm"))
def h01(t: Tables) -> DataFrame:
    return rounded(metrics(t), *_WM)


BOUNDS = {"growth_coverage": ("lower", 0.5), "visit_coverage": ("lower", 0.9), "event_rate": ("diagnostic", None), "mean_gap": ("upper", 700.0)}


def _bound_sql(m: str, kind: str, b) -> str:
    sup = "interval_support" if m == "mean_gap" else "members"
    test = {"lower": f"{m} >= {b}", "upper": f"{m} <= {b}", "diagnostic": "true"}[kind]
    return f"""SELECT "window", '{m}' AS metric, round({m}, 6) AS observed, cast({'NULL' if b is None else b} AS DOUBLE) AS bound, {sup} AS support, CASE WHEN {test} THEN 'PASS' ELSE 'FAIL' END AS status FROM wm WHERE {sup} >= 20 AND members >= 20 AND {m} IS NOT NULL
      UNION ALL SELECT "window", '{m}', NULL, cast({'NULL' if b is None else b} AS DOUBLE), NULL, 'UNEVALUABLE' FROM wm WHERE NOT coalesce({sup} >= 20 AND members >= 20 AND {m} IS NOT NULL, false)"""


@query("h02_window_bounds", wm_sql(" UNION ALL ".join(_bound_sql(m, k, b) for m, (k, b) in BOUNDS.items())))
def h02(t: Tables) -> DataFrame:
    return rounded(op.window_bounds(metrics(t), BOUNDS, 20), "observed")


@query("h03_window_steps", wm_sql("""SELECT "window", metric, round(step, 6) AS step, bound, CASE WHEN abs(step) <= bound THEN 'PASS' ELSE 'FAIL' END AS status FROM (
    SELECT "window", position, 'mean_visits_step' AS metric, mean_visits - lag(mean_visits) OVER (ORDER BY position) AS step, 2e0 AS bound FROM wm
    UNION ALL SELECT "window", position, 'event_rate_step', event_rate - lag(event_rate) OVER (ORDER BY position), 1e-1 FROM wm) s WHERE position > 0"""))
def h03(t: Tables) -> DataFrame:
    return rounded(op.window_steps(metrics(t), {"mean_visits": 2.0, "event_rate": 0.1}, 20), "step")


_KINDS = ["latent_onset", "observable_phenotype", "workup", "treatment_start", "treatment_response", "unknown_kind"]
# One entity per order; its lines are the events, in line order.
PHASE_SQL = """ph AS (SELECT visit_id AS patient_id, age_in_days, slot AS seq, CASE WHEN substr(code, 1, 1) = 'Z' THEN 'unknown_kind'
    ELSE list_extract(['latent_onset', 'observable_phenotype', 'workup', 'treatment_start', 'treatment_response'], cast((slot - 1) % 5 + 1 AS BIGINT)) END AS kind FROM visit_codes)"""


def phased(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS[:5]])
    kind = F.when(F.substring("code", 1, 1) == "Z", "unknown_kind").otherwise(F.get(kinds, (F.col("slot") - 1) % 5))
    return t.visit_codes.select(F.col("visit_id").alias(PID), AGE, F.col("slot").alias("seq"), kind.alias("kind"))


@query("h04_event_order", with_roles("""
    , p AS (SELECT *, CASE kind WHEN 'latent_onset' THEN 0 WHEN 'observable_phenotype' THEN 1 WHEN 'workup' THEN 3 WHEN 'treatment_start' THEN 5 WHEN 'treatment_response' THEN 6 END AS phase FROM ph),
    l AS (SELECT *, lag(phase) OVER w AS pp, lag(age_in_days) OVER w AS pa FROM p WINDOW w AS (PARTITION BY patient_id ORDER BY seq))
    SELECT patient_id, coalesce(bool_and(phase IS NOT NULL AND (pp IS NULL OR phase > pp) AND (pa IS NULL OR age_in_days >= pa)) AND bool_or(kind = 'treatment_start') = bool_or(kind = 'treatment_response'), false) AS valid FROM l GROUP BY 1""", "visit_codes", ctes=PHASE_SQL))
def h04(t: Tables) -> DataFrame:
    return op.event_order(phased(t), PID, "kind", AGE, "seq").select(PID, "valid")


@query("h05_event_timing", with_roles("""
    , w AS (SELECT patient_id, cast(patient_id AS BIGINT) % 400 AS s, 6500 + cast(patient_id AS BIGINT) % 900 AS e, 6900 + cast(patient_id AS BIGINT) % 700 AS a FROM patients)
    SELECT patient_id, bounds_ok, records_ok, bounds_ok AND records_ok AS valid FROM (SELECT w.patient_id, s >= 0 AND s < e AND e <= a AS bounds_ok, coalesce(bool_and(v.age_in_days >= s AND v.age_in_days < e AND v.age_in_days >= 0) FILTER (v.patient_id IS NOT NULL), true) AS records_ok
      FROM w LEFT JOIN visits v USING (patient_id) GROUP BY w.patient_id, s, e, a) x""", "patients", "visits"))
def h05(t: Tables) -> DataFrame:
    n = F.col(PID).cast("long")
    windows = t.patients.select(PID, (n % 400).alias("start"), (6500 + n % 900).alias("end"), (6900 + n % 700).alias("admin_end"))
    return op.event_timing(t.visits, windows, PID, AGE)


PRED_CTE = """pred AS (SELECT doc_id, lang, label, CASE WHEN lang = 'de' AND doc_id % 11 = 0 THEN NULL ELSE n_chars % 5 < 3 END AS decision, CASE WHEN lang = 'fr' AND doc_id % 13 = 0 THEN NULL ELSE cast(n_chars % 50 AS DOUBLE) / 50 END AS score FROM scored)"""
DEC_CTE = """cell AS (SELECT *, unnest(['overall', 'lang=' || lang]) AS cell FROM pred),
    dm0 AS (SELECT cell, count(*) AS members, count(decision) AS evaluable, count(*) FILTER (label = 1 AND decision) AS tp, count(*) FILTER (label = 0 AND NOT decision) AS tn, count(*) FILTER (label = 0 AND decision) AS fp, count(*) FILTER (label = 1 AND NOT decision) AS fn FROM cell GROUP BY 1),
    dm AS (SELECT *, tp + fn AS positives, tn + fp AS negatives, members - evaluable AS missing, tp / nullif(cast(tp + fn AS DOUBLE), 0) AS sensitivity, tn / nullif(cast(tn + fp AS DOUBLE), 0) AS specificity, tp / nullif(cast(tp + fp AS DOUBLE), 0) AS "precision",
      (tp / nullif(cast(tp + fn AS DOUBLE), 0) + tn / nullif(cast(tn + fp AS DOUBLE), 0)) / 2 AS balanced_accuracy FROM dm0)"""
SCORE_CTE = """rk AS (SELECT cell, label, score, rank() OVER (PARTITION BY cell ORDER BY score) + (count(*) OVER (PARTITION BY cell, score) - 1) / 2e0 AS mid FROM cell WHERE decision IS NOT NULL AND score IS NOT NULL),
    au AS (SELECT cell, (sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2e0) / nullif(cast(sum(label) * (count(*) - sum(label)) AS DOUBLE), 0) AS auroc FROM rk GROUP BY 1),
    sm AS (SELECT b.cell, missing_scores, CASE WHEN missing_scores = 0 THEN auroc END AS auroc, CASE WHEN missing_scores = 0 THEN brier END AS brier FROM (SELECT cell, avg(pow(score - label, 2)) AS brier, count(*) FILTER (score IS NULL) AS missing_scores FROM cell WHERE decision IS NOT NULL GROUP BY 1) b LEFT JOIN au ON au.cell = b.cell)"""


def predictions(t: Tables) -> DataFrame:
    lang, d, n = F.col("lang"), F.col("doc_id"), F.col("n_chars")
    return t.scored.select("doc_id", "lang", "label", F.when(~((lang == "de") & (d % 11 == 0)), n % 5 < 3).alias("decision"),
                           F.when(~((lang == "fr") & (d % 13 == 0)), (n % 50).cast("double") / 50).alias("score"))


_RATES = ["sensitivity", "specificity", "precision", "balanced_accuracy"]


@query("h06_decision_metrics", with_roles("SELECT cell, members, evaluable, tp, tn, fp, fn, positives, negatives, missing, " + ", ".join(f'round("{c}", 8) AS "{c}"' for c in _RATES) + " FROM dm", "scored", ctes=f"{PRED_CTE}, {DEC_CTE}"))
def h06(t: Tables) -> DataFrame:
    return rounded(op.decision_metrics(predictions(t), "label", "decision", "lang"), *_RATES, digits=8)


@query("h07_score_metrics", with_roles("SELECT cell, missing_scores, round(auroc, 8) AS auroc, round(brier, 8) AS brier FROM sm", "scored", ctes=f"{PRED_CTE}, {DEC_CTE}, {SCORE_CTE}"))
def h07(t: Tables) -> DataFrame:
    return rounded(op.score_metrics(predictions(t), "label", "decision", "score", "lang"), "auroc", "brier", digits=8)


_LIMITS = {"sensitivity": ("lower", 0.4), "specificity": ("lower", 0.2), "auroc": ("lower", 0.3), "brier": ("upper", 0.6)}
_OUT = " OR ".join(f"coalesce({m} {'<' if k == 'lower' else '>'} {b}, false)" for m, (k, b) in _LIMITS.items())


@query("h08_utility_status", with_roles(f"""SELECT cell, members, evaluable, missing, {', '.join(f'CASE WHEN NOT thin THEN {c} END AS {c}' for c in ('positives', 'negatives', 'tp', 'tn', 'fp', 'fn'))},
    {', '.join(f'CASE WHEN NOT thin THEN round("{c}", 8) END AS "{c}"' for c in [*_RATES, 'auroc', 'brier'])}, CASE reason WHEN 'WITHIN_BOUNDS' THEN 'PASS' WHEN 'OUTSIDE_BOUND' THEN 'FAIL' ELSE 'UNEVALUABLE' END AS status, reason FROM (
    SELECT *, CASE WHEN thin THEN CASE WHEN missing > 0 THEN 'MISSING_PREDICTION' WHEN missing_scores > 0 THEN 'MISSING_SCORE' ELSE 'INSUFFICIENT_SUPPORT' END WHEN {_OUT} THEN 'OUTSIDE_BOUND' WHEN missing > 0 THEN 'MISSING_PREDICTION'
      WHEN missing_scores > 0 THEN 'MISSING_SCORE' WHEN "precision" IS NULL THEN 'INSUFFICIENT_SUPPORT' ELSE 'WITHIN_BOUNDS' END AS reason FROM (SELECT dm.*, sm.missing_scores, sm.auroc, sm.brier, positives < 15 OR negatives < 15 AS thin FROM dm LEFT JOIN sm ON sm.cell = dm.cell) a) b""",
    "scored", ctes=f"{PRED_CTE}, {DEC_CTE}, {SCORE_CTE}"))
def h08(t: Tables) -> DataFrame:
    p = predictions(t)
    out = op.utility_status(op.decision_metrics(p, "label", "decision", "lang"), op.score_metrics(p, "label", "decision", "score", "lang"), 15, _LIMITS)
    return rounded(out, *_RATES, "auroc", "brier", digits=8)


@query("h09_growth_fidelity", with_roles(f"""
    , z AS (SELECT age_in_days, (height_in - 45) / 10 AS height, (weight_oz - 1300) / 800 AS weight FROM visits),
    m AS (SELECT win, 'height' AS metric, height AS v, 1e0 AS tol FROM z JOIN win ON age_in_days >= lo AND age_in_days < hi UNION ALL SELECT win, 'weight', weight, 0.3e0 FROM z JOIN win ON age_in_days >= lo AND age_in_days < hi)
    SELECT win AS "window", metric, count(v) AS support, count(*) AS denominator, CASE WHEN count(v) >= 30 THEN round(avg(v), 6) END AS observed, max(tol) AS tolerance, CASE WHEN count(v) < 30 THEN 'UNEVALUABLE' WHEN abs(avg(v)) <= max(tol) THEN 'PASS' ELSE 'FAIL' END AS status FROM m GROUP BY 1, 2""", "visits", ctes=_WINDOW_CTE))
def h09(t: Tables) -> DataFrame:
    z = t.visits.select(AGE, ((F.col("height_in") - 45) / 10).alias("height"), ((F.col("weight_oz") - 1300) / 800).alias("weight"))
    return rounded(op.growth_fidelity(z, AGE, WINDOWS, {"height": 1.0, "weight": 0.3}, 30), "observed")


@query("h10_share_fidelity", with_roles("""
    , w AS (SELECT ethnicity AS category, count(*) AS weight FROM patients WHERE cast(patient_id AS BIGINT) % 2 = 0 GROUP BY 1), s AS (SELECT ethnicity AS category, count(*) AS n FROM patients WHERE cast(patient_id AS BIGINT) % 2 = 1 GROUP BY 1)
    SELECT category, coalesce(n, 0) AS support, round(observed, 6) AS observed, round(target, 6) AS target, round(abs(observed - target), 6) AS difference, CASE WHEN abs(observed - target) <= 1e-2 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT category, n, coalesce(n, 0) / (SELECT cast(sum(n) AS DOUBLE) FROM s) AS observed, coalesce(weight, 0) / (SELECT cast(sum(weight) AS DOUBLE) FROM w) AS target FROM w FULL JOIN s USING (category)) x""", "patients"))
def h10(t: Tables) -> DataFrame:
    odd = F.col(PID).cast("long") % 2 == 1
    weights = t.patients.where(~odd).groupBy(F.col("ethnicity").alias("category")).agg(F.count("*").cast("double").alias("weight"))
    return rounded(op.share_fidelity(t.patients.where(odd), "ethnicity", weights, 0.01), "observed", "target", "difference")


@query("h11_layer_rates", with_roles("""
    , c AS (SELECT 'observed' AS name, count(DISTINCT patient_id) AS support FROM visits WHERE head_circ_cm IS NOT NULL UNION ALL SELECT 'event', count(DISTINCT patient_id) FROM referrals WHERE specialty IS NOT NULL
      UNION ALL SELECT 'kind.' || k, (SELECT count(DISTINCT patient_id) FROM referrals WHERE specialty = k) FROM (SELECT unnest(['Economy Brand#1', 'Standard Brand#2', 'Nothing']) AS k) r)
    SELECT name, support, d AS denominator, support / cast(d AS DOUBLE) AS rate, CASE WHEN support = 0 THEN 'NO_EVIDENCE' WHEN support < 20 THEN 'INSUFFICIENT_SUPPORT' ELSE 'ABOVE_MINIMUM_SUPPORT' END AS reason,
      CASE WHEN support = 0 OR support >= 20 THEN 'PASS' ELSE 'UNEVALUABLE' END AS status FROM c CROSS JOIN (SELECT count(*) AS d FROM patients) p""", "patients", "visits", "referrals"))
def h11(t: Tables) -> DataFrame:
    return op.layer_rates(t.patients, t.visits.where("head_circ_cm is not null"), t.referrals.where("specialty is not null"), PID, "specialty",
                          ["Economy Brand#1", "Standard Brand#2", "Nothing"], 20, 100)


ALT_CTE = """alt AS (SELECT visit_id, CASE WHEN k % 31 = 0 THEN weight_oz + 0.5e0 ELSE weight_oz END AS weight_oz, CASE WHEN k % 37 = 0 THEN NULL ELSE height_in END AS height_in, CASE WHEN k % 41 = 0 THEN '1-URGENT' ELSE encounter_type END AS encounter_type
    FROM visits WHERE k % 101 <> 0 UNION ALL SELECT 'new-' || visit_id, weight_oz, height_in, encounter_type FROM visits WHERE k % 103 = 0)"""


def alternative(t: Tables) -> DataFrame:
    k = F.col("k")
    cols = [VID, "weight_oz", "height_in", "encounter_type"]
    changed = t.visits.where(k % 101 != 0).select(
        VID, F.when(k % 31 == 0, F.col("weight_oz") + 0.5).otherwise(F.col("weight_oz")).alias("weight_oz"), F.when(k % 37 != 0, F.col("height_in")).alias("height_in"),
        F.when(k % 41 == 0, "1-URGENT").otherwise(F.col("encounter_type")).alias("encounter_type"))
    return changed.unionByName(t.visits.where(k % 103 == 0).withColumn(VID, F.concat(F.lit("new-"), VID)).select(*cols))


def parity_sql(field: str, numeric: bool, left: str, right: str, source: str, tol: str = "1e-1") -> str:
    bad = f"({left} IS NULL) <> ({right} IS NULL) OR coalesce({f'abs({left} - {right}) > {tol}' if numeric else f'{left} <> {right}'}, false)"
    diff = f"coalesce(round(max(abs({left} - {right})), 6), 0)" if numeric else "0e0"
    return f"SELECT '{field}' AS field, count(*) AS compared, count(*) FILTER ({bad}) AS mismatches, {diff} AS max_difference, CASE WHEN count(*) FILTER ({bad}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM {source}"


_BOTH = "visits a JOIN alt b USING (visit_id)"


@query("h12_keyed_parity", with_roles(" UNION ALL ".join([
    "SELECT '(keys)' AS field, count(*) AS compared, count(*) FILTER (a.visit_id IS NULL OR b.visit_id IS NULL) AS mismatches, 0e0 AS max_difference, 'FAIL' AS status FROM visits a FULL JOIN alt b ON a.visit_id = b.visit_id",
    parity_sql("weight_oz", True, "a.weight_oz", "b.weight_oz", _BOTH), parity_sql("height_in", True, "a.height_in", "b.height_in", _BOTH),
    parity_sql("encounter_type", False, "a.encounter_type", "b.encounter_type", _BOTH)]), "visits", ctes=ALT_CTE))
def h12(t: Tables) -> DataFrame:
    return rounded(op.keyed_parity(t.visits, alternative(t), VID, ["weight_oz", "height_in"], ["encounter_type"], 0.1), "max_difference")


_PROJ = "(SELECT b.weight_oz AS dw, b.encounter_type AS de, a.weight_oz AS sw, a.encounter_type AS se FROM alt b JOIN visits a USING (visit_id)) p"


@query("h13_projection_parity", with_roles(" UNION ALL ".join([
    "SELECT '(keys)' AS field, count(*) AS compared, count(*) FILTER (a.visit_id IS NULL) AS mismatches, 0e0 AS max_difference, 'FAIL' AS status FROM alt b LEFT JOIN visits a ON a.visit_id = b.visit_id",
    parity_sql("weight_oz", False, "dw", "sw", _PROJ), parity_sql("encounter_type", False, "de", "se", _PROJ),
    "SELECT 'cleaned ethnicity', count(*), 0, 0e0, 'PASS' FROM patients"]), "visits", "patients", ctes=ALT_CTE))
def h13(t: Tables) -> DataFrame:
    visits = op.projection_parity(t.visits, alternative(t), VID, ["weight_oz", "encounter_type"])
    clean = derive.clean_categories(t.patients, ["ethnicity"])
    people = op.projection_parity(clean, clean, PID, ["ethnicity"]).where("field = 'ethnicity'").withColumn("field", F.lit("cleaned ethnicity"))
    return visits.unionByName(people)


LAYER_CTE = f"""{BASE_CTE}, layer AS (SELECT visit_id, age_in_days, weight_oz, height_in, age_in_months, CASE WHEN k % 53 = 0 THEN age_in_years + 1 ELSE age_in_years END AS age_in_years, wz AS weight_z_score, hz AS height_z_score,
      CASE WHEN k % 59 = 0 OR wz BETWEEN -5 AND 5 THEN weight_kg END AS weight_kg, CASE WHEN hz BETWEEN -5 AND 3 THEN height_cm + CASE WHEN k % 61 = 0 THEN 1 ELSE 0 END END AS height_cm
      FROM (SELECT *, (weight_kg - 35) / 5 AS wz, (height_cm - 115) / 12 AS hz FROM base) x),
    full_layer AS (SELECT *, CASE WHEN age_in_days / 30.4375e0 >= 24 AND weight_kg > 0 AND height_cm > 0 THEN weight_kg / pow(height_cm / 100, 2) END AS bmi FROM layer)"""


def layer(t: Tables) -> DataFrame:
    k, wz, hz = F.col("k"), F.col("weight_z_score"), F.col("height_z_score")
    d = base(t).withColumns({"weight_z_score": (F.col("weight_kg") - 35) / 5, "height_z_score": (F.col("height_cm") - 115) / 12})
    d = d.withColumns({
        "age_in_years": F.when(k % 53 == 0, F.col("age_in_years") + 1).otherwise(F.col("age_in_years")), "weight_kg": F.when((k % 59 == 0) | wz.between(-5, 5), F.col("weight_kg")),
        "height_cm": F.when(hz.between(-5, 3), F.col("height_cm") + F.when(k % 61 == 0, 1).otherwise(0))})
    return derive.add_bmi(d, "weight_kg", "height_cm", "age_in_months").select(
        VID, "age_in_months", "age_in_years", "weight_z_score", "height_z_score", "weight_kg", "height_cm", "bmi")


def _unit_sql(field: str, z: str, raw: str, want: str, lo: int, hi: int) -> str:
    open_ = f"{raw} IS NULL OR ({field} IS NULL AND {z} IS NULL)"
    out = f"coalesce(NOT ({z} BETWEEN {lo} AND {hi}), false)"
    wrong = f"(CASE WHEN {field} IS NULL THEN NOT {out} ELSE {out} OR abs({field} - {want}) > 1e-1 END)"
    used = f"NOT ({open_}) AND NOT ({field} IS NULL AND {out})"
    return f"""SELECT '{field}' AS field, count(*) FILTER ({used}) AS compared, count(*) FILTER ({used} AND {wrong}) AS mismatches, coalesce(round(max(abs({field} - {want})) FILTER (NOT {out}), 6), 0) AS max_difference,
      count(*) FILTER ({open_}) AS unevaluable, CASE WHEN count(*) FILTER ({used} AND {wrong}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM full_layer"""


_F = lambda f, want: parity_sql(f, True, f, want, "full_layer").replace("AS max_difference,", "AS max_difference, 0 AS unevaluable,")


@query("h14_formula_parity", with_roles(" UNION ALL ".join([
    _F("age_in_months", "round(age_in_days / 30.4375e0, 2)"), _F("age_in_years", "round(age_in_days / 365.25e0, 3)"), _F("bmi", "(CASE WHEN age_in_days / 30.4375e0 >= 24 AND weight_kg > 0 AND height_cm > 0 THEN weight_kg / pow(height_cm / 100, 2) END)"),
    _unit_sql("weight_kg", "weight_z_score", "weight_oz", "round(weight_oz / 35.274e0, 3)", -5, 5), _unit_sql("height_cm", "height_z_score", "height_in", "round(height_in * 2.54e0, 3)", -5, 3)]),
    "visits", "patients", ctes=LAYER_CTE))
def h14(t: Tables) -> DataFrame:
    return rounded(op.formula_parity(t.visits, layer(t), VID, AGE, 0.1), "max_difference")


SUM_CTE = """fv AS (SELECT *, cast(coalesce(bmi_percentile >= 95, false) AS INT) AS obesity_flag, CASE WHEN k % 67 = 0 THEN 1 ELSE cast(coalesce(bmi_percentile < 5, false) AS INT) END AS underweight_flag FROM visits),
    ex AS (SELECT patient_id, count(age_in_days) AS visits_count, min(age_in_days) AS min_visit_age_days, round(avg(bmi), 4) AS mean_bmi, max(obesity_flag) AS ever_obesity_flag, max(underweight_flag) AS ever_underweight_flag FROM fv GROUP BY 1),
    dv AS (SELECT patient_id, visits_count + CASE WHEN cast(patient_id AS BIGINT) % 71 = 0 THEN 1 ELSE 0 END AS visits_count, min_visit_age_days, mean_bmi + CASE WHEN cast(patient_id AS BIGINT) % 73 = 0 THEN 0.5e0 ELSE 0 END AS mean_bmi,
      CASE WHEN cast(patient_id AS BIGINT) % 79 = 0 THEN 1 - ever_obesity_flag ELSE ever_obesity_flag END AS ever_obesity_flag, ever_underweight_flag FROM ex WHERE cast(patient_id AS BIGINT) % 83 <> 0)"""
_ED = "dv a JOIN ex b USING (patient_id)"


def _flag_sql(f: str, rule: str) -> str:
    return f"""SELECT '{f}' AS field, count(*) FILTER (bmi_percentile IS NOT NULL) AS compared, count(*) FILTER (bmi_percentile IS NOT NULL AND {f} <> ({rule})::INT) AS mismatches, 0e0 AS max_difference,
      CASE WHEN count(*) FILTER (bmi_percentile IS NOT NULL AND {f} <> ({rule})::INT) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM fv"""


@query("h15_summary_parity", with_roles(" UNION ALL ".join([
    "SELECT '(keys)' AS field, count(*) AS compared, count(*) FILTER (a.patient_id IS NULL) AS mismatches, 0e0 AS max_difference, CASE WHEN count(*) FILTER (a.patient_id IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ex b LEFT JOIN dv a ON a.patient_id = b.patient_id",
    parity_sql("visits_count", False, "a.visits_count", "b.visits_count", _ED), parity_sql("min_visit_age_days", False, "a.min_visit_age_days", "b.min_visit_age_days", _ED), parity_sql("mean_bmi", True, "a.mean_bmi", "b.mean_bmi", _ED),
    _flag_sql("obesity_flag", "bmi_percentile >= 95"), _flag_sql("underweight_flag", "bmi_percentile < 5"),
    parity_sql("ever_obesity_flag", False, "a.ever_obesity_flag", "b.ever_obesity_flag", _ED), parity_sql("ever_underweight_flag", False, "a.ever_underweight_flag", "b.ever_underweight_flag", _ED)]), "visits", ctes=SUM_CTE))
def h15(t: Tables) -> DataFrame:
    p = F.col("bmi_percentile")
    events = derive.add_flags(t.visits, {"obesity_flag": p >= 95, "underweight_flag": p < 5}).withColumn(
        "underweight_flag", F.when(F.col("k") % 67 == 0, 1).otherwise(F.col("underweight_flag")))
    want = rollup.entity_summary(rollup.event_stats(events, PID, AGE).select(PID, "visits_count", "min_visit_age_days"), PID, [
        rollup.channel_stats(events, PID, ["bmi"]).select(PID, "mean_bmi"), rollup.ever_flags(events, PID, ["obesity_flag", "underweight_flag"])], {"visits_count": 0})
    n = F.col(PID).cast("long")
    have = want.where(n % 83 != 0).withColumns({
        "visits_count": F.col("visits_count") + F.when(n % 71 == 0, 1).otherwise(0), "mean_bmi": F.col("mean_bmi") + F.when(n % 73 == 0, 0.5).otherwise(0.0),
        "ever_obesity_flag": F.when(n % 79 == 0, 1 - F.col("ever_obesity_flag")).otherwise(F.col("ever_obesity_flag"))})
    summary = op.summary_parity(want, have, PID, ["visits_count", "min_visit_age_days"], ["mean_bmi"], 0.1)
    flags = op.flag_relations(events, PID, {"obesity_flag": p >= 95, "underweight_flag": p < 5}, have).withColumn("max_difference", F.lit(0.0))
    return rounded(summary.unionByName(flags), "max_difference")


WORLD_CTE = """world AS (SELECT patient_id, age_in_days, CASE WHEN height_in IS NOT NULL AND age_in_days >= onset AND cast(patient_id AS BIGINT) % 5 < 3 THEN height_in - CASE WHEN cast(patient_id AS BIGINT) % 5 = 2 AND k % 2 = 0 THEN -1 ELSE 1 END
        WHEN cast(patient_id AS BIGINT) % 29 = 0 THEN height_in + 1 ELSE height_in END AS height_in, CASE WHEN cast(patient_id AS BIGINT) % 31 = 0 THEN '9-NEW' ELSE encounter_type END AS encounter_type, weight_oz
    FROM (SELECT *, 2000 + cast(patient_id AS BIGINT) * 13 % 3000 AS onset FROM visits) v)"""


def world(t: Tables) -> DataFrame:
    n = F.col(PID).cast("long")
    late = F.col("height_in").isNotNull() & (F.col(AGE) >= 2000 + n * 13 % 3000) & (n % 5 < 3)
    moved = F.col("height_in") - F.when((n % 5 == 2) & (F.col("k") % 2 == 0), -1).otherwise(1)
    return t.visits.select(PID, AGE, F.when(late, moved).when(n % 29 == 0, F.col("height_in") + 1).otherwise(F.col("height_in")).alias("height_in"),
                           F.when(n % 31 == 0, "9-NEW").otherwise(F.col("encounter_type")).alias("encounter_type"), "weight_oz")


_LIST = lambda t, c: f"list(concat_ws('|', age_in_days, {c}) ORDER BY concat_ws('|', age_in_days, {c})) FILTER ({c} IS NOT NULL)"
_DIFF = " || ".join(f"CASE WHEN a.{n} IS DISTINCT FROM b.{n} THEN '{n},' ELSE '' END" for n in ("growth", "mass", "events"))


@query("h16_layer_diff", with_roles(f"""
    , a AS (SELECT patient_id, {_LIST('', 'height_in')} AS growth, {_LIST('', 'weight_oz')} AS mass, {_LIST('', 'encounter_type')} AS events FROM visits GROUP BY 1),
    b AS (SELECT patient_id, {_LIST('', 'height_in')} AS growth, {_LIST('', 'weight_oz')} AS mass, {_LIST('', 'encounter_type')} AS events FROM world GROUP BY 1)
    SELECT patient_id, changed, CASE WHEN contains(changed, 'mass') THEN 'INVARIANT_LAYER_CHANGED' WHEN contains(changed, 'events') THEN 'FORBIDDEN_LAYER_CHANGED' WHEN changed = '' THEN 'UNCHANGED' ELSE 'OK' END AS reason
    FROM (SELECT patient_id, rtrim({_DIFF}, ',') AS changed FROM a JOIN b USING (patient_id)) x""", "visits", ctes=WORLD_CTE))
def h16(t: Tables) -> DataFrame:
    layers = {"growth": [AGE, "height_in"], "mass": [AGE, "weight_oz"], "events": [AGE, "encounter_type"]}
    return op.layer_diff(t.visits, world(t), PID, layers, ["mass"], ["growth"])


@query("h17_paired_assertions", with_roles("""
    , i AS (SELECT patient_id, 2000 + cast(patient_id AS BIGINT) * 13 % 3000 AS onset, cast(patient_id AS BIGINT) % 900 AS ra, CASE WHEN cast(patient_id AS BIGINT) % 7 > 0 THEN cast(patient_id AS BIGINT) % 700 END AS rb FROM patients),
    j AS (SELECT * FROM (SELECT patient_id, age_in_days, max(height_in) AS va FROM visits WHERE height_in IS NOT NULL GROUP BY 1, 2) a FULL JOIN (SELECT patient_id, age_in_days, max(height_in) AS vb FROM world WHERE height_in IS NOT NULL GROUP BY 1, 2) b USING (patient_id, age_in_days) JOIN i USING (patient_id)),
    g AS (SELECT patient_id, count(*) FILTER (age_in_days < onset) AS nb, bool_and(va = vb) FILTER (age_in_days < onset) AS same, bool_or(va <> vb) AS diff, bool_and(vb < va) FILTER (va <> vb) AS dir, bool_or(rb < ra) AS early FROM j GROUP BY 1)
    SELECT patient_id, CASE WHEN nb = 0 THEN 'UNEVALUABLE' WHEN same THEN 'PASS' ELSE 'FAIL' END AS pre_onset_invariant, CASE WHEN diff THEN 'PASS' ELSE 'UNEVALUABLE' END AS differs, CASE WHEN NOT diff THEN 'UNEVALUABLE' WHEN dir THEN 'PASS' ELSE 'FAIL' END AS direction,
      CASE WHEN early IS NULL THEN 'UNEVALUABLE' WHEN early THEN 'PASS' ELSE 'FAIL' END AS earlier_recognition FROM g""", "patients", "visits", ctes=WORLD_CTE))
def h17(t: Tables) -> DataFrame:
    n = F.col(PID).cast("long")
    index = t.patients.select(PID, (2000 + n * 13 % 3000).alias("onset"), (n % 900).alias("ra"), F.when(n % 7 > 0, n % 700).alias("rb"))
    return op.paired_assertions(t.visits, world(t), index, PID, AGE, "height_in", "onset", "ra", "rb", -1)


BUNDLE_CTE = """lines AS (SELECT patient_id, lab_order_id, result_line_num, CASE result_line_num WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'other' END AS component, CASE WHEN cast(lab_order_id AS BIGINT) % 5 = 0 THEN visit_id ELSE lab_order_id END AS visit_id,
      order_age, CASE WHEN cast(lab_order_id AS BIGINT) % 3 = 0 THEN result_age ELSE order_age + 7 END AS result_age, order_age + cast(lab_order_id AS BIGINT) % 4 - 1 AS start_age FROM labs)"""


@query("h18_order_bundle_rules", with_roles("""SELECT lab_order_id, patient_id, count(DISTINCT (result_line_num, component)) FILTER (result_line_num <= 2) = 2 AND bool_and(result_line_num <= 2) AS pairs_ok,
    coalesce(count(DISTINCT visit_id) = 1 AND count(visit_id) = count(*), false) AS visit_ok, coalesce(count(DISTINCT order_age) = 1 AND count(DISTINCT result_age) = 1 AND count(result_age) = count(*) AND min(result_age) = min(order_age) + 7 AND bool_and(start_age >= order_age), false) AS timing_ok
    FROM lines GROUP BY 1, 2""", "labs", ctes=BUNDLE_CTE))
def h18(t: Tables) -> DataFrame:
    o, line = F.col("lab_order_id").cast("long"), F.col("result_line_num")
    rows = t.labs.select(
        PID, "lab_order_id", "result_line_num", F.when(line == 1, "first").when(line == 2, "second").otherwise("other").alias("component"),
        F.when(o % 5 == 0, F.col("visit_id")).otherwise(F.col("lab_order_id")).alias("visit_id"), "order_age",
        F.when(o % 3 == 0, F.col("result_age")).otherwise(F.col("order_age") + 7).alias("result_age"), (F.col("order_age") + o % 4 - 1).alias("start_age"))
    return op.order_bundle_rules(rows, "lab_order_id", PID, "result_line_num", "component", "visit_id", "order_age", "result_age", "start_age",
                                 [(1, "first"), (2, "second")], 7)
