"""Target, disclosure and comparison queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.partition import _pads, partition_label
from ..functions.stats import stabilize, suppress
from ..functions.storage import materialize
from ..operators import derive, targets as op
from .exploration import AGE, PID, VID, rounded
from .registry import query
from .roles import Tables, with_roles
from .screening import LABEL_CTE, labels

KEY, POINTS = b"an example key of 30 bytes----", 7000
_INNER, _OUTER = _pads(KEY)
_DIGEST = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(patient_id))))"
_MOD = f"list_reduce(list_transform(range(0, 16), lambda i: cast('0x' || substr({_DIGEST}, i * 4 + 1, 4) AS BIGINT)), lambda a, x: (a * 65536 + x) % 10000)"
PART_CTE = f"parts AS (SELECT patient_id, CASE WHEN {_MOD} % 10000 < {POINTS} THEN 'calibration' ELSE 'held_out' END AS partition FROM patients)"
KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-NEVER"]
REGISTRY = {"sex": ["F", "M", "U", "X"], "ethnicity": ["HOUSEHOLD", "FURNITURE", "AUTOMOBILE", "Unknown", "Nobody"]}
WINDOWS = [("w0", 0, 1000), ("w1", 1000, 4000), ("w2", 3000, 7305)]


def part(df: DataFrame) -> DataFrame:
    return op.assign_partition(df, PID, KEY, POINTS)


def label() -> Column:
    return partition_label(F.col(PID), KEY, POINTS)


def visits(t: Tables) -> DataFrame:
    return op.mark_partition(t.visits, PID, KEY, POINTS)


def rounded_targets(df: DataFrame) -> DataFrame:
    return df.select(*op.COLUMNS).withColumn("value", F.round("value", 6))


def prop(name: str, family: str, test: str, source: str, stratum: str = "'all'", by: str = "partition") -> str:
    return f"""SELECT partition, {stratum} AS stratum, '{name}' AS name, '{family}' AS family, 'proportion' AS statistic, round(count(*) FILTER ({test}) / cast(count(*) AS DOUBLE), 6) AS value,
      count(*) FILTER ({test}) AS support, count(*) AS denominator FROM {source} GROUP BY {by}"""


def stat(name: str, family: str, kind: str, expr: str, support: str, source: str, stratum: str = "'all'", by: str = "partition") -> str:
    return f"SELECT partition, {stratum} AS stratum, '{name}' AS name, '{family}' AS family, '{kind}' AS statistic, round({expr}, 6) AS value, {support} AS support, cast(NULL AS BIGINT) AS denominator FROM {source} GROUP BY {by}"


@query("f01_assign_partition", with_roles("SELECT * FROM parts", "patients", ctes=PART_CTE))
def f01(t: Tables) -> DataFrame:
    return part(t.patients).select(PID, "partition")


@query("f02_partition_counts", with_roles(" UNION ALL ".join(f"SELECT '{n}' AS table_name, partition, count(*) AS rows FROM {n} JOIN parts USING (patient_id) GROUP BY 2" for n in ("visits", "medications", "labs")),
                                          "patients", "visits", "medications", "labs", ctes=PART_CTE))
def f02(t: Tables) -> DataFrame:
    return op.partition_counts({n: getattr(t, n) for n in ("visits", "medications", "labs")}, PID, label())


PEOPLE = "(SELECT * FROM patients JOIN parts USING (patient_id)) p"
DEMO_SQL = " UNION ALL ".join([prop(f"{f}_{op._slug(c)}", "demographics", f"{f} = '{c}'", PEOPLE) for f, cs in REGISTRY.items() for c in cs] + [
    prop("multi_select", "demographics", "(race_1 IS NOT NULL)::INT + (race_2 IS NOT NULL)::INT + (race_3 IS NOT NULL)::INT > 1", PEOPLE)])


def demographics(t: Tables) -> DataFrame:
    return op.demographic_targets(part(t.patients), REGISTRY, ["race_1", "race_2", "race_3"])


@query("f03_demographic_targets", with_roles(DEMO_SQL, "patients", ctes=PART_CTE))
def f03(t: Tables) -> DataFrame:
    return rounded_targets(demographics(t))


_LAB = "(SELECT * FROM lab JOIN parts USING (patient_id)) p"


OUTCOME_SQL = " UNION ALL ".join([prop("flag_label", "outcome", "label = 1", _LAB), prop("flag_label2", "outcome", "label2 = 1", _LAB)] + [
    stat(f"idx_{s}", "outcome", k, e, "count(idx)", _LAB) for s, k, e in [("mean", "mean", "avg(idx)"), ("q50", "quantile", "quantile_cont(idx, 0.5)"), ("q90", "quantile", "quantile_cont(idx, 0.9)")]])


def outcomes(t: Tables) -> DataFrame:
    return op.outcome_targets(part(labels(t)), ["label", "label2"], "idx")


@query("f04_outcome_targets", with_roles(OUTCOME_SQL, "patients", ctes=f"{PART_CTE}, {LABEL_CTE}"))
def f04(t: Tables) -> DataFrame:
    return rounded_targets(outcomes(t))


_VIS = "(SELECT * FROM visits JOIN parts USING (patient_id)) v"
_USE = "(SELECT q.partition, cast(coalesce(v.c, 0) AS DOUBLE) AS c, cast(v.s AS DOUBLE) AS s FROM parts q LEFT JOIN (SELECT patient_id, count(*) AS c, max(age_in_days) - min(age_in_days) AS s FROM visits GROUP BY 1) v USING (patient_id)) u"
USE_SQL = " UNION ALL ".join(
    [stat(f"{n}_{s}", "utilization", k, e.format(c=c), "count(*)", _USE) for c, n in [("c", "events_per_entity"), ("s", "span_days")]
     for s, k, e in [("mean", "mean", "avg({c})"), ("q50", "quantile", "quantile_cont({c}, 0.5)"), ("q90", "quantile", "quantile_cont({c}, 0.9)")]]
    + [prop(f"kind_{op._slug(k)}", "utilization", f"encounter_type = '{k}'", _VIS) for k in KINDS] + [prop("source_share", "utilization", "source_yn = 'Y'", _VIS)])


def use(t: Tables, events: DataFrame) -> DataFrame:
    return op.use_targets(part(t.patients), events, PID, AGE, "encounter_type", KINDS, "source_yn")


@query("f05_use_targets", with_roles(USE_SQL, "patients", "visits", ctes=PART_CTE))
def f05(t: Tables) -> DataFrame:
    return rounded_targets(use(t, visits(t)))


LINK_SQL = " UNION ALL ".join(
    prop(f"{n}_link", "observation", "hit IS NOT NULL", f"(SELECT q.partition, v.visit_id AS hit FROM {n} x JOIN parts q USING (patient_id) LEFT JOIN visits v ON v.patient_id = x.patient_id AND v.visit_id = x.visit_id) l")
    for n in ("labs", "medications"))


def links(t: Tables, events: DataFrame) -> DataFrame:
    return op.link_targets({n: getattr(t, n) for n in ("labs", "medications")}, events, PID, VID, label())


@query("f06_link_targets", with_roles(LINK_SQL, "patients", "visits", "labs", "medications", ctes=PART_CTE))
def f06(t: Tables) -> DataFrame:
    return rounded_targets(links(t, t.visits))


_WINDOW_CTE = "win AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in WINDOWS) + ") w(win, lo, hi))"
_WVIS = "(SELECT v.*, partition, win FROM visits v JOIN parts USING (patient_id) JOIN win ON age_in_days >= lo AND age_in_days < hi) x"


AVAILABLE_SQL = " UNION ALL ".join(prop(f"{c}_available", "observation", f"{c} IS NOT NULL", _WVIS, "win", "partition, win") for c in ("height_in", "weight_oz", "head_circ_cm"))


def availability(events: DataFrame) -> DataFrame:
    return op.availability_targets(events, AGE, WINDOWS, ["height_in", "weight_oz", "head_circ_cm"])


@query("f07_availability_targets", with_roles(AVAILABLE_SQL, "patients", "visits", ctes=f"{PART_CTE}, {_WINDOW_CTE}"))
def f07(t: Tables) -> DataFrame:
    return rounded_targets(availability(visits(t)))


_GAPS = "(SELECT partition, win, cast(gap AS DOUBLE) AS gap FROM (SELECT patient_id, age_in_days, age_in_days - lag(age_in_days) OVER (PARTITION BY patient_id ORDER BY age_in_days, visit_id) AS gap FROM visits) v JOIN parts USING (patient_id) JOIN win ON age_in_days >= lo AND age_in_days < hi WHERE gap IS NOT NULL) x"


INTERVAL_SQL = " UNION ALL ".join(stat(f"interval_days_{s}", "utilization", k, e, "count(*)", _GAPS, "win", "partition, win") for s, k, e in [
    ("mean", "mean", "avg(gap)"), ("q50", "quantile", "quantile_cont(gap, 0.5)"), ("q90", "quantile", "quantile_cont(gap, 0.9)")])


def intervals(events: DataFrame) -> DataFrame:
    return op.interval_targets(events, PID, AGE, WINDOWS)


@query("f08_interval_targets", with_roles(INTERVAL_SQL, "patients", "visits", ctes=f"{PART_CTE}, {_WINDOW_CTE}"))
def f08(t: Tables) -> DataFrame:
    return rounded_targets(intervals(visits(t)))


_METRICS = {"height_in": ["flag"], "bmi": ["flag", "flag2"]}
_PHY = "(SELECT partition, win, sex, CASE WHEN flag = 0 THEN height_in END AS height_in, CASE WHEN flag = 0 AND flag2 = 0 THEN bmi END AS bmi FROM (SELECT *, CASE WHEN k % 5 > 0 THEN k % 7 // 6 END AS flag, k % 9 // 8 AS flag2 FROM visits) v JOIN parts USING (patient_id) JOIN patients USING (patient_id) JOIN win ON age_in_days >= lo AND age_in_days < hi) x"
PHYS_SQL = "SELECT * FROM (" + " UNION ALL ".join(stat(f"{m}_{s}", "physiology", k, e.format(m=m), f"count({m})", _PHY, "win || '/' || sex", "partition, win, sex") for m in _METRICS for s, k, e in [
    ("mean", "mean", "avg({m})"), ("sd", "sd", "stddev_samp({m})"), ("q10", "quantile", "quantile_cont({m}, 0.1)"), ("q50", "quantile", "quantile_cont({m}, 0.5)"), ("q90", "quantile", "quantile_cont({m}, 0.9)")]) + ") z WHERE support >= 2"


def physiology(t: Tables, events: DataFrame) -> DataFrame:
    k = F.col("k")
    events = derive.attach_entity(events, t.patients, PID, ["sex"]).withColumns({
        "flag": F.when(k % 5 > 0, F.floor(k % 7 / 6)), "flag2": F.floor(k % 9 / 8)})
    return op.physiology_targets(events, AGE, "sex", WINDOWS, _METRICS)


@query("f09_physiology_targets", with_roles(PHYS_SQL, "patients", "visits", ctes=f"{PART_CTE}, {_WINDOW_CTE}"))
def f09(t: Tables) -> DataFrame:
    return rounded_targets(physiology(t, visits(t)))


# The seven builders, in the order of the target table.
_BUILDERS = [DEMO_SQL, OUTCOME_SQL, USE_SQL, LINK_SQL, AVAILABLE_SQL, INTERVAL_SQL, PHYS_SQL]
_ALL_SQL = "targets AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM ({b}) b{i}" for i, b in enumerate(_BUILDERS)) + ")"
_ALL_CTES = f"{PART_CTE.replace('parts AS (', 'parts AS MATERIALIZED (', 1)}, {LABEL_CTE}, {_WINDOW_CTE}, {_ALL_SQL}"
_ALL_ROLES = ("patients", "visits", "labs", "medications")


def every(t: Tables) -> DataFrame:
    # Five of the builders read the visits; what they read of them is worked out and written once.
    events = materialize(visits(t).select("partition", PID, VID, AGE, "encounter_type", "source_yn", "height_in", "weight_oz", "head_circ_cm", "bmi", "k"), "target-visits")
    return op.raw_targets([demographics(t), outcomes(t), use(t, events), links(t, events), availability(events), intervals(events), physiology(t, events)])


@query("f10_raw_targets", with_roles("SELECT *, (SELECT count(*) FROM (SELECT 1 FROM targets GROUP BY partition, stratum, name, statistic HAVING count(*) > 1) d) AS duplicates FROM targets", *_ALL_ROLES, ctes=_ALL_CTES))
def f10(t: Tables) -> DataFrame:
    rows = materialize(rounded_targets(every(t)), "targets")
    return rows.crossJoin(op.duplicate_targets(rows).agg(F.count("*").alias("duplicates")))


_DISCLOSED = """disclosed AS MATERIALIZED (SELECT partition, stratum, name, family, statistic, CASE WHEN support >= 25 THEN round(value, 3) END AS value, CASE WHEN support >= 25 THEN support END AS support,
    CASE WHEN support >= 25 THEN denominator END AS denominator, CASE WHEN support >= 25 THEN 'released' ELSE 'suppressed' END AS status FROM targets)"""


def disclosed(t: Tables) -> DataFrame:
    return op.disclose(every(t).withColumn("value", F.round("value", 6)), 25, 3)


@query("f11_disclose", with_roles("SELECT * FROM disclosed", *_ALL_ROLES, ctes=f"{_ALL_CTES}, {_DISCLOSED}"))
def f11(t: Tables) -> DataFrame:
    return disclosed(t)


TOLERANCES = {"utilization": 30.0, "physiology": 1.5, "outcome": 1.0}
_COMPARE = """compared AS MATERIALIZED (SELECT stratum, name, family, statistic, CASE WHEN ok THEN CASE WHEN diff <= tol THEN 'PASS' ELSE 'FAIL' END ELSE 'UNEVALUABLE' END AS status, CASE WHEN ok THEN a END AS left_value,
    CASE WHEN ok THEN b END AS right_value, CASE WHEN ok THEN round(diff, 6) END AS difference, CASE WHEN ok THEN round(tol, 6) END AS tolerance FROM (SELECT *, abs(a - b) AS diff,
      CASE WHEN statistic = 'proportion' THEN greatest(0.02e0, 2e0 * greatest(sqrt(a * (1 - a) / ad), sqrt(b * (1 - b) / bd))) WHEN family = 'utilization' THEN 30e0 WHEN family = 'physiology' THEN 1.5e0 WHEN family = 'outcome' THEN 1e0 END AS tol,
      coalesce(a IS NOT NULL AND b IS NOT NULL AND asup >= 30 AND bsup >= 30, false) AS ok
    FROM (SELECT stratum, name, family, statistic, value AS a, support AS asup, denominator AS ad FROM disclosed WHERE partition = 'held_out') l
      FULL JOIN (SELECT stratum, name, family, statistic, value AS b, support AS bsup, denominator AS bd FROM disclosed WHERE partition = 'calibration') r USING (stratum, name, family, statistic)) c)"""
_CMP_CTES = f"{_ALL_CTES}, {_DISCLOSED}, {_COMPARE}"


def compared(t: Tables) -> DataFrame:
    d = materialize(disclosed(t), "disclosed")
    side = lambda p: d.where(F.col("partition") == p)
    return rounded(op.compare_targets(side("held_out"), side("calibration"), 30, 0.02, 2.0, 5.0, TOLERANCES), "difference", "tolerance")


@query("f12_compare_targets", with_roles("SELECT * FROM compared", *_ALL_ROLES, ctes=_CMP_CTES))
def f12(t: Tables) -> DataFrame:
    return compared(t)


@query("f13_fidelity_status", with_roles("""
    , c AS (SELECT family, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'UNEVALUABLE') AS unevaluable FROM compared GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN unevaluable > 0 THEN 'UNEVALUABLE' ELSE 'PASS' END AS status FROM c
    UNION ALL SELECT 'all', sum(passed)::BIGINT, sum(failed)::BIGINT, sum(unevaluable)::BIGINT, CASE WHEN sum(failed) > 0 THEN 'FAIL' WHEN sum(unevaluable) > 500 OR count(*) FILTER (family IN ('demographics', 'outcome') AND passed + failed > 0) < 2 THEN 'UNEVALUABLE' ELSE 'PASS' END FROM c""",
    *_ALL_ROLES, ctes=_CMP_CTES))
def f13(t: Tables) -> DataFrame:
    return op.fidelity_status(compared(t), ["demographics", "outcome"], 500)


@query("f14_evidence_across_runs", with_roles("""
    , runs AS (SELECT 'r1' AS run, * FROM compared UNION ALL SELECT 'r2', stratum, name, family, statistic, CASE WHEN status = 'UNEVALUABLE' THEN status WHEN round(difference + 1e-2, 6) <= tolerance THEN 'PASS' ELSE 'FAIL' END, left_value, right_value,
      round(difference + 1e-2, 6), tolerance FROM compared WHERE family <> 'physiology'),
    k AS (SELECT DISTINCT stratum, name, family, statistic FROM runs UNION SELECT 'all', 'required', 'outcome', 'mean'),
    f AS (SELECT k.*, n.run, coalesce(r.status, 'UNEVALUABLE') AS status, left_value, right_value, difference, tolerance FROM k CROSS JOIN (SELECT DISTINCT run FROM runs) n LEFT JOIN runs r USING (stratum, name, family, statistic, run)),
    g AS (SELECT *, status <> 'UNEVALUABLE' AS ok FROM f)
    SELECT stratum, name, family, statistic, min(left_value) FILTER (ok) AS held_out, min(right_value) FILTER (ok) AS generated_min, max(right_value) FILTER (ok) AS generated_max, max(difference) FILTER (ok) AS max_difference,
      round(max(difference - tolerance) FILTER (ok), 6) AS max_excess, count(*) FILTER (ok) AS evaluable, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
      CASE WHEN min(left_value) FILTER (ok) <> max(left_value) FILTER (ok) THEN 'INCONSISTENT' WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (ok) < count(*) THEN 'UNEVALUABLE' ELSE 'PASS' END AS status
    FROM g GROUP BY 1, 2, 3, 4""", *_ALL_ROLES, ctes=_CMP_CTES))
def f14(t: Tables) -> DataFrame:
    first = materialize(compared(t), "compared")
    moved = F.round(F.col("difference") + 0.01, 6)
    second = first.where("family <> 'physiology'").withColumns({
        "status": F.when(F.col("status") == "UNEVALUABLE", F.col("status")).when(moved <= F.col("tolerance"), "PASS").otherwise("FAIL"), "difference": moved})
    runs = first.withColumn("run", F.lit("r1")).unionByName(second.withColumn("run", F.lit("r2")))
    required = first.limit(1).select(*[F.lit(v).alias(c) for c, v in [("stratum", "all"), ("name", "required"), ("family", "outcome"), ("statistic", "mean")]])
    return rounded(op.evidence_across_runs(runs, required), "max_excess")


@query("f15_suppress", with_roles("SELECT patient_id, n, CASE WHEN n NOT BETWEEN 1 AND 9 THEN n END AS shown FROM (SELECT patient_id, count(head_circ_cm) + count(weight_oz) AS n FROM visits GROUP BY 1) x", "visits"))
def f15(t: Tables) -> DataFrame:
    n = t.visits.groupBy(PID).agg((F.count("head_circ_cm") + F.count("weight_oz")).alias("n"))
    return n.withColumn("shown", suppress(F.col("n")))


@query("f16_stabilize", with_roles("SELECT patient_id, cast(printf('%.7e', avg(weight_oz) / 7) AS DOUBLE) AS mean_weight FROM visits GROUP BY 1", "visits"))
def f16(t: Tables) -> DataFrame:
    return t.visits.groupBy(PID).agg(stabilize(F.avg("weight_oz") / 7).alias("mean_weight"))
