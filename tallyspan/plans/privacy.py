"""Privacy queries on three disjoint parts of the bound entities, one of them seeded with copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson_interval
from ..functions.storage import materialize
from ..operators import privacy as op
from .exploration import AGE, PID
from .registry import query
from .roles import Tables, with_roles

_PIECE = "sum(cast('0x' || substr(sha256({t}), {s}, 15) AS BIGINT)) FILTER (coalesce(height_in, weight_oz, head_circ_cm) IS NOT NULL)"
_ROW = "concat_ws('|', age_in_days, " + ", ".join(f"coalesce(cast(cast(round({m} * 1000000) AS BIGINT) AS VARCHAR), '-')" for m in ("height_in", "weight_oz", "head_circ_cm")) + ")"
_DAY = "cast(age_in_days AS VARCHAR)"
PROF_CTE = f"""per AS (SELECT patient_id, count(*) AS visit_count, count(*) FILTER (coalesce(height_in, weight_oz, head_circ_cm) IS NOT NULL) AS n_obs,
      {_PIECE.format(t=_ROW, s=1)} AS r1, {_PIECE.format(t=_ROW, s=16)} AS r2, {_PIECE.format(t=_DAY, s=1)} AS t1, {_PIECE.format(t=_DAY, s=16)} AS t2 FROM visits GROUP BY 1),
    prof0 AS (SELECT patient_id, sex, cast(label AS VARCHAR) AS label, n_obs, sha256(concat_ws('|', sex, ethnicity, race_1)) AS demographics, sha256(concat_ws(':', n_obs, t1, t2)) AS timing,
      cast(visit_count AS VARCHAR) AS utilization, sha256(concat_ws(':', n_obs, r1, r2)) AS trajectory, cast(label AS VARCHAR) AS diagnosis FROM patients JOIN per USING (patient_id) WHERE n_obs >= 3),
    prof AS (SELECT *, sha256(concat_ws('|', demographics, timing, utilization, trajectory, diagnosis)) AS signature FROM prof0)"""
SETS_CTE = """ref AS (SELECT * FROM prof WHERE cast(patient_id AS BIGINT) % 3 = 0), held AS (SELECT * FROM prof WHERE cast(patient_id AS BIGINT) % 3 = 1),
    gen AS (SELECT * FROM prof WHERE cast(patient_id AS BIGINT) % 3 = 2 UNION ALL SELECT * REPLACE ('g' || patient_id AS patient_id) FROM prof WHERE cast(patient_id AS BIGINT) % 21 = 0)"""
CTES = f"{PROF_CTE}, {SETS_CTE}"
Z = "1.959963984540054e0"


def wilson_sql(k: str, n: str, lower: str, upper: str) -> str:
    p, zz = f"({k} / cast({n} AS DOUBLE))", f"({Z} * {Z})"
    den = f"(1 + {zz} / {n})"
    centre = f"(({p} + {zz} / (2 * {n})) / {den})"
    half = f"(({Z} / {den}) * sqrt({p} * (1 - {p}) / {n} + {zz} / (4 * cast({n} AS DOUBLE) * {n})))"
    return f"round(greatest(0e0, {centre} - {half}), 6) AS {lower}, round(least(1e0, {centre} + {half}), 6) AS {upper}"


def profiles(t: Tables) -> DataFrame:
    return op.entity_profiles(t.patients, t.visits, PID, ["sex", "ethnicity", "race_1"], "sex", AGE, ["height_in", "weight_oz", "head_circ_cm"], "label")


def sets(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = materialize(profiles(t), "profiles")
    n = F.col(PID).cast("long")
    copies = p.where(n % 21 == 0).withColumn(PID, F.concat(F.lit("g"), PID))
    return p.where(n % 3 == 0), p.where(n % 3 == 2).unionByName(copies), p.where(n % 3 == 1)


def sql(body: str, *more: str) -> str:
    return with_roles(body, "patients", "visits", *more, ctes=CTES)


@query("g01_entity_profiles", sql("SELECT * FROM prof"))
def g01(t: Tables) -> DataFrame:
    return profiles(t)


@query("g02_identifier_overlap", sql(f"""
    , r AS (SELECT DISTINCT id FROM (SELECT patient_id AS id FROM ref UNION ALL SELECT visit_id FROM visits WHERE cast(patient_id AS BIGINT) % 3 = 0) x),
    g AS (SELECT DISTINCT id FROM (SELECT patient_id AS id FROM gen UNION ALL SELECT visit_id FROM visits WHERE cast(patient_id AS BIGINT) % 3 = 2 OR cast(patient_id AS BIGINT) % 300 = 0) x)
    SELECT identifiers, overlap, round(overlap / cast(identifiers AS DOUBLE), 6) AS overlap_rate, {wilson_sql('overlap', 'identifiers', 'ci_lower', 'ci_upper')}, CASE WHEN overlap > 0 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM (SELECT count(*) AS identifiers, count(*) FILTER (id IN (SELECT id FROM r)) AS overlap FROM g) s"""))
def g02(t: Tables) -> DataFrame:
    ref, gen, _ = sets(t)
    n = F.col(PID).cast("long")
    return op.identifier_overlap(
        op.identifiers([(ref, [PID]), (t.visits.where(n % 3 == 0), ["visit_id"])]),
        op.identifiers([(gen, [PID]), (t.visits.where((n % 3 == 2) | (n % 300 == 0)), ["visit_id"])]))


@query("g03_exact_reproduction", sql(f"""SELECT evaluated, reproduced, round(reproduced / cast(evaluated AS DOUBLE), 6) AS rate, {wilson_sql('reproduced', 'evaluated', 'ci_lower', 'ci_upper')},
    CASE WHEN reproduced > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT count(*) AS evaluated, count(*) FILTER (trajectory IN (SELECT trajectory FROM ref)) AS reproduced FROM gen) s"""))
def g03(t: Tables) -> DataFrame:
    ref, gen, _ = sets(t)
    return op.exact_reproduction(ref, gen)


_MATCH = " + ".join(f"(q.{c} = r.{c})::INT" for c in op.COMPONENTS)


def nearest_sql(source: str, prefix: str) -> str:
    return f"""(SELECT cell, count(*) AS {prefix}evaluated, count(*) FILTER (lvl = 5) AS {prefix}exact, round(count(*) FILTER (lvl = 5) / cast(count(*) AS DOUBLE), 6) AS {prefix}zero_rate,
      round(count(*) FILTER (n = 1) / cast(count(*) AS DOUBLE), 6) AS {prefix}unique_rate, round(count(*) FILTER (n <> 1) / cast(count(*) AS DOUBLE), 6) AS {prefix}tied_rate
      FROM (SELECT patient_id, unnest(['overall', 'sex=' || sex]) AS cell, lvl, n FROM (SELECT patient_id, sex, max(m) AS lvl, count(*) FILTER (m = best) AS n FROM
        (SELECT *, max(m) OVER (PARTITION BY patient_id) AS best FROM (SELECT q.patient_id, q.sex, {_MATCH} AS m FROM {source} q CROSS JOIN ref r) a) b GROUP BY 1, 2) c) d GROUP BY 1)"""


@query("g04_nearest_component", sql(f"""SELECT cell, evaluated, zero_rate, unique_rate, tied_rate, heldout_evaluated, heldout_zero_rate, heldout_unique_rate, {wilson_sql('exact', 'evaluated', 'ci_lower', 'ci_upper')},
    CASE WHEN evaluated < 50 OR coalesce(heldout_evaluated, 0) < 50 THEN 'UNEVALUABLE' WHEN zero_rate > 0.05e0 OR unique_rate > 0.9e0 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM {nearest_sql('gen', '')} g LEFT JOIN {nearest_sql('held', 'heldout_')} h USING (cell)"""))
def g04(t: Tables) -> DataFrame:
    ref, gen, held = sets(t)
    return op.nearest_component(ref, gen, held, 50, 0.05, 0.9)


_SELECTIONS = [(c,) for c in op.COMPONENTS] + [tuple(op.COMPONENTS)]


def link_sql(source: str, with_held: bool) -> str:
    key = lambda a, s: "concat_ws('|', " + ", ".join(f"{a}.{c}" for c in s) + ")"
    n = "(SELECT count(*) FROM ref)"
    shift = ", ".join(f"(SELECT {c} FROM idx j WHERE j.i = (idx.i + {k + 1}) % {n}) AS {c}" for k, c in enumerate(op.COMPONENTS))
    parts = []
    for i, s in enumerate(_SELECTIONS):
        uniq = lambda src: f"SELECT {key('z', s)} AS k FROM {src} z GROUP BY 1 HAVING count(*) = 1"
        rate = lambda src: f"round(count(*) FILTER ({key('q', s)} IN ({uniq(src)})) / cast(count(*) AS DOUBLE), 6)"
        held = (f"(SELECT {rate('ref')} FROM (SELECT *, unnest(['overall', 'sex=' || sex]) AS cell FROM held) q WHERE q.cell = g.cell)" if with_held else "cast(NULL AS DOUBLE)")
        parts.append(f"SELECT cell, {i} AS sel, '{'+'.join(s)}' AS selection, evaluated, unique_rate, permutation_rate, {held} AS heldout_unique_rate FROM (SELECT cell, count(*) AS evaluated, {rate('ref')} AS unique_rate, {rate('shifted')} AS permutation_rate "
                     f"FROM (SELECT *, unnest(['overall', 'sex=' || sex]) AS cell FROM {source}) q GROUP BY cell) g")
    return f"""idx AS (SELECT *, row_number() OVER (ORDER BY patient_id) - 1 AS i FROM ref), shifted AS (SELECT {shift} FROM idx),
    cand AS ({' UNION ALL '.join(parts)}),
    adv AS (SELECT *, round(greatest(0e0, unique_rate - greatest(permutation_rate, coalesce(heldout_unique_rate, 0e0))), 6) AS advantage FROM cand),
    link AS (SELECT cell, selection, evaluated, unique_rate, permutation_rate, heldout_unique_rate, advantage FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY advantage DESC, unique_rate DESC, permutation_rate, coalesce(heldout_unique_rate, 0e0), sel) AS rn FROM adv) z WHERE rn = 1)"""


@query("g05_linkage", sql(f", {link_sql('gen', True)} SELECT * FROM link"))
def g05(t: Tables) -> DataFrame:
    ref, gen, held = sets(t)
    return op.linkage(ref, gen, held, PID)


_RUNS = [("s1", 7, 3), ("s2", 5, 4)]
_RUN_CTE = "pack AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run, trajectory FROM ref WHERE cast(patient_id AS BIGINT) // 3 % {a} < {a // 2}" for r, a, _ in _RUNS) + "), mem AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS run, trajectory FROM ref WHERE cast(patient_id AS BIGINT) // 3 % {b} = 0" for r, _, b in _RUNS) + ")"


@query("g06_membership_inference", sql(f"""
    , {_RUN_CTE}, c AS (SELECT run, count(*) AS evaluated, count(*) FILTER (m) AS positives, count(*) FILTER (NOT m) AS negatives, count(*) FILTER (m AND s) AS tp, count(*) FILTER (NOT m AND s) AS fp
      FROM (SELECT u.run, EXISTS (SELECT 1 FROM mem WHERE mem.run = u.run AND mem.trajectory = ref.trajectory) AS m, EXISTS (SELECT 1 FROM pack WHERE pack.run = u.run AND pack.trajectory = ref.trajectory) AS s
        FROM ref CROSS JOIN (SELECT unnest(['s1', 's2']) AS run) u) x GROUP BY 1),
    w AS (SELECT *, {wilson_sql('tp', 'positives', 'tl', 'tu')}, {wilson_sql('fp', 'negatives', 'fl', 'fu')} FROM c)
    SELECT run, evaluated, positives, negatives, tp AS true_positives, fp AS false_positives, round(tp / cast(positives AS DOUBLE), 6) AS tpr, round(fp / cast(negatives AS DOUBLE), 6) AS fpr,
      round(greatest(0e0, tp / cast(positives AS DOUBLE) - fp / cast(negatives AS DOUBLE)), 6) AS advantage, round(greatest(0e0, tl - fu), 6) AS advantage_lower, round(greatest(0e0, tu - fl), 6) AS advantage_upper,
      CASE WHEN greatest(0e0, tp / cast(positives AS DOUBLE) - fp / cast(negatives AS DOUBLE)) > 1e-1 THEN 'FAIL' ELSE 'PASS' END AS status FROM w"""))
def g06(t: Tables) -> DataFrame:
    from functools import reduce

    ref, _, _ = sets(t)
    pick = lambda r, m, low: ref.where(F.floor(F.col(PID).cast("long") / 3) % m < low).select(F.lit(r).alias("run"), "trajectory")
    packages = reduce(DataFrame.unionByName, [pick(r, a, a // 2) for r, a, _ in _RUNS])
    members = reduce(DataFrame.unionByName, [pick(r, b, 1) for r, _, b in _RUNS])
    return op.membership_inference(ref, packages, members, 0.1)


_ATT = " + ".join(f"(q.{c} = r.{c})::INT" for c in op.COMPONENTS if c != "diagnosis")


@query("g07_attribute_disclosure", sql(f"""
    , idx AS (SELECT *, (row_number() OVER (ORDER BY patient_id) - 1) % 2 AS half FROM ref), tr AS (SELECT * FROM idx WHERE half = 0),
    q AS (SELECT g.*, e.label AS target FROM gen g JOIN idx e ON e.half = 1 AND e.trajectory = g.trajectory WHERE (SELECT count(*) FROM ref r WHERE r.trajectory = g.trajectory) = 1 AND (SELECT count(*) FROM gen z WHERE z.trajectory = g.trajectory) = 1),
    s AS (SELECT q.patient_id, q.target, r.label, {_ATT} AS m FROM q CROSS JOIN tr r), b AS (SELECT *, max(m) OVER (PARTITION BY patient_id) AS best FROM s),
    v AS (SELECT patient_id, target, CASE WHEN count(*) FILTER (label = '1') >= count(*) FILTER (label = '0') THEN '1' ELSE '0' END AS guess FROM b WHERE m = best GROUP BY 1, 2),
    mj AS (SELECT (SELECT CASE WHEN count(*) FILTER (label = '1') >= count(*) FILTER (label = '0') THEN '1' ELSE '0' END FROM tr) AS r, (SELECT CASE WHEN count(*) FILTER (label = '1') >= count(*) FILTER (label = '0') THEN '1' ELSE '0' END FROM held) AS h),
    a AS (SELECT count(*) AS evaluated, count(*) FILTER (guess = target) AS attack_hits, count(*) FILTER (target = r) AS rb, count(*) FILTER (target = h) AS hb FROM v, mj)
    SELECT evaluated, attack_hits, round(attack_hits / cast(evaluated AS DOUBLE), 6) AS attack_accuracy, {wilson_sql('attack_hits', 'evaluated', 'ci_lower', 'ci_upper')}, round(rb / cast(evaluated AS DOUBLE), 6) AS reference_baseline,
      round(hb / cast(evaluated AS DOUBLE), 6) AS heldout_baseline, round(greatest(0e0, round(attack_hits / cast(evaluated AS DOUBLE), 6) - round(greatest(rb, hb) / cast(evaluated AS DOUBLE), 6)), 6) AS advantage,
      CASE WHEN greatest(0e0, round(attack_hits / cast(evaluated AS DOUBLE), 6) - round(greatest(rb, hb) / cast(evaluated AS DOUBLE), 6)) > 0.05e0 THEN 'FAIL' ELSE 'PASS' END AS status FROM a"""))
def g07(t: Tables) -> DataFrame:
    ref, gen, held = sets(t)
    return op.attribute_disclosure(ref, gen, held, PID, 0.05)


@query("g08_composition", sql(f"""SELECT evaluated, reproduced, round(reproduced / cast(evaluated AS DOUBLE), 6) AS rate, {wilson_sql('reproduced', 'evaluated', 'ci_lower', 'ci_upper')}, cast(2 AS INT) AS prior_releases,
    CASE WHEN reproduced / cast(evaluated AS DOUBLE) > 1e-2 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM (SELECT count(*) AS evaluated, count(*) FILTER (trajectory IN (SELECT trajectory FROM held UNION ALL SELECT trajectory FROM ref WHERE cast(patient_id AS BIGINT) % 42 = 0)) AS reproduced FROM gen) s"""))
def g08(t: Tables) -> DataFrame:
    ref, gen, held = sets(t)
    return op.composition(gen, [held, ref.where(F.col(PID).cast("long") % 42 == 0)], 0.01)


def _harness_sql(source: str, name: str, detected: str) -> str:
    return f"""SELECT '{name}' AS control, evaluated, reproduced, rr AS reproduction_rate, unique_rate, permutation_rate, adv AS advantage, CASE WHEN (adv > 1e-1) = {detected} THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT s.*, l.*, round(greatest(0e0, unique_rate - permutation_rate, rr), 6) AS adv FROM (SELECT count(*) AS evaluated, count(*) FILTER (trajectory IN (SELECT trajectory FROM ref)) AS reproduced,
        round(count(*) FILTER (trajectory IN (SELECT trajectory FROM ref)) / cast(count(*) AS DOUBLE), 6) AS rr FROM {source}) s, (SELECT unique_rate, permutation_rate FROM link WHERE cell = 'overall') l) z"""


@query("g09_control_harness", sql(f", {link_sql('held', False)} {_harness_sql('held', 'negative_control', 'false')} UNION ALL SELECT * FROM (WITH {link_sql('ref', False)} {_harness_sql('ref', 'positive_control', 'true')}) p"))
def g09(t: Tables) -> DataFrame:
    ref, _, held = sets(t)
    return op.control_harness(ref, held, PID, "negative_control", False, 0.1).unionByName(op.control_harness(ref, ref, PID, "positive_control", True, 0.1))


@query("g10_wilson_interval", with_roles(f"SELECT encounter_type, k, n, {wilson_sql('k', 'n', 'ci_lower', 'ci_upper')} FROM (SELECT encounter_type, count(head_circ_cm) AS k, count(*) AS n FROM visits GROUP BY 1) x", "visits"))
def g10(t: Tables) -> DataFrame:
    rows = t.visits.groupBy("encounter_type").agg(F.count("head_circ_cm").alias("k"), F.count("*").alias("n"))
    lower, upper = wilson_interval(F.col("k"), F.col("n"))
    return rows.withColumns({"ci_lower": lower, "ci_upper": upper})


@query("g11_with_subgroups", sql(f"""
    , c AS (SELECT cell, count(*) AS evaluated, count(*) FILTER (trajectory IN (SELECT trajectory FROM ref)) AS reproduced FROM (SELECT *, unnest(['overall', 'sex=' || sex]) AS cell FROM gen) q GROUP BY 1),
    s AS (SELECT cell, evaluated, reproduced, round(reproduced / cast(evaluated AS DOUBLE), 6) AS rate, {wilson_sql('reproduced', 'evaluated', 'ci_lower', 'ci_upper')}, CASE WHEN evaluated < 40 THEN 'UNEVALUABLE' WHEN reproduced > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c)
    SELECT *, cell = (SELECT cell FROM s WHERE status = 'FAIL' ORDER BY rate DESC, evaluated DESC, cell DESC LIMIT 1) AS worst FROM s"""))
def g11(t: Tables) -> DataFrame:
    ref, gen, _ = sets(t)
    return op.with_subgroups(gen, lambda q: op.reproduction_by_cell(q, ref), 40)


@query("g12_audit_decision", sql("""
    , c AS (SELECT 'exact_reproduction' AS control, CASE WHEN count(*) FILTER (trajectory IN (SELECT trajectory FROM ref)) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM gen
      UNION ALL SELECT 'composition', CASE WHEN count(*) FILTER (trajectory IN (SELECT trajectory FROM held)) > 0 THEN 'FAIL' ELSE 'PASS' END FROM gen)
    SELECT count(*) AS controls, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (control IN ('exact_reproduction', 'linkage') AND status = 'UNEVALUABLE') + 2 - count(*) FILTER (control IN ('exact_reproduction', 'linkage')) AS required_open,
      CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (control IN ('exact_reproduction', 'linkage')) < 2 THEN 'UNEVALUABLE' ELSE 'PASS' END AS decision FROM c"""))
def g12(t: Tables) -> DataFrame:
    ref, gen, held = sets(t)
    rows = op.exact_reproduction(ref, gen).select(F.lit("exact_reproduction").alias("control"), "status").unionByName(
        op.composition(gen, [held]).select(F.lit("composition").alias("control"), "status"))
    return op.audit_decision(rows, ["exact_reproduction", "linkage"])
