"""Exploration queries on layers, measurements and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derive, explore as op
from .derivation import BASE_CTE, base, gap_sql, velocity_cte
from .profiling import YEAR_BANDS, band_sql
from .registry import query
from .roles import Tables, with_roles


PID, AGE, VID = "patient_id", "age_in_days", "visit_id"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


DERIVED_CTE = """derived AS (SELECT visit_id, CASE WHEN k % 13 = 0 THEN NULL ELSE weight_oz END AS weight_oz,
      CASE WHEN k % 17 = 0 THEN height_in + 0.05e0 ELSE coalesce(height_in, CASE WHEN k % 19 = 0 THEN 20e0 END) END AS height_in, encounter_type FROM visits)"""


def derived(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.visits.select(
        VID, F.when(k % 13 != 0, F.col("weight_oz")).alias("weight_oz"),
        F.when(k % 17 == 0, F.col("height_in") + 0.05).otherwise(F.coalesce("height_in", F.when(k % 19 == 0, 20.0))).alias("height_in"), "encounter_type")


_AGREE = " UNION ALL ".join(f"""SELECT count(*) AS rows, '{c}' AS field, count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) AS differs,
    count(*) FILTER (a.{c} IS NOT NULL AND b.{c} IS NULL) AS left_only, count(*) FILTER (a.{c} IS NULL AND b.{c} IS NOT NULL) AS right_only,
    count(*) FILTER (abs(try_cast(a.{c} AS DOUBLE) - try_cast(b.{c} AS DOUBLE)) > 1e-2) AS beyond_tolerance,
    100e0 * count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) / count(*) AS share FROM visits a JOIN derived b USING (visit_id)"""
                            for c in ("weight_oz", "height_in", "encounter_type"))


@query("e01_layer_agreement", with_roles(_AGREE, "visits", ctes=DERIVED_CTE))
def e01(t: Tables) -> DataFrame:
    return op.layer_agreement(t.visits, derived(t), VID, [(c, c) for c in ("weight_oz", "height_in", "encounter_type")])


_LOSS = " UNION ALL ".join(f"""SELECT '{c}' AS field, count(*) FILTER ({c} IS DISTINCT FROM d_{c}) AS differs, count(*) FILTER ({c} IS NOT NULL AND d_{c} IS NULL) AS lost,
    count(DISTINCT {c}) AS raw_distinct, count(DISTINCT d_{c}) AS derived_distinct, count(DISTINCT {c}) FILTER (d_{c} IS NULL) AS dropped_values FROM c""" for c in ("ethnicity", "race_1"))


@query("e02_category_loss", with_roles(f"""
    , c AS (SELECT ethnicity, race_1, CASE WHEN ethnicity NOT IN ('Unknown', 'Choose not to answer') THEN ethnicity END AS d_ethnicity,
      CASE WHEN race_1 <> 'Unable to collect' THEN race_1 END AS d_race_1 FROM patients) {_LOSS}""", "patients"))
def e02(t: Tables) -> DataFrame:
    return op.category_loss(t.patients, derive.clean_categories(t.patients, ["ethnicity", "race_1"]), PID, ["ethnicity", "race_1"])


@query("e03_funnel", with_roles("""
    , s AS (SELECT count(*) AS a, count(*) FILTER (height_in IS NOT NULL) AS b, count(*) FILTER (height_in IS NOT NULL AND age_in_days >= 730) AS c,
      count(*) FILTER (height_in IS NOT NULL AND age_in_days >= 730 AND weight_oz IS NOT NULL) AS d FROM visits)
    SELECT 0 AS step, 'all' AS label, a AS remaining, 0 AS excluded FROM s UNION ALL SELECT 1, 'height', b, a - b FROM s
    UNION ALL SELECT 2, 'two or older', c, b - c FROM s UNION ALL SELECT 3, 'weight', d, c - d FROM s
    UNION ALL SELECT 4, CASE WHEN count(DISTINCT code) = 500 THEN 'codes PASS' ELSE 'codes FAIL' END, count(DISTINCT code), 500 FROM visit_codes""", "visits", "visit_codes"))
def e03(t: Tables) -> DataFrame:
    steps = [("height", F.col("height_in").isNotNull()), ("two or older", F.col(AGE) >= 730), ("weight", F.col("weight_oz").isNotNull())]
    kept = op.surviving_codes(t.visit_codes, "code", 500).select(
        F.lit(4).alias("step"), F.concat(F.lit("codes "), F.col("status")).alias("label"), F.col("observed").alias("remaining"), F.col("expected").alias("excluded"))
    return op.funnel(t.visits, steps).unionByName(kept)


def _spread_sql(c: str, bound: str) -> str:
    return f"""SELECT '{c}' AS channel, count(*) FILTER (n > 1) AS multi, count(*) FILTER (s > 0) AS disagree, count(*) FILTER (s > 0 AND hi > {bound}) AS above_bound,
      round(quantile_cont(CASE WHEN s > 0 THEN s END, 0.5), 6) AS median, round(quantile_cont(CASE WHEN s > 0 THEN s END, 0.95), 6) AS p95,
      round(max(CASE WHEN s > 0 THEN s END), 6) AS max_spread
      FROM (SELECT count(*) AS n, max({c}) AS hi, max({c}) - min({c}) AS s FROM visits WHERE {c} IS NOT NULL GROUP BY patient_id, age_in_days) g"""


@query("e04_same_period_spread", with_roles(" UNION ALL ".join([_spread_sql("height_in", "60"), _spread_sql("weight_oz", "1e9")]), "visits"))
def e04(t: Tables) -> DataFrame:
    return rounded(op.same_period_spread(t.visits, PID, AGE, {"height_in": 60.0, "weight_oz": None}), "median", "p95", "max_spread")


@query("e05_spread_by_band", with_roles(f"""SELECT band, count(*) AS all_days, count(*) FILTER (s > 0) AS days, round(quantile_cont(CASE WHEN s > 0 THEN s END, 0.5), 6) AS median
    FROM (SELECT max(height_in) - min(height_in) AS s, {band_sql('age_in_days', YEAR_BANDS)} FROM visits WHERE height_in IS NOT NULL GROUP BY patient_id, age_in_days) g
    WHERE band IS NOT NULL GROUP BY band""", "visits"))
def e05(t: Tables) -> DataFrame:
    return rounded(op.spread_by_band(t.visits, PID, AGE, "height_in", YEAR_BANDS), "median")


PAIRS_CTE = """pairs AS (SELECT DISTINCT patient_id, code FROM (SELECT patient_id, code FROM visit_codes UNION ALL SELECT patient_id, pl_diag FROM problem_list) x WHERE trim(code) <> '')"""


def pairs(t: Tables) -> DataFrame:
    return op.entity_codes([t.visit_codes.select(PID, "code"), t.problem_list.select(PID, F.col("pl_diag").alias("code"))], t.tasks("lineitem"))


@query("e06_entity_codes", with_roles("SELECT * FROM pairs", "visit_codes", "problem_list", ctes=PAIRS_CTE))
def e06(t: Tables) -> DataFrame:
    return pairs(t)


SHAPE = "^[E-P][0-9][0-9]"


@query("e07_code_hierarchy", with_roles(f"""
    , tagged AS (SELECT patient_id, code, left(code, 3) AS parent, code = left(code, 3) AS bare, regexp_matches(code, '{SHAPE}') AS shaped FROM pairs),
    holders AS (SELECT parent, patient_id, bool_or(bare) AS has_bare FROM tagged WHERE shaped GROUP BY parent, patient_id),
    spread AS (SELECT count(*) / nullif(cast(sum(CASE WHEN has_bare THEN 1 ELSE 0 END) AS DOUBLE), 0) AS times FROM holders GROUP BY parent),
    vocabulary AS (SELECT DISTINCT code, parent, bare, shaped FROM tagged)
    SELECT (SELECT count(*) FROM vocabulary WHERE shaped) AS codes, (SELECT count(*) FROM vocabulary WHERE shaped AND bare) AS bare_codes,
      (SELECT count(DISTINCT parent) FROM vocabulary WHERE shaped) AS categories, (SELECT count(*) FROM vocabulary WHERE NOT shaped) AS unshaped,
      count(*) - count(times) AS silent, count(times) AS visible, round(quantile_cont(times, 0.5), 6) AS ratio_p50, round(quantile_cont(times, 0.9), 6) AS ratio_p90,
      round(max(times), 6) AS ratio_max FROM spread""",
    "visit_codes", "problem_list", ctes=PAIRS_CTE))
def e07(t: Tables) -> DataFrame:
    return rounded(op.code_hierarchy(pairs(t), PID, SHAPE, t.tasks("lineitem")), "ratio_p50", "ratio_p90", "ratio_max")


def _top_sql(expr: str, name: str, k: int, where: str = "true") -> str:
    return f"""(SELECT {expr} AS {name}, count(DISTINCT patient_id) AS n, cast(row_number() OVER (ORDER BY count(DISTINCT patient_id) DESC, {expr}) AS INT) AS rank
      FROM pairs WHERE {where} GROUP BY 1 ORDER BY rank LIMIT {k})"""


@query("e08_literal_vs_rolled", with_roles(f"""SELECT a.rank, a.code, a.n AS code_n, b.category, b.n AS category_n, c.code AS member, c.n AS member_n
    FROM {_top_sql('code', 'code', 6)} a JOIN {_top_sql('substr(code, 1, 3)', 'category', 6)} b USING (rank)
    LEFT JOIN {_top_sql('code', 'code', 5, "starts_with(code, 'E34')")} c USING (rank)""", "visit_codes", "problem_list", ctes=PAIRS_CTE))
def e08(t: Tables) -> DataFrame:
    p, parts = pairs(t), t.tasks("lineitem")
    member = op.subtree(p, PID, "E34", parts=parts).select("rank", F.col("code").alias("member"), F.col("n").alias("member_n"))
    return op.literal_vs_rolled(p, PID, parts=parts).join(member, "rank", "left")


@query("e09_grain_check", with_roles("""SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated, cast(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeated, max(n) AS largest
    FROM (SELECT count(*) AS n FROM visits GROUP BY patient_id, age_in_days) g""", "visits"))
def e09(t: Tables) -> DataFrame:
    return op.grain_check(t.visits, [PID, AGE])


@query("e10_capture_by_type", with_roles("""SELECT kind, CASE WHEN n > 9 THEN n END AS visits, CASE WHEN n > 9 THEN 100e0 * w / n END AS weight_oz, CASE WHEN n > 9 THEN 100e0 * h / n END AS head_circ_cm
    FROM (SELECT CASE WHEN k % 2003 = 0 THEN 'rare' ELSE encounter_type END AS kind, count(*) AS n, count(weight_oz) AS w, count(head_circ_cm) AS h FROM visits GROUP BY 1) x""", "visits"))
def e10(t: Tables) -> DataFrame:
    rows = t.visits.withColumn("kind", F.when(F.col("k") % 2003 == 0, "rare").otherwise(F.col("encounter_type")))
    return op.capture_by_type(rows, "kind", ["weight_oz", "head_circ_cm"])


@query("e11_capture_by_source", with_roles("""SELECT source_yn, count(*) AS visits, 100e0 * count(height_in) / count(*) AS height_in, 100e0 * count(bmi) / count(*) AS bmi FROM visits GROUP BY 1""", "visits"))
def e11(t: Tables) -> DataFrame:
    return op.capture_by_source(t.visits, "source_yn", ["height_in", "bmi"])


@query("e12_carry_forward", with_roles("""
    , s AS (SELECT event_id, patient_id, hour, kind, floor(value / 10) AS v FROM stream)
    SELECT kind, count(*) AS candidates, count(*) FILTER (EXISTS (SELECT 1 FROM s o WHERE o.patient_id = c.patient_id AND o.event_id <> c.event_id
      AND o.kind NOT IN ('error', 'view') AND abs(o.hour - c.hour) <= 24 AND o.v = c.v)) AS carried,
      100e0 * count(*) FILTER (EXISTS (SELECT 1 FROM s o WHERE o.patient_id = c.patient_id AND o.event_id <> c.event_id
      AND o.kind NOT IN ('error', 'view') AND abs(o.hour - c.hour) <= 24 AND o.v = c.v)) / count(*) AS share FROM s c GROUP BY kind""", "stream"))
def e12(t: Tables) -> DataFrame:
    return op.carry_forward(t.stream.withColumn("v", F.floor(F.col("value") / 10)), PID, "hour", "v", "kind", ["error", "view"], 24)


@query("e13_supply_curve", with_roles("""
    , p AS (SELECT count(DISTINCT age_in_days) AS k FROM visits WHERE height_in IS NOT NULL GROUP BY patient_id)
    SELECT k, (SELECT count(*) FROM p b WHERE b.k >= a.k) AS entities FROM (SELECT DISTINCT k FROM p) a""", "visits"))
def e13(t: Tables) -> DataFrame:
    return op.supply_curve(t.visits, PID, AGE, "height_in")


@query("e14_row_day_inflation", with_roles("""
    , p AS (SELECT patient_id, count(height_in) AS r, count(h2) AS d, count(DISTINCT CASE WHEN h2 IS NOT NULL THEN age_in_days END) AS days
      FROM (SELECT *, CASE WHEN height_in BETWEEN 20 AND 70 THEN height_in END AS h2 FROM visits) v GROUP BY 1)
    SELECT count(*) FILTER (d > days) AS inflated, count(*) FILTER (r > 0) AS raw_entities, count(*) FILTER (d > 0) AS derived_entities,
      count(*) FILTER (r > 0 AND d = 0) AS raw_only, count(*) FILTER (r > d) AS lost_some, cast(sum(r) - sum(d) AS BIGINT) AS removed FROM p""", "visits"))
def e14(t: Tables) -> DataFrame:
    return op.row_day_inflation(t.visits.withColumn("h2", F.when(F.col("height_in").between(20, 70), F.col("height_in"))), PID, AGE, "height_in", "h2")


_GRIDS = [("whole inch", "height_in", 1.0), ("half inch", "height_in", 0.5), ("quarter inch", "height_in", 0.25), ("whole ounce", "weight_oz", 1.0), ("whole pound", "weight_oz", 16.0)]


@query("e15_heaping", with_roles(" UNION ALL ".join(
    f"""SELECT '{g}' AS grid, count({c}) AS n, count(*) FILTER ({c} / {s}e0 = floor({c} / {s}e0)) AS on_grid,
      100e0 * count(*) FILTER ({c} / {s}e0 = floor({c} / {s}e0)) / count({c}) AS share FROM visits""" for g, c, s in _GRIDS), "visits"))
def e15(t: Tables) -> DataFrame:
    return op.heaping(t.visits, _GRIDS)


@query("e16_heaping_by_band", with_roles(f"""SELECT band, count(weight_oz) AS n, round(100e0 * count(*) FILTER (weight_oz / 16 = floor(weight_oz / 16)) / count(weight_oz), 1) AS share
    FROM (SELECT *, {band_sql('age_in_days', YEAR_BANDS)} FROM visits) v WHERE band IS NOT NULL GROUP BY 1""", "visits"))
def e16(t: Tables) -> DataFrame:
    return op.heaping_by_band(t.visits, "weight_oz", 16.0, AGE, YEAR_BANDS)


@query("e17_conversion_error", with_roles(" UNION ALL ".join(
    f"""SELECT '{n}' AS conversion, count({a} - {b} * {k}) AS pairs, count(*) FILTER (abs({a} - {b} * {k}) > 1e-3) AS over, round(max(abs({a} - {b} * {k})), 9) AS largest,
      CASE WHEN count(*) FILTER (abs({a} - {b} * {k}) > 1e-3) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM base"""
    for n, a, b, k in [("height", "height_cm", "height_in", "2.54e0"), ("weight", "weight_kg", "weight_oz", "0.028e0")]), "visits", "patients", ctes=BASE_CTE))
def e17(t: Tables) -> DataFrame:
    return rounded(op.conversion_error(base(t), [("height", "height_cm", "height_in", 2.54), ("weight", "weight_kg", "weight_oz", 0.028)]), "largest", digits=9)


@query("e18_saturation", with_roles("""
    SELECT 'z' AS channel, count(z) AS n, min(z) AS min_value, max(z) AS max_value, CASE WHEN count(*) FILTER (abs(z) > 5) NOT BETWEEN 1 AND 9 THEN count(*) FILTER (abs(z) > 5) END AS beyond,
      cast(0 AS BIGINT) AS at_0, cast(0 AS BIGINT) AS at_100 FROM (SELECT (height_in - 45) / 8 AS z FROM visits) q
    UNION ALL SELECT 'bmi_percentile', count(bmi_percentile), min(bmi_percentile), max(bmi_percentile), 0, count(*) FILTER (bmi_percentile = 0), count(*) FILTER (bmi_percentile = 100) FROM visits""", "visits"))
def e18(t: Tables) -> DataFrame:
    return op.saturation(t.visits.withColumn("z", (F.col("height_in") - 45) / 8), ["z"], ["bmi_percentile"])


@query("e19_tail_truncation", with_roles("""SELECT a AS lower_near, b AS lower_far, c AS upper_near, d AS upper_far, round(c * b / cast(a AS DOUBLE), 6) AS expected_upper_far FROM (
    SELECT count(*) FILTER (z <= -1.5e0) AS a, count(*) FILTER (z <= -2) AS b, count(*) FILTER (z >= 1.5e0) AS c, count(*) FILTER (z >= 2) AS d FROM (SELECT (height_in - 45) / 8 AS z FROM visits) q) s""", "visits"))
def e19(t: Tables) -> DataFrame:
    return rounded(op.tail_truncation(t.visits.withColumn("z", (F.col("height_in") - 45) / 8), "z", (1.5, 2.0)), "expected_upper_far")


@query("e20_band_repair", with_roles("""SELECT band, CASE WHEN count(*) NOT BETWEEN 1 AND 9 THEN count(*) END AS visits, min(v) AS min_value, max(v) AS max_value,
    count(*) FILTER (v / 2.54e0 BETWEEN 25 AND 65) AS repaired_once, count(*) FILTER (v / 2.54e0 / 2.54e0 BETWEEN 25 AND 65) AS repaired_twice, round(quantile_cont(v, 0.5), 6) AS median
    FROM (SELECT head_circ_cm AS v, CASE WHEN head_circ_cm <= 25 THEN 'low' WHEN head_circ_cm <= 65 THEN 'normal' WHEN head_circ_cm <= 100 THEN 'high' ELSE 'top' END AS band
      FROM visits WHERE head_circ_cm IS NOT NULL) b GROUP BY 1""", "visits"))
def e20(t: Tables) -> DataFrame:
    bands = [("low", None, 25.0), ("normal", 25.0, 65.0), ("high", 65.0, 100.0), ("top", 100.0, None)]
    return rounded(op.band_repair(t.visits, "head_circ_cm", bands, 25.0, 65.0, 2.54), "median")


EXPECT_CTE = """one_value AS (SELECT patient_id, age_in_days, max(height_in) AS v, row_number() OVER (PARTITION BY patient_id ORDER BY age_in_days) AS i
      FROM visits WHERE height_in IS NOT NULL GROUP BY patient_id, age_in_days HAVING min(height_in) = max(height_in)),
    expect AS (SELECT m.patient_id, m.age_in_days, m.v, a.v + (b.v - a.v) * (m.age_in_days - a.age_in_days) / (b.age_in_days - a.age_in_days) AS expected
      FROM one_value m JOIN one_value a ON a.patient_id = m.patient_id AND a.i + 1 = m.i JOIN one_value b ON b.patient_id = m.patient_id AND b.i = m.i + 1
      WHERE a.v >= 15 AND a.v <= 80 AND b.v >= 15 AND b.v <= 80 AND b.age_in_days <= a.age_in_days + 1460 AND b.v >= a.v - 0.5e0)"""


def expectation(t: Tables) -> DataFrame:
    return op.neighbour_expectation(t.visits, PID, AGE, "height_in", 15.0, 80.0, 1460, 0.5)


@query("e21_neighbour_expectation", with_roles("SELECT patient_id, age_in_days, v, round(expected, 6) AS expected FROM expect", "visits", ctes=EXPECT_CTE))
def e21(t: Tables) -> DataFrame:
    return rounded(expectation(t), "expected")


# Names of the two unit slips.
SCALES = [("centimetre value in the inch field", 1.0 / 2.54), ("inch value where a centimetre is expected", 2.54)]
ORDER = [op.FEET, *[n for n, _ in SCALES], op.SHIFT, op.SWAP, op.OMIT, op.CALIBRATION]
_NUM = "(try_cast(c AS DOUBLE) > 0 AND {same}abs(try_cast(c AS DOUBLE) - expected) <= 1)"
HITS_CTE = f"""odd AS (SELECT patient_id || '-' || cast(age_in_days AS VARCHAR) AS id, age_in_days, v, expected FROM expect WHERE expected > 0 AND abs(v - expected) > 3)"""


def hits_cte(source: str, name: str, keep: str) -> str:
    digit = lambda e: f"contains('0123456789', {e}) AND length({e}) = 1"
    at = lambda i: f"substr(s, cast({i} AS BIGINT), 1)"
    other = "try_cast(c AS DOUBLE) <> v AND "
    swaps = (f"list_filter(list_transform(range(1, length(s)), lambda i: CASE WHEN {digit(at('i'))} AND {digit(at('i + 1'))} AND {at('i')} <> {at('i + 1')} "
             f"THEN substr(s, 1, i - 1) || {at('i + 1')} || {at('i')} || substr(s, i + 2) END), lambda c: {_NUM.format(same=other)})")
    ins = (f"list_filter(list_transform(range(0, 10 * (length(s) + 1)), lambda q: substr(s, 1, q // 10) || cast(q % 10 AS VARCHAR) || substr(s, q // 10 + 1)), "
           f"lambda c: {_NUM.format(same=other)})")
    sub = (f"list_filter(list_transform(range(0, 10 * length(s)), lambda q: CASE WHEN {digit(at('q // 10 + 1'))} AND {at('q // 10 + 1')} <> cast(q % 10 AS VARCHAR) "
           f"THEN substr(s, 1, q // 10) || cast(q % 10 AS VARCHAR) || substr(s, q // 10 + 2) END), lambda c: {_NUM.format(same='')})")
    tests = [(op.FEET, "v = floor(v) AND v BETWEEN 1 AND 6 AND floor(expected / 12) = v"),
             (SCALES[0][0], "abs(v * (1e0 / 2.54e0) - expected) <= 1"), (SCALES[1][0], "abs(v * 2.54e0 - expected) <= 1"),
             (op.SHIFT, "abs(v * 1e-2 - expected) <= 1 OR abs(v * 1e-1 - expected) <= 1 OR abs(v * 1e1 - expected) <= 1 OR abs(v * 1e2 - expected) <= 1"),
             (op.SWAP, f"len({swaps}) > 0"), (op.OMIT, f"len({ins}) > 0"), (op.CALIBRATION, f"len({sub}) > 0")]
    items = ", ".join(f"CASE WHEN {test} THEN '{n}' END" for n, test in tests)
    return f"""{name} AS (SELECT {keep}, list_filter([{items}], lambda x: x IS NOT NULL) AS hits FROM
      (SELECT *, regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\\.$', '') AS s FROM {source}) q)"""


def anomalies(t: Tables) -> DataFrame:
    return expectation(t).where((F.col("expected") > 0) & (F.abs(F.col("v") - F.col("expected")) > 3)).select(
        F.concat_ws("-", PID, AGE).alias("id"), AGE, "v", "expected")


def score(df: DataFrame) -> DataFrame:
    return op.entry_mechanisms(df, "v", "expected", F.lit(1.0), SCALES, feet=True)


@query("e22_entry_mechanisms", with_roles("SELECT id, array_to_string(hits, '; ') AS hits FROM h", "visits", ctes=f"{EXPECT_CTE}, {HITS_CTE}, {hits_cte('odd', 'h', 'id')}"))
def e22(t: Tables) -> DataFrame:
    return score(anomalies(t)).select("id", F.array_join("hits", "; ").alias("hits"))


REPS = 20
NULL_CTE = f"""pool AS (SELECT *, expected - v AS deviation, least(age_in_days // 365, 17) AS pool FROM odd),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY deviation, id) - 1 AS number, count(*) OVER (PARTITION BY pool) AS size FROM pool),
    drawn AS (SELECT a.id, r.rep, a.v, a.v + b.deviation AS expected FROM numbered a CROSS JOIN (SELECT unnest(range({REPS})) AS rep) r
      JOIN numbered b ON a.pool = b.pool AND b.number = cast('0x' || substr(md5('null|' || a.id || '|' || cast(r.rep AS VARCHAR)), 1, 8) AS BIGINT) % a.size)"""


def null_hits(t: Tables) -> DataFrame:
    return op.mechanism_null(anomalies(t), "id", "v", "expected", AGE, score, REPS)


def rate_sql(body: str) -> str:
    return with_roles(body, "visits", ctes=f"{EXPECT_CTE}, {HITS_CTE}, {hits_cte('odd', 'h', 'id')}, {NULL_CTE}, {hits_cte('drawn', 'n', 'id, rep')}, rates AS (SELECT mechanism, "
                      f"(SELECT count(*) FROM h WHERE list_contains(hits, mechanism)) AS observed, (SELECT count(*) FROM n WHERE list_contains(hits, mechanism)) / {REPS}e0 AS null_n "
                      f"FROM (SELECT unnest([{', '.join(repr(x) for x in ORDER)}]) AS mechanism) m)")


@query("e23_mechanism_null", rate_sql('SELECT mechanism, observed, null_n AS "null", round(CASE WHEN null_n >= 0.2e0 THEN observed / null_n END, 6) AS ratio FROM rates'))
def e23(t: Tables) -> DataFrame:
    return rounded(op.mechanism_rates(score(anomalies(t)), null_hits(t), REPS, ORDER), "ratio")


@query("e24_mechanism_accounting", rate_sql(f"""
    , keep AS (SELECT list(mechanism) AS c FROM rates WHERE mechanism <> '{op.CALIBRATION}' AND observed > null_n),
    own AS (SELECT x AS name, count(*) AS observed FROM (SELECT list_intersect(hits, c)[1] AS x FROM h, keep WHERE len(list_intersect(hits, c)) = 1) q GROUP BY 1),
    chance AS (SELECT x AS name, count(*) AS n FROM (SELECT list_intersect(hits, c)[1] AS x FROM n, keep WHERE len(list_intersect(hits, c)) = 1) q GROUP BY 1)
    SELECT 'named' AS item, count(*) FILTER (list_has_any(hits, c)) AS observed, cast(NULL AS DOUBLE) AS "null" FROM h, keep
    UNION ALL SELECT 'calibration_only', count(*) FILTER (NOT list_has_any(hits, c) AND list_contains(hits, '{op.CALIBRATION}')), NULL FROM h, keep
    UNION ALL SELECT 'nothing', count(*) FILTER (NOT list_has_any(hits, c) AND NOT list_contains(hits, '{op.CALIBRATION}')), NULL FROM h, keep
    UNION ALL SELECT 'alone: ' || name, observed, coalesce(chance.n, 0) / {REPS}e0 FROM own LEFT JOIN chance USING (name)"""))
def e24(t: Tables) -> DataFrame:
    from ..functions.storage import materialize

    hits, chance = materialize(score(anomalies(t)), "hits"), materialize(null_hits(t), "null-hits")
    return op.mechanism_accounting(hits, chance, op.mechanism_rates(hits, chance, REPS, ORDER), REPS)


@query("e25_gate_sensitivity", with_roles("""
    , picked AS (SELECT v, regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\\.$', '') AS s FROM expect),
    moved AS (SELECT v, unnest(list_distinct(list_transform(range(1, length(s)), lambda i: CASE WHEN contains('0123456789', substr(s, i, 1)) AND contains('0123456789', substr(s, i + 1, 1))
      AND substr(s, i, 1) <> substr(s, i + 1, 1) THEN try_cast(substr(s, 1, i - 1) || substr(s, i + 1, 1) || substr(s, i, 1) || substr(s, i + 2) AS DOUBLE) END))) AS c FROM picked)
    SELECT (SELECT count(*) FROM picked) AS sampled, count(*) AS swaps, count(*) FILTER (abs(c - v) / v > 1e-1) AS caught,
      round(100e0 * count(*) FILTER (abs(c - v) / v > 1e-1) / count(*), 6) AS share FROM moved WHERE c > 0 AND c <> v""", "visits", ctes=EXPECT_CTE))
def e25(t: Tables) -> DataFrame:
    return rounded(op.gate_sensitivity(expectation(t), "v", 0.1), "share")


PAIR_CTE = """days AS (SELECT patient_id, age_in_days, min(sex) AS sex, min(height_cm) AS v FROM base WHERE height_cm IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT height_cm) = 1),
    rp AS (SELECT * FROM (SELECT *, lag(v) OVER w AS v_prev, lag(age_in_days) OVER w AS age_prev, lead(v) OVER w AS v_next, v - lag(v) OVER w AS change,
      age_in_days - lag(age_in_days) OVER w AS gap FROM days WINDOW w AS (PARTITION BY patient_id ORDER BY age_in_days)) f WHERE v_prev IS NOT NULL)"""


def pair_rows(t: Tables) -> DataFrame:
    return op.repeat_pairs(base(t), PID, AGE, "height_cm", ["sex"])


def pair_sql(body: str) -> str:
    return with_roles(body, "visits", "patients", ctes=f"{BASE_CTE}, {PAIR_CTE}")


@query("e26_repeat_pairs", pair_sql("SELECT patient_id, age_in_days, sex, v, v_prev, age_prev, v_next, round(change, 6) AS change, gap FROM rp"))
def e26(t: Tables) -> DataFrame:
    return rounded(pair_rows(t), "change")


@query("e27_change_by_gap", pair_sql("""SELECT band, count(*) AS pairs, 100e0 * count(*) FILTER (change = 0) / count(*) AS zero, 100e0 * count(*) FILTER (change < 0) / count(*) AS decrease,
    round(quantile_cont(CASE WHEN change < 0 THEN -change END, 0.5), 6) AS median_loss
    FROM (SELECT *, CASE WHEN gap BETWEEN 0 AND 180 THEN 'to 180' WHEN gap BETWEEN 181 AND 365 THEN '181-365' WHEN gap >= 366 THEN 'over a year' END AS band
      FROM rp WHERE age_prev >= 730) g WHERE band IS NOT NULL GROUP BY 1"""))
def e27(t: Tables) -> DataFrame:
    gaps = [("to 180", 0, 180), ("181-365", 181, 365), ("over a year", 366, None)]
    return rounded(op.change_by_gap(pair_rows(t).where("age_prev >= 730"), gaps), "median_loss")


_AB = [("2-6", 730, 2192), ("6-12", 2192, 4383), ("12-20", 4383, 7305)]


@query("e28_change_by_age", pair_sql(f"""SELECT 'all' AS split, * FROM (SELECT {band_sql('age_prev', _AB)}, 'all' AS sex, count(*) AS pairs, round(100e0 * count(*) FILTER (change < 0) / count(*), 6) AS rate, round(avg(change), 6) AS mean_change
    FROM rp WHERE gap BETWEEN 181 AND 365 GROUP BY 1) a WHERE band IS NOT NULL AND pairs >= 50 UNION ALL
    SELECT 'sex', * FROM (SELECT {band_sql('age_prev', _AB)}, sex, count(*) AS pairs, round(100e0 * count(*) FILTER (change < 0) / count(*), 6), round(avg(change), 6)
    FROM rp WHERE gap BETWEEN 181 AND 365 GROUP BY 1, 2) a WHERE band IS NOT NULL AND pairs >= 50"""))
def e28(t: Tables) -> DataFrame:
    p = pair_rows(t)
    overall = op.change_by_age(p, _AB).withColumns({"sex": F.lit("all"), "split": F.lit("all")})
    return rounded(overall.unionByName(op.change_by_age(p, _AB, "sex").withColumn("split", F.lit("sex"))), "rate", "mean_change")


@query("e29_rebound", pair_sql("""SELECT count(*) AS losses, count(*) FILTER (v_next >= v_prev) AS back, count(*) FILTER (v_next >= v_prev - 0.5e0) AS back_with_slack
    FROM rp WHERE gap > 365 AND age_prev >= 730 AND change < -1 AND v_next IS NOT NULL"""))
def e29(t: Tables) -> DataFrame:
    return op.rebound(pair_rows(t))


def published(t: Tables) -> DataFrame:
    return derive.min_gap_velocity(t.visits, PID, AGE, VID, {"h": ("height_in", derive.HEIGHT_GAPS)}, digits=6)


def source_cte(rule, name: str) -> str:
    return f"""{name} AS (SELECT c.*, (SELECT max(p.age_in_days) FROM h p WHERE p.v IS NOT NULL AND p.patient_id = c.patient_id
      AND p.age_in_days <= c.age_in_days - ({gap_sql(rule, 'c.age_in_days')})) AS prev_age FROM h c WHERE c.v IS NOT NULL)"""


PUB_CTE = velocity_cte("visits", "height_in", derive.HEIGHT_GAPS, "h")


def half_up(e: str) -> str:
    """Spark's ``round`` to six digits, half away from zero on the number as written; DuckDB's own rounds the binary product with 10**6, which moves ties."""
    return f"cast(round(cast(cast({e} AS VARCHAR) AS DECIMAL(38, 24)), 6) AS DOUBLE)"


_E30_CTES = f"""{velocity_cte("visits", "height_in", derive.HEIGHT_GAPS, "h0")},
    h AS (SELECT * REPLACE ({half_up('raw')} AS delta, {half_up('raw / gap * 365')} AS velocity) FROM h0), {source_cte(derive.HEIGHT_GAPS, 's')}"""


@query("e30_reproduce_velocity", with_roles(f"""
    , dup AS (SELECT patient_id, age_in_days FROM h WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    r AS (SELECT *, (SELECT max(q.v) FROM h q WHERE q.patient_id = s.patient_id AND q.age_in_days = s.prev_age) AS prev_v,
      EXISTS (SELECT 1 FROM dup d WHERE d.patient_id = s.patient_id AND d.age_in_days IN (s.age_in_days, s.prev_age)) AS isdup FROM s WHERE delta IS NOT NULL AND prev_age IS NOT NULL),
    x AS (SELECT *, abs({half_up('v - prev_v')} - delta) AS diff FROM r)
    SELECT count(*) AS n, (SELECT count(delta) FROM h) AS published, count(*) FILTER (age_in_days - prev_age = gap) AS gap_match, count(*) FILTER (diff < 1e-9) AS exact,
      count(*) FILTER (diff < 0.0101e0) AS within, count(*) FILTER (diff >= 0.0101e0) AS off, count(*) FILTER (diff >= 0.0101e0 AND isdup) AS off_on_repeated_days,
      count(*) FILTER ({half_up('(v - prev_v) / (age_in_days - prev_age) * 365')} = velocity) AS velocity_from_source,
      count(*) FILTER ({half_up('delta / gap * 365')} = velocity) AS velocity_from_published, count(*) FILTER ({half_up('delta / gap * 365.25e0')} = velocity) AS velocity_other_year,
      CASE WHEN count(*) = (SELECT count(delta) FROM h) THEN 'PASS' ELSE 'FAIL' END AS status,
      (SELECT count(*) FROM (SELECT max(v) - lag(max(v)) OVER (PARTITION BY patient_id ORDER BY age_in_days) AS dv, max(delta) AS d FROM h WHERE v IS NOT NULL GROUP BY patient_id, age_in_days) l
        WHERE abs(dv - d) < 0.0101e0) AS lag1 FROM x""", "visits", ctes=_E30_CTES))
def e30(t: Tables) -> DataFrame:
    pub = published(t)
    naive = op.naive_velocity(pub, PID, AGE, "height_in", "delta_h").select("lag1")
    return op.reproduce_velocity(pub, PID, AGE, "height_in", "delta_h", "gap_h", "velocity_h", derive.HEIGHT_GAPS, digits=6).crossJoin(naive)


@query("e31_cross_rule", with_roles(f"""
    SELECT 'own' AS item, cast(NULL AS BIGINT) AS smallest, count(*) FILTER (gap IS NOT NULL) AS n, count(*) FILTER (age_in_days - prev_age = gap) AS matched FROM s
    UNION ALL SELECT 'weight rule', NULL, count(*) FILTER (gap IS NOT NULL), count(*) FILTER (age_in_days - prev_age = gap) FROM s2
    UNION ALL SELECT band, min(gap), count(*), NULL FROM (SELECT gap, {band_sql('age_in_days', YEAR_BANDS)} FROM h WHERE gap IS NOT NULL) b WHERE band IS NOT NULL GROUP BY band""",
    "visits", ctes=f"{PUB_CTE}, {source_cte(derive.HEIGHT_GAPS, 's')}, {source_cte(derive.WEIGHT_GAPS, 's2')}"))
def e31(t: Tables) -> DataFrame:
    pub = published(t)
    rules = op.cross_rule(pub, PID, AGE, "height_in", "gap_h", {"own": derive.HEIGHT_GAPS, "weight rule": derive.WEIGHT_GAPS}).select(
        F.col("rule").alias("item"), F.lit(None).cast("long").alias("smallest"), F.col("rows").alias("n"), "matched")
    gaps = op.smallest_gap(pub, AGE, "gap_h", YEAR_BANDS).select(F.col("band").alias("item"), "smallest", "n", F.lit(None).cast("long").alias("matched"))
    return rules.unionByName(gaps)


@query("e32_reference_spread", with_roles("""
    , z AS (SELECT height_in / 10 AS a, weight_oz / 300 AS b, bmi / 4 AS c FROM visits)
    SELECT 'spread' AS item, count(*) AS n, round(quantile_cont(greatest(a, b, c) - least(a, b, c), 0.5), 6) AS p50, round(quantile_cont(greatest(a, b, c) - least(a, b, c), 0.95), 6) AS p95 FROM z
      WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
    UNION ALL (SELECT 'gap ' || cast(gap AS VARCHAR), count(*), NULL, NULL FROM h WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 8)""", "visits", ctes=PUB_CTE))
def e32(t: Tables) -> DataFrame:
    z = t.visits.select((F.col("height_in") / 10).alias("a"), (F.col("weight_oz") / 300).alias("b"), (F.col("bmi") / 4).alias("c"))
    spread = rounded(op.reference_spread(z, ["a", "b", "c"]), "p50", "p95").select(F.lit("spread").alias("item"), "n", "p50", "p95")
    common = op.common_values(published(t), "gap_h").select(F.concat(F.lit("gap "), F.col("value")).alias("item"), "n",
                                                            F.lit(None).cast("double").alias("p50"), F.lit(None).cast("double").alias("p95"))
    return spread.unionByName(common)


@query("e33_band_profile", with_roles(f"""SELECT band, sex, count(*) AS rows, count(DISTINCT patient_id) AS entities, round(avg(height_cm), 6) AS mean_height_cm, round(stddev_samp(height_cm), 6) AS sd_height_cm,
    round(avg(weight_kg), 6) AS mean_weight_kg, round(stddev_samp(weight_kg), 6) AS sd_weight_kg FROM (SELECT *, {band_sql('age_in_days', YEAR_BANDS)} FROM base) b WHERE band IS NOT NULL GROUP BY 1, 2""",
    "visits", "patients", ctes=BASE_CTE))
def e33(t: Tables) -> DataFrame:
    cols = ["height_cm", "weight_kg"]
    return rounded(op.band_profile(base(t), PID, AGE, YEAR_BANDS, "sex", cols), *[f"{s}_{c}" for c in cols for s in ("mean", "sd")])


@query("e34_variance_components", with_roles("""
    , series AS (SELECT patient_id, list(x ORDER BY age_in_days) AS xs FROM (SELECT patient_id, age_in_days, max(bmi) AS x FROM visits WHERE bmi IS NOT NULL
        GROUP BY patient_id, age_in_days HAVING min(bmi) = max(bmi)) one GROUP BY patient_id),
    long AS (SELECT len(xs) AS n, list_avg(xs) AS centre, list_var_samp(xs) AS spread FROM series WHERE len(xs) > 1),
    sums AS (SELECT count(*) AS entities, cast(sum(n) AS BIGINT) AS n_values, var_samp(centre) AS across, avg(spread) AS inside, sum(spread * (n - 1)) / sum(n - 1) AS pooled FROM long),
    steps AS (SELECT xs[i] AS later, xs[i - 1] AS sooner FROM (SELECT xs, unnest(range(2, len(xs) + 1)) AS i FROM series) r),
    chain AS (SELECT count(*) AS pairs, corr(later, sooner) AS rho FROM steps)
    SELECT entities, n_values, round(sqrt(across), 6) AS "between", round(sqrt(inside), 6) AS within, round(sqrt(pooled), 6) AS within_pooled, pairs, round(rho, 6) AS lag1,
      round(across / (across + inside), 6) AS icc, round(across / (across + pooled), 6) AS icc_pooled, round(1 + inside / across, 6) AS design_factor FROM sums, chain""", "visits"))
def e34(t: Tables) -> DataFrame:
    return rounded(op.variance_components(t.visits, PID, AGE, "bmi"), "between", "within", "within_pooled", "lag1", "icc", "icc_pooled", "design_factor")


@query("e35_recompute_check", with_roles("""
    , q AS (SELECT abs(b2 - weight_kg / pow(height_cm / 100, 2)) AS d, CASE WHEN bmi_percentile < 5 THEN 'low' WHEN bmi_percentile <= 85 THEN 'mid' WHEN bmi_percentile IS NOT NULL THEN 'top' END AS c,
      CASE WHEN bmi_percentile < 5 THEN 'low' WHEN bmi_percentile < 85 THEN 'mid' ELSE 'top' END AS r FROM (SELECT *, round(weight_kg / pow(height_cm / 100, 2), 1) AS b2 FROM base) x)
    SELECT count(d) AS n, round(max(d), 6) AS largest, count(*) FILTER (d > 1e-1) AS off, count(c) AS categorised, count(*) FILTER (c <> r) AS wrong_category, round(quantile_cont(d, 0.5), 6) AS median,
      CASE WHEN count(*) FILTER (d > 1e-1) > 0 OR count(*) FILTER (c <> r) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM q""", "visits", "patients", ctes=BASE_CTE))
def e35(t: Tables) -> DataFrame:
    formula, p = F.col("weight_kg") / F.pow(F.col("height_cm") / 100, 2), F.col("bmi_percentile")
    rows = base(t).withColumn("b2", F.round(formula, 1)).withColumn("cat", F.when(p < 5, "low").when(p <= 85, "mid").when(p.isNotNull(), "top"))
    return rounded(op.recompute_check(rows, "b2", formula, 0.1, "cat", F.when(p < 5, "low").when(p < 85, "mid").otherwise("top")), "largest", "median")
