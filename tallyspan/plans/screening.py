"""Domain, label and screen queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derive, explore, rollup, screens as op
from .exploration import AGE, PAIRS_CTE, PID, pairs, rounded
from .profiling import YEAR_BANDS, band_sql
from .registry import query
from .roles import Tables, with_roles
from .rollup import CODES_CTE, FIRST_CTE, PREFIXES, _LEAST, codes

LABEL_CTE = """lab AS (SELECT patient_id, label, label2, CASE WHEN label = 1 THEN round((cast(patient_id AS BIGINT) * 37 % 6000) / 365.25e0, 3) END AS idx, balance FROM patients)"""


def labels(t: Tables) -> DataFrame:
    age = F.round((F.col(PID).cast("long") * 37 % 6000) / 365.25, 3)
    return t.patients.select(PID, "label", "label2", F.when(F.col("label") == 1, age).alias("idx"), "balance")


@query("e36_slots_filled", with_roles("""SELECT cast(n AS INT) AS filled, count(*) AS rows, n * count(*) AS slots
    FROM (SELECT count(*) AS n FROM visit_codes GROUP BY patient_id, visit_id) s GROUP BY n""", "visit_codes"))
def e36(t: Tables) -> DataFrame:
    return op.lines_filled(t.visit_codes, [PID, "visit_id"])


LOOKUP_CTE = """book AS (SELECT replace(code, '.', '') AS key, min(description) AS description FROM named_codes GROUP BY 1)"""


def _top_codes_sql(source: str, code: str, kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, f.code, coalesce(description, '[not in the lookup]') AS description, n, entities FROM
      (SELECT {code} AS code, count(*) AS n, count(DISTINCT patient_id) AS entities FROM {source} GROUP BY 1 ORDER BY n DESC, code LIMIT 25) f LEFT JOIN book ON replace(f.code, '.', '') = key"""


@query("e37_top_codes", with_roles(" UNION ALL ".join([_top_codes_sql("visit_codes", "code", "slots"), _top_codes_sql("problem_list", "pl_diag", "problems"),
                                                       _top_codes_sql("pairs", "substr(code, 1, 3)", "categories")]),
                                   "visit_codes", "problem_list", "named_codes", ctes=f"{PAIRS_CTE}, {LOOKUP_CTE}"))
def e37(t: Tables) -> DataFrame:
    from ..sources.references import code_lookup

    book = code_lookup(t.named_codes, "code", "description")
    top = lambda df, c, kind: op.top_codes(df, PID, c, book, parts=t.tasks("lineitem")).withColumn("kind", F.lit(kind))
    return top(t.visit_codes, F.col("code"), "slots").unionByName(top(t.problem_list, F.col("pl_diag"), "problems")).unionByName(
        top(pairs(t), F.substring("code", 1, 3), "categories"))


@query("e38_entities_without", with_roles("""
    SELECT 'referrals' AS kind, count(*) AS entities FROM patients WHERE patient_id NOT IN (SELECT patient_id FROM referrals)
    UNION ALL SELECT 'early visits', count(*) FROM patients WHERE patient_id NOT IN (SELECT patient_id FROM visits WHERE age_in_days < 730)
    UNION ALL SELECT 'problem rows', count(*) FROM problem_list UNION ALL SELECT 'problem pairs', count(*) FROM (SELECT DISTINCT patient_id, pl_diag FROM problem_list) p""",
    "patients", "referrals", "visits", "problem_list"))
def e38(t: Tables) -> DataFrame:
    none = op.entities_without(t.patients, {"referrals": t.referrals, "early visits": t.visits.where("age_in_days < 730")}, PID)
    unique = op.pair_uniqueness(t.problem_list, [PID, "pl_diag"]).unpivot([], ["rows", "pairs"], "kind", "entities")
    return none.unionByName(unique.withColumn("kind", F.concat(F.lit("problem "), "kind")))


@query("e39_component_grain", with_roles("""
    , g AS (SELECT lab_order_id, count(*) AS rows, count(component) AS c FROM labs GROUP BY 1),
    p AS (SELECT procedure_name, count(*) AS procedure_rows, count(DISTINCT patient_id) AS procedure_entities, cast(row_number() OVER (ORDER BY count(*) DESC, procedure_name) AS INT) AS rank,
      count(*) OVER () AS procedures FROM labs WHERE procedure_name IS NOT NULL GROUP BY 1 QUALIFY rank <= 25)
    SELECT p.*, x.* FROM p CROSS JOIN (SELECT cast(sum(rows) AS BIGINT) AS rows, count(*) AS orders, cast(sum(c) AS BIGINT) AS components, count(*) FILTER (c > 0) AS resulted_orders, count(*) FILTER (c = 0) AS empty_orders,
      (SELECT count(DISTINCT patient_id) FROM labs) AS entities, sum(rows) / cast(count(*) AS DOUBLE) AS rows_per_order, sum(c) / cast(count(*) FILTER (c > 0) AS DOUBLE) AS components_per_order FROM g) x""", "labs"))
def e39(t: Tables) -> DataFrame:
    grain = op.component_grain(t.labs, PID, "lab_order_id", "result_line_num", "component")
    return op.top_procedures(t.labs, PID, "procedure_name").crossJoin(grain)  # one row


@query("e40_record_types", with_roles("""SELECT record_type, count(*) AS rows, count(DISTINCT patient_id) AS entities, 100e0 * count(start_age) / count(*) AS start_age_pct, 100e0 * count(end_age) / count(*) AS end_age_pct,
    (SELECT count(DISTINCT generic_name) FROM medications WHERE regexp_matches(generic_name, '[a-z][A-Z]{2,}')) AS emphasised,
    (SELECT count(*) FROM (SELECT lower(generic_name) FROM medications GROUP BY 1 HAVING count(DISTINCT generic_name) > 1) v) AS case_variants FROM medications GROUP BY 1""", "medications"))
def e40(t: Tables) -> DataFrame:
    return op.record_types(t.medications, PID, "record_type", ["start_age", "end_age"]).crossJoin(op.name_shapes(t.medications, "generic_name"))


@query("e41_listing_with_age", with_roles(f"""(SELECT 'specialty' AS part, specialty AS item, count(*) AS n, count(DISTINCT patient_id) AS entities, round(quantile_cont(cast(referral_age AS DOUBLE), 0.5) / 365.25e0, 6) AS median_age,
      cast(NULL AS DOUBLE) AS specialty_missing FROM referrals WHERE trim(specialty) <> '' GROUP BY 2 ORDER BY n DESC, item LIMIT 25)
    UNION ALL SELECT 'band', band, count(*), NULL, NULL, 100e0 * count(*) FILTER (coalesce(trim(specialty), '') = '') / count(*)
      FROM (SELECT *, {band_sql('referral_age', YEAR_BANDS)} FROM referrals) b WHERE band IS NOT NULL GROUP BY band""", "referrals"))
def e41(t: Tables) -> DataFrame:
    top = rounded(op.listing_with_age(t.referrals, PID, "specialty", "referral_age"), "median_age").select(
        F.lit("specialty").alias("part"), F.col("specialty").alias("item"), "n", "entities", "median_age", F.lit(None).cast("double").alias("specialty_missing"))
    bands = op.age_band_counts(t.referrals, "referral_age", YEAR_BANDS, ["specialty"])
    return top.unionByName(bands.select(F.lit("band").alias("part"), F.col("band").alias("item"), "n", F.lit(None).cast("long").alias("entities"),
                                        F.lit(None).cast("double").alias("median_age"), "specialty_missing"))


_SHARES = " UNION ALL ".join(f"""SELECT '{c}' AS field, coalesce(nullif(trim({c}), ''), '[blank]') AS category, count(*) AS n, (SELECT count(*) FROM patients) AS total FROM patients GROUP BY 2""" for c in ("sex", "ethnicity", "race_2"))


@query("e42_category_shares", with_roles(f"""SELECT field, category, CASE WHEN lower(category) IN ('unknown', 'choose not to answer') THEN 'no answer' ELSE 'recorded' END AS kind,
    CASE WHEN n NOT BETWEEN 1 AND 9 THEN n END AS entities, CASE WHEN n NOT BETWEEN 1 AND 9 THEN 100e0 * n / total END AS share FROM ({_SHARES}) s
    UNION ALL SELECT 'visits', statistic, 'utilisation', NULL, round(value, 6) FROM (UNPIVOT (SELECT quantile_cont(cast(n AS DOUBLE), 0.25) AS p25, quantile_cont(cast(n AS DOUBLE), 0.5) AS p50, quantile_cont(cast(n AS DOUBLE), 0.75) AS p75,
      quantile_cont(cast(n AS DOUBLE), 0.95) AS p95, avg(n) AS mean, cast(max(n) AS DOUBLE) AS max_value FROM (SELECT count(*) AS n FROM visits GROUP BY patient_id) v) ON COLUMNS(*) INTO NAME statistic VALUE value) u""", "patients", "visits"))
def e42(t: Tables) -> DataFrame:
    shares = op.category_shares(t.patients, ["sex", "ethnicity", "race_2"], derive.NON_RESPONSE)
    use = op.utilisation(t.visits.groupBy(PID).agg(F.count("*").alias("n")), "n").withColumn("max_value", F.col("max_value").cast("double"))
    tall = use.unpivot([], use.columns, "category", "share")
    return shares.unionByName(tall.select(F.lit("visits").alias("field"), "category", F.lit("utilisation").alias("kind"), F.lit(None).cast("long").alias("entities"), F.round("share", 6).alias("share")))


@query("e43_flag_prevalence", with_roles("""
    SELECT 'flag' AS part, 'label' AS item, sum(label)::BIGINT AS n, 100e0 * sum(label) / count(*) AS a, cast(NULL AS DOUBLE) AS b FROM lab UNION ALL SELECT 'flag', 'label2', sum(label2)::BIGINT, 100e0 * sum(label2) / count(*), NULL FROM lab
    UNION ALL SELECT 'index', 'age', count(idx), round(quantile_cont(idx, 0.5), 6), cast(count(*) FILTER (idx <= 1e0 / 12) AS DOUBLE) FROM lab WHERE label = 1
    UNION ALL SELECT 'channel', 'bmi', count(*), round(avg(m), 3), round(avg(s), 3) FROM (SELECT round(avg(bmi), 4) AS m, round(stddev_samp(bmi), 4) AS s FROM visits GROUP BY patient_id HAVING count(bmi) > 1) c""", "patients", "visits", ctes=LABEL_CTE))
def e43(t: Tables) -> DataFrame:
    none, row = F.lit(None).cast("double"), lambda p, i: (F.lit(p).alias("part"), i.alias("item"))
    flags = op.flag_prevalence(labels(t), ["label", "label2"]).select(*row("flag", F.col("flag")), F.col("entities").alias("n"), F.col("share").alias("a"), none.alias("b"))
    index = op.index_age_summary(labels(t), "label", "idx").select(*row("index", F.lit("age")), "n", F.round("median", 6).alias("a"), F.col("first_month").cast("double").alias("b"))
    channel = op.mean_of_summaries(rollup.channel_stats(t.visits, PID, ["bmi"]), ["bmi"]).select(
        *row("channel", F.col("channel")), F.col("entities").alias("n"), F.round("mean", 3).alias("a"), F.round("std", 3).alias("b"))
    return flags.unionByName(index).unionByName(channel)


@query("e44_recover_threshold", with_roles("""SELECT max(bmi_percentile) FILTER (f = 1) AS max_flagged, min(bmi_percentile) FILTER (f = 0) AS min_unflagged, min(bmi_percentile) FILTER (f = 1) AS min_flagged,
    max(bmi_percentile) FILTER (f = 0) AS max_unflagged FROM (SELECT bmi_percentile, cast(bmi_percentile >= 95 AS INT) AS f FROM visits WHERE bmi_percentile IS NOT NULL) x""", "visits"))
def e44(t: Tables) -> DataFrame:
    return op.recover_threshold(t.visits.withColumn("f", (F.col("bmi_percentile") >= 95).cast("int")), "bmi_percentile", "f")


_TRACK = " UNION ALL ".join(f"SELECT '{p}' AS prefix, count({rollup.prefix_column(p)}) AS derived FROM firsts" for p in PREFIXES)


@query("e45_tracked_codes", with_roles(f"""SELECT prefix, derived, literal, subtree, derived = subtree AS hierarchical, subtree > literal AND derived = literal AS flat_evidence FROM
    (SELECT d.prefix, d.derived, count(DISTINCT patient_id) FILTER (code = prefix) AS literal, count(DISTINCT patient_id) AS subtree FROM ({_TRACK}) d LEFT JOIN pairs ON starts_with(code, prefix) GROUP BY 1, 2) x""",
    "visit_codes", "problem_list", ctes=f"{PAIRS_CTE}, {CODES_CTE}, {FIRST_CTE}"))
def e45(t: Tables) -> DataFrame:
    first = rollup.first_age_by_prefix(codes(t), PID, "age_in_years", PREFIXES)
    row = first.agg(*[F.count(rollup.prefix_column(p)).alias(p.replace(".", "#")) for p in PREFIXES])
    derived = row.unpivot([], row.columns, "prefix", "derived").withColumn("prefix", F.replace(F.col("prefix"), F.lit("#"), F.lit(".")))
    return op.tracked_codes(pairs(t), PID, PREFIXES, derived, t.tasks("lineitem"))


FAMILIES = {"economy": ["economy%"], "brand one": ["%brand#1%"], "large": ["%large%", "%standard%"]}


def _family_sql(column: str, patterns: list[str]) -> str:
    return " OR ".join(f"lower({column}) LIKE '{p}'" for p in patterns)


@query("e46_pattern_families", with_roles(" UNION ALL ".join(
    f"""SELECT '{n}' AS family, count(*) AS n, count(DISTINCT patient_id) AS entities, round(quantile_cont(cast(referral_age AS DOUBLE), 0.5) / 365.25e0, 6) AS median_age FROM referrals WHERE {_family_sql('specialty', p)} HAVING count(*) > 0"""
    for n, p in FAMILIES.items()) + f" UNION ALL SELECT 'all other', count(*), NULL, NULL FROM referrals WHERE NOT coalesce({_family_sql('specialty', [p for ps in FAMILIES.values() for p in ps])}, false)", "referrals"))
def e46(t: Tables) -> DataFrame:
    return rounded(op.pattern_families(t.referrals, PID, "specialty", "referral_age", FAMILIES), "median_age")


_P3 = ["E10", "K50", "Q90", "N18", "E23.0"]
_FA = " UNION ALL ".join(f"SELECT '{p}' AS code, {rollup.prefix_column(p)} AS age FROM firsts" for p in _P3)


@query("e47_first_age_table", with_roles(f"""
    , f AS (SELECT code, count(age) AS n, min(age) AS lo, quantile_cont(age, 0.5) AS med, avg(age) AS mean, max(age) AS hi FROM ({_FA}) a GROUP BY 1),
    d AS (SELECT {_LEAST} AS dx FROM firsts),
    tab AS (SELECT code, CASE WHEN n NOT BETWEEN 1 AND 9 THEN n END AS aged, CASE WHEN n > 9 THEN lo END AS min_age, CASE WHEN n > 9 THEN round(med, 6) END AS median_age, CASE WHEN n > 9 THEN round(mean, 6) END AS mean_age,
      CASE WHEN n > 9 THEN hi END AS max_age, CASE WHEN n > 9 THEN CASE WHEN med <= 10 THEN 'early' ELSE 'late' END END AS panel FROM f)
    SELECT * FROM tab UNION ALL SELECT 'band', NULL, max(median_age) FILTER (panel = 'early'), NULL, NULL, min(median_age) FILTER (panel = 'late'), NULL FROM tab
    UNION ALL SELECT 'all', count(dx), round(avg(dx) FILTER (dx <= 10), 6), round(quantile_cont(dx, 0.5), 6), round(avg(dx), 6), round(avg(dx) FILTER (dx > 10), 6), cast(count(*) FILTER (dx <= 10) AS VARCHAR) FROM d""",
    "visit_codes", "problem_list", ctes=f"{CODES_CTE}, {FIRST_CTE}"))
def e47(t: Tables) -> DataFrame:
    firsts = rollup.first_age_by_prefix(codes(t), PID, "age_in_years", PREFIXES)
    firsts = rollup.first_age_any(firsts, [rollup.prefix_column(p) for p in PREFIXES])
    table = rounded(op.first_age_table(firsts, {p: rollup.prefix_column(p) for p in _P3}, 10.0), "median_age", "mean_age")
    none = lambda kind: F.lit(None).cast(kind)
    band = op.split_band(table).select(F.lit("band").alias("code"), none("long").alias("aged"), F.col("band_lo").alias("min_age"), none("double").alias("median_age"),
                                       none("double").alias("mean_age"), F.col("band_hi").alias("max_age"), none("string").alias("panel"))
    whole = op.panel_decomposition(firsts, "dx_age_years", 10.0).select(
        F.lit("all").alias("code"), F.col("n").alias("aged"), F.round("early_mean", 6).alias("min_age"), F.round("median", 6).alias("median_age"), F.round("mean", 6).alias("mean_age"),
        F.round("late_mean", 6).alias("max_age"), F.col("early_n").cast("string").alias("panel"))
    return table.unionByName(band).unionByName(whole)


PRIOR_CTE = """ev AS (SELECT patient_id, round(age_in_days / 365.25e0, 3) AS age_in_years FROM visits WHERE height_in IS NOT NULL),
    prior AS (SELECT l.patient_id, l.idx, count(e.patient_id) AS n_before FROM lab l LEFT JOIN ev e ON e.patient_id = l.patient_id AND e.age_in_years < l.idx WHERE l.idx IS NOT NULL GROUP BY 1, 2)"""
BEFORE = [("none", 0, 0), ("one", 1, 1), ("2-4", 2, 4), ("5+", 5, None)]


def measured(t: Tables) -> DataFrame:
    return derive.add_ages(t.visits.where("height_in is not null"), AGE)


def prior(t: Tables) -> DataFrame:
    return op.prior_counts(labels(t), measured(t), PID, "age_in_years", "idx")


@query("e48_prior_history", with_roles("""
    , s AS (SELECT 'whole' AS stratum, * FROM prior UNION ALL SELECT CASE WHEN idx <= 2 THEN 'early' ELSE 'late' END, * FROM prior),
    t AS (SELECT stratum, count(*) AS total, quantile_cont(idx, 0.5) AS median_age FROM s GROUP BY 1)
    SELECT stratum, CASE WHEN n_before = 0 THEN 'none' WHEN n_before = 1 THEN 'one' WHEN n_before <= 4 THEN '2-4' ELSE '5+' END AS band, count(*) AS entities, total, round(t.median_age, 6) AS median_age,
      100e0 * count(*) / total AS share FROM s JOIN t USING (stratum) GROUP BY 1, 2, total, t.median_age""", "patients", "visits", ctes=f"{LABEL_CTE}, {PRIOR_CTE}"))
def e48(t: Tables) -> DataFrame:
    return rounded(op.prior_history(prior(t), "idx", BEFORE), "median_age")


@query("e49_use_by_stratum", with_roles("""
    , u AS (SELECT CASE WHEN label = 0 THEN 'unlabelled' WHEN idx <= 2 THEN 'early' ELSE 'late' END AS stratum, coalesce(n, 0) AS total, coalesce(n_before, 0) AS before FROM lab
      LEFT JOIN (SELECT patient_id, count(*) AS n FROM ev GROUP BY 1) v USING (patient_id) LEFT JOIN (SELECT patient_id, n_before FROM prior) p USING (patient_id))
    SELECT stratum, count(*) AS entities, round(quantile_cont(cast(total AS DOUBLE), 0.5), 6) AS median_total, round(avg(total), 6) AS mean_total, round(quantile_cont(cast(before AS DOUBLE), 0.5), 6) AS median_before,
      round(avg(before), 6) AS mean_before FROM u GROUP BY 1""", "patients", "visits", ctes=f"{LABEL_CTE}, {PRIOR_CTE}"))
def e49(t: Tables) -> DataFrame:
    total = measured(t).groupBy(PID).agg(F.count("*").alias("total"))
    rows = labels(t).join(total, PID, "left").join(prior(t).select(PID, F.col("n_before").alias("before")), PID, "left").fillna(0, ["total", "before"])
    side = F.when(F.col("label") == 0, "unlabelled").when(F.col("idx") <= 2, "early").otherwise("late")
    return rounded(op.use_by_stratum(rows, side, ["total", "before"]), "median_total", "mean_total", "median_before", "mean_before")


@query("e50_joint_availability", with_roles(f"""SELECT band, count(*) AS rows, 100e0 * count(height_in) / count(*) AS share_a, 100e0 * count(weight_oz) / count(*) AS share_b, 100e0 * count(height_in + weight_oz) / count(*) AS both,
    round(100e0 * (count(weight_oz) - count(height_in + weight_oz)) / count(*), 6) AS gap FROM (SELECT *, {band_sql('age_in_days', YEAR_BANDS)} FROM visits) b WHERE band IS NOT NULL GROUP BY 1""", "visits"))
def e50(t: Tables) -> DataFrame:
    return rounded(op.joint_availability(t.visits, "height_in", "weight_oz", AGE, YEAR_BANDS), "gap")


_CO = " UNION ALL ".join(f"""SELECT '{f}' AS flag, 100e0 * count(*) FILTER (label = 1 AND {f} = 1) / count(*) FILTER (label = 1) AS labelled, 100e0 * count(*) FILTER (label = 0 AND {f} = 1) / count(*) FILTER (label = 0) AS unlabelled,
    round((count(*) FILTER (label = 1 AND {f} = 1) / cast(count(*) FILTER (label = 1) AS DOUBLE)) / (count(*) FILTER (label = 0 AND {f} = 1) / cast(count(*) FILTER (label = 0) AS DOUBLE)), 6) AS ratio FROM fl""" for f in ("label2", "rich"))


@query("e51_flag_cooccurrence", with_roles(f", fl AS (SELECT *, cast(balance > 1000 AS INT) AS rich FROM lab) {_CO}", "patients", ctes=LABEL_CTE))
def e51(t: Tables) -> DataFrame:
    rows = labels(t).withColumn("rich", (F.col("balance") > 1000).cast("int"))
    return rounded(op.flag_cooccurrence(rows, ["label2", "rich"], "label"), "ratio")


@query("e52_presence_by_label", with_roles("""SELECT label, count(*) AS entities, 100e0 * count(*) FILTER (patient_id IN (SELECT patient_id FROM referrals)) / count(*) AS referrals,
    100e0 * count(*) FILTER (patient_id IN (SELECT patient_id FROM medications)) / count(*) AS medications, 100e0 * count(*) FILTER (patient_id IN (SELECT patient_id FROM labs)) / count(*) AS labs FROM lab GROUP BY 1""",
    "patients", "referrals", "medications", "labs", ctes=LABEL_CTE))
def e52(t: Tables) -> DataFrame:
    return op.presence_by_label(labels(t), PID, "label", {"referrals": t.referrals, "medications": t.medications, "labs": t.labs})


MARKERS = {"ring": ["%ring%"], "blue": ["%blue%", "%green%"], "small": ["small%"]}


def _marker_sql(table: str, column: str, age: str, markers: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS marker, patient_id, min({age}) AS first_age FROM {table} WHERE {_family_sql(column, p)} GROUP BY 2" for n, p in markers.items())


@query("e53_marker_lift", with_roles(f"""
    , m AS ({_marker_sql('medications', 'generic_name', 'order_age', MARKERS)}), b AS (SELECT 100e0 * avg(label) AS base FROM lab)
    SELECT marker, CASE WHEN count(*) NOT BETWEEN 1 AND 9 THEN count(*) END AS entities, cast(sum(label) AS BIGINT) AS labelled, 100e0 * sum(label) / count(*) AS share, round(100e0 * sum(label) / count(*) / (SELECT base FROM b), 6) AS lift,
      round(quantile_cont(cast(first_age AS DOUBLE), 0.5) / 365.25e0, 6) AS median_age FROM m JOIN lab USING (patient_id) GROUP BY 1""", "patients", "medications", ctes=LABEL_CTE))
def e53(t: Tables) -> DataFrame:
    first = op.first_marker(t.medications, PID, "order_age", [F.lower("generic_name")], MARKERS)
    return rounded(op.marker_lift(first, labels(t), PID, "label"), "lift", "median_age")


@query("e54_alternative_index", with_roles("""
    , w AS (SELECT patient_id, min(age) AS idx FROM (SELECT patient_id, round(order_age / 365.25e0, 3) AS age FROM medications WHERE lower(generic_name) LIKE '%ring%'
        UNION ALL SELECT patient_id, round(order_age / 365.25e0, 3) FROM labs WHERE component LIKE 'small%') x GROUP BY 1),
    wp AS (SELECT w.patient_id, count(e.patient_id) AS n_before FROM w LEFT JOIN ev e ON e.patient_id = w.patient_id AND e.age_in_years < w.idx GROUP BY 1)
    SELECT i AS index_name, count(*) AS entities, count(*) FILTER (n_before = 0) AS none, count(*) FILTER (n_before >= 2) AS two_or_more, quantile_cont(cast(n_before AS DOUBLE), 0.5) AS median_before
    FROM (SELECT 'work-up' AS i, n_before FROM wp UNION ALL SELECT 'code', n_before FROM prior) a GROUP BY 1""", "patients", "visits", "medications", "labs", ctes=f"{LABEL_CTE}, {PRIOR_CTE}"))
def e54(t: Tables) -> DataFrame:
    years = lambda df: df.withColumn("age", F.round(F.col("order_age") / 365.25, 3))
    index = op.alternative_index([years(t.medications.where("lower(generic_name) like '%ring%'")), years(t.labs.where("component like 'small%'"))], PID, "age")
    return op.index_contrast({"work-up": op.prior_counts(index, measured(t), PID, "age_in_years", "idx"), "code": prior(t)})


_SRC_CTE = "t AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PREFIXES) + """]) AS prefix),
    ea AS (SELECT patient_id, prefix, min(age_in_days) / 365.25e0 AS a FROM visit_codes JOIN t ON starts_with(code, prefix) GROUP BY 1, 2),
    pa AS (SELECT patient_id, prefix, min(noted_age) / 365.25e0 AS b FROM problem_list JOIN t ON starts_with(pl_diag, prefix) WHERE noted_age IS NOT NULL GROUP BY 1, 2),
    ab AS (SELECT * FROM ea FULL JOIN pa USING (patient_id, prefix))"""


def two_sources(t: Tables) -> DataFrame:
    left = rollup.matched_prefixes(t.visit_codes.select(PID, "code", (F.col(AGE) / 365.25).alias("age")), PREFIXES)
    right = rollup.matched_prefixes(t.problem_list.select(PID, F.col("pl_diag").alias("code"), (F.col("noted_age") / 365.25).alias("age")), PREFIXES)
    return op.two_source_rows(left, right, [PID, "prefix"])


@query("e55_two_source_compare", with_roles("""SELECT count(*) AS either, count(a + b) AS both, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (b < a - 1e-2) AS right_earlier,
    count(*) FILTER (abs(a - b) <= 1e-2) AS same, count(*) FILTER (b > a + 1e-2) AS right_later, round(quantile_cont(CASE WHEN b < a - 1e-2 THEN (a - b) * 365.25e0 END, 0.5), 4) AS lead_p50,
    round(quantile_cont(CASE WHEN b < a - 1e-2 THEN (a - b) * 365.25e0 END, 0.9), 4) AS lead_p90, round(quantile_cont(CASE WHEN b > a + 1e-2 THEN (b - a) * 365.25e0 END, 0.5), 4) AS lag_p50,
    round(quantile_cont(CASE WHEN b > a + 1e-2 THEN (b - a) * 365.25e0 END, 0.9), 4) AS lag_p90 FROM ab""", "visit_codes", "problem_list", ctes=_SRC_CTE))
def e55(t: Tables) -> DataFrame:
    return rounded(op.two_source_compare(two_sources(t)), "lead_p50", "lead_p90", "lag_p50", "lag_p90", digits=4)


@query("e56_two_source_by_code", with_roles("""SELECT prefix, count(*) AS either, count(a + b) AS both, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only,
    round(quantile_cont((b - a) * 365.25e0, 0.5), 4) AS median_diff FROM ab GROUP BY 1 HAVING count(*) >= 10""", "visit_codes", "problem_list", ctes=_SRC_CTE))
def e56(t: Tables) -> DataFrame:
    return rounded(op.two_source_by_code(two_sources(t), "prefix"), "median_diff", digits=4)


_TIMING = f"""m AS ({_marker_sql('referrals', 'specialty', 'referral_age', FAMILIES)}), b AS (SELECT 100e0 * avg(label) AS base FROM lab),
    j AS (SELECT *, first_age / 365.25e0 AS ra, (first_age / 365.25e0 - idx) * 365.25e0 AS gap FROM m JOIN lab USING (patient_id))"""


@query("e57_action_timing", with_roles("""SELECT marker, CASE WHEN count(*) NOT BETWEEN 1 AND 9 THEN count(*) END AS entities, cast(sum(label) AS BIGINT) AS labelled, round(100e0 * sum(label) / count(*) / (SELECT base FROM b), 6) AS lift,
      round(quantile_cont(ra, 0.5), 6) AS median_age, count(gap) AS both, round(quantile_cont(gap, 0.5), 4) AS median_gap, 100e0 * count(*) FILTER (gap < 0) / count(gap) AS first_share, 100e0 * count(*) FILTER (abs(gap) <= 30) / count(gap) AS near_share
    FROM j GROUP BY 1 UNION ALL SELECT CASE WHEN present THEN 'with' ELSE 'without' END, count(*), NULL, NULL, NULL, NULL, quantile_cont(cast(n_before AS DOUBLE), 0.5), 100e0 * count(*) FILTER (n_before = 0) / count(*),
      100e0 * count(*) FILTER (n_before >= 2) / count(*) FROM (SELECT *, patient_id IN (SELECT patient_id FROM m WHERE marker = 'economy') AS present FROM prior) p GROUP BY present""",
    "patients", "visits", "referrals", ctes=f"{LABEL_CTE}, {PRIOR_CTE}, {_TIMING}"))
def e57(t: Tables) -> DataFrame:
    first = op.first_marker(t.referrals, PID, "referral_age", [F.lower("specialty")], FAMILIES)
    timing = rounded(rounded(op.action_timing(first, labels(t), PID, "label", "idx"), "lift", "median_age"), "median_gap", digits=4)
    split = op.prior_by_presence(prior(t), first.where("marker = 'economy'"), PID)
    none = lambda k, n: F.lit(None).cast(k).alias(n)
    return timing.unionByName(split.select(
        F.when(F.col("present"), "with").otherwise("without").alias("marker"), "entities", none("long", "labelled"), none("double", "lift"), none("double", "median_age"), none("long", "both"),
        F.col("median_before").alias("median_gap"), F.col("none").alias("first_share"), F.col("two_or_more").alias("near_share")))


SCREEN_CTE = f"""{LABEL_CTE}, cells AS (SELECT DISTINCT field, patient_id, value FROM (SELECT 'medication' AS field, patient_id, generic_name AS value FROM medications
      UNION ALL SELECT 'specialty', patient_id, specialty FROM referrals UNION ALL SELECT 'encounter', patient_id, encounter_type FROM visits) c WHERE trim(value) <> ''),
    base AS (SELECT 100e0 * avg(label) AS b1, 100e0 * avg(label2) AS b2 FROM lab)"""
_SCORE = """count(*) AS entities, cast(sum(label) AS BIGINT) AS labelled, round(100e0 * sum(label) / count(*), 6) AS share, round(100e0 * sum(label) / count(*) / (SELECT b1 FROM base), 6) AS lift,
    round(CASE WHEN sum(label2) >= 10 {extra} THEN 100e0 * sum(label2) / count(*) / (SELECT b2 FROM base) END, 6) AS second_lift"""


@query("e58_value_screen", with_roles(f"""SELECT field, value, entities, labelled, share, lift, second_lift, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY field ORDER BY lift DESC, value) AS INT) AS rank FROM
    (SELECT field, value, {_SCORE.format(extra="AND NOT contains(upper(value), 'RING')")} FROM cells JOIN lab USING (patient_id) GROUP BY 1, 2 HAVING count(*) >= 20) s) r WHERE rank <= 5""",
    "patients", "medications", "referrals", "visits", ctes=SCREEN_CTE))
def e58(t: Tables) -> DataFrame:
    as_value = lambda df, c: df.select(PID, F.col(c).alias("value"))
    sources = {"medication": as_value(t.medications, "generic_name"), "specialty": as_value(t.referrals, "specialty"), "encounter": as_value(t.visits, "encounter_type")}
    return rounded(op.value_screen(sources, labels(t), PID, "label", "label2", 20, 5, ["RING"], parts=t.tasks("lineitem")), "share", "lift", "second_lift")


@query("e59_cohort_score", with_roles(f"""SELECT cohort, {_SCORE.format(extra='')} FROM (SELECT DISTINCT 'legacy' AS cohort, patient_id FROM visits WHERE source_yn <> 'Y' UNION
    SELECT 'native', patient_id FROM visits GROUP BY 2 HAVING max(CASE WHEN source_yn <> 'Y' THEN 1 ELSE 0 END) = 0 UNION SELECT 'diabetes', patient_id FROM pairs WHERE starts_with(code, 'E1')) c JOIN lab USING (patient_id) GROUP BY 1""",
    "patients", "medications", "referrals", "visits", "visit_codes", "problem_list", ctes=f"{SCREEN_CTE}, {PAIRS_CTE}").replace("count(*) AS entities", "CASE WHEN count(*) NOT BETWEEN 1 AND 9 THEN count(*) END AS entities"))
def e59(t: Tables) -> DataFrame:
    legacy = F.coalesce(F.col("source_yn") != "Y", F.lit(False))
    native = t.visits.groupBy(PID).agg(F.max(legacy.cast("int")).alias("m")).where("m = 0")
    cohorts = {"legacy": t.visits.where(legacy), "native": native, "diabetes": pairs(t).where(F.col("code").startswith("E1"))}
    return rounded(op.cohort_score(cohorts, labels(t), PID, "label", "label2"), "share", "lift", "second_lift")


_LABEL_CODES = ["E10", "K50", "Q7"]


@query("e60_code_screen", with_roles(f"""SELECT code, {_SCORE.format(extra='')}, {' OR '.join(f"starts_with(code, '{p}')" for p in _LABEL_CODES)} AS is_label, ({' OR '.join(f"starts_with(code, '{p}')" for p in _LABEL_CODES)}) AND sum(label) = count(*) AS perfect
    FROM pairs JOIN lab USING (patient_id) GROUP BY code HAVING count(*) >= 50""", "patients", "medications", "referrals", "visits", "visit_codes", "problem_list", ctes=f"{SCREEN_CTE}, {PAIRS_CTE}"))
def e60(t: Tables) -> DataFrame:
    return rounded(op.code_screen(pairs(t), labels(t), PID, "label", "label2", _LABEL_CODES, 50, t.tasks("lineitem")), "share", "lift", "second_lift")


@query("e61_leak_test", with_roles("""
    , u AS (SELECT label, coalesce(n, 0) AS total, CASE WHEN idx IS NULL THEN coalesce(n, 0) ELSE coalesce(n_before, 0) END AS pre FROM lab LEFT JOIN (SELECT patient_id, count(*) AS n FROM ev GROUP BY 1) v USING (patient_id)
      LEFT JOIN (SELECT patient_id, n_before FROM prior) p USING (patient_id))
    SELECT count(*) FILTER (pre < total) AS shorter, count(*) FILTER (pre < total AND label = 1) AS shorter_labelled, count(*) FILTER (pre >= total) AS equal, count(*) FILTER (pre >= total AND label = 1) AS equal_labelled,
      100e0 * count(*) FILTER (pre < total AND label = 1) / count(*) FILTER (pre < total) AS "precision", 100e0 * count(*) FILTER (pre < total AND label = 1) / count(*) FILTER (label = 1) AS recall FROM u""",
    "patients", "visits", ctes=f"{LABEL_CTE}, {PRIOR_CTE}"))
def e61(t: Tables) -> DataFrame:
    total = measured(t).groupBy(PID).agg(F.count("*").alias("total"))
    rows = labels(t).join(total, PID, "left").join(prior(t).select(PID, "n_before"), PID, "left").fillna(0, ["total"])
    rows = rows.withColumn("pre", F.when(F.col("idx").isNull(), F.col("total")).otherwise(F.coalesce("n_before", F.lit(0))))
    return op.leak_test(rows, "pre", "total", "label")


_NUM_CTE = f"""timeline AS (SELECT patient_id, list(age_in_days ORDER BY age_in_days) AS days FROM visits GROUP BY patient_id),
    waits AS (SELECT patient_id, median(cast(days[i + 1] - days[i] AS DOUBLE)) AS med_gap FROM (SELECT patient_id, days, unnest(range(1, len(days))) AS i FROM timeline) t GROUP BY patient_id),
    feat AS (SELECT p.patient_id, cast(p.patient_id AS BIGINT) AS file_order, round(v.vpy, 6) AS visits_per_year, v.measured_share, v.late_measures, coalesce(r.same_day, 0) AS same_day, g.med_gap, coalesce(l.o, 0) AS lab_orders, coalesce(l.q, 0) AS lab_procs,
      coalesce(m.n, 0) AS med_orders, coalesce(b.n, 0) AS problems_all, coalesce(b.u, 0) AS problems_untracked FROM patients p
    LEFT JOIN (SELECT patient_id, count(*) / cast(greatest(max(age_in_days) - min(age_in_days), 1) AS DOUBLE) * 365.25e0 AS vpy, count(height_in) / cast(count(*) AS DOUBLE) AS measured_share, count(*) FILTER (weight_oz IS NOT NULL AND age_in_days > 1095) AS late_measures FROM visits GROUP BY 1) v USING (patient_id)
    LEFT JOIN (SELECT patient_id, count(*) AS same_day FROM (SELECT patient_id FROM visits WHERE height_in IS NOT NULL GROUP BY patient_id, age_in_days HAVING count(*) >= 2) d GROUP BY 1) r USING (patient_id)
    LEFT JOIN waits g USING (patient_id) LEFT JOIN (SELECT patient_id, count(DISTINCT lab_order_id) AS o, count(DISTINCT procedure_name) AS q FROM labs GROUP BY 1) l USING (patient_id)
    LEFT JOIN (SELECT patient_id, count(*) AS n FROM medications GROUP BY 1) m USING (patient_id)
    LEFT JOIN (SELECT patient_id, count(*) AS n, count(*) FILTER (NOT ({' OR '.join(f"starts_with(pl_diag, '{p}')" for p in _LABEL_CODES)})) AS u FROM problem_list GROUP BY 1) b USING (patient_id))"""


def features(t: Tables) -> DataFrame:
    people = t.patients.withColumn("ordinal", F.col(PID).cast("long"))
    return op.constructed_features(people, PID, "ordinal", t.visits, AGE, "height_in", "weight_oz", 1095, t.labs, "lab_order_id", "procedure_name", t.medications, t.problem_list, "pl_diag", _LABEL_CODES)


@query("e62_constructed_features", with_roles("SELECT * FROM feat", "patients", "visits", "labs", "medications", "problem_list", ctes=_NUM_CTE))
def e62(t: Tables) -> DataFrame:
    return rounded(features(t), "visits_per_year")


_AUC_COLS = ["file_order", "visits_per_year", "med_gap", "measured_share", "lab_orders", "problems_untracked"]


def auc_sql(source: str, cols: list[str], label: str, restrict: str) -> str:
    """Pair counting over the distinct values: a positive wins over the negatives below it and halves those beside it."""
    cells = " UNION ALL ".join(
        f"""SELECT '{cohort}' AS cohort, '{c}' AS col, cast({c} AS DOUBLE) AS x, sum({label}) AS p, sum(1 - {label}) AS n FROM {source}
        WHERE {c} IS NOT NULL AND {test} GROUP BY x""" for c in cols for cohort, test in (("all", "true"), ("restricted", restrict)))
    return f"""SELECT cohort, col AS "column", cast(sum(p) AS BIGINT) AS n_pos, cast(sum(n) AS BIGINT) AS n_neg,
      round(sum(p * (below + n / 2e0)) / nullif(cast(sum(p) * sum(n) AS DOUBLE), 0), 8) AS auc,
      round(abs(2 * sum(p * (below + n / 2e0)) / nullif(cast(sum(p) * sum(n) AS DOUBLE), 0) - 1), 8) AS separation
      FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY cohort, col ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({cells}) c) w GROUP BY cohort, col"""


@query("e63_auc_screen", with_roles(auc_sql("(SELECT f.*, label FROM feat f JOIN lab USING (patient_id)) q", _AUC_COLS, "label", "lab_orders >= 8"), "patients", "visits", "labs", "medications", "problem_list", ctes=f"{LABEL_CTE}, {_NUM_CTE}"))
def e63(t: Tables) -> DataFrame:
    rows = rounded(features(t), "visits_per_year").join(labels(t).select(PID, "label"), PID)
    return rounded(op.auc_screen(rows, _AUC_COLS, "label", F.col("lab_orders") >= 8), "auc", "separation", digits=8)


@query("e64_split_coverage", with_roles("""SELECT count(idx) AS aged, count(*) FILTER (idx <= 2) AS early, 100e0 * count(*) FILTER (idx <= 2) / count(idx) AS early_share FROM lab WHERE label = 1""", "patients", ctes=LABEL_CTE))
def e64(t: Tables) -> DataFrame:
    return op.split_coverage(labels(t), "label", "idx")


@query("e65_artifact_catalogue", with_roles("""
    SELECT 'grain' AS finding_id, 'repeated days' AS name, 'grain' AS kind, 'yes' AS recoverable, count(*) AS scale FROM (SELECT 1 FROM visits GROUP BY patient_id, age_in_days HAVING count(*) > 1) g
    UNION ALL SELECT 'headcirc', 'double conversion', 'capture', 'yes', count(*) FROM visits WHERE head_circ_cm > 65 AND head_circ_cm <= 200
    UNION ALL SELECT 'links', 'unresolved lab links', 'linkage', 'no', count(*) FROM labs WHERE visit_id <> '' AND visit_id NOT IN (SELECT visit_id FROM visits)""", "visits", "labs"))
def e65(t: Tables) -> DataFrame:
    from ..operators.profiling import link_orphans

    return op.artifact_catalogue([
        ("grain", "repeated days", "grain", "yes", explore.grain_check(t.visits, [PID, AGE]).select(F.col("repeated").alias("n"))),
        ("headcirc", "double conversion", "capture", "yes", t.visits.where("head_circ_cm > 65 and head_circ_cm <= 200").agg(F.count("*").alias("n"))),
        ("links", "unresolved lab links", "linkage", "no", link_orphans(t.labs, t.visits, ("visit_id", "visit_id")).select(F.col("orphan_rows").alias("n")))])
