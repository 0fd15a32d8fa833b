"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profiling as op
from ..sources.contract import Contract, Field
from .registry import query
from .roles import Tables, with_roles
from .sources import VISITS, patients, visits

YEAR_BANDS = [("0-2", 0, 730), ("2-5", 730, 1826), ("5-12", 1826, 4383), ("12-20", 4383, 7305)]


def band_sql(value: str, bands, alias: str = "band") -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {lo} AND {value} < {hi} THEN '{b}'" for b, lo, hi in bands) + f" END AS {alias}"


@query("c01_field_profile", with_roles(" UNION ALL ".join(
    f"""SELECT '{c}' AS field, count(*) AS row_count, count(*) FILTER ({c} IS NULL OR cast({c} AS VARCHAR) = '') AS missing,
      {f'min(try_cast({c} AS DOUBLE))' if num else 'cast(NULL AS DOUBLE)'} AS min_value,
      {f'max(try_cast({c} AS DOUBLE))' if num else 'cast(NULL AS DOUBLE)'} AS max_value,
      {f"count(*) FILTER ({c} <> '' AND try_cast({c} AS DOUBLE) IS NULL)" if num else 'cast(NULL AS BIGINT)'} AS unparseable,
      count(DISTINCT {c}) AS distinct_values FROM labs"""
    for c, num in [("result_value", True), ("loinc", False), ("component", False), ("result_flag", False)]), "labs"))
def c01(t: Tables) -> DataFrame:
    return op.field_profile(t.labs, {"result_value": "number", "loinc": "string", "component": "string", "result_flag": "string"})


_DIST = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM labs" for c in ("component", "result_flag", "result_value", "loinc"))


@query("c02_value_distributions", with_roles(f"""
    , v AS (SELECT field, value, count(*) AS n FROM ({_DIST}) x WHERE value <> '' GROUP BY 1, 2)
    SELECT * FROM v WHERE field IN (SELECT field FROM v GROUP BY 1 HAVING count(*) <= 130)""", "labs"))
def c02(t: Tables) -> DataFrame:
    return op.value_distributions(t.labs, ["component", "result_flag", "result_value", "loinc"])


@query("c03_top_values", with_roles(f"""
    SELECT field, value, n, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INT) AS rank
      FROM (SELECT field, value, count(*) AS n FROM ({_DIST}) x WHERE value <> '' GROUP BY 1, 2) v) r WHERE rank <= 10""", "labs"))
def c03(t: Tables) -> DataFrame:
    return op.top_values(t.labs, ["component", "result_flag", "result_value", "loinc"])


@query("c04_distinct_slot_codes", with_roles("SELECT count(DISTINCT code) AS distinct_codes FROM visit_codes", "visit_codes"))
def c04(t: Tables) -> DataFrame:
    return op.distinct_slot_codes(t.visit_codes, ["code"])


@query("c05_category_range", with_roles("""SELECT encounter_type, count(*) AS n, min(bmi_percentile) AS min_value,
    max(bmi_percentile) AS max_value FROM visits GROUP BY 1""", "visits"))
def c05(t: Tables) -> DataFrame:
    return op.category_range(t.visits, "encounter_type", "bmi_percentile")


@query("c06_link_orphans", with_roles("""SELECT count(*) AS orphan_rows FROM labs
    WHERE visit_id <> '' AND visit_id NOT IN (SELECT visit_id FROM visits)""", "labs", "visits"))
def c06(t: Tables) -> DataFrame:
    return op.link_orphans(t.labs, t.visits, ("visit_id", "visit_id"))


_STATS = Contract("meds", (Field("record_type", enum=("Internal", "External")), Field("order_age", "integer"),
                           Field("visit_id")), links=(("visit_id", "visits"),))


@query("c07_package_stats", with_roles("""
    SELECT 'meds' AS table_name, field, statistic, category, value FROM (
      SELECT 'record_type' AS field, 'missing' AS statistic, '' AS category, cast(count(*) FILTER (record_type IS NULL) AS DOUBLE) AS value FROM medications
      UNION ALL SELECT 'order_age', 'missing', '', count(*) FILTER (order_age IS NULL) FROM medications
      UNION ALL SELECT 'visit_id', 'missing', '', count(*) FILTER (visit_id IS NULL OR visit_id = '') FROM medications
      UNION ALL SELECT 'record_type', 'unique', '', count(DISTINCT record_type) FROM medications
      UNION ALL SELECT 'order_age', 'unique', '', count(DISTINCT order_age) FROM medications
      UNION ALL SELECT 'visit_id', 'unique', '', count(DISTINCT visit_id) FROM medications
      UNION ALL SELECT 'order_age', 'minimum', '', min(order_age) FROM medications
      UNION ALL SELECT 'order_age', 'maximum', '', max(order_age) FROM medications
      UNION ALL SELECT 'record_type', 'category', record_type, count(*) FROM medications GROUP BY record_type
      UNION ALL SELECT 'visit_id', 'orphan', '', count(*) FROM medications WHERE visit_id NOT IN (SELECT visit_id FROM visits)) s""",
                                      "medications", "visits"))
def c07(t: Tables) -> DataFrame:
    return op.package_stats({"meds": t.medications.select(*_STATS.names)}, {"meds": _STATS}, {"visits": t.visits})


_ENUMS = Contract("v", (Field("encounter_type", enum=("1-URGENT", "2-HIGH", "9-NEVER")), Field("source_yn", enum=("Y", "N", "U"))))


@query("c08_unobserved_enum", with_roles("""
    SELECT 'encounter_type' AS field, '9-NEVER' AS value, count(encounter_type) AS populated FROM visits HAVING count(encounter_type) >= 300
    UNION ALL SELECT 'source_yn', 'U', count(source_yn) FROM visits HAVING count(source_yn) >= 300""", "visits"))
def c08(t: Tables) -> DataFrame:
    return op.unobserved_enum(t.visits, _ENUMS)


def _scan_sql() -> str:
    cells = [("patients", c, c) for c in ("patient_id", "sex", "ethnicity")] + [("patients", "race_1", "race_1..3")] + [
        ("visits", c, c) for c in VISITS.names]
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS resource, count(*) AS rows, '{label}' AS field, count({c}) AS present, count(DISTINCT {c}) AS distinct_values,
        100e0 * (count(*) - count({c})) / count(*) AS missing_pct FROM {t}""" for t, c, label in cells)


def _scan(t: Tables) -> DataFrame:
    return op.column_scan({"patients": patients(t), "visits": visits(t)}, ["race_", "enc_diag_"])


@query("c09_column_scan", with_roles(_scan_sql(), "patients", "visits"))
def c09(t: Tables) -> DataFrame:
    return _scan(t)


@query("c10_least_populated", with_roles(f"""
    , s AS ({_scan_sql()})
    (SELECT *, 'least populated' AS list FROM s ORDER BY missing_pct DESC, resource, field LIMIT 6) UNION ALL
    (SELECT *, 'outside family' FROM s WHERE NOT starts_with(field, 'head') ORDER BY missing_pct DESC, resource, field LIMIT 1)""",
                                        "patients", "visits"))
def c10(t: Tables) -> DataFrame:
    return op.least_populated(_scan(t), 6, "head")


_AVAIL = ["weight_oz", "height_in", "head_circ_cm", "bmi"]


@query("c11_availability_by_band", with_roles(" UNION ALL ".join(
    f"SELECT band, count(*) AS rows, '{c}' AS field, 100e0 * count({c}) / count(*) AS share FROM "
    f"(SELECT *, {band_sql('age_in_days', YEAR_BANDS)} FROM visits) b WHERE band IS NOT NULL GROUP BY band" for c in _AVAIL), "visits"))
def c11(t: Tables) -> DataFrame:
    return op.availability_by_band(t.visits, _AVAIL, "age_in_days", YEAR_BANDS)


@query("c12_sentinel_scan", with_roles("""
    SELECT 'visits' AS resource, 'height_in' AS field, 'zero height' AS pattern, CASE WHEN n NOT BETWEEN 1 AND 9 THEN n END AS rows
      FROM (SELECT count(*) FILTER (height_in = 0) AS n FROM visits) a
    UNION ALL SELECT 'visits', 'weight_oz', 'light', CASE WHEN n NOT BETWEEN 1 AND 9 THEN n END FROM (SELECT count(*) FILTER (weight_oz < 20) AS n FROM visits) a
    UNION ALL SELECT 'labs', 'result_value', 'empty text', CASE WHEN n NOT BETWEEN 1 AND 9 THEN n END FROM (SELECT count(*) FILTER (trim(result_value) = '') AS n FROM labs) a""",
                                      "visits", "labs"))
def c12(t: Tables) -> DataFrame:
    return op.sentinel_scan({"visits": t.visits, "labs": t.labs}, [
        ("visits", "height_in", "zero height", F.col("height_in") == 0), ("visits", "weight_oz", "light", F.col("weight_oz") < 20),
        ("labs", "result_value", "empty text", F.trim("result_value") == "")])


@query("c13_flag_rates", with_roles("""
    SELECT count(*) AS rows, count(component) AS resulted, count(*) FILTER (component IS NOT NULL AND result_flag IS NULL) AS resulted_null,
      count(result_flag) AS flagged, count(*) FILTER (result_flag <> 'Low') AS abnormal,
      100e0 * count(*) FILTER (result_flag <> 'Low') / count(component) AS rate_resulted,
      100e0 * count(*) FILTER (result_flag <> 'Low') / count(result_flag) AS rate_flagged,
      100e0 * count(*) FILTER (result_flag <> 'Low') / count(*) AS rate_rows FROM labs""", "labs"))
def c13(t: Tables) -> DataFrame:
    return op.flag_rates(t.labs, "result_flag", F.col("component").isNotNull(), "Low")


@query("c14_bounded_listing", with_roles("""
    , listed AS (SELECT 'flag' AS field, result_flag AS value, count(*) AS n FROM labs GROUP BY 2
      UNION ALL SELECT 'loinc', loinc, count(*) FROM labs GROUP BY 2),
    r AS (SELECT *, cast(row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS INT) AS rank,
      count(*) OVER (PARTITION BY field) AS d, sum(n) OVER (PARTITION BY field) AS total FROM listed)
    SELECT field, rank, value, n, d AS distinct_values, d <= 60 AS complete, 100e0 * n / total AS share FROM r WHERE d <= 60 OR rank <= 25""", "labs"))
def c14(t: Tables) -> DataFrame:
    return op.bounded_listing(t.labs, "result_flag").withColumn("field", F.lit("flag")).unionByName(
        op.bounded_listing(t.labs, "loinc").withColumn("field", F.lit("loinc")))


@query("c15_vocab_collapse", with_roles(r"""
    SELECT 'generic_name' AS field, count(DISTINCT generic_name) AS raw, count(DISTINCT lower(regexp_replace(trim(generic_name), '\s+', ' ', 'g'))) AS normalized,
      count(DISTINCT generic_name) - count(DISTINCT lower(regexp_replace(trim(generic_name), '\s+', ' ', 'g'))) AS collapse
    FROM medications WHERE trim(generic_name) <> ''""", "medications"))
def c15(t: Tables) -> DataFrame:
    return op.vocab_collapse(t.medications, "generic_name")


_SHAPE = r"^[A-P][0-9][0-9](\.[0-9])?$"


@query("c16_code_shape", with_roles(f"""
    , c AS (SELECT code, count(*) AS n FROM visit_codes WHERE trim(code) <> '' GROUP BY 1)
    SELECT 'filled' AS item, cast(sum(n) AS BIGINT) AS n, cast(0 AS INT) AS rank FROM c UNION ALL SELECT 'distinct_codes', count(*), 0 FROM c
    UNION ALL SELECT 'nonconforming', cast(coalesce(sum(n), 0) AS BIGINT), 0 FROM c WHERE NOT regexp_matches(code, '{_SHAPE}')
    UNION ALL SELECT code, n, rank FROM (SELECT code, n, cast(row_number() OVER (ORDER BY n DESC, code) AS INT) AS rank FROM c
      WHERE NOT regexp_matches(code, '{_SHAPE}')) r WHERE rank <= 6""", "visit_codes"))
def c16(t: Tables) -> DataFrame:
    return op.code_shape(t.visit_codes, F.col("code"), _SHAPE)


@query("c17_numeric_text_profile", with_roles("""
    SELECT count(*) AS rows, count(result_value) AS populated, count(try_cast(result_value AS DOUBLE)) AS parseable,
      count(*) FILTER (result_value IS NULL OR trim(result_value) = '') AS empty,
      count(*) FILTER (regexp_matches(trim(result_value), '^[<>]')) AS comparator,
      100e0 * (count(result_value) - count(try_cast(result_value AS DOUBLE))) / count(result_value) AS cast_loss FROM labs""", "labs"))
def c17(t: Tables) -> DataFrame:
    return op.numeric_text_profile(t.labs, "result_value")


@query("c18_duplicate_lines", with_roles("""
    SELECT count(*) FILTER (c > 1) AS repeated_groups, count(*) FILTER (c > 1 AND v > 1) AS disagreeing_groups
    FROM (SELECT count(*) AS c, count(DISTINCT result_value) AS v FROM labs GROUP BY lab_order_id, component) g""", "labs"))
def c18(t: Tables) -> DataFrame:
    return op.duplicate_lines(t.labs, ["lab_order_id", "component"], "result_value")


@query("c19_histogram", with_roles("""
    , v AS (SELECT height_in AS x FROM visits WHERE height_in IS NOT NULL),
    h AS (SELECT CASE WHEN x < 15 OR x > 80 THEN -1 WHEN x < 80 THEN least(floor((x - 15) / 1.625e0), 39) END AS bin, count(*) AS n FROM v GROUP BY 1)
    SELECT cast(i AS INT) AS bin, CASE WHEN i >= 0 THEN 15 + i * 1.625e0 END AS edge, coalesce(n, 0) AS n, cast(NULL AS VARCHAR) AS statistic, cast(NULL AS DOUBLE) AS value
      FROM range(-1, 40) r(i) LEFT JOIN h ON bin = i
    UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM v), statistic, round(value, 6) FROM (UNPIVOT (SELECT min(x) AS min_value, quantile_cont(x, 0.01) AS p1,
      quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.99) AS p99, max(x) AS max_value FROM v) ON COLUMNS(*) INTO NAME statistic VALUE value) u""", "visits"))
def c19(t: Tables) -> DataFrame:
    bins = op.histogram(t.visits, "height_in", 15.0, 80.0).withColumn("statistic", F.lit(None).cast("string")).withColumn(
        "value", F.lit(None).cast("double"))
    summary = op.number_summary(t.visits, ["height_in"])
    tall = summary.unpivot(["n"], ["min_value", "p1", "median", "p99", "max_value"], "statistic", "value")
    return bins.unionByName(tall.select(
        F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("edge"), "n", "statistic", F.round("value", 6).alias("value")))
