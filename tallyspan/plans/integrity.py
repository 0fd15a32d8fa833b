"""Integrity queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity as op
from ..sources.contract import Contract, Field
from .registry import query
from .roles import Tables, with_roles
from .sources import PATIENTS, VISITS, patients, visits

LABS = Contract("labs", (Field("patient_id"), Field("visit_id"), Field("lab_order_id"),
                         Field("result_line_num", "integer", minimum=1)),
                primary_key=("lab_order_id", "result_line_num"), links=(("visit_id", "visits"), ("patient_id", "patients")))
_ROW = ("SELECT '{t}' AS table_name, {f} AS field, '{r}' AS rule, cast({e} AS BIGINT) AS expected, {o} AS observed, "
        "CASE WHEN {e} IS NULL OR {o} = {e} THEN 'PASS' ELSE 'FAIL' END AS status FROM {src}")


def row(table: str, field: str | None, rule: str, expected, observed: str, source: str) -> str:
    return _ROW.format(t=table, f="NULL" if field is None else f"'{field}'", r=rule,
                       e="cast(NULL AS BIGINT)" if expected is None else expected, o=observed, src=source)


@query("b01_check_schema", with_roles("""
    SELECT 'visits' AS table_name, f.field, 'schema' AS rule, f.expected, f.expected AS observed, 'PASS' AS status, p.present
    FROM (VALUES ('patient_id','string'),('visit_id','string'),('age_in_days','bigint'),('encounter_type','string'),
      ('source_yn','string'),('weight_oz','double'),('height_in','double'),('head_circ_cm','double'),('bmi','double'),
      ('bmi_percentile','double')) f(field, expected)
    JOIN (UNPIVOT (SELECT count(patient_id) AS patient_id, count(visit_id) AS visit_id, count(age_in_days) AS age_in_days,
      count(encounter_type) AS encounter_type, count(source_yn) AS source_yn, count(weight_oz) AS weight_oz,
      count(height_in) AS height_in, count(head_circ_cm) AS head_circ_cm, count(bmi) AS bmi,
      count(bmi_percentile) AS bmi_percentile FROM visits) ON COLUMNS(*) INTO NAME field VALUE present) p USING (field)""", "visits"))
def b01(t: Tables) -> DataFrame:
    return op.check_schema(visits(t), VISITS)


def _rule_sql() -> str:
    parts = [row("visits", None, "row_count", None, "count(*)", "visits")]
    for f in VISITS.fields:
        tests = []
        if f.required:
            tests.append(("required", f"{f.name} IS NULL"))
        if f.enum:
            tests.append(("enum", f"{f.name} NOT IN ({', '.join(repr(e) for e in f.enum)})"))
        if f.minimum is not None:
            tests.append(("minimum", f"{f.name} < {f.minimum}"))
        if f.maximum is not None:
            tests.append(("maximum", f"{f.name} > {f.maximum}"))
        parts += [row("visits", f.name, rule, 0, f"count(*) FILTER ({test})", "visits") for rule, test in tests]
    return " UNION ALL ".join(parts)


@query("b02_check_rules", with_roles(_rule_sql(), "visits"))
def b02(t: Tables) -> DataFrame:
    return op.check_rules(visits(t), VISITS)


@query("b03_check_primary_key", " UNION ALL ".join([
    row("lineitem", "l_orderkey,l_linenumber", "key_complete", 0,
        "count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL)", "lineitem"),
    row("lineitem", "l_orderkey,l_linenumber", "key_unique", 0, "count(*)",
        "(SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d")]))
def b03(t: Tables) -> DataFrame:
    return op.check_primary_key(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")


@query("b04_check_foreign_key", " UNION ALL ".join([
    row("orders", "o_custkey", "foreign_key", 0, "count(*)",
        "(SELECT 1 FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) o"),
    row("lineitem", "l_partkey,l_suppkey", "foreign_key", 0, "count(*)",
        "(SELECT 1 FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber = 1 AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)) o")]))
def b04(t: Tables) -> DataFrame:
    single = op.check_foreign_key(t.orders, t.customer, [("o_custkey", "c_custkey")], "orders")
    pair = [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")]
    return single.unionByName(op.check_foreign_key(t.lineitem, t.lineitem.where("l_linenumber = 1"), pair, "lineitem"))


_ORPHAN = "count(*) FILTER (visit_id IS NOT NULL AND visit_id NOT IN (SELECT visit_id FROM visits))"


@query("b05_check_logical_fk", with_roles(" UNION ALL ".join([
    row("labs", "visit_id", "link_null", None, "count(*) FILTER (visit_id IS NULL)", "labs"),
    row("labs", "visit_id", "link_orphan", 100, _ORPHAN, "labs"),
    row("referrals", "visit_id", "link_null", 0, "count(*) FILTER (visit_id IS NULL)", "referrals"),
    row("referrals", "visit_id", "link_orphan", 0, _ORPHAN, "referrals")]), "visits", "labs", "referrals"))
def b05(t: Tables) -> DataFrame:
    on = [("visit_id", "visit_id")]
    return op.check_logical_fk(t.labs, t.visits, on, "labs", expected_orphans=100).unionByName(
        op.check_logical_fk(t.referrals, t.visits, on, "referrals", policy="complete"))


_TEXT = Contract("raw", (Field("visit_id", required=True), Field("age", "integer", minimum=30),
                         Field("weight", "number", minimum=100, maximum=2400), Field("kind", enum=("1-URGENT", "2-HIGH"))))


@query("b06_cell_errors", with_roles("""
    SELECT visit_id, field, error FROM (
      SELECT visit_id, 'age' AS field, CASE WHEN k % 50 = 0 THEN 'integer' WHEN age_in_days < 30 THEN 'minimum' END AS error FROM visits
      UNION ALL SELECT visit_id, 'weight', CASE WHEN k % 40 = 0 THEN 'finite' WHEN k % 41 = 0 THEN 'number'
        WHEN weight_oz < 100 THEN 'minimum' WHEN weight_oz > 2400 THEN 'maximum' END FROM visits
      UNION ALL SELECT visit_id, 'kind', CASE WHEN encounter_type NOT IN ('1-URGENT', '2-HIGH') THEN 'enum' END FROM visits) e
    WHERE error IS NOT NULL""", "visits"))
def b06(t: Tables) -> DataFrame:
    k, age = F.col("k"), F.col("age_in_days").cast("string")
    raw = t.visits.select(
        "visit_id", F.when(k % 50 == 0, F.concat(age, F.lit("x"))).otherwise(age).alias("age"),
        F.when(k % 40 == 0, "Infinity").when(k % 41 == 0, "heavy").otherwise(F.col("weight_oz").cast("string")).alias("weight"),
        F.col("encounter_type").alias("kind"))
    return op.cell_errors(raw, _TEXT, ["visit_id"])


@query("b07_check_vocab", with_roles("""
    SELECT 'ethnicity' AS field, ethnicity AS value, count(*) AS n FROM patients WHERE ethnicity NOT IN ('HOUSEHOLD', 'Unknown') GROUP BY 2
    UNION ALL SELECT 'generic_name', generic_name, count(*) FROM medications
      WHERE generic_name NOT IN (SELECT p_name FROM part) GROUP BY 2""", "patients", "medications"))
def b07(t: Tables) -> DataFrame:
    closed = op.check_vocab(t.patients, "ethnicity", ["HOUSEHOLD", "Unknown"]).withColumn("field", F.lit("ethnicity"))
    names = op.check_vocab(t.medications, "generic_name", t.part.select("p_name")).withColumn("field", F.lit("generic_name"))
    return closed.unionByName(names)


@query("b08_check_entity_links", with_roles(" UNION ALL ".join(
    row(n, "patient_id", "link_orphan", 0, "count(*) FILTER (patient_id NOT IN (SELECT patient_id FROM patients WHERE sex <> 'U'))", n)
    for n in ("visits", "labs", "medications")), "patients", "visits", "labs", "medications"))
def b08(t: Tables) -> DataFrame:
    tables = {"visits": t.visits, "labs": t.labs, "medications": t.medications}
    return op.check_entity_links(tables, t.patients.where("sex <> 'U'"), "patient_id")


@query("b09_schema_fingerprint", with_roles("""
    SELECT 'patients' AS table_name, sha256('patients(patient_id:string:required;sex:string:required:enum=F|M;ethnicity:string;race_1:string:required;race_2:string;race_3:string;key=patient_id)') AS schema_hash,
      count(*) AS rows FROM patients
    UNION ALL SELECT 'stream', sha256('stream(patient_id:string;event_id:bigint;kind:string;value:double;hour:bigint)'), count(*) FROM stream""",
                                               "patients", "stream"))
def b09(t: Tables) -> DataFrame:
    return op.schema_fingerprint({"patients": patients(t), "stream": t.stream}, {"patients": PATIENTS})


@query("b10_check_profile", with_roles("""
    , c AS (SELECT 'encounter_type' AS field, encounter_type AS value, count(*) AS n FROM visits GROUP BY 2
        UNION ALL SELECT 'source_yn', source_yn, count(*) FROM visits WHERE source_yn IS NOT NULL GROUP BY 2)
    SELECT f.field, v.row_count, CASE f.field WHEN 'source_yn' THEN v.missing ELSE 0 END AS missing, cast(f.total AS BIGINT) AS total, 'ok' AS finding
    FROM (SELECT field, sum(n) AS total FROM c GROUP BY 1) f CROSS JOIN
      (SELECT count(*) AS row_count, count(*) FILTER (source_yn IS NULL) AS missing FROM visits) v""", "visits"))
def b10(t: Tables) -> DataFrame:
    from ..operators import profiling

    df = t.visits.select("encounter_type", "source_yn")
    profile = profiling.field_profile(df, {"encounter_type": "string", "source_yn": "string"})
    return op.check_profile(profile, profiling.value_distributions(df, ["encounter_type", "source_yn"]), VISITS)


@query("b11_reconcile_counts", with_roles("""
    , d AS (SELECT count(*) AS rows, count(DISTINCT o_custkey) AS entities FROM orders)
    SELECT 'visits' AS table_name, count(*) AS measured_rows, count(DISTINCT patient_id) AS measured_entities,
      count(*) = (SELECT rows FROM d) AS rows_match, count(DISTINCT patient_id) = (SELECT entities FROM d) AS entities_match FROM visits
    UNION ALL SELECT 'labs', count(*), count(DISTINCT patient_id), false, false FROM labs""", "visits", "labs"))
def b11(t: Tables) -> DataFrame:
    declared = t.orders.agg(F.lit("visits").alias("table_name"), F.count("*").alias("rows"),
                            F.countDistinct("o_custkey").alias("entities"))
    return op.reconcile_counts({"visits": t.visits, "labs": t.labs}, declared, "patient_id")


def _audit(name: str, cols: str) -> str:
    null = " OR ".join(f"{c} IS NULL" for c in cols.split(", "))
    return f"""SELECT '{name}' AS candidate, cast(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
      cast(coalesce(sum(n) FILTER ({null}), 0) AS BIGINT) AS null_rows, count(*) FILTER (n > 1) AS duplicate_groups,
      cast(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicates FROM (SELECT {cols}, count(*) AS n FROM labs GROUP BY {cols}) g"""


_CANDIDATES = {"declared": "lab_order_id, result_line_num", "superkey": "lab_order_id, component, result_line_num",
               "trap": "lab_order_id, component"}


@query("b12_audit_keys", with_roles(" UNION ALL ".join(_audit(n, c) for n, c in _CANDIDATES.items()), "labs"))
def b12(t: Tables) -> DataFrame:
    return op.audit_keys(t.labs, {n: c.split(", ") for n, c in _CANDIDATES.items()})


@query("b13_link_report", with_roles("""
    SELECT record_type, count(*) AS rows, count(*) FILTER (m.visit_id IS NULL) AS null_ids,
      count(*) FILTER (m.visit_id IS NOT NULL AND v.visit_id IS NULL) AS unresolved,
      100e0 * count(*) FILTER (m.visit_id IS NOT NULL AND v.visit_id IS NULL) / count(m.visit_id) AS unresolved_share
    FROM medications m LEFT JOIN visits v ON m.visit_id = v.visit_id GROUP BY 1""", "medications", "visits"))
def b13(t: Tables) -> DataFrame:
    return op.link_report(t.medications, t.visits, ("visit_id", "visit_id"), "record_type")


ORDER_RULES = [
    ("lab result before order", "labs", "order_age", "result_age"),
    ("medication start before order", "medications", "order_age", "start_age"),
    ("medication end before start", "medications", "start_age", "end_age"),
    ("problem resolved before noted", "problem_list", "noted_age", "resolved_age"),
    ("problem before birth", "problem_list", "noted_age", None),
    ("lab before birth", "labs", "order_age", None),
    ("medication before birth", "medications", "order_age", None),
    ("visit before birth", "visits", "age_in_days", None),
]


def _ordering_sql() -> str:
    gaps = " UNION ALL ".join(
        f"SELECT '{label}' AS check_name, {early} - {late} AS gap FROM {table}" if late
        else f"SELECT '{label}', -{early} FROM {table}" for label, table, early, late in ORDER_RULES)
    return f"""SELECT check_name, checked, CASE WHEN v NOT BETWEEN 1 AND 9 THEN v END AS violations,
      CASE WHEN v NOT BETWEEN 1 AND 9 THEN 100e0 * v / checked END AS share,
      CASE WHEN v > 9 THEN med END AS median_gap, CASE WHEN v > 9 THEN p95 END AS p95_gap
    FROM (SELECT check_name, count(gap) AS checked, count(*) FILTER (gap > 0) AS v,
      quantile_cont(CASE WHEN gap > 0 THEN cast(gap AS DOUBLE) END, 0.5) AS med,
      quantile_cont(CASE WHEN gap > 0 THEN cast(gap AS DOUBLE) END, 0.95) AS p95 FROM ({gaps}) g WHERE gap IS NOT NULL GROUP BY 1) x"""


@query("b14_ordering_checks", with_roles(_ordering_sql(), "labs", "medications", "problem_list", "visits"))
def b14(t: Tables) -> DataFrame:
    tables = {n: getattr(t, n) for n in ("labs", "medications", "problem_list", "visits")}
    return op.ordering_checks(tables, ORDER_RULES)


@query("b15_ordering_by_group", with_roles("""
    SELECT record_type, count(*) AS checked, count(*) FILTER (gap > 0) AS violations,
      100e0 * count(*) FILTER (gap > 0) / count(*) AS violation_share,
      100e0 * count(*) FILTER (gap BETWEEN 1 AND 31) / nullif(count(*) FILTER (gap > 0), 0) AS near_share
    FROM (SELECT record_type, start_age - end_age AS gap FROM medications) g WHERE gap IS NOT NULL GROUP BY 1""", "medications"))
def b15(t: Tables) -> DataFrame:
    return op.ordering_by_group(t.medications, "start_age", "end_age", "record_type")


@query("b16_resource_map", with_roles("""
    SELECT 'patients' AS table_name, count(*) AS rows, cast(6 AS BIGINT) AS n_columns, 'patient_id' AS key, '' AS links FROM patients
    UNION ALL SELECT 'visits', count(*), 10, 'visit_id', 'patient_id->patients' FROM visits
    UNION ALL SELECT 'labs', count(*), 4, 'lab_order_id,result_line_num', 'visit_id->visits,patient_id->patients' FROM labs""",
                                     "patients", "visits", "labs"))
def b16(t: Tables) -> DataFrame:
    tables = {"patients": patients(t), "visits": visits(t), "labs": t.labs.select(*LABS.names)}
    return op.resource_map(tables, {"patients": PATIENTS, "visits": VISITS, "labs": LABS})
