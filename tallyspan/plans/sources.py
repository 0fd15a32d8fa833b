"""Source and sink queries: every one round-trips the given tables through files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import fresh_path, materialize
from ..sources import bundle, delimited, fhir, references
from ..sources.contract import Contract, Field, contract_rules
from .registry import query
from .roles import Tables, with_roles

VISITS = Contract("visits", (
    Field("patient_id", required=True), Field("visit_id", required=True),
    Field("age_in_days", "integer", required=True, minimum=0),
    Field("encounter_type", required=True,
          enum=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    Field("source_yn", enum=("Y", "N")), Field("weight_oz", "number", minimum=16, maximum=9600),
    Field("height_in", "number", minimum=10, maximum=90), Field("head_circ_cm", "number", maximum=80),
    Field("bmi", "number", maximum=24), Field("bmi_percentile", "number", minimum=0, maximum=100),
), primary_key=("visit_id",), links=(("patient_id", "patients"),))
PATIENTS = Contract("patients", (
    Field("patient_id", required=True), Field("sex", required=True, enum=("F", "M")),
    Field("ethnicity"), Field("race_1", required=True), Field("race_2"), Field("race_3"),
), primary_key=("patient_id",))


def visits(t: Tables) -> DataFrame:
    return t.visits.select(*VISITS.names)


def patients(t: Tables) -> DataFrame:
    return t.patients.select(*PATIENTS.names)


@query("a01_contract_schema", with_roles("""
    SELECT 'visits' AS table_name, r.field, r.rule, r.expected, p.present FROM (VALUES
      ('patient_id','type','string'),('patient_id','required','0'),('patient_id','link','patients'),
      ('visit_id','type','string'),('visit_id','required','0'),('visit_id','primary_key','0'),
      ('age_in_days','type','integer'),('age_in_days','required','0'),('age_in_days','minimum','0'),
      ('encounter_type','type','string'),('encounter_type','required','0'),
      ('encounter_type','enum','1-URGENT|2-HIGH|3-MEDIUM|4-NOT SPECIFIED|5-LOW'),
      ('source_yn','type','string'),('source_yn','enum','Y|N'),
      ('weight_oz','type','number'),('weight_oz','minimum','16'),('weight_oz','maximum','9600'),
      ('height_in','type','number'),('height_in','minimum','10'),('height_in','maximum','90'),
      ('head_circ_cm','type','number'),('head_circ_cm','maximum','80'),
      ('bmi','type','number'),('bmi','maximum','24'),
      ('bmi_percentile','type','number'),('bmi_percentile','minimum','0'),('bmi_percentile','maximum','100'))
      r(field, rule, expected)
    JOIN (UNPIVOT (SELECT count(patient_id) AS patient_id, count(visit_id) AS visit_id, count(age_in_days) AS age_in_days,
      count(encounter_type) AS encounter_type, count(source_yn) AS source_yn, count(weight_oz) AS weight_oz,
      count(height_in) AS height_in, count(head_circ_cm) AS head_circ_cm, count(bmi) AS bmi,
      count(bmi_percentile) AS bmi_percentile FROM visits)
      ON COLUMNS(*) INTO NAME field VALUE present) p USING (field)""", "visits"))
def a01(t: Tables) -> DataFrame:
    present = t.visits.agg(*[F.count(n).alias(n) for n in VISITS.names]).unpivot(
        [], VISITS.names, "field", "present")
    return contract_rules(t.spark, [VISITS]).join(F.broadcast(present), "field").select(
        "table_name", "field", "rule", "expected", "present")


def _csv(df: DataFrame, contract: Contract, label: str) -> str:
    path = fresh_path(df.sparkSession, label)
    delimited.write_exact_csv(df, contract, path)
    return path


_RAW = """SELECT patient_id, visit_id,
    CASE WHEN k % 50 = 0 THEN cast(age_in_days AS VARCHAR) || '.5' ELSE cast(age_in_days AS VARCHAR) END AS age_in_days,
    CASE WHEN k % 40 = 0 THEN 'inf' WHEN k % 41 = 0 THEN 'heavy' WHEN k % 43 = 0 THEN '' ELSE cast(k AS VARCHAR) END AS weight_oz
    FROM visits"""
_RAW_CONTRACT = Contract("raw", (Field("patient_id"), Field("visit_id"), Field("age_in_days", "integer"),
                                 Field("weight_oz", "number")))


@query("a02_read_typed_csv", with_roles(f"""
    SELECT patient_id, visit_id, try_cast(CASE WHEN age_in_days NOT LIKE '%.%' THEN age_in_days END AS BIGINT) AS age_in_days,
      CASE WHEN weight_oz NOT IN ('inf', 'heavy', '') THEN cast(weight_oz AS DOUBLE) END AS weight_oz,
      concat_ws(',', CASE WHEN age_in_days LIKE '%.%' THEN 'raw.age_in_days' END,
        CASE WHEN weight_oz IN ('inf', 'heavy') THEN 'raw.weight_oz' END) AS errors
    FROM ({_RAW}) x""", "visits"))
def a02(t: Tables) -> DataFrame:
    k, age = F.col("k"), F.col("age_in_days").cast("string")
    raw = t.visits.select(
        "patient_id", "visit_id",
        F.when(k % 50 == 0, F.concat(age, F.lit(".5"))).otherwise(age).alias("age_in_days"),
        F.when(k % 40 == 0, "inf").when(k % 41 == 0, "heavy").when(k % 43 == 0, "").otherwise(k.cast("string"))
        .alias("weight_oz"))
    read = delimited.read_typed_csv(t.spark, _csv(raw, _RAW_CONTRACT, "csv"), _RAW_CONTRACT, "quarantine")
    return read.withColumn("errors", F.concat_ws(",", "_errors")).drop("_errors")


_TEXT = Contract("texts", (Field("doc_id", "integer"), Field("lang"), Field("text")), encoding="cp1252",
                 delimiter="|")


@query("a03_single_byte_encodings", "SELECT doc_id, lang, md5(text) AS text_md5, cast(length(text) AS BIGINT) AS n FROM documents")
def a03(t: Tables) -> DataFrame:
    read = delimited.read_typed_csv(t.spark, _csv(t.documents.select("doc_id", "lang", "text"), _TEXT, "latin"), _TEXT)
    return read.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@query("a04_preflight", with_roles("""
    SELECT 'visits' AS table_name, true AS header_ok, cast(NULL AS BIGINT) AS expected_rows, count(*) AS observed_rows, 'PASS' AS status FROM visits
    UNION ALL SELECT 'patients', true, 7, count(*), CASE WHEN count(*) = 7 THEN 'PASS' ELSE 'FAIL' END FROM patients""",
                                   "visits", "patients"))
def a04(t: Tables) -> DataFrame:
    root = fresh_path(t.spark, "preflight")
    declared = Contract("patients", PATIENTS.fields, rows=7)
    delimited.write_exact_csv(visits(t), VISITS, f"{root}/visits")
    delimited.write_exact_csv(patients(t), declared, f"{root}/patients")
    return delimited.preflight(t.spark, [VISITS, declared], root)


# Contracts of the stored tables: the declared limits that the given rows keep.
STORED = {"patients": replace(PATIENTS, fields=tuple(replace(f, enum=("F", "M", "U") if f.name == "sex" else f.enum) for f in PATIENTS.fields)),
          "visits": replace(VISITS, fields=tuple(replace(f, minimum=None, maximum=None) for f in VISITS.fields))}


def _content_sql(table: str, names: list[str]) -> str:
    text = " || ".join(f"coalesce(length(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')" for c in names)
    return f"""SELECT '{table}' AS table_name, count(*) AS rows, cast({len(names)} AS BIGINT) AS fields,
      cast(sum(cast(concat('0x', substr(sha256({text}), 1, 15)) AS BIGINT)) AS VARCHAR) AS content_hash FROM {table}"""


_BOTH = f"{_content_sql('patients', PATIENTS.names)} UNION ALL {_content_sql('visits', VISITS.names)}"


@query("a05_fingerprint", with_roles(f"""SELECT * EXCLUDE (table_name), true AS unchanged, false AS unchanged_after_edit, false AS unchanged_after_move, rows AS source_lines
    FROM ({_content_sql('patients', PATIENTS.names)}) p""", "patients"))
def a05(t: Tables) -> DataFrame:
    """Content hash of the table, and the source lines' own fingerprint before and after an export, an edit and another order."""
    path = _csv(patients(t).orderBy("patient_id"), PATIENTS, "source")
    before = materialize(bundle.fingerprint_files(t.spark, path))
    read = delimited.read_typed_csv(t.spark, path, PATIENTS)
    delimited.write_augmented(read, fresh_path(t.spark, "export"), PATIENTS.names)
    unchanged = bundle.same_fingerprint(before, bundle.fingerprint_files(t.spark, path))
    edited = _csv(patients(t).withColumn("race_1", F.lit("edited")).orderBy("patient_id"), PATIENTS, "edited")
    moved = _csv(patients(t).orderBy(F.desc("patient_id")), PATIENTS, "moved")
    return bundle.fingerprint(read, "sha256").withColumns({
        "unchanged": F.lit(unchanged), "unchanged_after_edit": F.lit(bundle.same_fingerprint(before, bundle.fingerprint_files(t.spark, edited))),
        "unchanged_after_move": F.lit(bundle.same_fingerprint(before, bundle.fingerprint_files(t.spark, moved))), "source_lines": F.lit(before.first()["lines"] - before.first()["files"])})  # each file has its header


@query("a06_write_bundle", with_roles(_BOTH, "patients", "visits"))
def a06(t: Tables) -> DataFrame:
    return bundle.write_bundle({"patients": patients(t), "visits": visits(t)}, fresh_path(t.spark, "bundle"), STORED)


@query("a07_verify_bundle", with_roles("""
    SELECT 'patients' AS table_name, true AS schema_ok, count(*) AS rows, true AS rows_ok, true AS content_ok FROM patients
    UNION ALL SELECT 'visits', true, count(*), true, true FROM visits""", "patients", "visits"))
def a07(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "bundle")
    bundle.write_bundle({"patients": patients(t), "visits": visits(t)}, path, STORED)
    return bundle.verify_bundle(t.spark, path, STORED)


_RULES_OF = {c.name: sum(1 + f.required + (f.enum is not None) + (f.minimum is not None) + (f.maximum is not None) for f in c.fields) + bool(c.primary_key) + len(c.links) for c in STORED.values()}
_CHECKS_OF = {c.name: 1 + sum(f.required + (f.enum is not None) + (f.minimum is not None) + (f.maximum is not None) for f in c.fields) + 2 * bool(c.primary_key) + len(c.links) for c in STORED.values()}


def _stored_sql(name: str) -> str:
    c = STORED[name]
    return (f"SELECT *, {len(c.fields)}::BIGINT AS described, {sum(f.required for f in c.fields)}::BIGINT AS required, {_RULES_OF[name]}::BIGINT AS rules, "
            f"{_CHECKS_OF[name]}::BIGINT AS checks, 0::BIGINT AS failed, (SELECT count(*) FROM patients) + (SELECT count(*) FROM visits) AS built_rows, "
            f"cast(rows AS VARCHAR) AS property_rows FROM ({_content_sql(name, c.names)})")


@query("a08_publish_tables", with_roles(f"{_stored_sql('patients')} UNION ALL {_stored_sql('visits')}", "patients", "visits"))
def a08(t: Tables) -> DataFrame:
    """What the catalog holds of the published tables: each metadata table and the table properties are read back."""
    path = fresh_path(t.spark, "store")
    db = f"tallyspan_{path.rsplit('-', 1)[-1]}"
    resources = bundle.publish_tables({"patients": patients(t), "visits": visits(t)}, db, STORED, path)
    meta = lambda name: t.spark.table(f"{db}.{name}")
    described = meta("meta_descriptor").groupBy("table_name").agg(F.count("*").alias("described"), F.count_if("required").alias("required"))
    rules = meta("meta_rules").groupBy("table_name").agg(F.count("*").alias("rules"))
    checks = meta("meta_validations").groupBy("table_name").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    build = meta("meta_build").select(F.col("rows").alias("built_rows"))
    properties = [(n, r["value"]) for n in STORED for r in t.spark.sql(f"SHOW TBLPROPERTIES {db}.{n}").collect() if r["key"] == "rows"]
    stored = t.spark.createDataFrame(properties, "table_name string, property_rows string")
    return resources.join(described, "table_name").join(rules, "table_name").join(checks, "table_name").join(stored, "table_name").crossJoin(build)  # one row


# Formula grids with the shape of published references over a fixed range of steps;
# only A09 takes the steps from the visit table.  kind -> (key column, key, M, S, L).
GRIDS = {
    "weight_age": ("Agemos", "i * 3e0", "3.4e0 + 0.276e0 * i * 3e0", "0.12e0", "(i - 33e0) / 33e0"),
    "height_age": ("Agemos", "i * 3e0", "49.5e0 + 0.541e0 * i * 3e0", "0.04e0", "1e0"),
    "bmi_age": ("Agemos", "i * 3e0 + 24e0", "15e0 + 0.09e0 * i * 3e0", "0.15e0", "-1e0"),
    "head_age": ("Agemos", "i * 1e0", "34.5e0 + 0.304e0 * i", "0.03e0", "1e0"),
    "weight_length": ("Length", "i + 45e0", "3.4e0 + 0.51e0 * (i - 4e0)", "0.12e0", "-0.3e0"),
    "weight_stature": ("Height", "i + 77e0", "17.5e0 + 0.51e0 * i", "0.12e0", "-0.3e0"),
    "velocity_no": ("Ageyrs", "i * 0.25e0", "6.5e0 - 0.05e0 * i * 0.25e0", "0.4e0", "1e0"),
    "velocity_early": ("Ageyrs", "i * 0.25e0", "7e0 - 0.05e0 * i * 0.25e0", "0.4e0", "0.8e0"),
    "velocity_average": ("Ageyrs", "i * 0.25e0", "6.8e0 - 0.05e0 * i * 0.25e0", "0.45e0", "1e0"),
    "velocity_late": ("Ageyrs", "i * 0.25e0", "6e0 - 0.05e0 * i * 0.25e0", "0.5e0", "1.2e0"),
}


STEPS = 81


def grid_sql(kind: str, steps: str) -> str:
    key, k, m, s, l = GRIDS[kind]
    return f"""SELECT sx AS "Sex", {k} AS "{key}", {l} AS "L", ({m}) * (1e0 + sx * 1e-2) AS "M", {s} AS "S"
        FROM ({steps}) steps
        CROSS JOIN (SELECT 1 AS sx UNION ALL SELECT 2 AS sx) sexes"""


def grid(t: Tables, kind: str, observed: bool = False) -> DataFrame:
    steps = "SELECT DISTINCT age_in_days div 91 AS i FROM {visits}" if observed else f"SELECT id AS i FROM range(0, {STEPS})"
    given = {"visits": t.visits} if observed else {}
    return references.load_lms(t.spark.sql(grid_sql(kind, steps).replace('"', "`"), **given), GRIDS[kind][0])


def grid_cte(kind: str, name: str, observed: bool = False) -> str:
    key = GRIDS[kind][0]
    steps = "SELECT DISTINCT age_in_days // 91 AS i FROM visits" if observed else f"SELECT unnest(range(0, {STEPS})) AS i"
    return (f"""{name} AS (SELECT CASE "Sex" WHEN 1 THEN 'M' ELSE 'F' END AS "Sex", "{key}", "L", "M", "S" """
            f"""FROM ({grid_sql(kind, steps)}) g)""")


@query("a09_load_lms", with_roles("""SELECT "Sex" AS sex, "Agemos" AS knot, round("L", 8) AS l, round("M", 8) AS m,
    round("S", 8) AS s FROM g""", "visits", ctes=grid_cte("weight_age", "g", True)))
def a09(t: Tables) -> DataFrame:
    return grid(t, "weight_age", True).select(
        F.col("Sex").alias("sex"), F.col("Agemos").alias("knot"),
        *[F.round(F.col(c), 8).alias(c.lower()) for c in "LMS"])


@query("a10_code_lookup", with_roles("""
    SELECT replace(code, '.', '') AS code, min(description) AS description, max(chronic) AS chronic FROM named_codes GROUP BY 1""", "named_codes"))
def a10(t: Tables) -> DataFrame:
    # Both dictionaries come from one small pass over the code column.
    small = t.named_codes.groupBy("code", "chronic").agg(F.min("description").alias("description"))
    dotless = F.replace(F.col("code"), F.lit("."), F.lit(""))
    chronic = references.chronic_codes(small, "code", "chronic").select(dotless.alias("code")).distinct()
    return references.code_lookup(small, "code", "description").join(
        chronic.withColumn("chronic", F.lit(1)), "code", "left").fillna(0, ["chronic"])


_ORDER = ["visit_id", "patient_id", "age_in_days", "weight_oz", "height_in"]


@query("a11_write_augmented", with_roles(f"SELECT {', '.join(_ORDER)} FROM visits", "visits"))
def a11(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "augmented")
    delimited.write_augmented(t.visits, path, _ORDER)
    return t.spark.read.parquet(path)


BUNDLES_A_FILE = 50_000


def bundles(t: Tables) -> str:
    """One FHIR bundle per visit, written as packed JSON lines from the visit table."""
    ref = lambda kind, c: F.struct(F.concat(F.lit(kind + "/"), c).alias("reference"))
    coded = lambda system, code: F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"))).alias("coding"))
    pid, vid, day = F.concat(F.lit("p"), F.col("patient_id")), F.concat(F.lit("e"), F.col("visit_id")), F.date_add(
        F.lit("2001-01-01").cast("date"), F.col("age_in_days").cast("int")).cast("string")
    resource = lambda kind, **fields: F.to_json(F.struct(
        F.lit(kind).alias("resourceType"), *[c.alias(n) for n, c in fields.items() if c is not None]))

    def extension(name: str, value):
        part = F.struct(F.lit("text").alias("url"), value.alias("valueString"))
        return F.struct(F.lit(f"http://hl7.org/fhir/us/core/StructureDefinition/{name}").alias("url"), F.array(part).alias("extension"))

    def observation(suffix: str, code: str, value):
        own = F.when(F.col("k") % 4 != 0, ref("Encounter", vid))
        return F.when(value.isNotNull(), resource(
            "Observation", id=F.concat(vid, F.lit("-" + suffix)), subject=ref("Patient", pid), encounter=own,
            code=coded("http://loinc.org", F.lit(code)), effectiveDateTime=F.concat(day, F.lit("T10:00:00Z")),
            valueQuantity=F.struct(value.alias("value"))))

    text = F.array_compact(F.array(
        resource("Patient", id=pid, gender=F.lit("female"), birthDate=F.lit("2001-01-01"), extension=F.array(
            extension("us-core-race", F.concat(F.lit("race-"), (F.col("patient_id").cast("long") % 5).cast("string"))),
            extension("us-core-ethnicity", F.lit("group")))),
        resource("Encounter", id=vid, subject=ref("Patient", pid), period=F.struct(day.alias("start"))),
        observation("h", "8302-2", F.col("height_in") * 2.54), observation("w", "29463-7", F.col("weight_oz") / 35.274),
        observation("c", "9843-4", F.col("head_circ_cm")),
        # What real bundles are full of: other codes, no code, no value, remote references.
        observation("o", "85354-9", F.col("age_in_days").cast("double")),
        resource("Observation", id=F.concat(vid, F.lit("-n")), subject=ref("Patient", pid), effectiveDateTime=day),
        F.when(F.col("k") % 7 == 0, resource("Observation", id=F.concat(vid, F.lit("-r")), subject=ref("https://elsewhere.example/Patient", pid),
                                             code=coded("http://loinc.org", F.lit("8302-2")), effectiveDateTime=day)),
        resource("Condition", id=F.concat(vid, F.lit("-d")), subject=ref("Patient", pid),
                 encounter=F.when(F.col("k") % 3 == 0, ref("Encounter", vid)),
                 onsetDateTime=F.when(F.col("k") % 5 != 0, day),
                 code=coded(fhir.ICD10, F.concat(F.lit("K"), (F.col("k") % 97).cast("string")))),
    ))
    line = F.concat(F.lit('{"resourceType":"Bundle","entry":['),
                    F.concat_ws(",", F.transform(text, lambda r: F.concat(F.lit('{"resource":'), r, F.lit("}")))),
                    F.lit("]}"))
    path = fresh_path(t.spark, "fhir")
    # The same field names stand in every bundle. A packed file is one split, so each holds a bounded number of bundles.
    t.visits.select(line.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", BUNDLES_A_FILE).text(path)
    return path


@query("a12_flatten_fhir", with_roles("""
    SELECT 'observations' AS kind, 'p' || patient_id AS patient_id, 'e' || visit_id AS source, metric AS name, round(value, 6) AS value
      FROM (SELECT *, 'height_cm' AS metric, height_in * 2.54e0 AS value FROM visits UNION ALL
            SELECT *, 'weight_kg', weight_oz / 35.274e0 FROM visits UNION ALL SELECT *, 'head_circ_cm', head_circ_cm FROM visits) o
      WHERE value IS NOT NULL
    UNION ALL SELECT 'conditions', 'p' || patient_id, 'e' || visit_id, 'K' || cast(k % 97 AS VARCHAR), NULL FROM visits
    UNION ALL SELECT 'encounters', 'p' || patient_id, 'e' || visit_id, NULL, NULL FROM visits
    UNION ALL SELECT DISTINCT 'patients', 'p' || patient_id, 'race-' || cast(cast(patient_id AS BIGINT) % 5 AS VARCHAR) || '/group', 'F', NULL FROM visits""", "visits"))
def a12(t: Tables) -> DataFrame:
    flat = fhir.flatten_fhir(t.spark, bundles(t))
    none = F.lit(None)
    part = lambda kind, source, name, value: flat[kind].select(
        F.lit(kind).alias("kind"), "patient_id", source.alias("source"), name.alias("name"), value.alias("value"))
    return (
        part("observations", F.substring_index("observation_id", "-", 1), F.col("metric"), F.round("value", 6))
        .unionByName(part("conditions", F.substring_index("condition_id", "-", 1), F.col("code"), none.cast("double")))
        .unionByName(part("encounters", F.col("encounter_id"), none.cast("string"), none.cast("double")))
        .unionByName(part("patients", F.concat_ws("/", F.array_join("races", "+"), "ethnicity"), F.col("sex"), none.cast("double"))))


@query("a13_fhir_to_visits", with_roles("""SELECT v.pid AS patient_id, v.group_id, v.age AS age_in_days, round(v.w * 35.274e0, 5) AS weight_oz, round(v.h / 2.54e0, 5) AS height_in,
      v.hc AS head_circ_cm, round(CASE WHEN v.age >= 730 THEN v.w / pow(v.h / 100e0, 2) END, 5) AS bmi, coalesce(codes, '') AS codes, coalesce(n_codes, 0) AS n_codes
    FROM v LEFT JOIN codes USING (pid, group_id, age)""", "visits", ctes="""
      g AS (SELECT 'p' || patient_id AS pid, CASE WHEN k % 4 <> 0 THEN 'e' || visit_id
          ELSE 'date:' || cast(DATE '2001-01-01' + cast(age_in_days AS INT) AS VARCHAR) END AS group_id, age_in_days AS age, 'e' || visit_id AS eid,
          height_in * 2.54e0 AS h, weight_oz / 35.274e0 AS w, head_circ_cm AS hc
        FROM visits WHERE coalesce(height_in, weight_oz, head_circ_cm) IS NOT NULL),
      v AS (SELECT pid, group_id, age, arg_min(h, eid || '-h') FILTER (h IS NOT NULL) AS h, arg_min(w, eid || '-w') FILTER (w IS NOT NULL) AS w,
          arg_min(hc, eid || '-c') FILTER (hc IS NOT NULL) AS hc FROM g GROUP BY ALL),
      c AS (SELECT 'p' || patient_id AS pid, CASE WHEN k % 3 = 0 THEN 'e' || visit_id END AS eid,
          CASE WHEN k % 5 <> 0 THEN age_in_days END AS onset, 'K' || cast(k % 97 AS VARCHAR) AS code FROM visits),
      d AS (SELECT c.*, v.group_id AS g0, v.age AS a0 FROM c LEFT JOIN v ON c.pid = v.pid AND c.eid = v.group_id),
      placed AS (SELECT pid, g0 AS group_id, a0 AS age, code FROM d WHERE g0 IS NOT NULL UNION ALL
        SELECT pid, t.g, t.a, code FROM (SELECT d.pid, d.code, coalesce(
          (SELECT min({'a': v.age, 'g': v.group_id}) FROM v WHERE v.pid = d.pid AND (d.onset IS NULL OR v.age >= d.onset)),
          (SELECT max({'a': v.age, 'g': v.group_id}) FROM v WHERE v.pid = d.pid)) AS t FROM d WHERE g0 IS NULL) z WHERE t IS NOT NULL),
      codes AS (SELECT pid, group_id, age, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, cast(count(DISTINCT code) AS INT) AS n_codes FROM placed GROUP BY ALL)"""))
def a13(t: Tables) -> DataFrame:
    rows = fhir.fhir_to_visits(fhir.flatten_fhir(t.spark, bundles(t)))
    return rows.select("patient_id", "group_id", "age_in_days", F.round("weight_oz", 5).alias("weight_oz"),
                       F.round("height_in", 5).alias("height_in"), "head_circ_cm", F.round("bmi", 5).alias("bmi"),
                       F.array_join("codes", ",").alias("codes"), "n_codes")


@query("a14_write_findings", with_roles("""
    SELECT 'first' AS step, true AS written, count(*) AS groups FROM (SELECT DISTINCT encounter_type FROM visits) x
    UNION ALL SELECT 'again', false, count(*) FROM (SELECT DISTINCT encounter_type FROM visits) x""", "visits"))
def a14(t: Tables) -> DataFrame:
    found = t.visits.groupBy("encounter_type").agg(F.count("*").alias("n"))
    path = fresh_path(t.spark, "findings")
    steps = [(step, bundle.write_findings(found, path, ["encounter_type", "n"])) for step in ("first", "again")]
    stored = t.spark.read.text(path).agg(F.count("*").alias("groups"))
    return t.spark.createDataFrame(steps, "step string, written boolean").crossJoin(F.broadcast(stored))


@query("a15_write_exact_csv", with_roles("""SELECT patient_id, sex, ethnicity, race_1, race_2, race_3 FROM patients""",
                                         "patients"))
def a15(t: Tables) -> DataFrame:
    return delimited.read_typed_csv(t.spark, _csv(patients(t), PATIENTS, "exact"), PATIENTS)
