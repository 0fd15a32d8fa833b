"""FHIR bundles as a Spark JSON source: flatten resources, then build visit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import fresh_path, materialize

# LOINC codes of the four body measurements.
METRICS = {"8302-2": "height_cm", "29463-7": "weight_kg", "39156-5": "bmi", "9843-4": "head_circ_cm"}
RACES = 8  # race fields of the patient table
ICD10 = "http://hl7.org/fhir/sid/icd-10-cm"

_CODED = "struct<coding: array<struct<system: string, code: string>>, text: string>"
_REF = "struct<reference: string>"
RESOURCE = f"""id string, extension array<struct<url: string, extension: array<struct<url: string, valueString: string>>>>,
  gender string, birthDate string, subject {_REF}, encounter {_REF}, period struct<`start`: string>, code {_CODED}, valueQuantity struct<value: double>,
  effectiveDateTime string, effectivePeriod struct<`start`: string>, onsetDateTime string, recordedDate string"""
SCHEMA = f"entry array<struct<resource: struct<resourceType: string, {RESOURCE}>>>"


def _local_id(reference: str, kind: str):
    """Id of a local reference (``Kind/id`` or ``urn:uuid:id``); remote ones give null."""
    found = F.regexp_extract(F.col(reference), rf"^(?:{kind}/|urn:uuid:)([A-Za-z0-9\-.]+)$", 1)
    return F.when(found != "", found)


def _texts(name: str):
    """Distinct texts of the named extension, in order."""
    own = F.filter("extension", lambda e: F.element_at(F.split(e.url, "/"), -1) == name)
    parts = F.flatten(F.transform(own, lambda e: F.coalesce(e.extension, F.array().cast("array<struct<url: string, valueString: string>>"))))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: (p.url == "text") & p.valueString.isNotNull()), lambda p: p.valueString))


def _day(*columns: str):
    return F.coalesce(*[F.to_date(F.substring(F.col(c), 1, 10)) for c in columns])


def flatten_fhir(spark: SparkSession, path_in: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """Patient, encounter, observation and condition tables of a folder of bundles.

    The JSON is parsed once, into a written table split by kind.  A resource may stand in many
    bundles if it says the same in each; two patients that share an id but differ
    fail, as do observations before birth (in :func:`fhir_to_visits`).  Observations with
    other codes, without coding or without value are left out.
    """
    path = fresh_path(spark, "fhir-resources")
    (spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path_in)
     .select(F.explode("entry.resource").alias("r")).select("r.*")
     .where(F.col("resourceType").isin("Patient", "Encounter", "Observation", "Condition"))
     .write.partitionBy("resourceType").parquet(path))
    resources = spark.read.schema("resourceType string, " + RESOURCE).parquet(path)
    of = lambda kind: resources.where(F.col("resourceType") == kind)
    patients = of("Patient").select(
        F.col("id").alias("patient_id"),
        F.when(F.col("gender") == "male", "M").when(F.col("gender") == "female", "F").otherwise("U").alias("sex"),
        _day("birthDate").alias("birth_date"), F.slice(_texts("us-core-race"), 1, RACES).alias("races"),
        F.coalesce(F.get(_texts("us-core-ethnicity"), F.lit(0)), F.lit("Unknown")).alias("ethnicity"),
    ).distinct()
    # Distinct rows are left, so a second row of an id contradicts the first.
    same = F.when(F.count("*") > 1, F.raise_error(F.lit("two patients share an id"))).otherwise(F.first(F.struct("sex", "birth_date", "races", "ethnicity")))
    patients = patients.groupBy("patient_id").agg(same.alias("p")).select("patient_id", "p.*").withColumn(
        "races", F.when(F.size("races") > 0, F.col("races")).otherwise(F.array(F.lit("Unknown"))))
    encounters = of("Encounter").select(
        F.col("id").alias("encounter_id"), _local_id("subject.reference", "Patient").alias("patient_id"),
        _day("period.start").alias("start_date")).distinct()
    loinc = F.get(F.filter("code.coding", lambda c: c.code.isin(*METRICS)), F.lit(0)).code
    mapping = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    observations = of("Observation").select(
        F.col("id").alias("observation_id"), _local_id("subject.reference", "Patient").alias("patient_id"),
        _local_id("encounter.reference", "Encounter").alias("encounter_id"),
        _day("effectiveDateTime", "effectivePeriod.start").alias("obs_date"),
        mapping[loinc].alias("metric"), F.col("valueQuantity.value").alias("value"),
    ).where("metric is not null and value is not null and patient_id is not null").distinct()
    conditions = of("Condition").select(
        F.col("id").alias("condition_id"), _local_id("subject.reference", "Patient").alias("patient_id"),
        _local_id("encounter.reference", "Encounter").alias("encounter_id"),
        _day("onsetDateTime", "recordedDate").alias("onset_date"),
        F.explode(F.filter("code.coding", lambda c: c.system == ICD10)).alias("c"),
    ).select("condition_id", "patient_id", "encounter_id", "onset_date", F.col("c.code").alias("code")).distinct()
    return {"patients": patients, "encounters": encounters, "observations": observations, "conditions": conditions}


def fhir_to_visits(tables: dict[str, DataFrame]) -> DataFrame:
    """Visit rows from flattened resources, each with all its codes and their number.

    Measurements group by encounter (else date) and date, the first source id
    per metric winning.  Conditions follow their encounter; otherwise they go
    to the first visit on or after onset, else to the last visit, and undated
    ones to the first visit.
    """
    group_id = F.coalesce("encounter_id", F.concat(F.lit("date:"), F.col("obs_date").cast("string")))
    first = lambda metric: F.min_by("value", F.when(F.col("metric") == metric, F.col("observation_id"))).alias(metric)
    visits = (
        tables["observations"].withColumn("group_id", group_id)
        .groupBy("patient_id", "group_id", "obs_date")
        .agg(*[first(m) for m in METRICS.values()])
        .join(tables["patients"], "patient_id")
        .withColumn("age_in_days", F.datediff("obs_date", "birth_date").cast("long"))
        .withColumn("age_in_days", F.when(F.col("age_in_days") < 0, F.raise_error(F.lit("observation before birth"))).otherwise(F.col("age_in_days")))
    )
    filled = F.when((F.col("age_in_days") >= 730), F.col("weight_kg") / F.pow(F.col("height_cm") / 100, 2))
    visits = materialize(visits.withColumn("bmi", F.coalesce("bmi", filled)), "fhir-visits")

    conditions = tables["conditions"]
    keys = visits.select("patient_id", "group_id", "obs_date")
    direct = conditions.join(
        keys.withColumnRenamed("patient_id", "vp"),
        (F.col("vp") == F.col("patient_id")) & (F.col("group_id") == F.col("encounter_id")), "left")
    matched = direct.where("group_id is not null").select("patient_id", "group_id", "obs_date", "code")
    loose = direct.where("group_id is null").select("patient_id", "onset_date", "code").distinct()
    # One row per patient and day, so the window is bounded by the calendar.
    days = keys.groupBy("patient_id", F.col("obs_date").alias("day")).agg(F.min("group_id").alias("day_group"))
    asked = loose.select("patient_id", F.col("onset_date").alias("day")).where("day is not null").distinct()
    line = days.join(asked.withColumn("asked", F.lit(True)), ["patient_id", "day"], "full")
    later = Window.partitionBy("patient_id").orderBy(F.col("day").desc())
    target = F.when(F.col("day_group").isNotNull(), F.struct(F.col("day").alias("obs_date"),
                                                              F.col("day_group").alias("group_id")))
    assigned = line.select("patient_id", "day", "asked", F.last(target, True).over(later).alias("t")).where("asked")
    ends = keys.groupBy("patient_id").agg(
        F.min(F.struct("obs_date", "group_id")).alias("first"), F.max(F.struct("obs_date", "group_id")).alias("final"))
    placed = (
        loose.join(assigned.select("patient_id", F.col("day").alias("onset_date"), "t"), ["patient_id", "onset_date"], "left")
        .join(ends, "patient_id")
        .select("patient_id", F.when(F.col("onset_date").isNull(), F.col("first"))
                .otherwise(F.coalesce("t", "final")).alias("t"), "code")
        .select("patient_id", "t.group_id", "t.obs_date", "code")
    )
    # Codes are de-duplicated first; a visit then collects a vocabulary-bounded set.
    codes = matched.unionByName(placed).distinct().groupBy("patient_id", "group_id", "obs_date").agg(
        F.array_sort(F.collect_set("code")).alias("codes"))
    return visits.join(codes, ["patient_id", "group_id", "obs_date"], "left").select(
        "patient_id", "group_id", "obs_date", "age_in_days",
        (F.col("weight_kg") * 35.274).alias("weight_oz"), (F.col("height_cm") / 2.54).alias("height_in"),
        "head_circ_cm", "bmi", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
        F.coalesce(F.size("codes"), F.lit(0)).alias("n_codes"),
    )
