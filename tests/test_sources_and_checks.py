import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspan.functions.keys import canonical, join_split
from tallyspan.functions.storage import fresh_path
from tallyspan.operators import assurance, explore, integrity, privacy, profiling, screens, targets
from tallyspan.sources import bundle, delimited, fhir
from tallyspan.sources.contract import Contract, Field, contract_schema

TINY = Contract("tiny", (Field("id", required=True), Field("n", "integer", minimum=0), Field("x", "number"), Field("k", enum=("a", "b"))), primary_key=("id",))


def write(spark, path, lines, encoding="utf-8"):
    import os

    os.makedirs(path)
    with open(f"{path}/part-0.csv", "wb") as f:
        f.write("\n".join(lines).encode(encoding) if encoding else b"\n".join(lines))


def test_typed_scan_raises_without_the_value(spark):
    path = fresh_path(spark, "t")
    write(spark, path, ["id,n,x,k", "1,+5,1e3,a", '2,,"",', "3,7x,secret,b"])
    with pytest.raises(Exception) as error:
        delimited.read_typed_csv(spark, path, TINY).collect()
    assert "tiny.n" in str(error.value) and "7x" not in str(error.value).split("tiny.n")[1][:40]
    got = {r.id: r for r in delimited.read_typed_csv(spark, path, TINY, "quarantine").collect()}
    assert got["1"].n == 5 and got["1"].x == 1000.0 and got["2"].n is None and got["2"].k is None
    assert got["3"]["_errors"] == ["tiny.n", "tiny.x"]
    with pytest.raises(ValueError):
        delimited.read_typed_csv(spark, path, TINY, "skip")


def test_windows_code_page_bytes(spark):
    path = fresh_path(spark, "t")
    c = Contract("w", (Field("id"), Field("t")), encoding="cp1252")
    write(spark, path, [b"id,t", b"1,\x93quoted\x94 \x80", b"2,\x81"], None)
    got = {r.id: r.t for r in delimited.read_typed_csv(spark, path, c).collect()}
    assert got == {"1": "“quoted” €", "2": "�"}


def test_preflight_reports_every_failing_table(spark):
    root = fresh_path(spark, "pre")
    for name, head in (("good", "a,b"), ("swapped", "b,a"), ("short", "a,b")):
        write(spark, f"{root}/{name}", [head, "1,2"])
    fields = (Field("a"), Field("b"))
    out = {r.table_name: r for r in delimited.preflight(spark, [Contract("good", fields, rows=1), Contract("swapped", fields), Contract("short", fields, rows=2)], root).collect()}
    assert {n: r.status for n, r in out.items()} == {"good": "PASS", "swapped": "FAIL", "short": "FAIL"}
    assert not out["swapped"].header_ok


def test_fingerprint_ignores_order_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert bundle.same_fingerprint(bundle.fingerprint(a), bundle.fingerprint(a.orderBy(F.desc("i")).repartition(3)))
    for other in (a.limit(2), a.withColumn("i", F.col("i") + 1), a.union(a.limit(1))):
        assert not bundle.same_fingerprint(bundle.fingerprint(a, "sha256"), bundle.fingerprint(other, "sha256"))


def test_bundle_detects_a_changed_table(spark):
    path = fresh_path(spark, "b")
    df = spark.createDataFrame([("1", 5, 1.0, "a"), ("2", None, None, None)], contract_schema(TINY))
    bundle.write_bundle({"tiny": df}, path, {"tiny": TINY})
    row = bundle.verify_bundle(spark, path, {"tiny": TINY}).first()
    assert row.schema_ok and row.rows_ok and row.content_ok
    df.limit(1).write.mode("append").parquet(f"{path}/tiny")
    row = bundle.verify_bundle(spark, path, {"tiny": TINY}).first()
    assert not row.rows_ok and not row.content_ok


def test_rules_keys_and_links(spark):
    df = spark.createDataFrame([("1", -1, 1.0, "a"), ("1", 2, None, "z"), (None, 3, None, None)], "id string, n long, x double, k string")
    got = {(r.field, r.rule): r.observed for r in integrity.check_rules(df, TINY).collect()}
    assert got == {(None, "row_count"): 3, ("id", "required"): 1, ("n", "minimum"): 1, ("k", "enum"): 1}
    keys = {r.rule: r.observed for r in integrity.check_primary_key(df, ["id"], "t").collect()}
    assert keys == {"key_complete": 1, "key_unique": 1}
    parent = spark.createDataFrame([("1",), ("1",)], "id string")
    child = spark.createDataFrame([("1",), ("9",), ("9",), (None,)], "id string")
    links = {r.rule: (r.observed, r.status) for r in integrity.check_logical_fk(child, parent, [("id", "id")], "c", 1, 2).collect()}
    assert links == {"link_null": (1, "PASS"), "link_orphan": (2, "PASS")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, n long, x double, k string")
    assert {r.observed for r in integrity.check_rules(empty, TINY).collect()} == {0}
    assert {r.observed for r in integrity.check_primary_key(empty, ["id"], "t").collect()} == {0}
    assert profiling.histogram(empty, "x", 0.0, 4.0, 4).agg(F.sum("n")).first()[0] == 0
    assert explore.same_period_spread(empty.withColumnRenamed("n", "age"), "id", "age", {"x": None}).count() == 0
    assert profiling.field_profile(empty, {"x": "number"}).first().row_count == 0


def test_ordering_suppresses_count_and_size_together(spark):
    data = [(10, 5 if i < 9 else 12) for i in range(20)]
    few = spark.createDataFrame(data, "a long, b long")
    many = spark.createDataFrame([(10, 5)] * 12 + [(1, 3)], "a long, b long")
    rule = lambda n: [("r", n, "a", "b")]
    hidden = integrity.ordering_checks({"t": few}, rule("t")).first()
    shown = integrity.ordering_checks({"t": many}, rule("t")).first()
    assert (hidden.checked, hidden.violations, hidden.share, hidden.median_gap) == (20, None, None, None)
    assert (shown.violations, shown.median_gap, shown.p95_gap) == (12, 5.0, 5.0)


def test_carry_forward_without_pairs(spark):
    data = [("a", 0, 1.0, "phone"), ("a", 7, 1.0, "office"), ("a", 20, 1.0, "phone"), ("a", 21, 2.0, "office"), ("b", 0, 1.0, "office"), ("b", 0, 1.0, "office")]
    df = spark.createDataFrame(data, "p string, a int, v double, k string")
    got = {r.k: (r.candidates, r.carried) for r in explore.carry_forward(df, "p", "a", "v", "k", ["phone"], 7).collect()}
    assert got == {"phone": (2, 1), "office": (4, 2)}


def test_entry_mechanisms(spark):
    data = [(1, 5.0, 61.0), (2, 100.0, 39.37), (3, 4.05, 40.5), (4, 53.0, 35.0), (5, 5.25, 52.0)]
    df = spark.createDataFrame(data, "i int, v double, expected double")
    scales = [("cm", 1 / 2.54)]
    got = {r.i: set(r.hits) for r in explore.entry_mechanisms(df, "v", "expected", F.lit(0.6), scales, feet=True).collect()}
    assert explore.FEET in got[1] and "cm" in got[2] and explore.SHIFT in got[3] and explore.SWAP in got[4] and explore.SHIFT in got[5]


def test_cells_keep_their_borders(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("-", "c"), ("", "c"), ("1:a", None), ("1", ":a-")], "a string, b string")
    assert df.select(canonical("a", "b").alias("k")).distinct().count() == 7
    a = spark.createDataFrame([(1, 5, None, "x"), (2, 5, "a|b", "c"), (3, 5, "a", "b")], "pid long, age long, p string, q string")
    b = spark.createDataFrame([(1, 5, "-", "x"), (2, 5, "a", "b|c"), (3, 5, "a", "b")], "pid long, age long, p string, q string")
    got = {r.pid: r.reason for r in assurance.layer_diff(a, b, "pid", {"cells": ["age", "p", "q"]}, [], ["cells"]).collect()}
    assert got == {1: "OK", 2: "OK", 3: "UNCHANGED"}
    keys = privacy.subset_counts(spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("-", "c")], "p string, q string"), ["p", "q"], {"n": F.count("*")})
    assert keys.where("n > 1").count() == 1  # only the last component alone repeats


def test_distinct_counts_without_expanding_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.0, None), (1, "A", -0.0, None), (None, "", float("nan"), None), (2, None, float("nan"), None)], "i int, s string, x double, none string")
    want = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first().asDict()
    out = profiling.field_profile(df, {"i": "integer", "s": "string", "x": "number", "none": "string"}, ["i", "s", "x", "none"])
    assert {r.field: r.distinct_values for r in out.collect()} == want == {"i": 2, "s": 3, "x": 2, "none": 0}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    scan = profiling.column_scan({"t": df}, [])
    assert {r.field: (r.present, r.distinct_values) for r in scan.collect()} == {"i": (3, 2), "s": (3, 3), "x": (4, 2), "none": (0, 0)}
    assert "Expand" not in scan._jdf.queryExecution().executedPlan().toString()
    assert [r.distinct_values for r in profiling.field_profile(df, {"i": "integer", "s": "string"}, ["s"]).orderBy("field").collect()] == [None, 3]


def test_cross_rule_sorts_once_for_all_rules(spark):
    rules = {"short": ([(100, 10)], 20), "long": ([], 35), "mixed": ([(60, 20)], 35)}
    rng = random.Random(6)
    data = [(f"p{rng.randrange(3)}", rng.randrange(200), rng.choice([1.0, None, 2.0]), rng.choice([None, 10, 20, 21, 35, 40])) for _ in range(160)]
    data += data[:20]
    df = spark.createDataFrame(data, "pid string, age long, v double, gap long")
    out = explore.cross_rule(df, "pid", "age", "v", "gap", rules)
    want = {}
    for name, (steps, default) in rules.items():
        rows = [r for r in data if r[2] is not None and r[3] is not None]
        least = lambda age: next((g for below, g in steps if age <= below), default)
        prior = lambda r: max((o[1] for o in data if o[0] == r[0] and o[2] is not None and o[1] <= r[1] - least(r[1])), default=None)
        want[name] = (len(rows), sum(prior(r) is not None and r[1] - prior(r) == r[3] for r in rows))
    assert {r.rule: (r.rows, r.matched) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_split_join_gives_the_plain_join(spark, hot):
    left = spark.createDataFrame([(f"k{0 if i % 3 else i}", i) for i in range(300)], "key string, i long")
    right = spark.createDataFrame([("k0", "hot"), ("k3", "x"), ("k9", "y"), ("none", "z")], "key string, v string")
    got, want = join_split(left, right, "key"), left.join(right, "key")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert "__part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_splits_a_component_of_few_values(spark, hot):
    test_nearest_matches_all_pairs(spark)


def test_top_procedures_and_whole_lookup(spark):
    labs = spark.createDataFrame([("a", "p1"), ("a", "p1"), ("b", "p1"), ("b", "p2"), ("b", None), ("c", "p3")], "pid string, name string")
    assert [tuple(r[c] for c in ("rank", "name", "procedure_rows", "procedure_entities", "procedures")) for r in screens.top_procedures(labs, "pid", "name", 2).orderBy("rank").collect()] == [
        (1, "p1", 3, 2, 3), (2, "p2", 1, 1, 3)]
    book = spark.createDataFrame([("K1", "known")], "code string, description string")
    codes = spark.createDataFrame([("a", "K.1"), ("a", "Z9")], "pid string, code string")
    assert {r.code: r.description for r in screens.top_codes(codes, "pid", F.col("code"), book).collect()} == {"K.1": "known", "Z9": "[not in the lookup]"}


def test_nearest_matches_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(1)
    make = lambda n, p: [(f"{p}{i}", rng.choice("MF"), *[str(rng.randint(0, 3)) for _ in range(5)]) for i in range(n)]
    ref, q = make(25, "r"), make(30, "q")
    cols = "pid string, sex string, " + ", ".join(f"{c} string" for c in privacy.COMPONENTS)
    out = privacy.nearest_outcomes(privacy.with_cells(spark.createDataFrame(q, cols)), spark.createDataFrame(ref, cols))
    got = {r.cell: (r.evaluated, r.exact, r.unique_nearest, r.tied) for r in out.collect()}
    exact = unique = 0
    for x in q:
        score = [sum(a == b for a, b in zip(x[2:], y[2:])) for y in ref]
        exact += max(score) == 5
        unique += score.count(max(score)) == 1
    assert got["overall"] == (30, exact, unique, 30 - unique)


def test_compare_targets_statuses(spark):
    schema = "partition string, stratum string, name string, family string, statistic string, value double, support long, denominator long"
    left = targets.disclose(spark.createDataFrame([("l", "s", "p", "f", "proportion", 0.5, 50, 100), ("l", "s", "m", "f", "mean", 4.0, 50, None), ("l", "s", "thin", "f", "mean", 4.0, 2, None)], schema))
    right = targets.disclose(spark.createDataFrame([("r", "s", "p", "f", "proportion", 0.59, 59, 100), ("r", "s", "m", "f", "mean", 6.5, 50, None), ("r", "s", "only", "f", "mean", 4.0, 50, None)], schema))
    got = {r.name: r.status for r in targets.compare_targets(left, right, 10, 0.01, 1.96, 5.0, {"f": 2.0}).collect()}
    assert got == {"p": "PASS", "m": "FAIL", "thin": "UNEVALUABLE", "only": "UNEVALUABLE"}


def test_event_order_rules(spark):
    e = lambda p, *kinds: [(p, k, 10 * i, i) for i, k in enumerate(kinds)]
    data = (e("ok", "latent_onset", "workup", "treatment_start", "treatment_response") + e("repeat", "workup", "workup") + e("back", "workup", "latent_onset")
            + e("open", "treatment_start") + e("odd", "nonsense") + e("no_start", "workup", "treatment_response") + [("age", "latent_onset", 10, 0), ("age", "workup", 5, 1)])
    df = spark.createDataFrame(data, "p string, kind string, age int, seq int")
    got = {r.p: r.valid for r in assurance.event_order(df, "p", "kind", "age", "seq").collect()}
    assert got == {"ok": True, "repeat": False, "back": False, "open": False, "odd": False, "no_start": False, "age": False}


def test_decision_metrics_hand_values(spark):
    data = [(1, True, 0.9, "M"), (1, False, 0.4, "M"), (0, False, 0.4, "M"), (0, True, 0.8, "F"), (1, None, None, "F")]
    df = spark.createDataFrame(data, "y int, d boolean, s double, sex string")
    r = {x.cell: x for x in assurance.decision_metrics(df, "y", "d", "sex").collect()}["overall"]
    assert (r.members, r.missing, r.tp, r.fn, r.tn, r.fp) == (5, 1, 1, 1, 1, 1)
    s = {x.cell: x for x in assurance.score_metrics(df, "y", "d", "s", "sex").collect()}["overall"]
    assert s.auroc == pytest.approx(0.625) and s.brier == pytest.approx((0.01 + 0.36 + 0.16 + 0.64) / 4)


def test_broken_bundle_is_not_published(spark):
    import os

    path = fresh_path(spark, "b")
    df = spark.createDataFrame([("1", -1, 1.0, "a"), ("1", 2, None, "z")], "id string, n long, x double, k string")
    with pytest.raises(ValueError, match="rules broken"):
        bundle.write_bundle({"tiny": df}, path, {"tiny": TINY})
    assert not os.path.exists(path.removeprefix("file:"))


def test_bundle_evaluates_its_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    plain = spark.createDataFrame([(str(i), i, float(i), "a") for i in range(90)], "id string, n long, x double, k string").repartition(3)
    bundle.write_bundle({"tiny": plain.mapInPandas(count, plain.schema)}, fresh_path(spark, "b"), {"tiny": TINY})
    assert seen.value == 90


CHILD = Contract("child", (Field("a"), Field("b", "integer"), Field("id")), primary_key=("a", "b"), links=(("id", "tiny"),))


@pytest.mark.parametrize("tiny,child,broken", [
    ([("1", 1), ("2", 2)], [("x", 1, "1"), ("x", 2, "1"), ("y", 1, None)], []),
    ([("1", 1), ("1", 2)], [("x", 1, "1")], ["tiny.id: key_unique"]),
    ([("1", 1)], [("x", 1, "1"), ("x", 1, "1"), ("x1", 1, "9")], ["child.a,b: key_unique", "child.id: foreign_key"]),
    ([(None, -1)], [("x", None, None)], ["tiny.id: required", "tiny.n: minimum", "tiny.id: key_complete", "child.a,b: key_complete"]),
    ([], [], []),
])
def test_bundle_names_what_is_broken(spark, tiny, child, broken):
    tables = {"tiny": spark.createDataFrame([(*r, 1.0, "a") for r in tiny], "id string, n long, x double, k string"), "child": spark.createDataFrame(child, "a string, b long, id string")}
    write = lambda: bundle.write_bundle(tables, fresh_path(spark, "b"), {"tiny": TINY, "child": CHILD})
    if not broken:
        got = {r.table_name: r for r in write().collect()}
        assert {n: r.rows for n, r in got.items()} == {"tiny": len(tiny), "child": len(child)}
        assert got["child"].content_hash == bundle.fingerprint(tables["child"], "sha256").first().content_hash
    else:
        with pytest.raises(ValueError) as error:
            write()
        assert all(x in str(error.value) for x in broken) and str(error.value).count(": ") == len(broken) + 1


def _file(spark, *contents):
    import os

    path = fresh_path(spark, "files")
    os.makedirs(path)
    for i, c in enumerate(contents):
        with open(f"{path}/{i}.txt", "wb") as f:
            f.write(c)
    return path


def test_file_fingerprint_is_true_to_order_and_bytes(spark):
    lines = [b"line %d \xff" % i for i in range(10_000)]
    whole = b"\n".join(lines) + b"\n"
    print_of = lambda *contents: bundle.fingerprint_files(spark, _file(spark, *contents)).first()
    base = print_of(whole)
    assert (base.lines, base.bytes, base.files) == (10_000, len(whole), 1) and print_of(whole) == base
    swapped, moved = lines[:], lines[1:] + lines[:1]
    swapped[4095], swapped[4096] = swapped[4096], swapped[4095]
    for other in (b"\n".join(swapped) + b"\n", b"\n".join(moved) + b"\n", whole.replace(b"\n", b"\r\n"), whole[:-1], whole.replace(b"\xff", b"\xfe", 1)):
        assert print_of(other) != base
    assert print_of(lines[0] + b"\n", b"\n".join(lines[1:]) + b"\n") != base
    assert print_of(b"a\n", b"b\n") != print_of(b"b\n", b"a\n")
    empty = print_of(b"")
    assert (empty.lines, empty.bytes, empty.files) == (0, 0, 0)


def test_file_fingerprint_does_not_depend_on_splits(spark):
    path = _file(spark, b"".join(b"row %d\n" % i for i in range(9_000)), b"", b"tail")
    want, blocks = bundle.fingerprint_files(spark, path).first(), bundle.file_blocks(spark, path).where("lines = 4096").count()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert bundle.fingerprint_files(spark, path).first() == want and blocks == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_published_tables_carry_their_metadata(spark):
    path = fresh_path(spark, "store")
    db = f"published_{path[-8:]}"
    df = spark.createDataFrame([("1", 1, 1.0, "a"), ("1", -2, 1.0, "z")], "id string, n long, x double, k string")
    bundle.publish_tables({"tiny": df}, db, {"tiny": TINY}, path)
    meta = lambda name: spark.table(f"{db}.meta_{name}").collect()
    assert [(r.rows, r.fields) for r in meta("resources")] == [(2, 4)] and [(r.tables, r.rows) for r in meta("build")] == [(1, 2)]
    assert {(r.field, r.type, r.required, r.in_key, r.allowed) for r in meta("descriptor")} == {
        ("id", "string", True, True, None), ("n", "bigint", False, False, None), ("x", "double", False, False, None), ("k", "string", False, False, "a|b")}
    assert {(r.field, r.rule) for r in meta("validations") if r.status == "FAIL"} == {("n", "minimum"), ("k", "enum"), ("id", "key_unique")}
    assert {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {db}.tiny").collect()}["rows"] == "2"
    assert {r.col_name: r.comment for r in spark.sql(f"DESCRIBE {db}.tiny").collect()}["id"] == "required"


def test_null_and_marker_texts_differ(spark):
    hashes = [bundle.fingerprint(spark.createDataFrame([(v, "x")], "a string, b string"), "sha256").first().content_hash for v in (None, "\\N", "-", "")]
    assert len(set(hashes)) == 4


def _csv_file(spark, text):
    path = fresh_path(spark, "raw")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


@pytest.mark.parametrize("line,errors", [
    ("1,5,2.5d,a", ["tiny.x"]), ("1,5,1f,a", ["tiny.x"]), ("1,5,0x1p3,a", ["tiny.x"]), ("1,5.0,1,a", ["tiny.n"]), ("1,5,1,a,surplus", ["tiny: record"]), ("1,5", ["tiny: record"]),
    ('1,5,-1.5e3,"two\nlines, and ""quotes"""', []), ("1,5,.5,  kept  ", [])])
def test_bad_record_kinds(spark, line, errors):
    path = _csv_file(spark, f"id,n,x,k\n{line}\n2,6,1.0,b")
    rows = delimited.read_typed_csv(spark, path, TINY, "quarantine").orderBy("id").collect()
    assert len(rows) == 2 and list(rows[0]["_errors"]) == errors and list(rows[1]["_errors"]) == []
    if errors:
        with pytest.raises(Exception, match="tiny"):
            delimited.read_typed_csv(spark, path, TINY).collect()
    else:
        assert rows[0].k in ('two\nlines, and "quotes"', "  kept  ")


def test_preflight_reads_every_header(spark):
    root = fresh_path(spark, "pre")
    for head in ("id,n,x,k", "n,id,x,k"):
        spark.createDataFrame([(f"{head}\n1,5,1.0,a",)], "value string").coalesce(1).write.mode("append").text(f"{root}/tiny")
    assert delimited.preflight(spark, [TINY], root).first().header_ok is False


class Chart:
    """Builds one bundle about one person, resource by resource."""

    def __init__(self, person="p7", **fields):
        self.person = person
        self.resources = [{"resourceType": "Patient", "id": person, "gender": "male", "birthDate": "2010-06-15", **fields}]

    def about(self, kind, number, **fields):
        self.resources.append({"resourceType": kind, "id": f"{kind[0].lower()}{number}", "subject": {"reference": f"Patient/{self.person}"}, **fields})
        return self

    def measure(self, number, day, loinc=None, value=None, **fields):
        if loinc:
            fields["code"] = {"coding": [{"system": "http://loinc.org", "code": loinc}]}
        if value is not None:
            fields["valueQuantity"] = {"value": value}
        return self.about("Observation", number, effectiveDateTime=day, **fields)

    def line(self):
        return json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in self.resources]})


def flattened(spark, *charts):
    path = fresh_path(spark, "charts")
    spark.createDataFrame([(c.line(),) for c in charts], "value string").write.text(path)
    return fhir.flatten_fhir(spark, path)


HEIGHT = "8302-2"  # fixed value: body height


def test_fhir_skips_other_observations_and_keeps_all_codes(spark):
    race = {"url": "http://hl7.org/fhir/us/core/StructureDefinition/us-core-race", "extension": [{"url": "text", "valueString": "Asian"}]}
    chart = Chart(extension=[race]).measure(1, "2014-03-02", HEIGHT, 88.5).measure(2, "2014-03-02", "2708-6", 97).measure(3, "2014-03-02").measure(4, "2014-03-02", HEIGHT)
    chart.measure(5, "2014-03-02", HEIGHT, 2.0, subject={"reference": "https://elsewhere.example/Patient/p7"})
    for i in range(37):
        chart.about("Condition", i, code={"coding": [{"system": fhir.ICD10, "code": f"L{i:02}"}]})
    flat = flattened(spark, chart)
    assert [r.value for r in flat["observations"].collect()] == [88.5]
    person = flat["patients"].first()
    assert (list(person.races), person.ethnicity) == (["Asian"], "Unknown")
    visit = fhir.fhir_to_visits(flat).first()
    assert visit.n_codes == 37 and len(visit.codes) == 37


def test_fhir_rejects_contradictions(spark):
    with pytest.raises(Exception, match="share an id"):
        flattened(spark, Chart(), Chart(gender="other"))["patients"].collect()
    with pytest.raises(Exception, match="before birth"):
        fhir.fhir_to_visits(flattened(spark, Chart().measure(1, "2009-12-31", HEIGHT, 50.0))).collect()


def test_code_tasks_grow_with_the_lines(spark, tmp_path):
    from tallyspan.functions import storage
    from tallyspan.plans import exploration, screening
    from tallyspan.plans.roles import Tables

    folder = os.environ.get("TALLYSPAN_DATA", "/root/testdata/sf0.001")
    queries = [exploration.e06, exploration.e07, exploration.e08, screening.e37, screening.e45, screening.e58, screening.e60]
    flat = lambda df: sorted(map(str, df.collect()))
    assert Tables(spark, folder).tasks("lineitem") is None  # small tables are left to the session
    plain = [flat(q(Tables(spark, folder))) for q in queries]
    spark.conf.set(storage.TASK_ROWS_KEY, "500")
    try:
        t = Tables(spark, folder)
        assert t.tasks("lineitem") == -(-t.lineitem.count() // 500) > 4
        assert exploration.e06(t).rdd.getNumPartitions() == t.tasks("lineitem")
        assert [flat(q(t)) for q in queries] == plain
    finally:
        spark.conf.unset(storage.TASK_ROWS_KEY)


def test_bundles_are_packed_in_bounded_files(spark, monkeypatch):
    from tallyspan.plans import sources
    from tallyspan.plans.roles import Tables

    t = Tables(spark, os.environ.get("TALLYSPAN_DATA", "/root/testdata/sf0.001"))
    monkeypatch.setattr(sources, "BUNDLES_A_FILE", 400)
    lines = spark.read.text(sources.bundles(t)).select("value", F.input_file_name().alias("f"))
    files = lines.groupBy("f").count().collect()
    assert all(r.f.endswith(".gz") and r["count"] <= 400 for r in files)
    assert sum(r["count"] for r in files) == t.visits.count() > 400


def test_subsets_of_a_profile_travel_as_short_keys(spark, monkeypatch):
    long = [(f"{i % 3}" * 64, f"{i % 5}" * 64) for i in range(30)]
    df = spark.createDataFrame(long, "a string, b string")
    seen = []
    monkeypatch.setattr(privacy, "join_split", lambda left, right, key: seen.append(left) or join_split(left, right, key))
    out = {(r.a[0], r.b[0]): (r.level, r.n) for r in privacy.nearest_counts(df, df.where(F.col("a") != "2" * 64), ["a", "b"], {"n": F.count("*")}).collect()}
    assert dict(seen[0].dtypes) == {"__kind": "binary", "level": "int", "key": "binary"}
    assert out == {(str(i % 3), str(i % 5)): (2, 2) if i % 3 < 2 else (1, 4) for i in range(30)}
