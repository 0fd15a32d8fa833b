"""Costly expressions are worked out once per row or entity, not once per use."""

from pyspark.sql import functions as F

from tallyspan.functions.partition import partition_label
from tallyspan.operators import derive, explore, targets
from tallyspan.plans.derivation import grids
from tallyspan.plans.roles import Tables


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entry_mechanisms_format_the_value_once(spark):
    df = spark.createDataFrame([(1, 53.0, 35.0), (2, 4.0, 41.0), (3, None, 2.0)], "i int, v double, expected double").repartition(2)
    out = explore.entry_mechanisms(df, "v", "expected", F.lit(0.6), [("cm", 1 / 2.54)])
    assert optimized(out).count("format_string(") == 1
    assert out.columns == ["i", "v", "expected", "hits"]
    got = {r.i: r.hits for r in out.collect()}
    assert explore.SWAP in got[1] and explore.OMIT in got[2] and explore.SHIFT not in got[2]
    assert got[3] == []


KEY = b"sixteen bytes or more"


def hashed_by(df) -> str:
    """The first step that hashes ids: its results are formed once per group."""
    return next(line for line in optimized(df).splitlines() if "sha2(" in line)


def test_partition_of_many_rows_is_hashed_once_per_entity(spark):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5)], "id string, n int").repartition(2)
    marked = targets.mark_partition(events, "id", KEY, 5000)
    assert "Aggregate [id" in hashed_by(marked)
    want = sorted(targets.assign_partition(events, "id", KEY, 5000).select("n", "partition").collect())
    assert sorted(marked.select("n", "partition").collect()) == want


def test_links_fold_to_entities_before_their_partition(spark):
    events = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, visit string")
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "x"), ("b", None), (None, "1")], "id string, visit string").repartition(2)
    label = partition_label(F.col("id"), KEY, 5000)
    out = targets.link_targets({"t": rows}, events, "id", "visit", label)
    assert "Aggregate [id" in hashed_by(out)
    of = {r.id: r.p for r in rows.select("id", label.alias("p")).distinct().collect()}
    want = {p: [0, 0] for p in of.values()}
    for pid, hit in [("a", 1), ("a", 1), ("a", 0), ("b", 0), (None, 0)]:
        want[of[pid]][0] += hit
        want[of[pid]][1] += 1
    assert {r.partition: [r.support, r.denominator] for r in out.collect()} == want
    counts = targets.partition_counts({"t": rows}, "id", label)
    assert "Aggregate [id" in hashed_by(counts)
    assert {r.partition: r.rows for r in counts.collect()} == {p: n for p, (_, n) in want.items()}


def test_scores_are_cut_into_pieces_that_compile(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    out = derive.derive_visits(t.visits, t.patients, grids(t))
    joins = [piece.count("Join LeftOuter") for piece in optimized(out).split("Repartition 1073741824, false")]
    assert len(joins) > 8 and max(joins) <= 8
    assert out.columns[-8:-6] == ["velocity_height_z_score", "velocity_height_percentile"]
    assert out.columns.index("velocity_height") == out.columns.index("velocity_height_z_score") - 1
