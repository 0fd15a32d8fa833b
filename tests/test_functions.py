import hashlib
import hmac
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.functions import bands, growthref, ordering, partition, stats
from tallyspan.functions.storage import materialize, split_hot


def test_normal_cdf_matches_erf(spark):
    zs = [-9.0, -5.0, -2.5, -0.66, -0.1, 0.0, 0.1, 0.66, 1.96, 3.0, 6.0, 40.0]
    df = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double")
    got = {r.z: r.p for r in df.select("z", stats.normal_cdf(F.col("z")).alias("p")).collect()}
    assert got.pop(None) is None
    for z, p in got.items():
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-9)


def test_partition_equals_hmac(spark):
    key = b"sixteen bytes or more"
    ids = [str(i) for i in range(40)] + ["é", "x" * 200]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.m for r in df.select("id", partition.digest_modulus(partition.keyed_digest(F.col("id"), key), 10_000).alias("m")).collect()}
    for i in ids:
        assert got[i] == int.from_bytes(hmac.new(key, i.encode(), hashlib.sha256).digest(), "big") % 10_000
    with pytest.raises(ValueError):
        partition.partition_label(F.col("id"), b"short", 1)


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    data = [(g, round(rng.gauss(0, 5), 2) if rng.random() > 0.1 else None) for g in ("a", "b", None) for _ in range(101)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    out = stats.exact_quantiles(df, ["g"], {"v": F.col("v")}, {"p10": 0.1, "p50": 0.5, "p95": 0.95}).collect()
    assert len(out) == 4
    for r in out:
        vals = [v for g, v in data if g == r.g and v is not None]
        assert r.n == len(vals)
        for name, p in (("p10", 10), ("p50", 50), ("p95", 95)):
            assert r[name] == pytest.approx(np.percentile(vals, p))


def test_running_totals_over_ranges(spark):
    data = [(g, i, i % 3 + 1) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(data, "g string, v int, n long")
    got = {(r.g, r.v): r.before for r in ordering.running_totals(df, ["g"], ["v"], {"before": "n"}).collect()}
    for g in "ab":
        total = 0
        for i in range(200):
            assert got[(g, i)] == total
            total += i % 3 + 1


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_rank_auc_against_all_pairs(spark):
    rng = random.Random(5)
    data = [(c, float(rng.randint(0, 6)), rng.randint(0, 1)) for c in ("x", "y") for _ in range(60)] + [("z", 1.0, 1), ("z", 2.0, 1)]
    df = spark.createDataFrame(data, "c string, value double, y int")
    got = {r.c: r.auc for r in stats.rank_auc(df, ["c"], "y").collect()}
    for c in "xyz":
        want = brute_auc([(s, y) for k, s, y in data if k == c])
        assert got[c] is None if want is None else got[c] == pytest.approx(want)


def test_neighbours_split_equals_plain(spark):
    rng = random.Random(9)
    # One entity holds a third of the rows.
    data = [("hot", i, i * 1.5) for i in range(60)] + [(f"e{i % 30}", rng.randint(0, 500) * 100 + i, float(i)) for i in range(120)]
    df = spark.createDataFrame(data, "pid string, a int, v double")
    spec = {"p1": (F.col("v"), -1), "p3": (F.col("v"), -3), "n2": (F.col("v"), 2)}
    key = lambda d: sorted(map(tuple, d.select("pid", "a", "v", *spec).collect()))
    plain = key(ordering.neighbours(df, ["pid"], ["a"], spec))
    spark.conf.set("tallyspan.hotRows", "3")
    try:
        assert split_hot(df, ["pid"])[1] is not None
        assert key(ordering.neighbours(df, ["pid"], ["a"], spec)) == plain
    finally:
        spark.conf.unset("tallyspan.hotRows")
    assert len(plain) == 180


def test_bands_are_half_open(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 9, 10, 19, 20, None)], "v int")
    got = [r.b for r in df.select(bands.band_label(F.col("v"), [("low", 0, 10), ("high", 10, 20)]).alias("b")).collect()]
    assert got == [None, "low", "low", "high", "high", None, None]
    both = [r.b for r in df.select(bands.all_bands(F.col("v"), [("x", 0, 15), ("y", 10, 20)]).alias("b")).collect()]
    assert both == [[], ["x"], ["x"], ["x", "y"], ["y"], [], []]


GRID = [("M", 0.0, 0.0, 10.0, 0.1), ("M", 10.0, 1.0, 20.0, 0.1), ("M", 12.0, 1.0, 24.0, 0.2)]


def lms(v, l, m, s):
    return round(math.log(v / m) / s if abs(l) < 1e-6 else ((v / m) ** l - 1) / (l * s), 4)


def test_lms_interpolates_clamps_and_nulls(spark):
    grid = spark.createDataFrame(GRID, "Sex string, k double, L double, M double, S double")
    cases = [("M", 0.0, 11.0, lms(11, 0, 10, 0.1)), ("M", 5.0, 16.0, lms(16, 0.5, 15, 0.1)), ("M", 11.0, 22.0, lms(22, 1, 22, 0.15)), ("M", 12.0, 30.0, lms(30, 1, 24, 0.2)),
             ("M", 500.0, 30.0, lms(30, 1, 24, 0.2)), ("M", -0.1, 11.0, None), ("F", 5.0, 16.0, None), ("U", 5.0, 16.0, None), ("M", 5.0, 0.0, None), ("M", None, 5.0, None), ("M", 5.0, None, None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, sex string, x double, v double")
    got = {r.i: r.z_score for r in growthref.lms_zscore(df, "v", "x", "sex", grid, "k").collect()}
    assert len(got) == len(cases)
    for i, c in enumerate(cases):
        assert got[i] is None if c[3] is None else got[i] == pytest.approx(c[3], abs=1e-4)


def test_lms_value_inverts_and_rejects_outside(spark):
    grid = spark.createDataFrame(GRID, "Sex string, k double, L double, M double, S double")
    df = spark.createDataFrame([(1, "M", 5.0, 0.7), (2, "M", 0.0, -1.0), (3, "M", 13.0, 0.0), (4, "M", 12.0, 9.0)], "i int, sex string, x double, z double")
    out = growthref.lms_value(df, "z", "x", "sex", grid, "k", clamp=(-2.0, 2.0))
    back = growthref.lms_zscore(out, "value", "x", "sex", grid, "k", "again")
    got = {r.i: (r.value, r.again) for r in back.collect()}
    assert got[1][1] == pytest.approx(0.7, abs=1e-3) and got[2][1] == pytest.approx(-1.0, abs=1e-3)
    assert got[3][0] is None
    assert got[4][1] == pytest.approx(2.0, abs=1e-3)


def test_suppress_and_stabilize(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.23456789012), (9, -4.0e-9), (10, 0.0)], "n int, x double")
    got = df.select(stats.suppress(F.col("n")).alias("n"), stats.stabilize(F.col("x")).alias("x")).collect()
    assert [r.n for r in got] == [0, None, None, 10]
    assert got[1].x == pytest.approx(1.2345679, abs=1e-12) and got[3].x == 0.0


def test_stabilize_keeps_null_and_special_values(spark):
    df = spark.createDataFrame([(0, None), (1, 2.5), (2, float("inf")), (3, float("nan"))], "k int, x double")
    got = [r.x for r in df.orderBy("k").select(stats.stabilize(F.col("x")).alias("x")).collect()]
    assert got[:3] == [None, 2.5, float("inf")] and got[3] != got[3]


def test_wilson_interval_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 10)], "k int, n int")
    lo, hi = stats.wilson_interval(F.col("k"), F.col("n"))
    got = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert got[0].lo is None and got[0].hi is None
    assert got[1].lo == 0.0 and got[1].hi == pytest.approx(0.277533, abs=1e-6)
    assert got[2].hi == 1.0
    assert (got[3].lo, got[3].hi) == (pytest.approx(0.107791, abs=1e-6), pytest.approx(0.603222, abs=1e-6))


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(5).withColumn("x", F.lit(None).cast("double"))
    again = materialize(df)
    assert [f.dataType for f in again.schema] == [f.dataType for f in df.schema] and again.count() == 5


def test_cleanup_deletes_what_was_written(spark, tmp_path):
    from tallyspan.functions import storage

    kept, storage._made[:] = list(storage._made), []
    try:
        stored = storage.materialize(spark.range(5))
        assert stored.count() == 5 and storage.cleanup(spark) == 1 and storage._made == []
    finally:
        storage._made[:] = kept
