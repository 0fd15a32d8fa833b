"""Registered queries: contract shape always, full comparison on request."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tallyspan.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TALLYSPAN_DATA", "/root/testdata/sf0.001")
FULL = os.environ.get("TALLYSPAN_FULL") == "1"
QUICK = ["b14_ordering_checks", "c02_value_distributions", "d05_lms_zscore", "d13_min_gap_velocity", "d26_first_age_by_prefix", "e12_carry_forward",
         "e58_value_screen", "e63_auc_screen", "f09_physiology_targets", "g04_nearest_component", "h16_layer_diff"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    assert set(QUERIES) - set(ORACLES) == {"d31_derived_layers"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if FULL else QUICK)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(check.norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=check.key)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(check.norm(r[i]) for i in order) for r in cur.fetchall()), key=check.key)
    assert got == want


def test_reproduced_velocity_counts_ties_as_its_sql_does(spark, tmp_path):
    # Published -27.69 over 1248 days: the two ways to the velocity lie on both sides of a tie at the sixth digit.
    old = duckdb.connect()
    old.execute(f"""COPY (SELECT * FROM (VALUES (3168311, 323370, TIMESTAMP '1997-12-22', '3-MEDIUM', 'F', 219948.86e0), (3186921, 323370, TIMESTAMP '1996-11-04', '2-HIGH', 'F', 418761.72e0),
        (3198436, 323370, TIMESTAMP '1995-07-04', '4-NOT SPECIFIED', 'P', 496115.7e0), (3212577, 323370, TIMESTAMP '1995-09-15', '5-LOW', 'P', 168794.73e0))
        o(o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice)) TO '{tmp_path}/orders.parquet'""")
    old.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = entry.queries()["e30_reproduce_velocity"](spark, str(tmp_path))
    want = old.execute(entry.oracle_sql()["e30_reproduce_velocity"])
    want = dict(zip([c[0] for c in want.description], want.fetchone()))
    assert got.first().asDict() == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "velocity_height" in df.columns
