"""Bind the generic operator roles (patients, visits, labs, ...) to the given tables.

Each role is one SQL text rendered for Spark or for the checking engine, so
both sides compute the same inputs from the same Parquet files.  Measurements
come from integer arithmetic on the order's price and date, which makes them
identical in both engines; some rows carry deliberate entry errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import deal, task_count

BASE = "region nation customer supplier part orders lineitem events documents labels".split()
# Sides of the joins of lines, with the key they meet on.
JOINED = {"orders": "o_orderkey", "part": "p_partkey"}
# Columns of the wide layout at rest, as the reference has them; nothing is derived from it.
SLOTS = 33


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def days(self, ts: str, start: str = "DATE '1995-01-01'") -> str:
        if self.spark:
            return f"datediff({ts}, {start})"
        return f"date_diff('day', {start}, cast({ts} AS DATE))"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def seconds(self, ts: str) -> str:
        # Field arithmetic, so the session time zone plays no part.
        if self.spark:
            return f"(datediff({ts}, DATE '1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"
        return f"cast(floor(epoch({ts})) AS BIGINT)"

    def table(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name


def _code(d: Dialect, key: str) -> str:
    """Hierarchical code such as E34 or E34.3 from an integer key."""
    return (
        f"substr('EEKNPQRZ', cast({key} % 8 AS INT) + 1, 1)"
        f" || lpad(cast({d.div(key, '8')} % 100 AS VARCHAR(4)), 2, '0')"
        f" || CASE WHEN {key} % 3 = 0 THEN '' ELSE '.' || cast({key} % 10 AS VARCHAR(2)) END"
    )


def patients(d: Dialect) -> str:
    t = d.table("customer")
    return f"""
    SELECT cast(c_custkey AS VARCHAR(20)) AS patient_id,
      CASE WHEN c_custkey % 20 = 0 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'Unknown' WHEN 'MACHINERY' THEN 'Choose not to answer'
        ELSE c_mktsegment END AS ethnicity,
      CASE WHEN c_nationkey = 7 THEN 'Unable to collect' ELSE 'race-' || cast(c_nationkey % 6 AS VARCHAR(4)) END AS race_1,
      CASE WHEN c_nationkey % 4 = 0 THEN 'race-' || cast((c_nationkey + 1) % 6 AS VARCHAR(4)) END AS race_2,
      CASE WHEN c_nationkey % 12 = 0 THEN 'Unknown' END AS race_3,
      CASE WHEN c_acctbal < 1500 THEN 1 ELSE 0 END AS label,
      CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS label2,
      c_acctbal AS balance
    FROM {t}"""


def visits(d: Dialect) -> str:
    h = (f"1950 + {d.div('7 * age', '10')} + (c % 41 - 20) * 8 + (k % 61 - 30)")
    w = (f"1200 + {d.div('32 * age', '10')} + (c % 37 - 18) * {d.div('age', '100')} + ({d.div('k', '100')} % 301 - 150)")
    return f"""
    SELECT patient_id, visit_id, age_in_days, encounter_type, source_yn,
      CASE WHEN k % 11 = 5 THEN NULL
        WHEN k % 83 = 0 THEN cast(w * 10 AS DOUBLE) / 10
        WHEN k % 79 = 0 THEN cast({d.div('w', '16')} AS DOUBLE) / 10
        WHEN k % 5 = 0 THEN cast({d.div('w', '160')} * 160 AS DOUBLE) / 10
        WHEN k % 3 = 0 THEN cast({d.div('w', '10')} * 10 AS DOUBLE) / 10
        ELSE cast(w AS DOUBLE) / 10 END AS weight_oz,
      CASE WHEN k % 7 = 3 THEN NULL
        WHEN k % 89 = 0 THEN cast({d.div('h * 254', '100')} AS DOUBLE) / 100
        WHEN k % 97 = 0 THEN cast(h * 10 AS DOUBLE) / 100
        WHEN k % 4 <> 0 THEN cast({d.div('h', '25')} * 25 AS DOUBLE) / 100
        ELSE cast(h AS DOUBLE) / 100 END AS height_in,
      CASE WHEN age_in_days > 1095 OR k % 3 = 1 THEN NULL
        WHEN k % 29 = 0 THEN cast({d.div('hc * 254', '100')} AS DOUBLE) / 100
        ELSE cast(hc AS DOUBLE) / 100 END AS head_circ_cm,
      CASE WHEN age_in_days >= 730 AND k % 6 <> 1 THEN cast(1400 + k % 1200 AS DOUBLE) / 100 END AS bmi,
      CASE WHEN age_in_days >= 730 AND k % 6 <> 1 THEN cast(k % 1001 AS DOUBLE) / 10 END AS bmi_percentile,
      k
    FROM (SELECT cast(c AS VARCHAR(20)) AS patient_id, cast(o AS VARCHAR(20)) AS visit_id, age AS age_in_days,
        encounter_type, source_yn, k, {h} AS h, {w} AS w, 3400 + age + k % 100 AS hc
      FROM (SELECT o_custkey AS c, o_orderkey AS o, cast(3 * {d.days('o_orderdate')} AS BIGINT) AS age,
          o_orderpriority AS encounter_type,
          CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END AS source_yn,
          cast(round(o_totalprice * 100) AS BIGINT) AS k
        FROM {d.table('orders')}) a) b"""


def visit_codes(d: Dialect) -> str:
    """Tall diagnosis slots: one row per line of an order."""
    return f"""
    SELECT cast(o_custkey AS VARCHAR(20)) AS patient_id, cast(o_orderkey AS VARCHAR(20)) AS visit_id,
      cast(3 * {d.days('o_orderdate')} AS BIGINT) AS age_in_days, l_linenumber AS slot,
      {_code(d, 'l_partkey')} AS code
    FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey"""


def visit_slots(d: Dialect) -> str:
    """Wide diagnosis slots, as the visit table holds them at rest; repeated lines take further slots.

    A sink only: ``overflow`` counts the codes of the visit that found no slot.
    """
    slots = ", ".join(f"max(CASE WHEN place = {i} THEN code END) AS enc_diag_{i}" for i in range(1, SLOTS + 1))
    return f"""SELECT patient_id, visit_id, age_in_days, {slots}, count(CASE WHEN place > {SLOTS} THEN 1 END) AS overflow FROM (
      SELECT *, row_number() OVER (PARTITION BY patient_id, visit_id, age_in_days ORDER BY slot, code) AS place FROM ({visit_codes(d)}) vc) placed
      GROUP BY patient_id, visit_id, age_in_days"""


def named_codes(d: Dialect) -> str:
    """Every line's code with the description that stands on the same line."""
    return f"""
    SELECT {_code(d, 'l_partkey')} AS code, p_name AS description, CASE WHEN p_size < 10 THEN 1 ELSE 0 END AS chronic
    FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey"""


def problem_list(d: Dialect) -> str:
    days = d.days("l_shipdate")
    return f"""
    SELECT cast(o_custkey AS VARCHAR(20)) AS patient_id,
      cast(l_orderkey AS VARCHAR(20)) || '-' || cast(l_linenumber AS VARCHAR(4)) || '-' || cast(l_partkey AS VARCHAR(20)) AS problem_list_id,
      CASE WHEN l_quantity > 45 THEN NULL ELSE cast(3 * {days} AS BIGINT) END AS noted_age,
      CASE WHEN l_returnflag = 'R' THEN cast(3 * {days} + l_quantity - 10 AS BIGINT) END AS resolved_age,
      {_code(d, '(l_partkey + 3)')} AS pl_diag
    FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey"""


def labs(d: Dialect) -> str:
    return f"""
    SELECT cast(o_custkey AS VARCHAR(20)) AS patient_id,
      CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 9 = 1 THEN 'x' || cast(l_orderkey AS VARCHAR(20))
        ELSE cast(l_orderkey AS VARCHAR(20)) END AS visit_id,
      cast(l_orderkey AS VARCHAR(20)) AS lab_order_id, l_linenumber AS result_line_num,
      cast(3 * {d.days('o_orderdate')} AS BIGINT) AS order_age,
      CASE WHEN l_linenumber = 7 THEN NULL
        ELSE cast(3 * {d.days('o_orderdate')} + l_quantity - 3 AS BIGINT) END AS result_age,
      p_type AS procedure_name, CASE WHEN l_linenumber = 7 THEN NULL ELSE p_name END AS component,
      CASE WHEN l_linenumber = 7 THEN NULL
        ELSE cast(l_partkey % 9000 + 1000 AS VARCHAR(8)) || CASE WHEN l_partkey % 13 = 0 THEN '' ELSE '-' || cast(l_partkey % 10 AS VARCHAR(2)) END END AS loinc,
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 11 = 0 THEN '<' || cast(cast(l_quantity AS INT) AS VARCHAR(8))
        WHEN l_suppkey % 13 = 0 THEN 'Negative' WHEN l_suppkey % 17 = 0 THEN ''
        ELSE cast(cast(l_quantity AS INT) AS VARCHAR(8)) END AS result_value,
      CASE WHEN l_linenumber = 7 OR l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 'High' ELSE 'Low' END AS result_flag
    FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey
      JOIN {d.table('part')} ON l_partkey = p_partkey"""


def medications(d: Dialect) -> str:
    return f"""
    SELECT cast(o_custkey AS VARCHAR(20)) AS patient_id,
      CASE WHEN l_linestatus = 'O' THEN 'x' ELSE '' END || cast(l_orderkey AS VARCHAR(20)) AS visit_id,
      cast(l_orderkey AS VARCHAR(20)) || '-' || cast(l_linenumber AS VARCHAR(4)) || '-' || cast(l_partkey AS VARCHAR(20)) AS med_record_id,
      cast(3 * {d.days('o_orderdate')} AS BIGINT) AS order_age,
      CASE WHEN l_quantity > 40 THEN NULL ELSE cast(3 * {d.days('o_orderdate')} + l_suppkey % 10 - 2 AS BIGINT) END AS start_age,
      CASE WHEN l_returnflag = 'N' THEN NULL ELSE cast(3 * {d.days('o_orderdate')} + l_quantity - 5 AS BIGINT) END AS end_age,
      CASE WHEN l_linestatus = 'O' THEN 'External' ELSE 'Internal' END AS record_type,
      CASE WHEN l_partkey % 5 = 0 THEN upper(p_name) WHEN l_partkey % 5 = 1 THEN replace(p_name, 'ring', 'RINg') ELSE p_name END AS generic_name
    FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey
      JOIN {d.table('part')} ON l_partkey = p_partkey"""


def referrals(d: Dialect) -> str:
    return f"""
    SELECT cast(o_custkey AS VARCHAR(20)) AS patient_id,
      CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'x' || cast(l_orderkey AS VARCHAR(20)) ELSE cast(l_orderkey AS VARCHAR(20)) END AS visit_id,
      cast(l_orderkey AS VARCHAR(20)) || '-' || cast(l_linenumber AS VARCHAR(4)) || '-' || cast(l_partkey AS VARCHAR(20)) AS referral_id,
      cast(3 * {d.days('o_orderdate')} AS BIGINT) AS referral_age,
      CASE WHEN l_quantity > 48 THEN NULL ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' ' || p_brand END AS specialty,
      cast(l_quantity AS BIGINT) % 4 AS n_visits
    FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey
      JOIN {d.table('part')} ON l_partkey = p_partkey"""


def stream(d: Dialect) -> str:
    """Dense event series: hour index as the time axis."""
    return f"""
    SELECT cast(user_id AS VARCHAR(20)) AS patient_id, event_id, event_type AS kind, value,
      {d.div(d.seconds('ts') + ' - 1704067200', '3600')} AS hour
    FROM {d.table('events')}"""


def scored(d: Dialect) -> str:
    """Documents as labelled entities with numeric and categorical features."""
    return f"""
    SELECT x.doc_id, lang, source, n_chars, quality AS label, toxic AS label2
    FROM {d.table('documents')} x JOIN {d.table('labels')} y ON x.doc_id = y.doc_id"""


ROLES = {
    "patients": patients, "visits": visits, "visit_codes": visit_codes, "visit_slots": visit_slots, "named_codes": named_codes,
    "problem_list": problem_list, "labs": labs, "medications": medications, "referrals": referrals,
    "stream": stream, "scored": scored,
}
_SPARK, _SQL = Dialect(True), Dialect(False)


class Tables:
    """Lazy access to the base tables and the role views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._tasks = spark, folder.rstrip("/"), {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self, name: str) -> int | None:
        """Tasks that work per row of a base table needs; the rows are counted once, from the footers of its files."""
        if name not in self._tasks:
            self._tasks[name] = task_count(self.spark, self.base(name).count())
        return self._tasks[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            text = ROLES[name](_SPARK)
            used = {b: self.base(b) for b in BASE if "{" + b + "}" in text}
            # The joins of lines take the number of tasks from this side.
            used |= {b: deal(used[b], self.tasks("lineitem"), key) for b, key in JOINED.items() if b in used and "lineitem" in used}
            return self.spark.sql(text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(8)", "STRING")
                                  .replace("VARCHAR(4)", "STRING").replace("VARCHAR(2)", "STRING"), **used)
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)


def with_roles(body: str, *names: str, ctes: str = "") -> str:
    """Oracle text: role views as common table expressions, then the body.

    A body that starts with a comma adds its own expressions to the list.
    """
    views = [f"{n} AS ({ROLES[n](_SQL)})" for n in names]
    if ctes:
        views.append(ctes)
    if not views:
        return body
    return f"WITH {', '.join(views)}{body if body.lstrip().startswith(',') else ' ' + body}"
