"""Contract and integrity checks; each gives rows, never a driver-side verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, suppress
from ..functions.storage import broadcast_if_small
from ..sources.contract import Contract, contract_schema

CHECK = "table_name string, field string, rule string, expected long, observed long, status string"


def _check_rows(agg: DataFrame, table: str, checks: list[tuple[str, str | None, str, int | None]]) -> DataFrame:
    """Turn a one-row aggregate into check rows: (column, field, rule, expected)."""
    rows = F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(field).cast("string").alias("field"), F.lit(rule).alias("rule"),
            F.lit(expected).cast("long").alias("expected"), F.col(name).cast("long").alias("observed"),
            F.when(F.lit(expected).isNull() | (F.col(name) == F.lit(expected)), "PASS").otherwise("FAIL").alias("status"))
        for name, field, rule, expected in checks
    ])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def check_schema(df: DataFrame, contract: Contract) -> DataFrame:
    """Ordered name/type pairs against the contract, with the measured presence per field."""
    want = contract_schema(contract)
    observed = {f.name: (i, f.dataType) for i, f in enumerate(df.schema)}
    agg = df.agg(F.count("*").alias("__rows"), *[F.count(n).alias(n) for n in want.names if n in observed])
    rows = F.array(*[
        F.struct(
            F.lit(contract.name).alias("table_name"), F.lit(f.name).alias("field"), F.lit("schema").alias("rule"),
            F.lit(f.dataType.simpleString()).alias("expected"),
            F.lit(observed[f.name][1].simpleString() if f.name in observed else None).cast("string").alias("observed"),
            F.lit("PASS" if observed.get(f.name) == (i, f.dataType) else "FAIL").alias("status"),
            (F.col(f.name) if f.name in observed else F.lit(None).cast("long")).alias("present"))
        for i, f in enumerate(want)
    ])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def rule_tests(contract: Contract) -> list[tuple[str, str, Column]]:
    """(field, rule, violated) for every value rule of a contract."""
    tests = []
    for f in contract.fields:
        c = F.col(f"`{f.name}`")
        if f.required:
            tests.append((f.name, "required", c.isNull()))
        if f.enum is not None:
            tests.append((f.name, "enum", c.isNotNull() & ~c.isin(*f.enum)))
        if f.minimum is not None:
            tests.append((f.name, "minimum", c < f.minimum))
        if f.maximum is not None:
            tests.append((f.name, "maximum", c > f.maximum))
    return tests


def check_rules(df: DataFrame, contract: Contract) -> DataFrame:
    """Row count and all value rules in one pass."""
    tests = rule_tests(contract)
    agg = df.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)])
    checks = [("rows", None, "row_count", contract.rows)]
    checks += [(f"t{i}", field, rule, 0) for i, (field, rule, _) in enumerate(tests)]
    return _check_rows(agg, contract.name, checks)


def check_primary_key(df: DataFrame, key: list[str], table: str) -> DataFrame:
    """Completeness and uniqueness; groups are counted map-side first."""
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    groups = df.groupBy(*key).agg(F.count("*").alias("__n"))
    agg = groups.agg(
        F.coalesce(F.sum(F.when(missing, F.col("__n"))), F.lit(0)).alias("nulls"),
        F.count_if(~missing & (F.col("__n") > 1)).alias("duplicates"))
    field = ",".join(key)
    return _check_rows(agg, table, [("nulls", field, "key_complete", 0), ("duplicates", field, "key_unique", 0)])


def _orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Distinct unresolved child keys with their row counts, plus null-key rows.

    The child folds to one row per key before the join, so a key that holds a
    large share of the rows is combined map-side and never skews the join.
    """
    names = [f"__k{i}" for i in range(len(on))]
    keys = child.groupBy(*[F.col(c).alias(n) for n, (c, _) in zip(names, on)]).agg(F.count("*").alias("__n"))
    known = parent.select(*[F.col(p).alias(n) for n, (_, p) in zip(names, on)]).distinct().withColumn("__hit", F.lit(True))
    return keys.join(known, names, "left")


def _link_counts(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    joined = _orphans(child, parent, on)
    null = reduce(Column.__or__, [F.col(f"__k{i}").isNull() for i in range(len(on))])
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("__n"))), F.lit(0))
    return joined.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), total(null).alias("nulls"),
        total(~null & F.col("__hit").isNull()).alias("orphans"))


def check_foreign_key(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], table: str) -> DataFrame:
    """Strict link: no populated child key may lack a parent."""
    return _check_rows(_link_counts(child, parent, on), table, [("orphans", ",".join(c for c, _ in on), "foreign_key", 0)])


def check_logical_fk(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], table: str,
                     expected_nulls: int | None = None, expected_orphans: int | None = None,
                     policy: str = "allow_incomplete") -> DataFrame:
    """Link whose null and orphan counts are expected values; ``complete`` expects none."""
    if policy == "complete":
        expected_nulls, expected_orphans = 0, 0
    field = ",".join(c for c, _ in on)
    return _check_rows(_link_counts(child, parent, on), table, [
        ("nulls", field, "link_null", expected_nulls), ("orphans", field, "link_orphan", expected_orphans)])


def cell_errors(df: DataFrame, contract: Contract, key: list[str]) -> DataFrame:
    """One row per bad cell of an all-text table: (key..., field, error)."""
    found = []
    for f in contract.fields:
        text = F.when(F.col(f.name) != "", F.col(f.name))
        number = text.try_cast("double")
        error = F.when(F.lit(f.required) & text.isNull(), "required")
        if f.type == "integer":
            error = error.when(text.isNotNull() & ~text.rlike(r"^[+-]?[0-9]+$"), "integer")
        elif f.type == "number":
            error = error.when(text.isNotNull() & number.isNull(), "number")
            error = error.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), "finite")
        if f.enum is not None:
            error = error.when(text.isNotNull() & ~text.isin(*f.enum), "enum")
        if f.minimum is not None:
            error = error.when(number < f.minimum, "minimum")
        if f.maximum is not None:
            error = error.when(number > f.maximum, "maximum")
        found.append(F.when(error.isNotNull(), F.struct(F.lit(f.name).alias("field"), error.alias("error"))))
    return df.select(*key, F.explode(F.array_compact(F.array(*found))).alias("e")).select(*key, "e.field", "e.error")


def check_vocab(df: DataFrame, column: str, vocabulary: list[str] | DataFrame) -> DataFrame:
    """Values outside a closed vocabulary, with their row counts."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if isinstance(vocabulary, list):
        return values.where(~F.col("value").isin(*vocabulary))
    return values.join(vocabulary.toDF("value").distinct(), "value", "left_anti")


def check_entity_links(tables: dict[str, DataFrame], entities: DataFrame, pid: str) -> DataFrame:
    """Per table: rows whose entity id does not resolve."""
    return reduce(DataFrame.unionByName, [
        check_logical_fk(df, entities, [(pid, pid)], name, 0, 0).where("rule = 'link_orphan'") for name, df in tables.items()])


def _field_text(name: str, kind: str, rule) -> str:
    """Canonical text of a field with its constraints; ``rule`` is its declaration, if any."""
    parts = [name, kind]
    if rule is not None:
        parts += ["required"] * rule.required
        parts += [f"enum={'|'.join(rule.enum)}"] if rule.enum is not None else []
        parts += [f"{word}={float(v)!r}" for word, v in (("min", rule.minimum), ("max", rule.maximum)) if v is not None]
    return ":".join(parts)


def schema_fingerprint(tables: dict[str, DataFrame], contracts: dict[str, Contract] | None = None) -> DataFrame:
    """SHA-256 over the canonical names, types and declared constraints, beside the measured row count."""
    parts = []
    for name, df in sorted(tables.items()):
        contract = (contracts or {}).get(name)
        rules = {f.name: f for f in contract.fields} if contract else {}
        items = [_field_text(f.name, f.dataType.simpleString(), rules.get(f.name)) for f in df.schema]
        if contract:
            items += [f"key={','.join(contract.primary_key)}"] * bool(contract.primary_key) + [f"link={c}>{p}" for c, p in contract.links]
        text = ";".join(items)
        parts.append(df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), F.sha2(F.lit(f"{name}({text})"), 256).alias("schema_hash"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def check_profile(profile: DataFrame, categories: DataFrame, contract: Contract) -> DataFrame:
    """Profile against itself: categories plus missing make the rows, values keep their range.

    ``profile``: (field, row_count, missing, min_value, max_value);
    ``categories``: (field, value, n).
    """
    allowed = {f.name: f.enum for f in contract.fields if f.enum is not None}
    outside = reduce(lambda acc, kv: acc | ((F.col("field") == kv[0]) & ~F.col("value").isin(*kv[1])),
                     allowed.items(), F.lit(False))
    seen = categories.groupBy("field").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(outside, 1)), F.lit(0)).alias("outside"))
    j = profile.join(broadcast_if_small(seen), "field")
    return j.select(
        "field", "row_count", "missing", F.col("total").cast("long").alias("total"),
        F.when(F.col("missing") > F.col("row_count"), "missing exceeds rows")
        .when(F.col("total") + F.col("missing") != F.col("row_count"), "categories do not total")
        .when(F.col("outside") > 0, "category outside enum")
        .when(F.col("min_value") > F.col("max_value"), "inverted range").otherwise("ok").alias("finding"))


def reconcile_counts(tables: dict[str, DataFrame], declared: DataFrame, pid: str) -> DataFrame:
    """Measured rows and distinct entities against declared ones (table_name, rows, entities)."""
    measured = reduce(DataFrame.unionByName, [
        df.groupBy(pid).agg(F.count("*").alias("n")).agg(
            F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("m_rows"), F.count(pid).alias("m_entities"))
        for name, df in tables.items()])
    j = measured.join(declared, "table_name", "left")
    return j.select(
        "table_name", F.col("m_rows").alias("measured_rows"), F.col("m_entities").alias("measured_entities"),
        F.col("m_rows").eqNullSafe(F.col("rows")).alias("rows_match"),
        F.col("m_entities").eqNullSafe(F.col("entities")).alias("entities_match"))


def audit_keys(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Per candidate key: distinct values, null rows and duplicate groups."""
    parts = []
    for name, cols in candidates.items():
        null = reduce(Column.__or__, [F.col(c).isNull() for c in cols])
        g = df.groupBy(*cols).agg(F.count("*").alias("__n"))
        parts.append(g.agg(
            F.lit(name).alias("candidate"), F.sum("__n").alias("rows"), F.count("*").alias("distinct_keys"),
            F.coalesce(F.sum(F.when(null, F.col("__n"))), F.lit(0)).alias("null_rows"),
            F.count_if(F.col("__n") > 1).alias("duplicate_groups"),
            F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("rows_in_duplicates")))
    return reduce(DataFrame.unionByName, parts)


def link_report(child: DataFrame, parent: DataFrame, on: tuple[str, str], by: str | None = None) -> DataFrame:
    """Null, populated-but-unresolved and resolved rows, optionally per record type."""
    groups = [by] if by else []
    keys = child.groupBy(*groups, F.col(on[0]).alias("__k")).agg(F.count("*").alias("__n"))
    known = parent.select(F.col(on[1]).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    j = keys.join(known, "__k", "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0))
    out = j.groupBy(*groups).agg(
        F.sum("__n").alias("rows"), total(F.col("__k").isNull()).alias("null_ids"),
        total(F.col("__k").isNotNull() & F.col("__hit").isNull()).alias("unresolved"))
    return out.withColumn("unresolved_share", ratio(100.0 * F.col("unresolved"), F.col("rows") - F.col("null_ids")))


def ordering_checks(tables: dict[str, DataFrame], rules: list[tuple[str, str, str, str | None]], below: int = 10) -> DataFrame:
    """Age-order rules (label, table, early, late-or-None for zero) with violation sizes.

    A rule holds when ``late >= early`` (or ``early >= 0``).  All rules of a
    table share one pass over it; gaps are whole days, so counts per
    (rule, gap) are a small table from which quantiles are exact.
    """
    by_table: dict[str, list] = {}
    for rule in rules:
        by_table.setdefault(rule[1], []).append(rule)
    parts = []
    for name, own in by_table.items():
        pairs = F.array(*[
            F.struct(F.lit(label).alias("check_name"),
                     (F.col(early) - F.col(late) if late else -F.col(early)).alias("gap"))
            for label, _, early, late in own])
        parts.append(tables[name].select(F.explode(pairs).alias("p")).where("p.gap is not null").groupBy(
            "p.check_name", "p.gap").agg(F.count("*").alias("n")))
    counts = reduce(DataFrame.unionByName, parts)
    bad = F.col("gap") > 0
    agg = counts.groupBy("check_name").agg(
        F.sum("n").alias("checked"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("__v"),
        F.percentile(F.when(bad, F.col("gap")), 0.5, F.col("n")).alias("__med"),
        F.percentile(F.when(bad, F.col("gap")), 0.95, F.col("n")).alias("__p95"))
    shown = suppress(F.col("__v"), below)
    visible = shown.isNotNull() & (shown > 0)
    return agg.select(
        "check_name", "checked", shown.alias("violations"),
        F.when(shown.isNotNull(), ratio(100.0 * F.col("__v"), F.col("checked"))).alias("share"),
        F.when(visible, F.col("__med")).alias("median_gap"), F.when(visible, F.col("__p95")).alias("p95_gap"))


def ordering_by_group(df: DataFrame, early: str, late: str, by: str, near: int = 31) -> DataFrame:
    """Violation rate per record type and the share of violations within ``near`` days."""
    gap = F.col(early) - F.col(late)
    return df.where(gap.isNotNull()).groupBy(by).agg(
        F.count("*").alias("checked"), F.count_if(gap > 0).alias("violations"),
        ratio(100.0 * F.count_if(gap > 0), F.count("*")).alias("violation_share"),
        ratio(100.0 * F.count_if((gap > 0) & (gap <= near)), F.count_if(gap > 0)).alias("near_share"))


def resource_map(tables: dict[str, DataFrame], contracts: dict[str, Contract]) -> DataFrame:
    """Rows, columns, key and links per table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.lit(",".join(contracts[name].primary_key)).alias("key"),
            F.lit(",".join(f"{c}->{p}" for c, p in contracts[name].links)).alias("links"))
        for name, df in tables.items()])
