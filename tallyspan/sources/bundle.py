"""Parquet bundles, managed tables, fingerprints and findings."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import canonical
from ..functions.storage import broadcast_if_small, materialize
from ..operators import integrity
from .contract import Contract, contract_schema, contract_rules

# Lines of a block, and nodes of a digest that make one of the next level.
FAN = 4096


def _row_hash(columns: list[str]) -> Column:
    """60 bits of SHA-256 over the canonical text of the row."""
    return _sixty_bits(F.sha2(canonical(*[F.col(f"`{c}`") for c in columns]), 256))


def _sixty_bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, method: str = "xxhash64") -> DataFrame:
    """Order-free content fingerprint: rows, fields and a sum of row hashes.

    Only partial sums leave the tasks.  ``sha256`` hashes a canonical text of
    the row and can be recomputed by any other engine.
    """
    value = F.xxhash64(*df.columns).cast("decimal(38,0)") if method == "xxhash64" else _row_hash(df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(value).cast("string").alias("content_hash")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("fields"), "content_hash")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line): every line of a text source as its bytes, with its number in its file from 0.

    Only a line feed ends a line, so a carriage return is part of it.  A line's number is its place in
    its split plus the lines of the splits before; there is one row per split to add up.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    # Within a split the ids follow the lines.
    splits = materialize(lines.groupBy("file", "start").agg(F.min("at").alias("base"), F.count("*").alias("n")), "line-splits")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("base")).alias("shift"))
    return lines.join(broadcast_if_small(shift), ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("number"), "line")


def file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, lines, digest): digests of ``FAN`` lines each; a changed, moved or swapped line shows in its blocks.

    A line is hashed with its place in the block, so the sum, which is combined before the shuffle, depends on the order.
    """
    placed = numbered_lines(spark, path).select("file", F.floor(F.col("number") / FAN).alias("block"), _sixty_bits(F.sha2(F.concat(
        F.concat((F.col("number") % FAN).cast("string"), F.lit(":")).cast("binary"), "line"), 256)).alias("h"))
    return placed.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum("h").cast("string").alias("digest"))


def _digest_tree(nodes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One (keys, lines, digest) from nodes numbered by ``at``: each level hashes at most ``FAN`` digests in their order."""
    top = nodes.agg(F.max(at)).first()[0] or 0
    while True:
        groups = nodes.groupBy(*keys, F.floor(F.col(at) / FAN).alias(at)).agg(
            F.sum("lines").alias("lines"), F.sort_array(F.collect_list(F.struct(at, "digest"))).alias("below"))  # FAN entries at most
        nodes = groups.select(*keys, at, "lines", F.sha2(F.concat_ws(",", "below.digest"), 256).alias("digest"))
        top //= FAN
        if top == 0:
            return nodes.drop(at)
        nodes = materialize(nodes, "digests")


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines, content hash, bytes and files of a text source, true to its bytes and their order.

    Line digests fold into blocks, blocks into one digest for each file, and those, in the order of the file
    names, into the content hash.  Swapped or moved lines, other line ends and a missing last line end all change the
    row (the last one its bytes); how the files are split over tasks does not.  No file is loaded whole; lengths come
    from the listing, which leaves out files without a byte.
    """
    trees = _digest_tree(materialize(file_blocks(spark, path), "file-blocks"), ["file"], "block")
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")  # file contents are pruned
    # One row per file, as the driver lists them anyway.
    files = listed.join(trees, "file", "left").select("file", "length", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("digest", F.lit("")).alias("digest"))
    files = materialize(files.withColumn("at", F.row_number().over(Window.orderBy("file")) - 1), "file-digests")
    sizes = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
    root = _digest_tree(files.select("at", "lines", "digest"), [], "at").agg(
        F.coalesce(F.max("lines"), F.lit(0)).alias("lines"), F.coalesce(F.max("digest"), F.lit("")).alias("content_hash"))
    return root.crossJoin(sizes)  # one row each


def same_fingerprint(before: DataFrame, after: DataFrame) -> bool:
    """True when a source is unchanged: compares the single fingerprint rows."""
    return before.first() == after.first()


def _manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        fingerprint(df, "sha256").select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()])


def _measures(columns: list[str], contract: Contract | None = None) -> dict[str, Column]:
    """What one pass over a table can tell: rows, content hash, violations of every value rule, incomplete keys."""
    out = {"rows": F.count("*"), "content_hash": F.sum(_row_hash(columns)).cast("string")}
    if contract is not None:
        out |= {f"t{i}": F.count_if(test) for i, (_, _, test) in enumerate(integrity.rule_tests(contract))}
        if contract.primary_key:
            out["incomplete"] = F.count_if(reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in contract.primary_key]))
    return out


class _Watch:
    """Measures taken while another job reads a table; of a job that runs once per row, only successful tasks count."""

    def __init__(self, df: DataFrame, contract: Contract | None = None):
        self.measures, self.seen = _measures(df.columns, contract), Observation()
        self.df = df.observe(self.seen, *[c.alias(n) for n, c in self.measures.items()])

    def numbers(self, stored: DataFrame) -> dict:
        """The measures once the job is done; ``stored`` is what it read or wrote."""
        try:
            return self.seen.get
        except Py4JJavaError:
            if not stored.isEmpty():
                raise
        # The plan of a table known to be empty is replaced before anything can be observed in it.
        return {n: None if n == "content_hash" else 0 for n in self.measures}


def _broken_values(contract: Contract, schema, seen: dict) -> list[str]:
    """``table.field: rule`` of what the observed numbers and the schema of a table violate."""
    want, have = contract_schema(contract), {f.name: (i, f.dataType) for i, f in enumerate(schema)}
    out = [f"{contract.name}.{f.name}: schema" for i, f in enumerate(want) if have.get(f.name) != (i, f.dataType)]
    out += [f"{contract.name}.rows: row_count"] * (contract.rows is not None and contract.rows != seen["rows"])
    out += [f"{contract.name}.{name}: {rule}" for i, (name, rule, _) in enumerate(integrity.rule_tests(contract)) if seen[f"t{i}"]]
    return out + [f"{contract.name}.{','.join(contract.primary_key)}: key_complete"] * bool(contract.primary_key and seen["incomplete"])


def _key_entries(name: str, contracts: dict[str, Contract]) -> list[Column]:
    """(space, side, key) of each row: what it is known by, and what it links to; one empty entry where it has neither."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    entry = lambda space, side, key: F.struct(F.lit(space).alias("space"), F.lit(side).alias("side"), key.alias("key"))
    c, out = contracts.get(name), []
    if c is not None and c.primary_key:
        out.append(entry(name, "parent", text(c.primary_key[0])))
        if len(c.primary_key) > 1:
            out.append(entry(name, "key", F.when(reduce(Column.__and__, [text(k).isNotNull() for k in c.primary_key]), canonical(*map(text, c.primary_key)))))
    for column, parent in c.links if c is not None else ():
        if parent in contracts and contracts[parent].primary_key:
            out.append(entry(parent, f"{name}.{column}", text(column)))
    return out or [entry(name, "", F.lit(None).cast("string"))]


def _broken_keys(keys: DataFrame, contracts: dict[str, Contract]) -> list[str]:
    """Repeated keys and links without a parent, from the folded (space, side, key, n) of all tables."""
    unique = {n: "key" if len(c.primary_key) > 1 else "parent" for n, c in contracts.items() if c.primary_key}
    known = keys.where("key IS NOT NULL")
    repeated = known.where("n > 1").select("space", "side").distinct()
    # A key's sides are as many as the declared links to its table.
    sides = known.groupBy("space", "key").agg(F.collect_set("side").alias("sides")).where(~F.array_contains("sides", "parent"))
    orphans = sides.select("space", F.explode("sides").alias("side")).where("side <> 'key'").distinct()
    found = {(r.space, r.side) for r in repeated.collect()}  # at most one row for each declared key or link
    out = [f"{n}.{','.join(contracts[n].primary_key)}: key_unique" for n, side in unique.items() if (n, side) in found]
    return out + [f"{r.side}: foreign_key" for r in orphans.orderBy("space", "side").collect()]


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"cannot publish {target}")


def write_bundle(tables: dict[str, DataFrame], path: str, contracts: dict[str, Contract] | None = None) -> DataFrame:
    """Write every table as Zstandard Parquet beside its place, validate the files, then publish.

    The job that writes a table also counts its rows, its content hash and its rule violations, so a source is
    evaluated once.  The stored files are read once: that pass gives their own rows and hash, which must be
    those of what was written, and the keys and links, folded to one row per key.  Only if all holds
    are the tables moved to ``path``; the manifest comes last, so a folder without
    one is not a bundle, and a failed write publishes nothing.
    """
    spark, contracts = next(iter(tables.values())).sparkSession, contracts or {}
    staging = f"{path.rstrip('/')}_staging_{uuid.uuid4().hex}"
    wanted, broken = {}, []
    for name, df in tables.items():
        watch = _Watch(df, contracts.get(name))
        watch.df.write.option("compression", "zstd").parquet(f"{staging}/{name}")
        wanted[name] = watch.numbers(spark.read.parquet(f"{staging}/{name}"))
        if name in contracts:
            broken += _broken_values(contracts[name], df.schema, wanted[name])
    stored, folds = {}, []
    for name, df in tables.items():
        reread = spark.read.parquet(f"{staging}/{name}")
        if [(f.name, f.dataType) for f in reread.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"schema changed while writing {name}")
        watch = _Watch(reread)
        stored[name] = (watch, reread)
        folds.append(watch.df.select(F.explode(F.array(*_key_entries(name, contracts))).alias("e")).select("e.*"))
    keys = materialize(reduce(DataFrame.union, folds).groupBy("space", "side", "key").agg(F.count("*").alias("n")), "bundle-keys")
    found = {n: watch.numbers(reread) for n, (watch, reread) in stored.items()}
    changed = [n for n, x in found.items() if any(x[k] != wanted[n][k] for k in ("rows", "content_hash"))]
    if changed:
        raise ValueError(f"content changed while writing: {sorted(changed)}")
    broken += _broken_keys(keys, contracts)
    if broken:
        raise ValueError(f"rules broken: {broken}")
    spark.createDataFrame([(n, seen["rows"], len(tables[n].columns), seen["content_hash"]) for n, seen in wanted.items()],
                          "table_name string, rows long, fields long, content_hash string").coalesce(1).write.parquet(f"{staging}/_manifest_v1")
    for name in [*tables, "_manifest_v1"]:
        _move(spark, f"{staging}/{name}", f"{path}/{name}")
    return spark.read.parquet(f"{path}/_manifest_v1")


def verify_bundle(spark: SparkSession, path: str, contracts: dict[str, Contract]) -> DataFrame:
    """Re-read a bundle and compare schema, counts and content with its manifest."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in contracts}
    measured = _manifest(spark, tables)
    expected = spark.read.parquet(f"{path}/_manifest_v1")
    schemas = spark.createDataFrame(
        [(n, [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in contract_schema(contracts[n])])
         for n, df in tables.items()], "table_name string, schema_ok boolean")
    joined = measured.alias("m").join(expected.alias("e"), "table_name", "left").join(schemas, "table_name")
    return joined.select(
        "table_name", "schema_ok", F.col("m.rows").alias("rows"),
        F.col("m.rows").eqNullSafe(F.col("e.rows")).alias("rows_ok"),
        F.col("m.content_hash").eqNullSafe(F.col("e.content_hash")).alias("content_ok"),
    )


def _identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError("not a plain identifier")
    return f"`{name}`"


def _descriptor(spark: SparkSession, tables: dict[str, DataFrame], contracts: dict[str, Contract]) -> DataFrame:
    """One row per stored field: its place, its type and what its contract says of it."""
    rows = []
    for name, df in tables.items():
        declared = {f.name: f for f in contracts[name].fields} if name in contracts else {}
        key = contracts[name].primary_key if name in contracts else ()
        for i, f in enumerate(df.schema):
            d = declared.get(f.name)
            rows.append((name, i, f.name, f.dataType.simpleString(), bool(d and d.required), f.name in key, "|".join(d.enum) if d and d.enum else None))
    return spark.createDataFrame(rows, "table_name string, position int, field string, type string, required boolean, in_key boolean, allowed string")


def _validations(stored: dict[str, DataFrame], contracts: dict[str, Contract]) -> DataFrame:
    """The check rows of every contract over the stored tables: value rules, keys and links."""
    checks = []
    for name, c in contracts.items():
        if name in stored:
            checks.append(integrity.check_rules(stored[name], c))
            checks += [integrity.check_primary_key(stored[name], list(c.primary_key), name)] * bool(c.primary_key)
            checks += [integrity.check_foreign_key(stored[name], stored[parent], [(column, contracts[parent].primary_key[0])], name)
                       for column, parent in c.links if parent in stored and parent in contracts and contracts[parent].primary_key]
    return reduce(DataFrame.union, checks)


def publish_tables(tables: dict[str, DataFrame], db: str, contracts: dict[str, Contract] | None = None, location: str | None = None) -> DataFrame:
    """Save managed tables with their metadata in tables beside them, in the warehouse or at ``location``.

    ``meta_resources`` (rows, fields and content hash of each table), ``meta_descriptor`` (each field),
    ``meta_build`` (what made them) and, with contracts, ``meta_rules`` and ``meta_validations``.  A table carries its rows and hash as
    properties, and its required fields a comment, so any catalog client sees them.
    """
    spark = next(iter(tables.values())).sparkSession
    place = "" if location is None else " LOCATION '" + location.replace("'", "\\'") + "'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_identifier(db)}{place}")
    where = lambda name: f"{_identifier(db)}.{_identifier(name)}"
    save = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").saveAsTable(where(name))
    seen = {}
    for name, df in tables.items():
        seen[name] = _Watch(df)
        save(seen[name].df, name)
    stored = {name: spark.table(where(name)) for name in tables}
    found = {name: watch.numbers(stored[name]) for name, watch in seen.items()}
    for name, numbers in found.items():
        spark.sql(f"ALTER TABLE {where(name)} SET TBLPROPERTIES ('rows' = '{numbers['rows']}', 'content_hash' = '{numbers['content_hash']}')")
        for f in contracts[name].fields if contracts and name in contracts else ():
            if f.required and f.name in tables[name].columns:
                spark.sql(f"ALTER TABLE {where(name)} ALTER COLUMN `{f.name}` COMMENT 'required'")
    save(spark.createDataFrame([(n, x["rows"], len(tables[n].columns), x["content_hash"]) for n, x in found.items()],
                               "table_name string, rows long, fields long, content_hash string").coalesce(1), "meta_resources")
    save(_descriptor(spark, stored, contracts or {}).coalesce(1), "meta_descriptor")
    save(spark.createDataFrame([("spark", spark.version, len(tables), sum(x["rows"] for x in found.values()))],
                               "engine string, version string, tables int, rows long").coalesce(1), "meta_build")
    if contracts:
        save(contract_rules(spark, list(contracts.values())).coalesce(1), "meta_rules")
        save(_validations(stored, contracts), "meta_validations")
    return spark.table(where("meta_resources"))


def write_findings(df: DataFrame, path: str, order: list[str]) -> bool:
    """Write canonical JSON rows only if they differ from what is stored; True if written."""
    spark = df.sparkSession
    rows = df.select(F.to_json(F.struct(*order)).alias("value"))
    try:
        stored = spark.read.text(path)
        if same_fingerprint(fingerprint(rows), fingerprint(stored)):
            return False
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    rows.write.mode("overwrite").text(path)
    return True
