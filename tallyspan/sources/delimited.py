"""Typed delimited files: scan, preflight and exact-order export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contract import Contract

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_BAD = "__bad_record"
# Bytes 0x80-0x9F decoded by the Windows code page; undefined ones are replaced.
_C1 = "".join(chr(i) for i in range(0x80, 0xA0))
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def _options(contract: Contract) -> dict[str, str]:
    encoding = "ISO-8859-1" if contract.encoding.lower() in ("iso-8859-1", "cp1252") else contract.encoding
    return {"header": "true", "sep": contract.delimiter, "quote": contract.quote, "escape": contract.quote,
            "encoding": encoding, "multiLine": str(contract.quoted_newlines).lower(),
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _decoded(name: str, contract: Contract) -> Column:
    c = F.col(f"`{name}`")
    c = F.translate(c, _C1, _CP1252) if contract.encoding.lower() == "cp1252" else c
    return F.when(c != "", c)


def _typed(text: Column, kind: str) -> tuple[Column, Column]:
    """Typed value and whether the text fails its type."""
    if kind == "integer":
        value = F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    elif kind == "number":
        number = F.when(text.rlike(DECIMAL), text.try_cast("double"))
        value = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
    else:
        return text, F.lit(False)
    return value, text.isNotNull() & value.isNull()


def read_typed_csv(spark: SparkSession, path: str, contract: Contract, on_error: str = "raise") -> DataFrame:
    """Scan as text, then cast strictly.

    ``raise`` stops on the first bad cell or record and names ``table.field`` only;
    ``quarantine`` nulls bad cells and lists their fields in ``_errors``, where a record
    with too few or too many fields is ``table: record``.  With ``quoted_newlines`` a file is
    one split, so large tables should come in many files; without it a record that goes on
    over a line end is a bad record.
    """
    if on_error not in ("raise", "quarantine"):
        raise ValueError("on_error must be 'raise' or 'quarantine'")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*contract.names, _BAD]])
    raw = spark.read.options(**_options(contract), enforceSchema="false", columnPruning="false", columnNameOfCorruptRecord=_BAD).schema(texts).csv(path)
    broken = F.col(_BAD).isNotNull()
    if on_error == "raise":
        raw = raw.where(F.when(broken, F.raise_error(F.lit(f"{contract.name}: record with the wrong number of fields")).cast("boolean")).otherwise(True))
    decoded = raw.select(*[_decoded(n, contract).alias(n) for n in contract.names], broken.alias(_BAD))
    values, errors = [], []
    for f in contract.fields:
        value, bad = _typed(F.col(f"`{f.name}`"), f.type)
        message = f"{contract.name}.{f.name}"
        if on_error == "raise" and f.type != "string":
            value = F.when(bad, F.raise_error(F.lit(f"{message}: not a valid {f.type}"))).otherwise(value)
        values.append(value.alias(f.name))
        errors.append(F.when(bad, F.lit(message)))
    if on_error == "quarantine":
        errors.append(F.when(F.col(_BAD), F.lit(f"{contract.name}: record")))
        values.append(F.array_compact(F.array(*errors)).alias("_errors"))
    return decoded.select(*values)


def preflight(spark: SparkSession, contracts: list[Contract], root: str) -> DataFrame:
    """Header order of every file and row count of every table, reported together."""
    parts = []
    for c in contracts:
        lines = spark.read.option("encoding", _options(c)["encoding"]).text(f"{root}/{c.name}").select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
        # The first line of a file comes first among the rows of its first split.
        heads = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("head"))
        wanted = c.delimiter.join(c.names)
        header = heads.agg(F.coalesce(F.bool_and(F.replace("head", F.lit(c.quote), F.lit("")) == F.lit(wanted)), F.lit(False)).alias("header_ok"))
        texts = T.StructType([T.StructField(n, T.StringType()) for n in c.names])
        rows = spark.read.options(**_options(c), columnPruning="false").schema(texts).csv(f"{root}/{c.name}").agg(F.count("*").alias("observed_rows"))
        parts.append(rows.crossJoin(header).select(  # one row each
            F.lit(c.name).alias("table_name"), "header_ok", F.lit(c.rows).cast("long").alias("expected_rows"), "observed_rows",
            F.when(F.col("header_ok") & (F.lit(c.rows).isNull() | (F.col("observed_rows") == F.lit(c.rows))), "PASS").otherwise("FAIL").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def write_exact_csv(df: DataFrame, contract: Contract, path: str) -> None:
    """Base-table export in contract order, header first, quotes doubled."""
    text = lambda n: F.col(f"`{n}`").cast("string")
    coded = (lambda n: F.translate(text(n), _CP1252, _C1)) if contract.encoding.lower() == "cp1252" else text
    df.select(*[coded(n).alias(n) for n in contract.names]).write.options(
        **_options(contract), emptyValue="").csv(path)


def write_augmented(df: DataFrame, path: str, order: list[str], fmt: str = "parquet") -> None:
    """Derived layer in its fixed column order."""
    out = df.select(*order)
    out.write.option("header", "true").csv(path) if fmt == "csv" else out.write.parquet(path)
