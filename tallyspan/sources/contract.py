"""Declared table contracts and the rules they imply."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    enum: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Contract:
    """One table: ordered fields, key, links, and how its delimited file is written."""

    name: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    links: tuple[tuple[str, str], ...] = ()
    rows: int | None = None
    delimiter: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"
    quoted_newlines: bool = True
    families: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def contract_schema(contract: Contract) -> T.StructType:
    """Schema with the constraints kept as field metadata."""
    out = []
    for f in contract.fields:
        meta = {"required": f.required}
        if f.enum is not None:
            meta["enum"] = list(f.enum)
        if f.minimum is not None:
            meta["minimum"] = f.minimum
        if f.maximum is not None:
            meta["maximum"] = f.maximum
        out.append(T.StructField(f.name, TYPES[f.type], not f.required, meta))
    return T.StructType(out)


def contract_rules(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """One row per declared rule: (table_name, field, rule, expected)."""
    rows = []
    for c in contracts:
        if c.rows is not None:
            rows.append((c.name, None, "row_count", str(c.rows)))
        if c.primary_key:
            rows.append((c.name, ",".join(c.primary_key), "primary_key", "0"))
        for column, parent in c.links:
            rows.append((c.name, column, "link", parent))
        for f in c.fields:
            rows.append((c.name, f.name, "type", f.type))
            if f.required:
                rows.append((c.name, f.name, "required", "0"))
            if f.enum is not None:
                rows.append((c.name, f.name, "enum", "|".join(f.enum)))
            if f.minimum is not None:
                rows.append((c.name, f.name, "minimum", str(f.minimum)))
            if f.maximum is not None:
                rows.append((c.name, f.name, "maximum", str(f.maximum)))
    return spark.createDataFrame(rows, "table_name string, field string, rule string, expected string")
