"""Small helpers that the corpus operators share.

Rows are handed to Python as Arrow batches.  Texts travel as UTF-8 bytes,
because every word rule of this package is a rule on bytes: the separators
and the letters that are lower-cased are ASCII.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyspan.functions.storage import fresh_path, materialize  # noqa: F401  (shared-folder tables)

# Words of letters, digits and everything beyond ASCII; the text is lower-cased first.
ALNUM = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def alnum_words(text: bytes | None) -> list[bytes]:
    return ALNUM.findall(text.lower()) if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D)."""
    return text.split() if text else []


def as_bytes(column: str = "text") -> Column:
    return F.col(column).cast("string").cast("binary")


def text_key(column: str = "text") -> Column:
    """16 bytes that stand for a text: equal texts share the key, null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def held_out(doc_id: int | None, mod: int, rest: int = 1) -> bool:
    """True where crc32 of the id's decimal text leaves ``rest``; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


def held_out_column(mod: int, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def reachable(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver did (no effect where it is installed)."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, *paths]))


def arrow_schema(ddl: str) -> pa.Schema:
    """Made on the driver; the tasks get it inside their function."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_batches(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``fn(list of columns as Python lists) -> dict of lists`` over Arrow batches.

    The rows of a batch are worked off in slices, so one slice of very long
    texts bounds the memory of the Python side.
    """
    reachable(df.sparkSession)
    width, schema = len(df.columns), arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = fn(*[part.column(i).to_pylist() for i in range(width)])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that the frame does not have."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"__c{k}") not in taken:
            out.append(name)
        k += 1
    return out
