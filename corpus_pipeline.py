"""Training-data pipeline: five stages over ``documents``, each written as Parquet and reread.

Each stage works on all that the one before it kept.  The filters return the columns
of ``documents``; the last stage returns packed pieces.  Further columns are carried along
whatever they are called; an empty table gives empty tables.  What a stage writes on its way goes when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions.storage import fresh_path, scratch
from tallyspan.llm import decontaminate, lines, packing, simhash, toxicity
from tallyspan.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under its threshold; a null text is scored as an empty one, copies fare alike."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that resemble an earlier line; ``n_chars`` follows the text.

    A null text stays null with its ``n_chars``; a document whose lines all stood earlier stays with an empty text.
    """
    out = lines.dedup_lines(docs)
    kinds = dict(docs.dtypes)
    if "n_chars" not in kinds:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kinds["n_chars"]))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8.

    The smallest id stays, rows without an id come last; null and empty texts are copies of each other.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows; a null text has no words and stays."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096; a null or empty text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents),
          ("decontamination", drop_contaminated), ("packing", pack)]
ORACLE_SQL = None  # trained scores, fingerprints and tokens are beyond SQL; tests hold the run against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
