"""Materialisation and size checks.

Intermediate results are cut by writing a table into the shared folder named
by ``spark.checkpoint.dir``.  A written table survives executor loss, prunes
columns on re-read and gives the optimiser its true size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entities above this row count are treated as hot and split across tasks.
HOT_ROWS_KEY = "tallyspan.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
# A side is broadcast only after its row count was seen to be at most this.
BROADCAST_ROWS = 200_000
# Large tables are dealt over so many tasks that each holds about this many of their rows.
TASK_ROWS_KEY = "tallyspan.taskRows"
TASK_ROWS_DEFAULT = 500_000

_fallback: dict[str, str] = {}
_made: list[str] = []


def workspace(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    Only a local master may fall back to a private folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-tallyspan-", dir="/tmp")
    return _fallback[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the intermediates written inside; nothing read after it may build on them."""
    start = len(_made)
    try:
        yield
    finally:
        cleanup(spark, start)


def cleanup(spark: SparkSession, start: int = 0) -> int:
    """Delete every intermediate this process has written (from the ``start``-th on); call it when no frame built on them is needed any more."""
    done = 0
    while len(_made) > start:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a bounded count proves the side small.

    Beyond the bound no hint is given: the equi-join keys remain and the join
    runs as a shuffled join with adaptive skew handling.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def split_hot(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Split rows into those of ordinary entities and those of hot ones.

    The count is combined map-side, so it moves one row per entity and task.
    At most ``rows / hotRows`` entities can be hot, so that side stays small.
    """
    limit = hot_rows(df.sparkSession)
    sizes = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    hot = materialize(sizes, "hot-keys")
    if hot.isEmpty():
        return df, None
    hot = broadcast_if_small(hot.toDF(*[f"__r_{k}" for k in keys]))
    condition = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return df.join(hot, condition, "left_anti"), df.join(hot, condition, "left_semi")


def task_count(spark: SparkSession, rows: int) -> int | None:
    """How many tasks rows of this number need, or None where the session's shuffle partitions are enough."""
    parts = -(-rows // int(spark.conf.get(TASK_ROWS_KEY, str(TASK_ROWS_DEFAULT))))
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def deal(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Deal rows by key over ``parts`` tasks, so that what a task holds does not grow with the table; None leaves it to the session."""
    return df if parts is None else df.repartition(parts, *keys)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left side's key columns only."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    if not keys:
        return left.crossJoin(renamed)  # callers pass a single totals row here
    condition = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
