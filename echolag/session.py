"""Session helpers: shared scratch folder, intermediate tables, planner settings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_DIR_CONF = "spark.checkpoint.dir"
# most tasks that list the folders of one level; a task of its own for each of many thousand takes longer than listing them
LISTING_TASKS = 500
_scope: ContextVar[str | None] = ContextVar("echolag_scratch", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, named by ``spark.checkpoint.dir``; there is no other choice."""
    context = spark.sparkContext
    named = spark.conf.get(_DIR_CONF, None) or context.getConf().get(_DIR_CONF) or context.getCheckpointDir()
    if not named:
        raise ValueError(f"set {_DIR_CONF} to a folder every executor can reach")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses, in the folder of the open ``scratch`` block or else of the application."""
    folder = _scope.get() or f"{scratch_dir(spark)}/echolag/{spark.sparkContext.applicationId}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables from whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of one call, removed at the end of the block.

    Consume the result inside the block: ``with scratch(spark): mine_rules(...).write.parquet(out)``. Outside any block
    the tables stay in the folder of the application until ``clear_scratch``.
    """
    folder = f"{scratch_dir(spark)}/echolag/call-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        remove_path(spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the application has written outside ``scratch`` blocks."""
    remove_path(spark, f"{scratch_dir(spark)}/echolag/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the planner true sizes for what follows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings the operators are planned for, in the given session and for good.

    All of them are ordinary session settings; a caller who wants to keep its own passes ``spark.newSession()``.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a join on (cell, time point) may use a partitioning by cell alone, so that pair counts need no second shuffle
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING_TASKS),
    }.items():
        spark.conf.set(key, value)
    return spark
