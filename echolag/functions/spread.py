"""Joins that hold when some keys have a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# least number of rows of one heavy key that stay together
HEAVY_CHUNK = 500_000
# a chunk is never less than this share of all rows, so at most as many keys can be heavy, whatever the data
HEAVY_SHARE = 50_000


def join_heavy(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    weights: DataFrame | None = None,
    chunk: int = HEAVY_CHUNK,
    hint: str | None = None,
) -> DataFrame:
    """Join ``left`` with ``right`` (few rows per key), splitting every key that is heavy on the left.

    ``weights`` has the key columns and ``weight``, the number of left rows; it is counted when not given. A key with
    more than ``max(chunk, all rows / HEAVY_SHARE)`` left rows is cut into chunks of that size and its right rows are
    repeated per chunk. Fewer than ``HEAVY_SHARE`` keys can be that heavy, so the list of them is small by construction;
    whether it is broadcast is left to Spark, which sees its size. ``hint`` is a join hint for the right side, such as
    ``merge`` where that grows with the left one: files of few bytes may hold very many rows.
    """
    on = list(on)
    hinted = (lambda df: df.hint(hint)) if hint else (lambda df: df)
    if weights is None:
        weights = left.groupBy(*on).agg(F.count(F.lit(1)).alias("weight"))
    total, most = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    chunk = max(chunk, total // HEAVY_SHARE)
    if most <= chunk:
        return left.join(hinted(right), on, how)
    heavy = weights.where(F.col("weight") > chunk).select(
        *on, F.ceil(F.col("weight") / chunk).cast("int").alias("_splits")
    )
    spread = left.join(heavy, on, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_splits")).cast("int"), F.lit(0)),
    )
    repeated = right.join(heavy, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))
    )
    return spread.drop("_splits").join(hinted(repeated.drop("_splits")), [*on, "_salt"], how).drop("_salt")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a lookup side that has one row per key.

    Spark sends the lookup side to every executor where its size in bytes is within
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles both sides and splits skewed partitions.
    """
    return left.join(right, list(on), how)
