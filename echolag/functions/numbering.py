"""Dense numbering without one global sort task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dense_index(
    df: DataFrame, order: Sequence[str], bucket: Column, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """Number the rows of each ``by`` group 0, 1, 2 … by (bucket, order).

    Rows are numbered inside their bucket; only the bucket sizes are summed up in one place. ``bucket`` must not
    decrease along the wanted order, and ``order`` must be unique inside a bucket.
    """
    by = list(by)
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    placed = bucketed.withColumn("_place", F.row_number().over(inside) - 1)
    return placed.join(starts, [*by, "_bucket"]).select(
        *df.columns, (F.col("_start") + F.col("_place")).cast("int").alias(name)
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number all rows 0, 1, 2 … by ``order``, which must be unique, with one distributed sort.

    The sorted rows are written with their partition and place; the partition sizes, one row each, give the offsets.
    """
    places = 1 << 33
    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn(
        "_part", F.floor(F.col("_id") / places)
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").select(
        *df.columns, (F.col("_start") + F.col("_id") % places).alias(name)
    )
