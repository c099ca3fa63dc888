"""Edit logs of infoboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EDITS_JSON


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one edit each. Adds ``seq``, the order of edits: time stamp, then file, then place in the file."""
    edits = spark.read.schema(EDITS_JSON).json(path)
    place = F.struct(
        F.col("validFrom"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return edits.select("*", place.alias("seq")).where(F.col("template").isNotNull())
