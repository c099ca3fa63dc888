"""Rows that can be told apart, also repeated ones, and the one of a group that stays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy
from ..session import materialize

_SEEDS = 4


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _by_place(docs: DataFrame, name: str) -> DataFrame | None:
    """``docs`` numbered by file and place in it; None where that does not tell its rows apart."""
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        found = docs.select(file.alias("file"), place.alias("place"))
        files = materialize(found.groupBy("file").agg(F.max("place").alias("most")), "files")
    except AnalysisException:
        return None
    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("most"), F.lit(0)).alias("most")).first()
    shift = max(1, int(size["most"]).bit_length())
    for seed in range(_SEEDS):
        # a file has as many bits as its places leave
        part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), file), shift + 1)
        number = F.shiftleft(part, shift).bitwiseOR(place)
        hashes = files.select(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "file"), shift + 1).alias("part"))
        if hashes.distinct().count() < size["n"]:
            continue
        numbered = docs.withColumn(name, number)
        # a join or an explode before may have repeated rows of a file
        again = numbered.select(name).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return numbered if again.isEmpty() else None
    return None


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that tells its rows apart and stays the same when they are read again, and its name.

    Rows of stored Parquet files are known by file and place where that tells them apart; others are numbered and written.
    """
    name = unused(docs, "row_number")
    found = _by_place(docs, name)
    if found is None:
        found = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    return found, name


def one_of_each(docs: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those of ``groups(row, group)`` that are not the first of their group.

    First is the row with the least ``doc_id``, nulls last, and of these the one with the least number.
    """
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    light = materialize(groups.join(ids, "row").select("row", "group", order.alias("order")), "grouped")
    firsts = light.groupBy("group").agg(F.min("order")["row"].alias("first"), F.count(F.lit(1)).alias("weight"))
    firsts = materialize(firsts.where("weight > 1"), "firsts")
    met = join_heavy(light, firsts.select("group", "first"), ["group"], weights=firsts.select("group", "weight"))
    gone = materialize(met.where("row <> first").select(F.col("row").alias(row)), "gone")
    return docs.join(gone, row, "left_anti").drop(row)
