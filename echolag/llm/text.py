"""What the corpus operators share: white space, words and null texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of ``text``, in order; none for an empty text."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def collapsed(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space."""
    return F.regexp_replace(text, SPACE + "+", " ")
