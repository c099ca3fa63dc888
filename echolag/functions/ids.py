"""Entity levels and change ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_columns(level: str) -> list[str]:
    """Identity columns that a level keeps."""
    return {
        "table": ["table_id"],
        "column": ["table_id", "column_id"],
        "row": ["table_id", "row_id"],
        "field": ["table_id", "column_id", "row_id"],
    }[level]


def entity_id(sep: str = "_") -> Column:
    """Joined identity; parts that a level does not use are NULL and are left out."""
    return F.concat_ws(sep, "table_id", "column_id", "row_id")


def type_letter(change_type: Column) -> Column:
    return F.substring(change_type, 1, 1)


def change_id() -> Column:
    """Entity id plus the first letter of the change type, such as ``songs_genre_12_u``."""
    return F.concat_ws("_", "table_id", "column_id", "row_id", type_letter(F.col("change_type")))


def template_of_change(change: Column) -> Column:
    """First ``_`` token of a change id."""
    return F.substring_index(change, "_", 1)


def key_of_change(change: Column) -> Column:
    """Second-last ``_`` token of a change id (the infobox key)."""
    return F.try_element_at(F.split(change, "_", -1), F.lit(-2))


def seeded_digest(seed: int, *columns: str) -> Column:
    """Digest to draw by: the same on any engine, for any layout of the rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
