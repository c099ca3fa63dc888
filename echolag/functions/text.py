"""String helpers: whitespace, template names, null marks, JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that stand for a missing value (next to the word "null" in any case)
NULL_MARKS = ("-", "/", "", "–", "—", "%")


def strip_whitespace(value: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def sanitize(name: Column) -> Column:
    """Canonical template or property name: no ``_``, blank or line break inside, none of them or ``-`` at the ends."""
    stripped = F.regexp_replace(name, r"^[\n\t \-_]+|[\n\t \-_]+$", "")
    return F.translate(stripped, " \n_\t", "---")


def string_is_null(value: Column) -> Column:
    """True for a missing value or a text that stands for one."""
    bare = strip_whitespace(value)
    return value.isNull() | bare.isin(*NULL_MARKS) | (F.lower(bare) == "null")


def json_text_to_string(text: Column) -> Column:
    """Plain string of a JSON scalar's text; the JSON ``null`` becomes NULL."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "ARRAY<STRING>")[0]


def json_text_is_null(text: Column) -> Column:
    """Null test on JSON scalar text: ``null`` itself, or a quoted null mark. Numbers and booleans are never null."""
    quoted = text.startswith('"')
    return text.isNull() | (text == "null") | (quoted & string_is_null(json_text_to_string(text)))
