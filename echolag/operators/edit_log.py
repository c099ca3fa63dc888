"""Changes from an edit log of infoboxes.

An edit names a template, a page, the infobox's key and the old and new values of its properties. ``seq`` orders the
edits of a key: a struct of time stamp, file and position (see ``sources.read_edits``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy, lookup, sanitize, strip_whitespace
from ..functions.ids import entity_columns
from ..session import materialize
from .timeline import truncate

_TYPE_LETTERS = {"insert": "i", "delete": "d", "update": "u"}


def infobox_edits(edits: DataFrame, start_year: int | None = 2003, final_year: int | None = 2019) -> DataFrame:
    """Edits of infobox templates in the years asked for, without creations; the template gets its canonical name."""
    template = F.lower("template")
    kept = edits.where(template.contains("infobox") & (F.col("type") != "CREATE"))
    year = F.substring("validFrom", 1, 4)
    if start_year is not None:
        kept = kept.where(year >= F.lit(str(start_year)))
    if final_year is not None:
        kept = kept.where(year <= F.lit(str(final_year)))
    return kept.withColumn("template", sanitize(template))


def value_change(previous: Column, current: Column) -> Column:
    """insert, delete or update; NULL for no change. Empty and missing values are the same."""
    old, new = (F.nullif(strip_whitespace(v), F.lit("")) for v in (previous, current))
    return (
        F.when(old.isNull() & new.isNotNull(), F.lit("insert"))
        .when(old.isNotNull() & new.isNull(), F.lit("delete"))
        .when(old != new, F.lit("update"))
    )


def latest_templates(infoboxes: DataFrame) -> DataFrame:
    """Last template of each infobox on each page, and its number of edits (``weight``)."""
    return infoboxes.groupBy("pageID", "key").agg(
        F.max_by("template", "seq").alias("latest"), F.count(F.lit(1)).alias("weight")
    )


def property_changes(
    infoboxes: DataFrame, granularity: str = "d", whitelist: DataFrame | None = None
) -> DataFrame:
    """Changed properties as (template, property, key, change_type, tp).

    Every change carries the last template its infobox had on the page, so a renamed template keeps one identity.
    """
    edits = infoboxes.select("pageID", "key", "validFrom", "changes")
    # read three times below, and far smaller than the edits
    latest = materialize(latest_templates(infoboxes), "latest")
    named = join_heavy(
        edits, latest.select("pageID", "key", F.col("latest").alias("template")), ["pageID", "key"], weights=latest
    )
    if whitelist is not None:
        named = lookup(named, whitelist.select("template").distinct(), ["template"], "left_semi")
    return (
        named.select("template", "key", truncate(F.col("validFrom"), granularity).alias("tp"), F.explode("changes").alias("c"))
        .select(
            "template",
            sanitize(F.col("c.property.name")).alias("property"),
            "key",
            value_change(F.col("c.previousValue"), F.col("c.currentValue")).alias("change_type"),
            "tp",
        )
        .where("change_type IS NOT NULL")
    )


def edit_occurrences(changes: DataFrame, level: str = "field") -> DataFrame:
    """Distinct (change_id, tp) at an entity level: template, property and key are table, column and row."""
    letter = F.create_map(*[F.lit(x) for pair in _TYPE_LETTERS.items() for x in pair])[F.col("change_type")]
    parts = {"table_id": "template", "column_id": "property", "row_id": "key"}
    identity = F.concat_ws("_", *[parts[c] for c in entity_columns(level)], letter)
    return changes.select(identity.alias("change_id"), "tp").distinct()


def page_titles(infoboxes: DataFrame) -> DataFrame:
    """Distinct titles each page has had."""
    return infoboxes.select(F.col("pageID").alias("page_id"), F.col("pageTitle").alias("title")).distinct()


def page_title_lists(infoboxes: DataFrame) -> DataFrame:
    """Titles per page as one sorted list."""
    return page_titles(infoboxes).groupBy("page_id").agg(F.sort_array(F.collect_list("title")).alias("titles"))


def template_aliases(infoboxes: DataFrame) -> DataFrame:
    """Edits per key and template name, with the key's last template."""
    counts = infoboxes.groupBy("key", "template").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
    latest = counts.groupBy("key").agg(F.max_by("template", "seq").alias("latest"))
    return counts.drop("seq").join(latest, "key").select("key", "latest", "template", "n")


def key_pages(infoboxes: DataFrame) -> DataFrame:
    """Last page of each key."""
    return infoboxes.groupBy("key").agg(F.max_by("pageID", "seq").alias("page_id"))


def key_pages_full(edits: DataFrame) -> DataFrame:
    """Last page of each key over all edits whose template starts with ``infobox`` (in this case only)."""
    return key_pages(edits.where(F.col("template").startswith("infobox")))


def infoboxes_per_template(edits: DataFrame) -> DataFrame:
    """Infoboxes per last template, over all years."""
    latest = latest_templates(infobox_edits(edits, None, None))
    return latest.groupBy(F.col("latest").alias("template")).agg(F.count(F.lit(1)).alias("n"))


def keys_per_template(aliases: DataFrame) -> DataFrame:
    """Keys per last template, most frequent first."""
    chosen = aliases.select("key", F.col("latest").alias("template")).distinct()
    return chosen.groupBy("template").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "template")


def frequent_templates(counts: DataFrame, above: int = 100) -> DataFrame:
    """Templates with more than ``above`` infoboxes, most frequent first."""
    return counts.where(F.col("n") > above).orderBy(F.desc("n"), "template")
