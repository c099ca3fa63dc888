"""Counts and summaries of changes, tables, values and runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entity_columns, json_text_is_null, json_text_to_string
from ..schemas import LEVELS
from ..session import materialize


def change_counts(
    field_changes: DataFrame,
    entity_events: DataFrame,
    level: str,
    base_tables: DataFrame | None = None,
    skip_new_and_deleted: bool = True,
) -> DataFrame:
    """Days with updates, adds and deletes per entity.

    Above the field level any field change is an update of the entity, unless the entity itself was added or deleted
    that day (with ``skip_new_and_deleted``). ``base_tables(table_id)`` are listed at the table level even without
    changes.
    """
    identity = entity_columns(level)
    on = lambda *kinds: F.col("change_type").isin(*kinds)
    if level == "field":
        events = field_changes.select(
            "date", *identity, on("update").alias("touched"), on("insert").alias("added"), on("delete").alias("deleted")
        )
    else:
        touched = field_changes.select(
            "date", *identity, F.lit(True).alias("touched"), F.lit(False).alias("added"), F.lit(False).alias("deleted")
        )
        item = [F.col("item_id").alias(c) for c in identity if c != "table_id"]
        own = entity_events.where(F.col("level") == level).select(
            "date",
            "table_id",
            *item,
            F.lit(False).alias("touched"),
            on("insert").alias("added"),
            on("delete").alias("deleted"),
        )
        events = touched.unionByName(own)
    per_day = events.groupBy("date", *identity).agg(
        F.max("touched").alias("touched"), F.max("added").alias("added"), F.max("deleted").alias("deleted")
    )
    updated = F.col("touched")
    if skip_new_and_deleted:
        updated = updated & ~F.col("added") & ~F.col("deleted")
    days = per_day.select(*identity, updated.alias("u"), F.col("added").alias("a"), F.col("deleted").alias("d"))
    if base_tables is not None and level == "table":
        none = F.lit(False)
        days = days.unionByName(base_tables.select("table_id", none.alias("u"), none.alias("a"), none.alias("d")))
    return days.groupBy(*identity).agg(
        F.count_if("u").alias("updates"), F.count_if("a").alias("adds"), F.count_if("d").alias("deletes")
    )


# log2 of the buckets of a sketch
SKETCH_SIZE = 14


def distinct_entities(field_changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct changed entities per level and change type; ``entity_sketches`` for an estimate that merges."""
    whole = ["table_id", "column_id", "row_id"]
    # every other level follows from the distinct fields, which are far fewer than their changes
    fields = materialize(field_changes.select(*by, "change_type", *whole).distinct(), "entities")
    shapes = [
        F.struct(
            F.lit(level).alias("level"),
            *[(F.col(c) if c in entity_columns(level) else F.lit(None).cast("string")).alias(c) for c in whole[1:]],
        )
        for level in LEVELS
        if level != "field"
    ]
    opened = fields.select(*by, "change_type", "table_id", F.explode(F.array(*shapes)).alias("e"))
    upper = opened.select(*by, "e.level", "change_type", "table_id", *[f"e.{c}" for c in whole[1:]]).distinct()
    keys = [*by, "level", "change_type"]
    levels = upper.select(*keys).unionByName(fields.select(*by, F.lit("field").alias("level"), "change_type"))
    return levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("entities"))


def entity_sketches(field_changes: DataFrame, lg_k: int = SKETCH_SIZE) -> DataFrame:
    """(date, level, change_type, sketch): a HyperLogLog sketch of the changed entities of each date.

    Sketches are small, whatever the data, and merge: keep them per date, and ask for any range of dates later.
    """
    # what a level does not use is left out; a unit separator keeps parts apart
    named = {
        level: F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in entity_columns(level)]) for level in LEVELS
    }
    per_date = field_changes.groupBy("date", "change_type").agg(
        *[F.hll_sketch_agg(entity, F.lit(lg_k)).alias(level) for level, entity in named.items()]
    )
    sketches = F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).alias("sketch")) for level in LEVELS])
    return per_date.select("date", F.explode(sketches).alias("s"), "change_type").select("date", "s.level", "change_type", "s.sketch")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, level, change_type, entities): the number of distinct entities over all dates of a group, estimated.

    With ``lg_k`` = 14 the standard error is 0.8 percent.
    """
    union = F.hll_union_agg("sketch", False)
    return sketches.groupBy(*by, "level", "change_type").agg(F.hll_sketch_estimate(union).alias("entities"))


def count_tables(snapshots: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: number of distinct tables with a version in the date range."""
    chosen = snapshots.select("snapshot_date", "table_id")
    if start:
        chosen = chosen.where(F.col("snapshot_date") >= F.lit(start).cast("date"))
    if end:
        chosen = chosen.where(F.col("snapshot_date") <= F.lit(end).cast("date"))
    return chosen.select("table_id").distinct().agg(F.count(F.lit(1)).alias("tables"))


def table_sizes(snapshots: DataFrame) -> DataFrame:
    """Most columns and most rows of each table over its versions."""
    return snapshots.groupBy("table_id").agg(
        F.max(F.size("attributes")).alias("columns"), F.max(F.size("rows")).alias("rows")
    )


def average_table_size(sizes: DataFrame) -> DataFrame:
    """One row: number of tables, mean columns, mean rows."""
    return sizes.agg(
        F.count(F.lit(1)).alias("tables"), F.avg("columns").alias("avg_columns"), F.avg("rows").alias("avg_rows")
    )


def null_values(snapshots: DataFrame) -> DataFrame:
    """How often each representation of a missing value is used; the value itself, NULL for a real null."""
    values = snapshots.select(F.explode("rows.fields").alias("fields")).select(F.explode("fields").alias("text"))
    return (
        values.where(json_text_is_null(F.col("text")))
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(json_text_to_string(F.col("text")).alias("value"), "count")
        .groupBy("value")
        .agg(F.sum("count").alias("count"))
    )


def occurrence_frequencies(occurrences: DataFrame) -> DataFrame:
    """(n, changes): how many changes occur n times. The next three start from this table."""
    counts = occurrences.groupBy("change_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("changes"))


def occurrence_summary(frequencies: DataFrame) -> DataFrame:
    """One row: total, mean, median and most occurrences per change."""
    total = F.sum(F.col("n") * F.col("changes"))
    return frequencies.agg(
        total.alias("occurrences"),
        (total / F.sum("changes")).alias("mean"),
        F.percentile("n", F.lit(0.5), F.col("changes")).alias("median"),
        F.max("n").alias("most"),
    )


def rare_shares(frequencies: DataFrame, most: int = 20) -> DataFrame:
    """For n = 1 … ``most``: changes with exactly n and with at most n occurrences, and their shares in percent."""
    spark = frequencies.sparkSession
    whole = frequencies.agg(F.sum("changes")).scalar()
    steps = spark.range(1, most + 1).select(F.col("id").alias("k"))
    rare = frequencies.where(F.col("n") <= most)
    # at most ``most`` rows on either side; each frequency counts towards every step from its own on
    reached = rare.withColumn("k", F.explode(F.sequence("n", F.lit(most).cast("long"))))
    sums = reached.groupBy("k").agg(
        F.sum(F.when(F.col("k") == F.col("n"), F.col("changes")).otherwise(0)).alias("exactly"),
        F.sum("changes").alias("at_most"),
    )
    filled = steps.join(sums, "k", "left").select(
        F.col("k").alias("n"),
        F.coalesce("exactly", F.lit(0)).alias("exactly"),
        F.coalesce("at_most", F.lit(0)).alias("at_most"),
    )
    return filled.select(
        "*",
        (F.lit(100) * F.col("exactly") / whole).alias("exactly_percent"),
        (F.lit(100) * F.col("at_most") / whole).alias("at_most_percent"),
    )


def occurrence_histogram(frequencies: DataFrame, width: int = 10) -> DataFrame:
    """(bin_start, changes) in bins of ``width`` from the least n on; the last bin includes its end."""
    frequencies = materialize(frequencies, "frequencies")
    bounds = frequencies.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    least, most = bounds["least"] or 0, bounds["most"] or 0
    last = max(math.ceil((most - least) / width) - 1, 0)
    place = F.least(F.floor((F.col("n") - F.lit(least)) / width), F.lit(last))
    return frequencies.groupBy((F.lit(least) + place * width).alias("bin_start")).agg(F.sum("changes").alias("changes"))


def mean_runtimes(bench: DataFrame) -> DataFrame:
    """Mean seconds per parameter value of benchmark runs ``(parameter, value, run, seconds)``."""
    return bench.groupBy("parameter", "value").agg(F.avg("seconds").alias("seconds"))
