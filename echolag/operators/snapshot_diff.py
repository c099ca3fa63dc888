"""Changes between successive versions of tables.

A version is one snapshot of one table; a table has a version only on dates when it changed. Rows are compared whole
first, and only rows that differ are opened up into fields. Each row travels once, to the other versions of its row id,
and is compared with the one before if that is of the table's version before. Copies of a row id are collapsed before that.
Tables of versions and of rows grow alike, so joins of both are merge joins, however small their files are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import HEAVY_CHUNK, HEAVY_SHARE, join_heavy, json_text_is_null, lookup
from ..session import materialize


# columns of a version times those of the one before, up to which they are matched in place
SHORT_LISTS = 4_096


@dataclass(frozen=True)
class SnapshotChanges:
    """Result of a diff; each part is planned when it is asked for. Field changes and entity events are sets."""

    snapshots: DataFrame
    timeline: DataFrame
    distinguish_null: bool

    @cached_property
    def field_changes(self) -> DataFrame:
        return _field_changes(self.snapshots, self.timeline, self.distinguish_null)

    @cached_property
    def entity_events(self) -> DataFrame:
        # only the ids of rows matter, and whether there are fields at all
        none = F.array().cast("array<string>")
        bare = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), F.when(r["fields"].isNotNull(), none).alias("fields")))
        ids = self.snapshots.withColumn("rows", bare)
        return _entity_events(_row_pairs(ids, self.timeline, _is_large(self.timeline)), self.timeline)

    @cached_property
    def new_tables(self) -> DataFrame:
        return new_tables_per_date(self.timeline)


def versions(
    snapshots: DataFrame, start: str | None = None, end: str | None = None, base_date: str | None = None
) -> DataFrame:
    """Each table's versions with the one before and after, and whether the version's changes are reported.

    The version before is the latest strictly earlier date, back to ``base_date``. Changes are reported from ``start``
    on, but never for ``base_date`` itself.
    """
    carried = [c for c in ("carried",) if c in snapshots.columns]
    weights = []
    if "rows" in snapshots.columns:
        ids = F.transform("rows", lambda r: r["id"])
        repeats = F.size(F.array_distinct(ids)) < F.size(ids)
        weights = [F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), F.coalesce(repeats, F.lit(False)).alias("repeats")]
    light = snapshots.select("table_id", "snapshot_date", "attributes", *carried, *weights)
    if base_date:
        light = light.where(F.col("snapshot_date") >= F.lit(base_date).cast("date"))
    if end:
        light = light.where(F.col("snapshot_date") <= F.lit(end).cast("date"))
    reported = ~F.col("carried") if "carried" in light.columns else F.lit(True)
    if start:
        reported = reported & (F.col("snapshot_date") >= F.lit(start).cast("date"))
    if base_date:
        reported = reported & (F.col("snapshot_date") > F.lit(base_date).cast("date"))
    order = Window.partitionBy("table_id").orderBy("snapshot_date")
    return light.select(
        "*",
        F.lag("snapshot_date").over(order).alias("prev_date"),
        F.lead("snapshot_date").over(order).alias("next_date"),
        F.lag("attributes").over(order).alias("prev_attributes"),
        reported.alias("reported"),
    ).drop(*carried)


def last_versions(snapshots: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The last version of each table, of ``previous`` where no newer one came; the state that a later diff goes on from."""
    whole = snapshots.select("table_id", "snapshot_date", "attributes", "rows")
    if previous is not None:
        whole = whole.unionByName(previous.select(whole.columns))
    last = whole.groupBy("table_id").agg(F.max("snapshot_date").alias("snapshot_date"))
    return whole.join(last, ["table_id", "snapshot_date"], "left_semi").dropDuplicates(["table_id"])


def _newer(snapshots: DataFrame, previous: DataFrame) -> DataFrame:
    """``previous`` as versions that are compared with but not reported, and the versions that are newer than these."""
    columns = ["table_id", "snapshot_date", "attributes", "rows"]
    known = previous.select("table_id", F.col("snapshot_date").alias("_last"))
    newer = lookup(snapshots.select(columns), known, ["table_id"], "left")
    newer = newer.where("_last IS NULL OR snapshot_date > _last").select(*columns, F.lit(False).alias("carried"))
    return newer.unionByName(previous.select(*columns, F.lit(True).alias("carried")))


def select_tables(
    snapshots: DataFrame,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    num_tables: int = -1,
) -> DataFrame:
    """(snapshot_date, table_id) to report: the first ``num_tables`` per date, then inclusion, then exclusion."""
    chosen = snapshots.select("snapshot_date", "table_id")
    if num_tables >= 0:
        rank = F.row_number().over(Window.partitionBy("snapshot_date").orderBy("table_id"))
        chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= num_tables).drop("_rank")
    if include is not None:
        chosen = lookup(chosen, include.select("table_id").distinct(), ["table_id"], "left_semi")
    if exclude is not None:
        chosen = lookup(chosen, exclude.select("table_id").distinct(), ["table_id"], "left_anti")
    return chosen


def _typed(new: Column, old: Column, distinguish_null: bool) -> Column:
    """Change type of two values that differ; NULL where the difference does not count."""
    if not distinguish_null:
        return F.lit("update")
    new_null, old_null = json_text_is_null(new), json_text_is_null(old)
    return (
        F.when(new_null & old_null, F.lit(None))
        .when(new_null, F.lit("delete"))
        .when(old_null, F.lit("insert"))
        .otherwise(F.lit("update"))
    )


def _is_large(timeline: DataFrame) -> bool:
    """Whether a table has more rows than may meet in one task."""
    of_table = timeline.groupBy("table_id").agg(F.sum("n_rows").alias("n"))
    total, most = of_table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return most > max(HEAVY_CHUNK, total // HEAVY_SHARE)


def _row_pairs(snapshots: DataFrame, timeline: DataFrame, large: bool, places: dict[str, Column] | None = None) -> DataFrame:
    """One row per (table, reported version, row id) with the old side's first copy and the new side's distinct copies.

    ``places`` are columns of the version's alignment that its rows carry, so that none need to be looked up later. The row
    of a version that is gone in the next one carries its own version's.
    """
    key = ["table_id", "snapshot_date"]
    after = Window.partitionBy("table_id").orderBy("snapshot_date")
    lost = F.size(F.array_except("prev_attributes", "attributes")) > 0
    places = places or {}
    marks = timeline.select(
        *key,
        "reported",
        F.coalesce(lost, F.lit(False)).alias("lost"),
        "prev_date",
        F.when(F.lead("reported").over(after), F.col("next_date")).alias("next_date"),
        F.lead(F.coalesce(lost, F.lit(False))).over(after).alias("next_lost"),
        "repeats",
        *[column.alias(name) for name, column in places.items()],
    ).where("reported OR next_date IS NOT NULL")
    # all versions of a table may meet in one task unless they are very many rows; then its versions and rows are dealt out
    documents = snapshots.select(*key, "rows")
    if large:
        documents, marks = documents.repartition(*key), marks.repartition(*key)
    rows = documents.join(marks.hint("merge"), key)
    marked = ["reported", "lost", "prev_date", "next_date", "next_lost", *places]
    opened = rows.select(*key, *marked, "repeats", F.posexplode("rows").alias("pos", "row")).select(
        *key, *marked, "repeats", "pos", F.col("row.id").alias("row_id"), F.col("row.fields").alias("fields")
    )
    none = F.lit(None).cast("array<array<string>>")
    shape = [*key, *marked, "row_id", "fields", F.size("fields").alias("width"), none.alias("copies")]
    if timeline.where("repeats").isEmpty():
        single = opened.select(*shape)
    else:
        # copies are neighbours in the order that versions are compared in
        copy = Window.partitionBy("table_id", "row_id", "snapshot_date").orderBy("pos")
        whole = copy.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        copied = opened.withColumns({
            "width": F.max(F.size("fields")).over(whole),
            "copies": F.collect_set("fields").over(whole),
            "_copy": F.row_number().over(copy),
        })
        single = copied.where("_copy = 1").select(*key, *marked, "row_id", "fields", "width", "copies")

    if large:
        single = single.repartition("table_id", "row_id")
    versions_ = Window.partitionBy("table_id", "row_id").orderBy("snapshot_date")
    before = F.lag(F.struct("snapshot_date", "fields", "width")).over(versions_)
    beside = single.withColumns({"before": before, "following": F.lead("snapshot_date").over(versions_)})
    had = F.col("before.snapshot_date") == F.col("prev_date")
    as_new = F.when(
        F.col("reported"),
        F.struct(
            F.col("snapshot_date").alias("date"),
            F.when(had, F.col("before.fields")).alias("old"),
            F.coalesce("copies", F.array_compact(F.array("fields"))).alias("new"),
            F.when(had, F.col("before.width")).alias("old_width"),
            F.col("width").alias("new_width"),
            "lost",
            F.col("prev_date").isNull().alias("new_table"),
        ),
    )
    gone = F.col("next_date").isNotNull() & ~F.col("following").eqNullSafe(F.col("next_date"))
    as_old = F.when(
        gone,
        F.struct(
            F.col("next_date").alias("date"),
            F.col("fields").alias("old"),
            F.array().cast("array<array<string>>").alias("new"),
            F.col("width").alias("old_width"),
            F.lit(None).cast("int").alias("new_width"),
            F.col("next_lost").alias("lost"),
            F.lit(False).alias("new_table"),
        ),
    )
    sides = beside.select("table_id", "row_id", F.explode(F.array_compact(F.array(as_new, as_old))).alias("side"), *places)
    return sides.select("table_id", "row_id", "side.*", *places)


def _places(prev: Column) -> tuple[Column, Column, Column, Column]:
    """Whether all of ``attributes`` have kept their place in ``prev``, whether both are short, ``moves`` and ``gone``."""
    kept = (F.col("attributes") == prev) & (F.size(F.array_distinct("attributes")) == F.size("attributes"))
    short = F.size("attributes").cast("long") * F.size(prev) <= SHORT_LISTS
    moves = F.transform("attributes", lambda a: F.coalesce(F.array_position(prev, a).cast("int") - 1, F.lit(-1)))
    named = F.transform(prev, lambda name, place: F.struct(place.alias("place"), name.alias("name")))
    gone = F.filter(named, lambda g: ~F.coalesce(F.array_contains("attributes", g["name"]), F.lit(False)))
    return kept, short, moves, gone


def _carried(timeline: DataFrame) -> dict[str, Column] | None:
    """The columns of ``_alignment`` but ``prev``, where all lists are short and so can be matched in place; else None."""
    prev = F.coalesce("prev_attributes", F.array().cast("array<string>"))
    kept, short, moves, gone = _places(prev)
    differs = ~kept & F.col("prev_attributes").isNotNull()
    if not timeline.where(F.col("reported") & differs & ~short).isEmpty():
        return None
    none = F.array().cast("array<struct<place:int,name:string>>")
    return {"attributes": F.col("attributes"), "moves": F.when(differs, moves), "gone": F.when(differs, gone).otherwise(none)}


def _alignment(timeline: DataFrame) -> DataFrame:
    """(table_id, date, attributes, prev, moves, gone) of the reported versions.

    ``moves`` gives for each place of a column its first place in the version before, or -1; it is null where every column
    has kept its place. ``gone`` lists the places and names of columns that are no longer there. Short lists are matched in
    place; the columns of longer ones by one join over all versions whose lists differ, so the work grows with the columns
    and not with their square.
    """
    key = ["table_id", "date"]
    lists = timeline.where("reported").select(
        "table_id",
        F.col("snapshot_date").alias("date"),
        "attributes",
        F.coalesce("prev_attributes", F.array().cast("array<string>")).alias("prev"),
        F.col("prev_attributes").isNotNull().alias("_had"),
    )
    kept, short, places, lost_here = _places(F.col("prev"))
    none = F.array().cast("array<struct<place:int,name:string>>")
    # tables without an earlier version have nothing to be aligned with
    here, elsewhere = ~kept & F.col("_had") & short, ~kept & F.col("_had") & ~short
    differing = lists.where(elsewhere)
    lists = lists.select(
        *key,
        "attributes",
        "prev",
        F.when(here, places).alias("moves"),
        F.when(here, lost_here).otherwise(none).alias("gone"),
    )
    if differing.isEmpty():
        return lists
    new = differing.select(*key, F.posexplode("attributes").alias("place", "name"))
    old = differing.select(*key, F.posexplode("prev").alias("place", "name"))
    first = old.groupBy(*key, "name").agg(F.min("place").alias("old_place"))
    placed = new.join(first, [*key, "name"], "left").select(
        *key, F.struct("place", F.coalesce("old_place", F.lit(-1)).alias("old_place")).alias("move")
    )
    # a version has as many entries as columns
    moves = placed.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list("move")), lambda m: m["old_place"]).alias("_moves"))
    lost = old.join(new.select(*key, "name").distinct(), [*key, "name"], "left_anti")
    gone = lost.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("_gone"))
    both = lookup(lookup(lists, moves, key, "left"), gone, key, "left").select(
        *key, "attributes", "prev", F.coalesce("moves", "_moves").alias("moves"), F.coalesce("_gone", "gone").alias("gone")
    )
    return materialize(both, "alignment")


def _aligned_pairs(snapshots: DataFrame, timeline: DataFrame) -> DataFrame:
    """The rows that differ, with the alignment of their versions."""
    large = _is_large(timeline)
    # rows of a large table are dealt out, and long lists would be many times as much as the rows they go with
    places = None if large else _carried(timeline)
    pairs = _row_pairs(snapshots, timeline, large, places).withColumn(
        "differing", F.when(F.col("old_width").isNotNull(), F.filter("new", lambda fields: fields != F.col("old")))
    )
    touched = F.col("old_width").isNull() | F.col("new_width").isNull() | F.col("lost") | (F.size("differing") > 0)
    pairs = pairs.where(touched).drop("new")
    if places is not None:
        # of a row that is gone, the columns before are those of its own version
        return pairs.withColumn("prev", F.col("attributes"))
    order = Window.partitionBy("table_id").orderBy("snapshot_date")
    # rows of both versions, which is no less than the pairs
    weight = F.col("n_rows") + F.coalesce(F.lag("n_rows").over(order), F.lit(0))
    weights = timeline.select("table_id", F.col("snapshot_date").alias("date"), weight.cast("long").alias("weight"))
    return join_heavy(pairs, _alignment(timeline), ["table_id", "date"], weights=weights, hint="merge")


def _field_changes(snapshots: DataFrame, timeline: DataFrame, distinguish_null: bool) -> DataFrame:
    opened = _aligned_pairs(snapshots, timeline)

    def change(kind: Column, column: Column) -> Column:
        return F.struct(kind.alias("change_type"), column.alias("column_id"))

    width = F.when(F.col("new_table"), F.size("attributes")).otherwise(F.col("new_width"))
    inserted = F.transform(F.slice("attributes", F.lit(1), width), lambda a: change(F.lit("insert"), a))
    deleted = F.transform(F.slice("prev", F.lit(1), F.col("old_width")), lambda a: change(F.lit("delete"), a))
    # a short row ends before the last columns
    lost = F.filter("gone", lambda g: g["place"] < F.col("old_width"))
    gone = F.transform(lost, lambda g: change(F.lit("delete"), g["name"]))

    def compare(fields: Column) -> Column:
        def one(value: Column, place: Column) -> Column:
            old_place = F.when(F.col("moves").isNull(), place).otherwise(F.get("moves", place))
            before = F.get("old", F.greatest(old_place, F.lit(0)))
            kind = F.when(old_place < 0, F.lit("insert")).when(value != before, _typed(value, before, distinguish_null))
            return change(kind, F.get("attributes", place))

        return F.filter(F.transform(fields, one), lambda c: c["change_type"].isNotNull())

    compared = F.flatten(F.transform(F.coalesce("differing", F.array().cast("array<array<string>>")), compare))
    changes = (
        F.when(F.col("old_width").isNull(), inserted)
        .when(F.col("new_width").isNull(), deleted)
        .otherwise(F.array_distinct(F.concat(compared, gone)))
    )
    return opened.select("date", "table_id", "row_id", F.explode(changes).alias("change")).select(
        "date",
        F.col("change.change_type").alias("change_type"),
        "table_id",
        F.col("change.column_id").alias("column_id"),
        "row_id",
    )


def _entity_events(pairs: DataFrame, timeline: DataFrame) -> DataFrame:
    shape = ["date", "level", "change_type", "table_id", "item_id"]
    reported = timeline.where("reported").withColumn("date", F.col("snapshot_date"))
    empty = F.array().cast("array<string>")
    before = F.coalesce("prev_attributes", empty)
    columns = [
        reported.select(
            "date",
            F.lit("column").alias("level"),
            F.lit(kind).alias("change_type"),
            "table_id",
            F.explode(F.array_except(some, others)).alias("item_id"),
        )
        for kind, some, others in (("insert", F.col("attributes"), before), ("delete", before, F.col("attributes")))
    ]
    kind = F.when(F.col("old_width").isNull(), "insert").when(F.col("new_width").isNull(), "delete")
    rows = pairs.select(
        "date", F.lit("row").alias("level"), kind.alias("change_type"), "table_id", F.col("row_id").alias("item_id")
    ).where("change_type IS NOT NULL")
    tables = reported.where("prev_date IS NULL").select(
        "date",
        F.lit("table").alias("level"),
        F.lit("insert").alias("change_type"),
        "table_id",
        F.lit(None).cast("string").alias("item_id"),
    )
    return columns[0].unionByName(columns[1]).unionByName(rows).unionByName(tables).select(*shape)


def new_tables_per_date(timeline: DataFrame) -> DataFrame:
    """Number of reported tables without an earlier version, for every date in range; dates without one give 0."""
    in_range = F.col("in_range") if "in_range" in timeline.columns else F.col("reported")
    return (
        timeline.where(in_range)
        .groupBy(F.col("snapshot_date").alias("date"))
        .agg(F.count(F.when(F.col("reported") & F.col("prev_date").isNull(), 1)).alias("num_new_tables"))
    )


def find_changes(
    snapshots: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    base_date: str | None = None,
    distinguish_null: bool = False,
    selected: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> SnapshotChanges:
    """Field changes and column, row and table events between each version and the one before.

    With ``previous``, the state that ``last_versions`` gave after earlier dates, only newer versions are diffed and
    reported; versions that the state has or is newer than are left out, so a batch that comes again adds nothing.

    ``selected`` (see ``select_tables``) limits which versions are reported, not which serve as the version before. A
    row that survives with equal fields gets no insert for a new column and no update for a reordered one; a column
    that disappears is still deleted from it.
    """
    if previous is not None:
        snapshots = materialize(_newer(snapshots, previous), "batch")
    timeline = versions(snapshots, start, end, base_date)
    if selected is not None:
        marked = selected.select("snapshot_date", "table_id", F.lit(True).alias("_chosen"))
        timeline = (
            timeline.join(marked, ["snapshot_date", "table_id"], "left")
            .withColumn("in_range", F.col("reported"))
            .withColumn("reported", F.col("reported") & F.coalesce("_chosen", F.lit(False)))
            .drop("_chosen")
        )
    return SnapshotChanges(snapshots, materialize(timeline, "versions"), distinguish_null)
