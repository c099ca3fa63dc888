"""Snapshots of tables and the change logs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entity_columns
from ..schemas import CHANGE_TYPES, SNAPSHOT_JSON

_DATE_IN_PATH = r"(\d{4}-\d{2}-\d{2})"


def _decoded(part: Column) -> Column:
    """A part of a file's URL as the name it stands for; in paths a plus sign is itself."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _folder_value(path: Column, name: str) -> Column:
    """The value of the innermost folder ``name=value``, which Spark has escaped before the path was."""
    part = F.nullif(F.regexp_extract(path, f"/{name}=([^/]*)/[^/]*$", 1), F.lit(""))
    return _decoded(_decoded(part))


def _snapshot_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document below ``root`` with the date and table that its path names; of a broken one ``broken`` has the text.

    Paths are ``<date>/<table>.json?`` as other tools write them, or ``snapshot_date=<date>/table_id=<table>/…`` as
    ``write_snapshots`` does. Spark reads as many small files in one task as fit into ``spark.sql.files.maxPartitionBytes``.
    """
    schema = SNAPSHOT_JSON + ", broken STRING"
    documents = spark.read.schema(schema).json(
        root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json*", columnNameOfCorruptRecord="broken"
    )
    path = F.col("_metadata.file_path")
    dated = F.coalesce(*[
        F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
        for pattern in ("/snapshot_date=" + _DATE_IN_PATH + "/", _DATE_IN_PATH + "/[^/]*$")
    ])
    named = F.coalesce(
        _folder_value(path, "table_id"),
        F.regexp_replace(_decoded(F.substring_index(path, "/", -1)), r"\.json\??$", ""),
    )
    return documents.select(
        dated.cast("date").alias("snapshot_date"), named.alias("table_id"), "attributes", "rows", "broken", path.alias("file")
    )


def read_snapshots(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Read one JSON document per table version; see ``bad_snapshots`` for files that are none.

    Field values become the text of their JSON scalar, so that ``"1"`` and ``1`` differ while ``1`` and ``1.0`` do not.
    """
    snapshots = _snapshot_documents(spark, root).where("broken IS NULL AND attributes IS NOT NULL AND snapshot_date IS NOT NULL").select(
        "snapshot_date",
        "table_id",
        F.transform("attributes", lambda a: a["id"]).alias("attributes"),
        F.transform(
            "rows",
            lambda r: F.struct(r["id"].alias("id"), F.transform(r["fields"], lambda v: F.coalesce(F.to_json(v), F.lit("null"))).alias("fields")),
        ).alias("rows"),
    )
    if start:
        snapshots = snapshots.where(F.col("snapshot_date") >= F.lit(start).cast("date"))
    if end:
        snapshots = snapshots.where(F.col("snapshot_date") <= F.lit(end).cast("date"))
    return snapshots


def bad_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(file, reason) of the files below ``root`` that ``read_snapshots`` leaves out: no document, or no date in the path."""
    documents = _snapshot_documents(spark, root)
    reason = F.when(F.col("broken").isNotNull() | F.col("attributes").isNull(), F.lit("not a document")).when(F.col("snapshot_date").isNull(), F.lit("no date"))
    return documents.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def write_snapshots(snapshots: DataFrame, root: str, mode: str = "overwrite") -> None:
    """One JSON document per table version, in folders by date and table."""
    documents = snapshots.select(
        "snapshot_date",
        "table_id",
        F.transform("attributes", lambda a: F.struct(a.alias("id"))).alias("attributes"),
        F.transform(
            "rows",
            lambda r: F.struct(r["id"].alias("id"), F.transform(r["fields"], lambda v: F.parse_json(v)).alias("fields")),
        ).alias("rows"),
    )
    placed = documents.repartition("snapshot_date", "table_id")
    placed.write.mode(mode).partitionBy("snapshot_date", "table_id").json(root, ignoreNullFields=False)


def write_versions(last: DataFrame, path: str) -> None:
    """Keep the state of a diff, as ``last_versions`` gives it, in a folder of its own for each state."""
    last.write.mode("overwrite").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_versions`` wrote."""
    return spark.read.parquet(path).select("table_id", "snapshot_date", "attributes", "rows")


def write_change_log(field_changes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Field changes as Parquet, one folder per date."""
    field_changes.write.mode(mode).partitionBy("date").parquet(path)


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_change_log`` wrote."""
    return spark.read.parquet(path).select("date", "change_type", "table_id", "column_id", "row_id")


def _csv_files(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Lines of all CSV files below ``path``, with the ``date`` and the ``kind`` that their paths name.

    Paths are ``<date>_<kind>.csv`` as other tools write them, or ``date=<date>/kind=<kind>/…`` as the sinks here do.
    """
    lines = spark.read.schema(schema).csv(path, sep=";", recursiveFileLookup=True, pathGlobFilter="*.csv", **options)
    file, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")

    def part(folder: str, in_name: str) -> Column:
        found = [F.regexp_extract(file, folder, 1), F.regexp_extract(name, in_name, 1)]
        return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])

    date = part("/date=" + _DATE_IN_PATH + "/", "^" + _DATE_IN_PATH + "_")
    return lines.select("*", date.cast("date").alias("date"), part("/kind=([a-z_]+)/", r"^[0-9-]{10}_([a-z_]+)\.csv$").alias("kind"))


def write_change_csv(field_changes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``table;column;row`` lines, one folder per date and change type."""
    renamed = field_changes.withColumnRenamed("change_type", "kind")
    renamed.write.mode(mode).partitionBy("date", "kind").csv(path, sep=";")


def read_change_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read ``table;column;row`` lines of either layout; a missing file has no rows."""
    lines = _csv_files(spark, path, "table_id STRING, column_id STRING, row_id STRING")
    kept = lines.where(F.col("kind").isin(*CHANGE_TYPES))
    return kept.select("date", F.col("kind").alias("change_type"), "table_id", "column_id", "row_id")


def write_entity_events_csv(entity_events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``change_type;table;item`` lines of columns and rows, ``table`` lines of new tables, one folder per date and kind."""
    items = entity_events.where("level <> 'table'")
    kind = F.concat("level", F.lit("_insert_delete")).alias("kind")
    items.select("change_type", "table_id", "item_id", "date", kind).write.mode(mode).partitionBy("date", "kind").csv(
        path, sep=";"
    )
    tables = entity_events.where("level = 'table'").select("table_id", "date", F.lit("table_insert").alias("kind"))
    tables.write.mode("append").partitionBy("date", "kind").csv(path, sep=";")


def read_entity_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the column, row and table events of either layout."""
    pairs = _csv_files(spark, path, "change_type STRING, table_id STRING, item_id STRING")
    pairs = pairs.where(F.col("kind").isin("column_insert_delete", "row_insert_delete"))
    items = pairs.select(
        "date", F.substring_index("kind", "_", 1).alias("level"), "change_type", "table_id", "item_id"
    )
    tables = _csv_files(spark, path, "table_id STRING").where("kind = 'table_insert'")
    new = tables.select(
        "date",
        F.lit("table").alias("level"),
        F.lit("insert").alias("change_type"),
        "table_id",
        F.lit(None).cast("string").alias("item_id"),
    )
    return items.unionByName(new)


def write_entity_changes_csv(entity_changes: DataFrame, path: str, level: str, mode: str = "overwrite") -> None:
    """Rolled-up changes of one level with a header line, one folder per date."""
    columns = [F.col(c).alias(c.removesuffix("_id")) for c in entity_columns(level)]
    kind = F.lit(f"{level}_changes_aggregated").alias("kind")
    chosen = entity_changes.where(F.col("level") == level).select("date", kind, "change_type", *columns)
    # few files per date, however many tasks the changes come from; a busy date is split by size
    chosen = chosen.hint("rebalance", F.col("date"))
    chosen.write.mode(mode).partitionBy("date", "kind").csv(path, sep=";", header=True)


def read_entity_changes_csv(spark: SparkSession, path: str, level: str) -> DataFrame:
    """Read the rolled-up changes of one level, of either layout; every file has a header line."""
    kept = entity_columns(level)
    schema = "change_type STRING, " + ", ".join(f"{c} STRING" for c in kept)
    lines = _csv_files(spark, path, schema, header=True, enforceSchema=True)
    parts = [
        F.col(c) if c in kept else F.lit(None).cast("string").alias(c) for c in ("table_id", "column_id", "row_id")
    ]
    own = lines.where(F.col("kind") == f"{level}_changes_aggregated")
    return own.select("date", F.lit(level).alias("level"), "change_type", *parts)


def read_table_list(spark: SparkSession, path: str) -> DataFrame:
    """Table ids to include or exclude, one per line; blank lines and the header ``table_id`` are skipped."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("table_id"))
        .where(~F.col("table_id").isin("", "table_id"))
        .distinct()
    )


def write_new_tables(new_tables: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``date;num_new_tables`` with a header line."""
    new_tables.select("date", "num_new_tables").write.mode(mode).csv(path, sep=";", header=True)


def read_download_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``<domain>_urls.log`` files as (file_name, line); the name may also be a folder, as the sink writes it."""
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.coalesce(_folder_value(file, "file_name"), F.col("_metadata.file_name")).alias("file_name"), F.col("value").alias("line")
    )
    return lines.where(F.col("file_name").endswith(".log"))


def write_download_log(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Log lines, in one folder per log file."""
    name = F.substring_index("file_name", "/", -1).alias("file_name")
    lines.select(F.col("line").alias("value"), name).write.mode(mode).partitionBy("file_name").text(path)
