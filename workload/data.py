"""Occurrences, snapshots, edits and lookups derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolag.operators import timeline
from echolag.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def years_of(df: DataFrame, column: str) -> tuple[int, int]:
    """First and last year of a date or time column."""
    return tuple(df.agg(F.min(F.year(column)), F.max(F.year(column))).first())


def order_years(spark: SparkSession, sf: str) -> tuple[int, int]:
    return years_of(table(spark, sf, "orders"), "o_orderdate")


def event_years(spark: SparkSession, sf: str) -> tuple[int, int]:
    return years_of(table(spark, sf, "events"), "ts")


# -- occurrences -------------------------------------------------------------------------------------------------------


def user_days(spark: SparkSession, sf: str, change=None) -> DataFrame:
    """Each (user, event type) and the days on which it occurs."""
    change = F.concat_ws("_", "user_id", "event_type") if change is None else change
    return table(spark, sf, "events").select(change.alias("change_id"), F.to_date("ts").alias("tp")).distinct()


def user_hours(spark: SparkSession, sf: str, change=None) -> DataFrame:
    """The same by hour, as text ``YYYY-MM-DDTHH``."""
    change = F.concat_ws("_", "user_id", "event_type") if change is None else change
    hour = timeline.truncate(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), "h")
    return table(spark, sf, "events").select(change.alias("change_id"), hour.alias("tp")).distinct()


def page_change():
    """Change id of the form ``template_property_key_type``."""
    return F.concat_ws("_", F.lit("infobox"), "event_type", "user_id", F.lit("u"))


def publisher_change():
    """Change id that begins with a table id of nine characters."""
    return F.concat(F.format_string("s%08d", "user_id"), F.lit("_"), F.col("event_type"))


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer with an order priority, and the days of their orders."""
    change = F.concat_ws("_", "o_custkey", F.substring("o_orderpriority", 1, 1))
    return table(spark, sf, "orders").select(change.alias("change_id"), F.to_date("o_orderdate").alias("tp")).distinct()


def order_months(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer with an order priority, and the months of their orders."""
    return order_days(spark, sf).select("change_id", F.trunc("tp", "month").alias("tp")).distinct()


def nation_days(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer nation with an order priority, and the days of its orders."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit("-")).alias("nation"))
    placed = (
        table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    change = F.concat_ws("_", "nation", F.substring("o_orderpriority", 1, 1))
    return placed.select(change.alias("change_id"), F.to_date("o_orderdate").alias("tp")).distinct()


def nation_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by region."""
    regions = table(spark, sf, "region")
    nations = table(spark, sf, "nation")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("category"), F.replace("n_name", F.lit("_"), F.lit("-")).alias("template")
    )


def valued_event_types(spark: SparkSession, sf: str) -> DataFrame:
    """Event types whose mean value is not below the mean of all events."""
    events = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    whole = events.agg((F.sum(cents) / F.count(F.lit(1))).alias("m")).scalar()
    means = events.groupBy(F.col("event_type").alias("template")).agg((F.sum(cents) / F.count(F.lit(1))).alias("m"))
    return means.where(F.col("m") >= whole).select("template")


# -- snapshots ---------------------------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """A supplier's shipments of a month (or another ``unit``) as a table: line number × (return flag, status) with the quantity.

    Missing cells are null, cells without discount hold the null mark ``"-"``.
    """
    items = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.trunc(F.to_date("l_shipdate"), unit).alias("snapshot_date"),
        "l_linenumber",
        F.concat("l_returnflag", "l_linestatus").alias("column_id"),
        "l_quantity",
        "l_discount",
    )
    doc = ["l_suppkey", "snapshot_date"]
    # lines lie by document, so that neither its cells nor itself move again
    items = items.repartition(*doc)
    quantity = F.sum("l_quantity").cast("long").cast("string")
    cells = items.groupBy(*doc, "l_linenumber", "column_id").agg(
        F.when(F.max("l_discount") == 0, F.lit('"-"')).otherwise(quantity).alias("value")
    )
    # at most seven rows and six columns per document
    documents = cells.groupBy(*doc).agg(F.collect_list(F.struct("l_linenumber", "column_id", "value")).alias("cells"))
    entry = lambda c: F.struct(F.concat_ws("/", c["l_linenumber"].cast("string"), c["column_id"]), c["value"])
    numbers = F.array_compact(F.array_distinct("cells.l_linenumber")).cast("array<string>")
    named = documents.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("table_id"),
        "snapshot_date",
        F.sort_array(F.array_compact(F.array_distinct("cells.column_id"))).alias("attributes"),
        F.sort_array(numbers).alias("row_ids"),
        F.map_from_entries(F.transform("cells", entry)).alias("cells"),
    )

    def fields(row):
        return F.transform(
            "attributes", lambda a: F.coalesce(F.try_element_at("cells", F.concat_ws("/", row, a)), F.lit("null"))
        )

    rows = F.transform("row_ids", lambda r: F.struct(r.alias("id"), fields(r).alias("fields")))
    return named.select("snapshot_date", "table_id", "attributes", rows.alias("rows"))


def kept_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The monthly snapshots, written once for all that reads them."""
    return materialize(snapshots(spark, sf), "snapshots")


# -- edits -------------------------------------------------------------------------------------------------------------


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as infobox edits: one infobox per (user, event type), which moves to another page in mid-month."""
    events = table(spark, sf, "events")
    before = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    value = F.when(F.col("value") < 20, F.lit("  ")).otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))

    def change(name, current):
        return F.struct(
            F.struct(F.lit(name).alias("name")).alias("property"),
            F.lag(current).over(before).alias("previousValue"),
            current.alias("currentValue"),
        )

    high = F.col("value") > 50
    return events.select(
        F.concat(F.lit("Infobox "), "event_type", F.when(high, F.lit("_plus")).otherwise(F.lit(" "))).alias("template"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("validFrom"),
        F.when(F.row_number().over(before) == 1, F.lit("CREATE")).otherwise(F.lit("UPDATE")).alias("type"),
        F.concat_ws(".", "user_id", "event_type").alias("key"),
        F.concat(
            F.lit("p"), F.col("user_id").cast("string"), F.when(F.dayofmonth("ts") <= 15, F.lit("a")).otherwise(F.lit("b"))
        ).alias("pageID"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.when(high, F.lit(" (high)")).otherwise(F.lit(""))).alias(
            "pageTitle"
        ),
        F.array(change("Value_of entry", value), change("props", F.col("props"))).alias("changes"),
        F.struct("ts", "event_id").alias("seq"),
    )


# -- lookups -----------------------------------------------------------------------------------------------------------


def user_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A user's page is the nation of the customer with the same number."""
    pages = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("page_id")
    )
    names = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("page_id"), F.col("n_name").alias("page_name")
    )
    return pages, names


def download_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines of customers' tables, in one file per region; two lines each, one of which names no table."""
    customers = table(spark, sf, "customer")
    nations = table(spark, sf, "nation")
    regions = table(spark, sf, "region")
    placed = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    name = F.format_string("s%08d", "c_custkey")
    lines = F.array(F.concat(F.lit("Saving to: data/"), name, F.lit(".json")), F.concat(F.lit("Resolving "), name))
    return placed.select(
        F.concat(F.lit("logs/"), "r_name", F.lit("_urls.log")).alias("file_name"), F.explode(lines).alias("line")
    )
