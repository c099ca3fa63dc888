"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolag.operators import snapshot_diff, statistics

from . import data, sql

QUERIES = {}
SQL = {}


def query(statement: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if statement is not None:
            SQL[function.__name__] = statement
        return function

    return register


def _counts_sql(level: str) -> str:
    identity = {"table": ["table_id"], "column": ["table_id", "column_id"], "row": ["table_id", "row_id"]}[level]
    ids = ", ".join(identity)
    item = {"table": "table_id", "column": "table_id, item_id AS column_id", "row": "table_id, item_id AS row_id"}[level]
    extra = "UNION ALL SELECT DISTINCT table_id, false, false, false FROM cell" if level == "table" else ""
    return f"""
WITH {sql.SNAPSHOTS}, {sql.field_changes()}, {sql.ENTITY_EVENTS},
own AS (SELECT date, change_type, {item} FROM ev WHERE level = '{level}'),
days AS (
  SELECT date, {ids}, bool_or(t) AS t, bool_or(a) AS a, bool_or(d) AS d FROM (
    SELECT date, {ids}, true AS t, false AS a, false AS d FROM fc
    UNION ALL SELECT date, {ids}, false, change_type = 'insert', change_type = 'delete' FROM own) GROUP BY date, {ids}),
marked AS (SELECT {ids}, t AND NOT a AND NOT d AS u, a, d FROM days {extra})
SELECT {ids}, count(*) FILTER (u) AS updates, count(*) FILTER (a) AS adds, count(*) FILTER (d) AS deletes
FROM marked GROUP BY {ids}
"""


def _counts(spark, sf, level, with_base=False):
    snapshots = data.kept_snapshots(spark, sf)
    found = snapshot_diff.find_changes(snapshots)
    base = snapshots.select("table_id").distinct() if with_base else None
    return statistics.change_counts(found.field_changes, found.entity_events, level, base)


@query(_counts_sql("table"))
def change_counts_table(spark, sf):
    return _counts(spark, sf, "table", with_base=True)


@query(_counts_sql("column"))
def change_counts_column(spark, sf):
    return _counts(spark, sf, "column")


@query(_counts_sql("row"))
def change_counts_row(spark, sf):
    return _counts(spark, sf, "row")


@query(
    f"""
WITH {sql.SNAPSHOTS}, {sql.field_changes()},
days AS (SELECT date, table_id, column_id, row_id, bool_or(change_type = 'update') AS u,
                bool_or(change_type = 'insert') AS a, bool_or(change_type = 'delete') AS d FROM fc GROUP BY 1, 2, 3, 4)
SELECT table_id, column_id, row_id, count(*) FILTER (u AND NOT a AND NOT d) AS updates, count(*) FILTER (a) AS adds,
       count(*) FILTER (d) AS deletes
FROM days GROUP BY 1, 2, 3
"""
)
def change_counts_field(spark, sf):
    return _counts(spark, sf, "field")


@query(
    f"""
WITH {sql.SNAPSHOTS}, {sql.field_changes()}
SELECT 'table' AS level, change_type, count(DISTINCT table_id) AS entities FROM fc GROUP BY 2
UNION ALL SELECT 'column', change_type, count(DISTINCT (table_id, column_id)) FROM fc GROUP BY 2
UNION ALL SELECT 'row', change_type, count(DISTINCT (table_id, row_id)) FROM fc GROUP BY 2
UNION ALL SELECT 'field', change_type, count(DISTINCT (table_id, column_id, row_id)) FROM fc GROUP BY 2
"""
)
def distinct_entities(spark, sf):
    return statistics.distinct_entities(snapshot_diff.find_changes(data.kept_snapshots(spark, sf)).field_changes)


@query(
    f"""
WITH {sql.SNAPSHOTS}
SELECT count(DISTINCT table_id) AS tables FROM ver WHERE v BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
"""
)
def tables_in_range(spark, sf):
    return statistics.count_tables(data.snapshots(spark, sf), "1996-01-01", "1996-12-31")


_SIZES = """
per AS (SELECT table_id, v, count(DISTINCT column_id) AS c, count(DISTINCT row_id) AS r FROM cell GROUP BY 1, 2),
sizes AS (SELECT table_id, CAST(max(c) AS INTEGER) AS columns, CAST(max(r) AS INTEGER) AS rows FROM per GROUP BY 1)
"""


@query(f'WITH {sql.SNAPSHOTS}, {_SIZES} SELECT table_id, "columns", "rows" FROM sizes')
def table_sizes(spark, sf):
    return statistics.table_sizes(data.snapshots(spark, sf))


@query(
    f"""
WITH {sql.SNAPSHOTS}, {_SIZES}
SELECT count(*) AS tables, avg("columns") AS avg_columns, avg("rows") AS avg_rows FROM sizes
"""
)
def average_table_size(spark, sf):
    return statistics.average_table_size(statistics.table_sizes(data.snapshots(spark, sf)))


@query(
    f"""
WITH {sql.SNAPSHOTS}
SELECT CASE WHEN val = 'null' THEN NULL ELSE replace(val, '"', '') END AS value, count(*) AS count
FROM grid WHERE val IN ('null', '"-"') GROUP BY 1
"""
)
def null_values(spark, sf):
    return statistics.null_values(data.snapshots(spark, sf))


_FREQUENCIES = f"""
{sql.ORDER_DAYS}, cnt AS (SELECT change_id, count(*) AS n FROM occ GROUP BY 1),
freq AS (SELECT n, count(*) AS changes FROM cnt GROUP BY 1)
"""


def _frequencies(spark, sf):
    return statistics.occurrence_frequencies(data.order_days(spark, sf))


@query(
    f"""
WITH {_FREQUENCIES}
SELECT CAST(sum(n) AS BIGINT) AS occurrences, avg(n) AS mean, CAST(median(n) AS DOUBLE) AS median, max(n) AS most FROM cnt
"""
)
def occurrence_summary(spark, sf):
    return statistics.occurrence_summary(_frequencies(spark, sf))


@query(
    f"""
WITH {_FREQUENCIES}, k AS (SELECT unnest(generate_series(1, 20)) AS n),
s AS (SELECT k.n, CAST(coalesce(sum(changes) FILTER (f.n = k.n), 0) AS BIGINT) AS exactly,
             CAST(coalesce(sum(changes), 0) AS BIGINT) AS at_most
      FROM k LEFT JOIN freq f ON f.n <= k.n GROUP BY 1)
SELECT n, exactly, at_most, CAST(100 * exactly AS DOUBLE) / t AS exactly_percent,
       CAST(100 * at_most AS DOUBLE) / t AS at_most_percent
FROM s, (SELECT CAST(sum(changes) AS BIGINT) AS t FROM freq)
"""
)
def rare_shares(spark, sf):
    return statistics.rare_shares(_frequencies(spark, sf))


@query(
    f"""
WITH {sql.USER_HOURS.format(change="event_type || '_' || CAST(user_id AS BIGINT) % 7")},
cnt AS (SELECT change_id, count(*) AS n FROM occ GROUP BY 1),
b AS (SELECT min(n) AS lo, max(n) AS hi FROM cnt)
SELECT CAST(lo + least(floor((n - lo) / 10.0), greatest(ceil((hi - lo) / 10.0) - 1, 0)) * 10 AS BIGINT) AS bin_start,
       count(*) AS changes
FROM cnt, b GROUP BY 1
"""
)
def occurrence_histogram(spark, sf):
    change = F.concat_ws("_", "event_type", F.col("user_id").cast("long") % 7)
    occurrences = data.user_hours(spark, sf, change)
    return statistics.occurrence_histogram(statistics.occurrence_frequencies(occurrences))


@query(
    """
SELECT o_orderpriority AS parameter, o_orderstatus AS value, round(avg(o_totalprice), 4) AS seconds
FROM orders GROUP BY 1, 2
"""
)
def mean_runtimes(spark, sf):
    """Orders stand for benchmark runs: priority and status for parameter and value, the price for the seconds."""
    runs = data.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("parameter"),
        F.col("o_orderstatus").alias("value"),
        F.col("o_orderkey").alias("run"),
        F.col("o_totalprice").alias("seconds"),
    )
    return statistics.mean_runtimes(runs).select("parameter", "value", F.round("seconds", 4).alias("seconds"))
