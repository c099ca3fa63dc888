"""Round trips: what a query finds is written in an exchange form to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolag import sources
from echolag.operators import timeline
from echolag.session import materialize, scratch_path

from . import changes, data, mined, sql

QUERIES = {}
SQL = {}


def query(statement: str):
    def register(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = statement
        return function

    return register


@query(changes.SQL["field_changes"])
def change_log_parquet(spark, sf):
    path = scratch_path(spark, "change-log")
    sources.write_change_log(changes.field_changes(spark, sf), path)
    return sources.read_change_log(spark, path)


@query(changes.SQL["field_changes"])
def change_log_csv(spark, sf):
    path = scratch_path(spark, "change-csv")
    sources.write_change_csv(changes.field_changes(spark, sf), path)
    return sources.read_change_csv(spark, path)


@query(changes.SQL["entity_events"])
def entity_events_csv(spark, sf):
    path = scratch_path(spark, "events-csv")
    sources.write_entity_events_csv(changes.entity_events(spark, sf), path)
    return sources.read_entity_events_csv(spark, path)


@query(changes.SQL["entity_roll_up"])
def entity_changes_csv(spark, sf):
    # read once per level
    rolled, path = materialize(changes.entity_roll_up(spark, sf), "rolled"), scratch_path(spark, "rolled-csv")
    parts = []
    for level in ("table", "column", "row"):
        sources.write_entity_changes_csv(rolled, path, level, mode="append")
        parts.append(sources.read_entity_changes_csv(spark, path, level))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_USER_DAYS = sql.USER_DAYS.format(change=sql.USER_TYPE)


@query(f"WITH {_USER_DAYS} SELECT change_id, strftime(tp, '%Y-%m-%d') AS tp FROM occ")
def occurrence_index_json(spark, sf):
    path = scratch_path(spark, "index-json")
    sources.write_occurrence_json(data.user_days(spark, sf), path)
    return sources.read_occurrence_json(spark, path)


@query(f"WITH {_USER_DAYS}, {sql.OBSERVED} SELECT strftime(tp, '%Y-%m-%d') AS tp, CAST(idx AS INTEGER) AS tp_idx FROM tps")
def time_domain_json(spark, sf):
    path = scratch_path(spark, "days-json")
    sources.write_timepoints_json(timeline.observed_domain(data.user_days(spark, sf)), path)
    return sources.read_timepoints_json(spark, path)


@query(
    """
SELECT user_id || '.' || event_type AS key, count(*) AS edits, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last, 2 * count(*) AS changes
FROM events GROUP BY 1
"""
)
def edit_log_json(spark, sf):
    path = scratch_path(spark, "edits-json")
    data.edits(spark, sf).drop("seq").write.json(path)
    edits = sources.read_edits(spark, path)
    return edits.groupBy("key").agg(
        F.count(F.lit(1)).alias("edits"),
        F.min("seq.validFrom").alias("first"),
        F.max("seq.validFrom").alias("last"),
        F.sum(F.size("changes")).alias("changes"),
    )


@query(mined.SQL["rules_same_domain"])
def rules_csv(spark, sf):
    path = scratch_path(spark, "rules-csv")
    rules = mined.domain_rules(spark, sf)
    sources.write_rules_csv(rules, path)
    return mined.flat(sources.read_rules_csv(spark, path, domain=True), 5)


@query("SELECT 's' || s_suppkey AS table_id FROM supplier")
def table_list(spark, sf):
    path = scratch_path(spark, "tables")
    name = F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), F.lit(" "))
    listed = data.table(spark, sf, "supplier").select(F.explode(F.array(F.lit("table_id"), F.lit(""), name)))
    listed.write.text(path)
    return sources.read_table_list(spark, path)


@query(f"SELECT rule, score FROM (SELECT antecedent || ' => ' || consequent AS rule, score FROM ({mined.SQL['rule_scores']}))")
def score_files(spark, sf):
    path = scratch_path(spark, "scores")
    scored, general = mined.scored_with_general(spark, sf)
    sources.write_scores(scored, general, path)
    back = spark.read.schema("rule STRING, pdf ARRAY<DOUBLE>, score DOUBLE").json(f"{path}/highscores")
    return back.select("rule", F.round("score", 6).alias("score"))


_NINE = "antecedent, antecedent_page_id, antecedent_page_name, consequent, consequent_page_id, consequent_page_name, support, confidence"


@query(
    f"SELECT {_NINE}, '[' || concat_ws(', ', {', '.join(f'bin_{k}' for k in range(24))}) || ']' AS histogram"
    f" FROM ({mined.SQL['merged_rules']})"
)
def merged_rules_csv(spark, sf):
    path = scratch_path(spark, "merged-csv")
    sources.write_merged_rules(mined.merged(spark, sf), path)
    schema = ", ".join(f"{c} STRING" for c in _NINE.split(", ")[:6]) + ", support BIGINT, confidence DOUBLE, histogram STRING"
    return spark.read.schema(schema).csv(path, sep=";", header=True)


@query(changes.SQL["new_tables"])
def new_tables_csv(spark, sf):
    path = scratch_path(spark, "new-tables")
    sources.write_new_tables(changes.new_tables(spark, sf), path)
    return spark.read.schema("date DATE, num_new_tables BIGINT").csv(path, sep=";", header=True)


@query(changes.SQL["infoboxes_per_template"])
def report_csv(spark, sf):
    path = scratch_path(spark, "report")
    sources.write_report(changes.infoboxes_per_template(spark, sf), path)
    return spark.read.schema("template STRING, n BIGINT").csv(path, sep=";", header=True)


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS page_id FROM customer")
def key_pages_json(spark, sf):
    path = scratch_path(spark, "key-pages")
    sources.write_map(data.user_pages(spark, sf)[0], "key", "page_id", path)
    return sources.read_map(spark, path, "key", "page_id")


@query("SELECT r_name AS domain, n_name AS table_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def domain_tables_json(spark, sf):
    path = scratch_path(spark, "domains")
    nations, regions = data.table(spark, sf, "nation"), data.table(spark, sf, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    sources.write_list_map(rows.select(F.col("r_name").alias("domain"), F.col("n_name").alias("table_id")), "domain", "table_id", path)
    return sources.read_list_map(spark, path, "domain", "table_id")
