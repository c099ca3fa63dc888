"""Queries on tables built here: the whole job, and plans that hold when tables grow."""

import datetime as dt

from workload import QUERIES


def test_key_pages_full_has_every_key(spark, tmp_path):
    rows = [
        (user * 10 + k, dt.datetime(2024, 1, 1 + 10 * k), user, "view", 30.0 + k, "a") for user in range(1, 6) for k in range(3)
    ]
    schema = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    found = {row["key"]: row["page_id"] for row in QUERIES["key_pages_full"](spark, str(tmp_path)).collect()}
    assert found == {f"{user}.view": f"p{user}b" for user in range(1, 6)}


def _snapshots(spark, documents):
    schema = "snapshot_date DATE, table_id STRING, attributes ARRAY<STRING>, rows ARRAY<STRUCT<id: STRING, fields: ARRAY<STRING>>>"
    return spark.createDataFrame([(dt.date.fromisoformat(day), *rest) for day, *rest in documents], schema)


_HISTORY = [
    ("2024-01-01", "t", ["a", "b"], [("1", ["1", "2"]), ("2", ["3", "4"]), ("2", ["5", "4"]), (None, ["9", "9"])]),
    ("2024-01-02", "t", ["b", "c"], [("2", ["4", "6"]), ("2", ["7", "6"]), ("3", ["8", "8"]), (None, ["9", "9"])]),
    ("2024-01-04", "t", ["b", "c"], [("1", ["2", "2"]), ("2", ["4", "6"]), ("3", ["8", "8"])]),
    ("2024-01-01", "u", ["a"], [("1", ["1"])]),
]
_LATER = {
    # (2) has the first copy 3, 4 before
    ("2024-01-02", "insert", "c", "2"), ("2024-01-02", "update", "b", "2"), ("2024-01-02", "delete", "a", "2"),
    ("2024-01-02", "delete", "a", "1"), ("2024-01-02", "delete", "b", "1"),
    ("2024-01-02", "insert", "b", "3"), ("2024-01-02", "insert", "c", "3"),
    # a row with equal fields only loses columns
    ("2024-01-02", "delete", "a", None),
    ("2024-01-04", "insert", "b", "1"), ("2024-01-04", "insert", "c", "1"),
    ("2024-01-04", "delete", "b", None), ("2024-01-04", "delete", "c", None),
}


def _later(changes):
    found = [(str(r["date"]), r["change_type"], r["column_id"], r["row_id"]) for r in changes.collect() if r["date"].day > 1]
    assert len(found) == len(set(found))
    return set(found)


def test_rows_compared_over_their_versions(spark, monkeypatch):
    from echolag.operators import snapshot_diff

    found = _later(snapshot_diff.find_changes(_snapshots(spark, _HISTORY)).field_changes)
    assert found == _LATER
    # very large tables are dealt out by row, long lists of columns are matched by a join
    monkeypatch.setattr(snapshot_diff, "HEAVY_CHUNK", 1)
    monkeypatch.setattr(snapshot_diff, "SHORT_LISTS", 0)
    assert _later(snapshot_diff.find_changes(_snapshots(spark, _HISTORY)).field_changes) == found


def test_versions_and_rows_are_not_broadcast(spark):
    """Both grow with the tables; their files may be small where their rows are very many."""
    from echolag.operators import rollup, snapshot_diff

    rolled = rollup.roll_up(snapshot_diff.find_changes(_snapshots(spark, _HISTORY)).field_changes)
    rolled.collect()
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # rows that lie by table and date are rolled up where they are
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 2


def test_entities_are_opened_once(spark):
    """Sketches take one row per change, and levels above the field come from distinct fields."""
    from echolag.operators import statistics

    rows = [
        (dt.date(2024, 1, 1 + k % 3), kind, "t", f"c{k % 4}" if k else None, f"r{k % 5}") for k in range(20) for kind in ("insert", "update")
    ]
    changes = spark.createDataFrame(rows, "date DATE, change_type STRING, table_id STRING, column_id STRING, row_id STRING")
    expected = {(level, kind): n for kind in ("insert", "update") for level, n in (("table", 1), ("column", 5), ("row", 5), ("field", 20))}
    exact = statistics.distinct_entities(changes)
    assert {(r["level"], r["change_type"]): r["entities"] for r in exact.collect()} == expected
    sketches = statistics.entity_sketches(changes)
    assert {(r["level"], r["change_type"]): r["entities"] for r in statistics.merge_sketches(sketches).collect()} == expected
    plan = sketches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_field_changes_move_rows_once(spark):
    """Rows and versions travel once each; nothing is written between a snapshot and its changes."""
    from echolag.operators import snapshot_diff

    changes = snapshot_diff.find_changes(_snapshots(spark, _HISTORY)).field_changes
    changes.collect()
    plan = changes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "row-pairs" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_snapshots_move_lines_once(spark, tmp_path):
    from workload import data

    rows = [(k % 3, dt.datetime(2024, 1 + k % 4, 5), k % 7, "AN"[k % 2], "F", float(k), 0.1 * (k % 3)) for k in range(60)]
    schema = "l_suppkey LONG, l_shipdate TIMESTAMP, l_linenumber INT, l_returnflag STRING, l_linestatus STRING, l_quantity DOUBLE, l_discount DOUBLE"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = data.snapshots(spark, str(tmp_path))
    assert found.count() == 12
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_events_of_rows_without_fields(spark):
    """Events come from row ids alone; a row whose fields are missing counts as one that was not there."""
    from echolag.operators import snapshot_diff

    history = [
        ("2024-01-01", "t", ["a"], [("1", ["1"]), ("2", ["1"]), ("2", ["3"])]),
        ("2024-01-02", "t", ["a"], [("1", None), ("2", ["5"]), ("3", ["5"])]),
    ]
    found = snapshot_diff.find_changes(_snapshots(spark, history)).entity_events
    later = {(r["change_type"], r["item_id"]) for r in found.where("level = 'row' AND date = '2024-01-02'").collect()}
    assert later == {("delete", "1"), ("insert", "3")}


def test_classes_move_once_per_cell(spark):
    """A class is opened up into its time points where its cell is, not before it moves."""
    from echolag.operators import mining

    changes = [(f"c{k}", day) for k in range(12) for day in range(k % 3, 20, 2 + k % 4)]
    occurrences = spark.createDataFrame(changes, "change_id STRING, tp INT")
    points = spark.createDataFrame([(day, day) for day in range(20)], "tp INT, tp_idx INT")
    profile = mining.within_support(mining.profile_changes(occurrences, points), 0.0, 1.0)
    found, _ = mining.position_classes(profile, [], 3)
    plan = mining.word_rules(found, [], 3, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    sides = [plan.index("explode(probed#"), plan.index("explode(places#")]
    moved = [place for place in range(len(plan)) if plan.startswith("RepartitionByExpression", place)]
    assert len(moved) == 2 and sides[0] < moved[0] < sides[1] < moved[1]


def test_entity_changes_take_few_files(spark, tmp_path):
    """Files follow the dates and the size, not the tasks that the changes come from."""
    from echolag import sources

    rows = [(dt.date(2024, 1, 1 + k % 3), "row", "update", f"t{k}", None, "1") for k in range(96)]
    changes = spark.createDataFrame(rows, "date DATE, level STRING, change_type STRING, table_id STRING, column_id STRING, row_id STRING")
    sources.write_entity_changes_csv(changes.repartition(8), f"{tmp_path}/csv", "row")
    assert len(list(tmp_path.glob("csv/date=*/kind=*/*.csv"))) == 3
    back = sources.read_entity_changes_csv(spark, f"{tmp_path}/csv", "row")
    assert back.count() == changes.count() and back.exceptAll(changes.select(back.columns)).isEmpty()


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    """A folder per table version makes many folders; listing them takes a bounded number of tasks."""
    from echolag import session, sources

    count = session.LISTING_TASKS + 100
    for k in range(count):
        folder = tmp_path / f"snapshot_date=2024-01-01/table_id=t{k}"
        folder.mkdir(parents=True)
        (folder / "part.json").write_text('{"attributes": [{"id": "a"}], "rows": [{"id": "1", "fields": [1]}]}')
    spark.sparkContext.setJobGroup("listing", "listing")
    found = sources.read_snapshots(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("listing")]
    tasks = [tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]
    assert found.select("table_id").distinct().count() == count
    assert tasks and max(tasks) <= session.LISTING_TASKS
