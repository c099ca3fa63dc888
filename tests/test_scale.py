"""What must hold when keys, cells and runs grow."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echolag.functions import join_heavy
from echolag.operators import components, merge, mining, snapshot_diff, timeline
from echolag.operators.domains import same_domain_rules
from echolag.plans import rules_from_edits
from echolag.session import materialize, scratch, scratch_dir


def test_every_heavy_key_is_split(spark):
    """More heavy keys than any list of the heaviest would hold."""
    left = spark.range(60_000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("v"))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = join_heavy(left, right, ["k"], chunk=10)
    assert joined.count() == 60_000 and joined.where("w <> 2 * k").isEmpty()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Limit" not in plan


def test_passes_give_the_same_rules(spark, monkeypatch):
    rows = [(f"c{k}", t) for k in range(30) for t in range(k % 5, 60, 3 + k % 4)]
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp INT")
    points = timeline.observed_domain(occurrences)
    bounds = {"num_bins": 4, "min_sup": 0.0, "max_sup": 1.0, "min_conf": 0.5}
    whole = {tuple(r[:3]) for r in mining.mine_rules(occurrences, points, **bounds).collect()}
    # a repeated occurrence counts once
    twice = {tuple(r[:3]) for r in mining.mine_rules(occurrences.unionByName(occurrences), points, **bounds).collect()}
    monkeypatch.setattr(mining, "CELL_ROWS", 50)
    monkeypatch.setattr(mining, "MAX_CELLS", 20)
    monkeypatch.setattr(mining, "RULE_CELL_PAIRS", 10)
    parts = {tuple(r[:3]) for r in mining.mine_rules(occurrences, points, **bounds).collect()}
    assert whole and whole == twice == parts


def test_lists_are_intersected_once(spark):
    rows = [(f"c{k}", t) for k in range(6) for t in range(k, 40, 5)]
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp INT")
    points = timeline.observed_domain(occurrences)
    profile = mining.within_support(mining.profile_changes(occurrences, points), 0.0, 1.0)
    classes, _ = mining.position_classes(profile, [], 4)
    candidates = mining.candidate_pairs(classes, [], 4, 0.5)
    rules = mining.class_rules(classes, candidates, [], 4, 0.5)
    assert rules._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1


def test_stars_take_no_round(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("no round is needed")

    monkeypatch.setattr(components, "_large_star", fail)
    stars = spark.createDataFrame([(5, 1), (6, 1), (2, 9)], "src LONG, dst LONG")
    found = {tuple(r) for r in components.connected_components(stars).collect()}
    assert found == {(1, 1), (5, 1), (6, 1), (2, 2), (9, 2)}


def test_chain_is_one_component(spark):
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert components.connected_components(chain).where("component <> 0").isEmpty()


def test_scratch_is_empty_after_use(spark):
    shared = Path(scratch_dir(spark).removeprefix("file:"))
    with scratch(spark) as folder:
        assert materialize(spark.range(10), "numbers").count() == 10
        inside = Path(folder.removeprefix("file:"))
        assert inside.parent == shared / "echolag" and list(inside.iterdir())
    assert not inside.exists()


def test_dates_with_only_excluded_tables_count_zero(spark):
    rows = [("2020-01-01", "a"), ("2020-01-02", "b"), ("2020-01-03", "a")]
    snapshots = spark.createDataFrame(rows, "d STRING, table_id STRING").selectExpr(
        "CAST(d AS DATE) AS snapshot_date", "table_id", "array('x') AS attributes",
        "array(struct('r' AS id, array('1') AS fields)) AS rows",
    )
    chosen = snapshot_diff.select_tables(snapshots, include=spark.createDataFrame([("a",)], "table_id STRING"))
    found = snapshot_diff.find_changes(snapshots, selected=chosen).new_tables
    assert {(str(r["date"]), r["num_new_tables"]) for r in found.collect()} == {
        ("2020-01-01", 1), ("2020-01-02", 0), ("2020-01-03", 0),
    }


def test_first_of_repeated_row_ids_is_the_old_side(spark):
    rows = [
        ("2020-01-01", [("r", ["1"]), ("r", ["2"])]),
        ("2020-01-02", [("r", ["1"])]),
        ("2020-01-03", [("r", ["2"])]),
    ]
    snapshots = spark.createDataFrame(rows, "d STRING, rows ARRAY<STRUCT<id: STRING, fields: ARRAY<STRING>>>").selectExpr(
        "CAST(d AS DATE) AS snapshot_date", "'t' AS table_id", "array('x') AS attributes", "rows"
    )
    found = snapshot_diff.find_changes(snapshots).field_changes.where("change_type = 'update'")
    assert [str(r["date"]) for r in found.collect()] == ["2020-01-03"]


def test_lookups_are_strict_unless_told(spark):
    rules = spark.createDataFrame(
        [("s00000001_x", "s00000002_y", 3, 1.0, 1.0, [3])],
        "antecedent STRING, consequent STRING, support LONG, confidence DOUBLE, lift DOUBLE, hist ARRAY<INT>",
    )
    tables = spark.createDataFrame([("s00000001", "d")], "table_id STRING, domain STRING")
    with pytest.raises(KeyError):
        same_domain_rules(rules, tables)
    assert same_domain_rules(rules, tables, strict=False).isEmpty()
    pages = spark.createDataFrame([("s00000001", "1")], "key STRING, page_id STRING")
    names = spark.createDataFrame([("1", "One")], "page_id STRING, page_name STRING")
    with pytest.raises(KeyError):
        merge.merge_rules(rules, pages, names)
    assert merge.merge_rules(rules, pages, names, strict=False).isEmpty()


def test_edits_of_all_years_are_read(spark):
    days = spark.range(60).selectExpr("timestamp '2021-02-01 08:00:00' + make_interval(0, 0, 0, CAST(id AS INT) * 8) AS ts")
    edits = days.crossJoin(spark.createDataFrame([("k1", "p1", 0), ("k2", "p2", 3)], "key STRING, pageID STRING, late INT"))
    edits = edits.selectExpr(
        "'Infobox song' AS template",
        "date_format(ts + make_interval(0, 0, 0, 0, late), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS validFrom",
        "'UPDATE' AS type", "key", "pageID", "concat('Title ', pageID) AS pageTitle",
        "array(struct(struct('genre' AS name) AS property, 'a' AS previousValue, 'b' AS currentValue)) AS changes",
        "struct(ts AS validFrom, key) AS seq",
    )
    listed = spark.createDataFrame([("media", "infobox-song")], "category STRING, template STRING")
    found = rules_from_edits(edits, whitelist=listed, first_year=2020, last_year=2023, category="media", num_bins=24)
    assert found.merged.where("antecedent_page_id = 'p1' AND support = 60").count() == 1
