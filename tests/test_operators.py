"""Hand-made cases for the operators around mining."""

import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echolag import sources
from echolag.functions import dense_index, global_rank, join_heavy, json_text_is_null, sanitize
from echolag.operators import (
    components,
    domains,
    edit_log,
    grouping,
    interest,
    merge,
    mining,
    periodicity,
    rollup,
    snapshot_diff,
    statistics,
    support,
    sweep,
    timeline,
    validation,
)
from echolag.schemas import FIELD_CHANGES, SNAPSHOTS


def day(text):
    return dt.date.fromisoformat(text)


# -- functions ---------------------------------------------------------------------------------------------------------


def test_sanitize(spark):
    names = spark.createDataFrame([("_infobox song\n ",), ("a_b\tc d-",)], "n STRING")
    assert [r[0] for r in names.select(sanitize(F.col("n"))).collect()] == ["infobox-song", "a-bc-d"]


def test_null_texts(spark):
    texts = ["null", '"NULL "', '"-"', '" – "', '"\\n"', '"%"', "0", '"0"', "false", '"x"']
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in frame.select(json_text_is_null(F.col("t"))).collect()]
    assert got == [True] * 6 + [False] * 4


def test_join_heavy_equals_plain_join(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", i) for i in range(2000)]
    left = spark.createDataFrame(rows, "k STRING, i INT")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k STRING, v INT")
    for how in ("inner", "left"):
        split = join_heavy(left, right, ["k"], how, chunk=50).select("k", "i", "v")
        plain = left.join(right, "k", how).select("k", "i", "v")
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_dense_index(spark):
    frame = spark.createDataFrame([(g, i) for g in "ab" for i in range(0, 3000, 7)], "g STRING, tp INT")
    got = dense_index(frame, ["tp"], F.floor(F.col("tp") / 1000), "n", ["g"]).collect()
    assert all(r.n == r.tp // 7 for r in got) and len(got) == 2 * 429


def test_global_rank(spark):
    frame = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("v"))
    got = global_rank(frame, [F.desc("v")], "n").collect()
    assert len(got) == 1000 and all(r.n == 999 - r.v // 3 for r in got)


# -- timeline and support ----------------------------------------------------------------------------------------------


def test_hour_domain(spark):
    hours = timeline.hourly_domain(spark, "2020-01-01", "2020-01-02", hours_per_day=25).collect()
    index = {r.tp: r.tp_idx for r in hours}
    assert len(index) == 50
    assert index["2020-01-02T00"] - index["2020-01-01T23"] == 2


def test_calendar_domain_is_clamped(spark):
    occurrences = spark.createDataFrame([("a", day("2021-02-01"))], "change_id STRING, tp DATE")
    points = timeline.calendar_domain(occurrences)
    assert points.agg(F.min("tp"), F.max("tp")).first()[:] == (day("2020-11-11"), day("2021-02-01"))


def test_periods_and_their_support(spark):
    rows = [("a", day(f"{y}-01-01")) for y in (2014, 2015, 2018, 2019)]
    split = timeline.split_by_period(spark.createDataFrame(rows, "change_id STRING, tp DATE"))
    got = sorted((r.period, r.tp.year) for r in split.collect())
    assert got == [("2015-2018", 2015), ("2015-2018", 2018), ("2016-2019", 2018), ("2016-2019", 2019)]
    # ceil(1461 · 0.001) = 2
    assert support.filter_support_periods(split, 0.001, 1).count() == 4
    assert support.filter_support_periods(split, 0.002, 1).count() == 0


def test_support_bounds_are_inclusive(spark):
    rows = [(c, t) for c, n in (("one", 1), ("two", 2), ("five", 5), ("six", 6)) for t in range(n)]
    kept = support.filter_support(spark.createDataFrame(rows, "change_id STRING, tp INT"), 10, 0.11, 0.5)
    assert {r.change_id for r in kept.collect()} == {"two", "five"}


def test_prefixes(spark):
    occurrences = spark.createDataFrame([("a", t) for t in range(10)], "change_id STRING, tp INT")
    cut = timeline.timeline_prefixes(occurrences, timeline.observed_domain(occurrences), 4)
    # cuts at round(2.5) = 2, 5, round(7.5) = 8 and 9
    assert {(r.num_days, r.n) for r in cut.groupBy("num_days").agg(F.count("*").alias("n")).collect()} == {
        (3, 3),
        (6, 6),
        (9, 9),
        (10, 10),
    }


# -- snapshots ---------------------------------------------------------------------------------------------------------


def snapshot_frame(spark, versions):
    rows = [
        (day(date), table, attributes, [(i, [json.dumps(v, ensure_ascii=False) for v in fields]) for i, fields in rows_])
        for date, table, attributes, rows_ in versions
    ]
    return spark.createDataFrame(rows, SNAPSHOTS)


def changes_of(found):
    return {
        (str(r.date), r.change_type, r.table_id, r.column_id, r.row_id) for r in found.field_changes.collect()
    }


def brute_diff(versions, distinguish_null=False):
    """Change log from a plain reading of the rules, one pair of versions at a time."""

    def is_null(v):
        return v is None or (isinstance(v, str) and (v.strip() in ("-", "/", "", "–", "—", "%") or v.strip().lower() == "null"))

    out, by_table = set(), {}
    for version in sorted(versions):
        by_table.setdefault(version[1], []).append(version)
    for table, chain in by_table.items():
        for i, (date, _, cols, rows) in enumerate(chain):
            if i == 0:
                out |= {(date, "insert", table, c, r) for r, _ in rows for c in cols}
                continue
            _, _, old_cols, old_rows = chain[i - 1]
            old, new = {}, {r for r, _ in rows}
            for r, fields in old_rows:
                old.setdefault(r, fields)
            for r, fields in rows:
                if r not in old:
                    out |= {(date, "insert", table, c, r) for c in cols}
                elif fields != old[r]:
                    for c, v in zip(cols, fields):
                        if c not in old_cols:
                            out.add((date, "insert", table, c, r))
                            continue
                        before = old[r][old_cols.index(c)]
                        if v == before or (distinguish_null and is_null(v) and is_null(before)):
                            continue
                        kind = "update"
                        if distinguish_null:
                            kind = "delete" if is_null(v) else "insert" if is_null(before) else "update"
                        out.add((date, kind, table, c, r))
            for r, _ in old_rows:
                out |= {(date, "delete", table, c, r) for c in old_cols if r not in new or c not in cols}
    return out


@pytest.mark.parametrize("distinguish_null", [False, True])
def test_diff_against_brute_force(spark, distinguish_null):
    rng = random.Random(3)
    versions = []
    for table in ("t1", "t2", "t3"):
        for d in range(1, 9):
            if rng.random() < 0.7:
                cols = [c for c in "abcd" if rng.random() < 0.8] or ["a"]
                rng.shuffle(cols)
                ids = [f"r{rng.randint(0, 4)}" for _ in range(rng.randint(1, 6))]
                rows = [(i, [rng.choice(["x", "y", "-", None, " NULL "]) for _ in cols]) for i in ids]
                versions.append((f"2020-01-0{d}", table, cols, rows))
    found = snapshot_diff.find_changes(snapshot_frame(spark, versions), distinguish_null=distinguish_null)
    assert changes_of(found) == brute_diff(versions, distinguish_null)


def test_null_typing(spark):
    versions = [
        ("2020-01-01", "t", ["a", "b", "c"], [("r", [1, None, "–"])]),
        ("2020-01-02", "t", ["a", "b", "c"], [("r", ["-", 2, " NULL "])]),
    ]
    found = snapshot_diff.find_changes(snapshot_frame(spark, versions), start="2020-01-02", distinguish_null=True)
    assert changes_of(found) == {("2020-01-02", "delete", "t", "a", "r"), ("2020-01-02", "insert", "t", "b", "r")}


def test_unchanged_row_guard(spark):
    versions = [
        ("2020-01-01", "t", ["a"], [("r", [1])]),
        ("2020-01-02", "t", ["b"], [("r", [1])]),
    ]
    found = snapshot_diff.find_changes(snapshot_frame(spark, versions), start="2020-01-02")
    assert changes_of(found) == {("2020-01-02", "delete", "t", "a", "r")}
    events = {(r.level, r.change_type, r.item_id) for r in found.entity_events.collect()}
    assert events == {("column", "insert", "b"), ("column", "delete", "a")}


def test_gap_and_base_date(spark):
    versions = [
        ("2020-01-01", "t", ["a"], [("r", [1])]),
        ("2020-01-04", "t", ["a"], [("r", [2])]),
        ("2020-01-04", "new", ["a"], [("r", [2])]),
    ]
    found = snapshot_diff.find_changes(snapshot_frame(spark, versions), base_date="2020-01-01")
    assert changes_of(found) == {("2020-01-04", "update", "t", "a", "r"), ("2020-01-04", "insert", "new", "a", "r")}
    assert [r[:] for r in found.new_tables.collect()] == [(day("2020-01-04"), 1)]


def test_first_copy_of_a_row_id_is_compared(spark):
    versions = [
        ("2020-01-01", "t", ["a"], [("r", [1]), ("r", [2])]),
        ("2020-01-02", "t", ["a"], [("r", [1])]),
        ("2020-01-03", "t", ["a"], [("r", [2])]),
    ]
    found = snapshot_diff.find_changes(snapshot_frame(spark, versions), start="2020-01-02")
    assert changes_of(found) == {("2020-01-03", "update", "t", "a", "r")}


def test_table_selection(spark):
    versions = [("2020-01-01", t, ["a"], [("r", [1])]) for t in ("t1", "t2", "t3", "t4")]
    snapshots = snapshot_frame(spark, versions)
    include = spark.createDataFrame([("t2",), ("t3",), ("t4",)], "table_id STRING")
    exclude = spark.createDataFrame([("t3",)], "table_id STRING")
    chosen = snapshot_diff.select_tables(snapshots, include, exclude, num_tables=3)
    assert {r.table_id for r in chosen.collect()} == {"t2"}


def test_snapshot_files(spark, tmp_path):
    for date, value in (("2020-01-01", 1), ("2020-01-02", "1")):
        folder = tmp_path / date
        folder.mkdir()
        document = {
            "id": "aaaa-bbbb",
            "attributes": [{"id": "c1"}, {"id": "c2"}],
            "rows": [{"id": "r1", "fields": [value, None]}],
        }
        (folder / "aaaa-bbbb.json?").write_text(json.dumps(document))
    snapshots = sources.read_snapshots(spark, str(tmp_path))
    got = sorted((str(r.snapshot_date), r.table_id, r.rows[0].fields) for r in snapshots.collect())
    assert got == [("2020-01-01", "aaaa-bbbb", ["1", "null"]), ("2020-01-02", "aaaa-bbbb", ['"1"', "null"])]
    found = snapshot_diff.find_changes(snapshots, base_date="2020-01-01")
    assert changes_of(found) == {("2020-01-02", "update", "aaaa-bbbb", "c1", "r1")}
    assert [r[:] for r in statistics.null_values(snapshots).collect()] == [(None, 2)]
    assert statistics.average_table_size(statistics.table_sizes(snapshots)).first()[:] == (1, 2.0, 1.0)


# -- change logs and roll-up -------------------------------------------------------------------------------------------


def test_change_log_files(spark, tmp_path):
    (tmp_path / "2020-01-01_update.csv").write_text("t;c;r\nt;c;r2\n")
    (tmp_path / "2020-01-01_insert.csv").write_text("t;d;r\n")
    (tmp_path / "2020-01-01_row_insert_delete.csv").write_text("insert;t;r\n")
    (tmp_path / "2020-01-01_table_insert.csv").write_text("t\n")
    (tmp_path / "2020-01-01_column_changes_aggregated.csv").write_text("change_type;table;column\nupdate;t;c\n")
    log = sources.read_change_csv(spark, str(tmp_path))
    assert {r[1:] for r in log.collect()} == {("update", "t", "c", "r"), ("update", "t", "c", "r2"), ("insert", "t", "d", "r")}
    events = sources.read_entity_events_csv(spark, str(tmp_path))
    assert {r[1:] for r in events.collect()} == {("row", "insert", "t", "r"), ("table", "insert", "t", None)}
    rolled = sources.read_entity_changes_csv(spark, str(tmp_path), "column")
    assert {r[:] for r in rolled.collect()} == {(day("2020-01-01"), "column", "update", "t", "c", None)}
    sources.write_change_log(log, str(tmp_path / "log"))
    assert sources.read_change_log(spark, str(tmp_path / "log")).count() == 3
    sources.write_change_csv(log, str(tmp_path / "csv"))
    sources.write_entity_changes_csv(rolled, str(tmp_path / "rolled"), "column")
    lines = [p.read_text() for p in Path(tmp_path / "rolled").rglob("*.csv")]
    assert lines == ["change_type;table;column\nupdate;t;c\n"]


def test_roll_up_and_index(spark):
    log = spark.createDataFrame(
        [(day("2020-01-01"), "update", "t", "c", "r"), (day("2020-01-01"), "update", "t", "c", "q")], FIELD_CHANGES
    )
    rolled = rollup.roll_up(log)
    assert {r[1:] for r in rolled.collect()} == {
        ("table", "update", "t", None, None),
        ("column", "update", "t", "c", None),
        ("row", "update", "t", None, "r"),
        ("row", "update", "t", None, "q"),
    }
    index = rollup.occurrence_index(rolled, ["column", "row"])
    assert {r.change_id for r in index.collect()} == {"t_c_u", "t_r_u", "t_q_u"}


def test_change_counts(spark):
    log = spark.createDataFrame(
        [
            (day("2020-01-01"), "insert", "t", "c", "r"),
            (day("2020-01-02"), "update", "t", "c", "r"),
            (day("2020-01-03"), "delete", "t", "c", "r"),
        ],
        FIELD_CHANGES,
    )
    events = spark.createDataFrame(
        [
            (day("2020-01-01"), "row", "insert", "t", "r"),
            (day("2020-01-03"), "row", "delete", "t", "r"),
            (day("2020-01-01"), "table", "insert", "t", None),
        ],
        "date DATE, level STRING, change_type STRING, table_id STRING, item_id STRING",
    )
    counts = lambda level, **kw: {r[:] for r in statistics.change_counts(log, events, level, **kw).collect()}
    assert counts("field") == {("t", "c", "r", 1, 1, 1)}
    assert counts("row") == {("t", "r", 1, 1, 1)}
    assert counts("row", skip_new_and_deleted=False) == {("t", "r", 3, 1, 1)}
    base = spark.createDataFrame([("old",)], "table_id STRING")
    assert counts("table", base_tables=base) == {("t", 2, 1, 0), ("old", 0, 0, 0)}


# -- edits -------------------------------------------------------------------------------------------------------------


def edit(template, when, key, page, previous, current, kind="UPDATE"):
    change = {"property": {"name": "Some name"}}
    if previous is not None:
        change["previousValue"] = previous
    if current is not None:
        change["currentValue"] = current
    return {
        "template": template,
        "validFrom": when,
        "type": kind,
        "key": key,
        "pageID": page,
        "pageTitle": f"title {page}",
        "changes": [change],
    }


def test_edit_log(spark, tmp_path):
    lines = [
        edit("Infobox Song", "2016-01-01T10:00:00Z", "k1", "p1", None, "x", "CREATE"),
        edit("Infobox Song", "2016-01-02T10:00:00Z", "k1", "p1", "x", "y"),
        edit("infobox single", "2016-01-03T10:00:00Z", "k1", "p1", "y", "  "),
        edit("infobox film", "2016-01-03T11:00:00Z", "k2", "p2", " ", "z"),
        edit("infobox film", "2016-01-03T12:00:00Z", "k2", "p2", "z", " z "),
        edit("infobox film", "2021-01-03T12:00:00Z", "k2", "p3", "z", "w"),
        edit("navbox", "2016-01-03T12:00:00Z", "k3", "p2", "z", "w"),
        {k: v for k, v in edit("", "2016-01-03T12:00:00Z", "k3", "p2", "z", "w").items() if k != "template"},
    ]
    (tmp_path / "edits.json").write_text("\n".join(json.dumps(line) for line in lines))
    edits = sources.read_edits(spark, str(tmp_path / "edits.json"))
    boxes = edit_log.infobox_edits(edits)
    changes = edit_log.property_changes(boxes)
    got = {r[:] for r in edit_log.edit_occurrences(changes).collect()}
    # the song was renamed, so both of its changes carry the later name
    assert got == {
        ("infobox-single_Some-name_k1_u", "2016-01-02"),
        ("infobox-single_Some-name_k1_d", "2016-01-03"),
        ("infobox-film_Some-name_k2_i", "2016-01-03"),
    }
    listed = spark.createDataFrame([("c", "infobox-film")], "category STRING, template STRING")
    assert edit_log.property_changes(boxes, "h", listed).select("tp").collect()[0][0] == "2016-01-03T11"
    aliases = {r[:] for r in edit_log.template_aliases(boxes).collect()}
    assert aliases == {
        ("k1", "infobox-single", "infobox-song", 1),
        ("k1", "infobox-single", "infobox-single", 1),
        ("k2", "infobox-film", "infobox-film", 2),
    }
    assert {r[:] for r in edit_log.key_pages(boxes).collect()} == {("k1", "p1"), ("k2", "p2")}
    assert {r[:] for r in edit_log.key_pages_full(edits).collect()} == {("k1", "p1"), ("k2", "p3")}
    assert {r[:] for r in edit_log.infoboxes_per_template(edits).collect()} == {("infobox-single", 1), ("infobox-film", 2)}


# -- grouping, periodicity, domains ------------------------------------------------------------------------------------


def test_groups(spark):
    rows = [(c, t) for c, ts in {"a": [1, 2], "b": [1, 2], "c": [1, 3], "d": [4], "e": [4]}.items() for t in ts]
    grouped = grouping.group_simultaneous(spark.createDataFrame(rows, "change_id STRING, tp INT"))
    members = {}
    for r in grouped.groups.collect():
        members.setdefault(r.group_id, []).append(r.change_id)
    assert sorted(map(sorted, members.values())) == [["a", "b"], ["d", "e"]]
    assert set(members) == {"group0", "group1"}
    assert {r.change_id for r in grouped.occurrences.collect()} == {"c", "group0", "group1"}


def test_periodicity(spark):
    start = day("2019-11-02")
    dates = {
        "single": [0],
        "weekly": range(0, 140, 7),
        "tenth": [i for i in range(366) if (start + dt.timedelta(i)).day == 10],
        "constant": range(0, 360, 11),
        "random": random.Random(5).sample(range(366), 60),
    }
    rows = [(c, start + dt.timedelta(i)) for c, ds in dates.items() for i in ds]
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp DATE")
    kept = periodicity.drop_periodic(occurrences)
    assert {r.change_id for r in kept.collect()} == {"random"}


def test_domains(spark, tmp_path):
    (tmp_path / "x.org_urls.log").write_text("Saving to: data/aaaa-aaaa.json\nother line\nSaving to: data/bbbb-bbbb.json\n")
    (tmp_path / "y.org_urls.log").write_text("Saving to: data/cccc-cccc.json\n")
    tables = domains.domain_tables(sources.read_download_log(spark, str(tmp_path)))
    mapping = domains.table_domain(tables)
    assert {r[:] for r in mapping.collect()} == {("aaaa-aaaa", "x.org"), ("bbbb-bbbb", "x.org"), ("cccc-cccc", "y.org")}
    groups = spark.createDataFrame(
        [("group0", "bbbb-bbbb_u"), ("group0", "cccc-cccc_u")], "group_id STRING, change_id STRING"
    )
    pairs = [("aaaa-aaaa_u", "group0"), ("aaaa-aaaa_u", "cccc-cccc_d"), ("group0", "cccc-cccc_d")]
    rules = spark.createDataFrame(
        [(a, c, 1, 1.0, 1.0, [1]) for a, c in pairs],
        "antecedent STRING, consequent STRING, support BIGINT, confidence DOUBLE, lift DOUBLE, hist ARRAY<INT>",
    )
    kept = domains.same_domain_rules(rules, mapping, groups, strict=True)
    assert {(r.antecedent, r.consequent, r.domain) for r in kept.collect()} == {
        ("aaaa-aaaa_u", "group0", "x.org"),
        ("group0", "cccc-cccc_d", "y.org"),
    }
    with pytest.raises(KeyError):
        domains.same_domain_rules(rules, mapping.where("table_id <> 'cccc-cccc'"), groups, strict=True)


# -- sweep -------------------------------------------------------------------------------------------------------------


def test_sweep_keeps_bands_and_categories_apart(spark):
    base = [day("2015-03-01") + dt.timedelta(days=i * 9) for i in range(60)]
    often = [day("2015-03-01") + dt.timedelta(days=i * 5) for i in range(200)]
    rows = [(f"{t}_x_{n}_u", d) for t in ("song", "film") for n in (1, 2) for d in base]
    rows += [("song_y_3_u", d) for d in often]
    split = timeline.split_by_period(spark.createDataFrame(rows, "change_id STRING, tp DATE"))
    points = timeline.period_domain(spark)
    listed = spark.createDataFrame([("media", "song"), ("media2", "film")], "category STRING, template STRING")
    rules = sweep.mine_sweep(split, points, whitelist=listed, num_bins=(7,))
    got = {(r.period, r.category, r.antecedent, r.consequent, r.band, r.support) for r in rules.collect()}
    pairs = [("media", "song"), ("media2", "film")]
    expected = {
        ("2015-2018", c, f"{t}_x_{i}_u", f"{t}_x_{3 - i}_u", 0, 60) for c, t in pairs for i in (1, 2)
    }
    late = {("2016-2019", c, f"{t}_x_{i}_u", f"{t}_x_{3 - i}_u", 0, n) for c, t in pairs for i in (1, 2) for n in (26,)}
    assert {g for g in got if g[0] == "2015-2018"} == expected
    assert {g[:5] for g in got if g[0] == "2016-2019"} == {e[:5] for e in late}


# -- rules as files, scores, merging, clusters -------------------------------------------------------------------------


def some_rules(spark):
    rows = [
        ("box_a_k1_u", "box_b_k2_u", 4, 1.0, 0.25, [3, 1]),
        ("box_b_k2_u", "box_c_k3_u", 4, 1.0, 0.25, [4, 0]),
        ("box_a_k1_u", "box_d_k1_u", 4, 1.0, 0.25, [0, 4]),
        ("box_e_k4_u", "box_f_k5_u", 2, 0.5, 0.25, [2, 0]),
    ]
    return spark.createDataFrame(
        rows, "antecedent STRING, consequent STRING, support BIGINT, confidence DOUBLE, lift DOUBLE, hist ARRAY<INT>"
    )


def test_rule_files(spark, tmp_path):
    rules = some_rules(spark)
    sources.write_rules_csv(rules, str(tmp_path / "csv"))
    line = next(t for p in (tmp_path / "csv").glob("*.csv") for t in p.read_text().splitlines() if "box_d" in t)
    assert line == 'box_a_k1_u;box_d_k1_u;4;1.0;0.25;"[0, 4]"'
    back = sources.read_rules_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rules.collect()))
    sources.write_rules_csv(rules.withColumn("domain", F.lit("x.org")), str(tmp_path / "dom"))
    assert {r.domain for r in sources.read_rules_csv(spark, str(tmp_path / "dom"), domain=True).collect()} == {"x.org"}
    sources.write_rules(rules.withColumn("num_bins", F.lit(2)), str(tmp_path / "parquet"))
    assert sources.read_rules(spark, str(tmp_path / "parquet")).count() == 4


def test_index_files(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"a_u": ["2020-01-01", "2020-01-02"], "b_u": ["2020-01-02"]}))
    (tmp_path / "days.json").write_text(json.dumps(["2020-01-01", "2020-01-02"]))
    index = sources.read_occurrence_json(spark, str(tmp_path / "index.json"))
    assert index.count() == 3
    assert {r[:] for r in sources.read_timepoints_json(spark, str(tmp_path / "days.json")).collect()} == {
        ("2020-01-01", 0),
        ("2020-01-02", 1),
    }
    sources.write_occurrence_json(index, str(tmp_path / "out"))
    back = sources.read_occurrence_json(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect()))
    (tmp_path / "list.txt").write_text("table_id\n\n t1 \nt2\n")
    assert {r.table_id for r in sources.read_table_list(spark, str(tmp_path / "list.txt")).collect()} == {"t1", "t2"}


def test_scores(spark):
    rules = some_rules(spark)
    sample = interest.sample_rules(rules, 10, 0.4, 0.1, 0.5)
    assert sample.count() == 3
    general = interest.general_pdf(sample.where("antecedent <> 'box_a_k1_u'"), 2)
    scored = interest.score_rules(rules, general, 10, 0.4, 0.1, 0.5)
    by_pair = {(r.antecedent, r.consequent): r for r in scored.collect()}
    p, q = (1.0, 0.0), (0.75, 0.25)
    wanted = sum((x * x + y * y) / (x + y) for x, y in zip(p, q))
    assert by_pair["box_a_k1_u", "box_b_k2_u"].score == pytest.approx(wanted)
    assert interest.rank_rules(scored).first().consequent == "box_d_k1_u"
    true = interest.score_rules(rules, general, 10, 0.4, 0.1, 0.5, method="jensen_shannon")
    assert min(r.score for r in true.collect()) == pytest.approx(0.0)


def test_merge_and_clusters(spark, tmp_path):
    pages = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(1, 6)], "key STRING, page_id STRING")
    names = spark.createDataFrame([(f"p{i}", f"Page {i}") for i in range(1, 6)], "page_id STRING, page_name STRING")
    merged = merge.merge_rules(some_rules(spark), pages, names, strict=True)
    assert merge.external_rate(merged).first()[:] == (4, 3, 75.0)
    occurrences = spark.createDataFrame(
        [(c, "2020-01-01T05") for c in ("box_a_k1_u", "box_b_k2_u", "box_c_k3_u", "box_e_k4_u", "box_f_k5_u")],
        "change_id STRING, tp STRING",
    )
    listed = {r.antecedent: r for r in merge.list_external(merged, occurrences).collect()}
    assert listed["box_a_k1_u"].delayed == 0.25 and listed["box_a_k1_u"].antecedent_days == ["2020-01-01"]
    assert listed["box_a_k1_u"].antecedent_link.endswith("curid=p1")
    clusters = merge.rule_clusters(merged)
    sizes = merge.cluster_sizes(merge.cluster_pages(merged, clusters))
    assert [r[:] for r in merge.cluster_size_counts(sizes).collect()] == [(3, 1), (2, 1)]
    sources.write_merged_rules(merged, str(tmp_path / "merged"))
    header = next((tmp_path / "merged").glob("*.csv")).read_text().splitlines()[0]
    assert header.split(";")[-1] == "histogram" and len(header.split(";")) == 9
    with pytest.raises(KeyError):
        merge.merge_rules(some_rules(spark), pages.where("key <> 'k1'"), names, strict=True)


def test_components_against_union_find(spark):
    rng = random.Random(11)
    edges = [(f"v{rng.randint(0, 150):03}", f"v{rng.randint(0, 150):03}") for _ in range(110)]
    edges += [("hub", f"leaf{i}") for i in range(60)] + [("loop", "loop")]
    edges += [(f"path{i:02}", f"path{i + 1:02}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "src STRING, dst STRING"))
    assert {r.vertex: r.component for r in got.collect()} == {v: find(v) for v in parent}


def test_listed_clusters(spark):
    """Edges as listed for the military category: eight changes in four pairs of pages."""
    edges = [(f"m{i}", f"m{i + 1}") for i in range(0, 8, 2)]
    got = components.connected_components(spark.createDataFrame(edges, "src STRING, dst STRING"))
    sizes = got.groupBy("component").count().collect()
    assert [r["count"] for r in sizes] == [2, 2, 2, 2]


def test_seeded_draw(spark):
    occurrences = spark.createDataFrame([(f"c{i}", t) for i in range(20) for t in range(2)], "change_id STRING, tp INT")
    first = {r.change_id for r in validation.keep_changes(occurrences, 5).collect()}
    assert len(first) == 5 and first == {r.change_id for r in validation.keep_changes(occurrences, 5).collect()}


def test_lift_by_domain(spark):
    got = some_rules(spark).select(mining.lift_by_domain(F.col("lift"), 30).alias("x")).first()
    assert got.x == 7.5
