"""Rules of classes against the same rules written out, diffs in batches, intervals, and sources that report bad files."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echolag import sources
from echolag.operators import classes, domains, interest, merge, mining, snapshot_diff, timeline
from echolag.schemas import SNAPSHOTS

N_POINTS = 40


@pytest.fixture(scope="module")
def mined(spark):
    """Few position lists, each shared by several changes."""
    draw = random.Random(3)
    lists = [sorted(draw.sample(range(N_POINTS), draw.randint(3, 9))) for _ in range(7)]
    lists.append([t + 1 for t in lists[0] if t + 1 < N_POINTS])
    rows = []
    for k, points in enumerate(lists):
        for copy in range(draw.randint(1, 5)):
            rows += [(f"tableid{(k + copy) % 4:02d}_{copy}_k{k * 3 + copy}_u", t) for t in points]
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp INT")
    points = spark.range(N_POINTS).select(F.col("id").cast("int").alias("tp"), F.col("id").cast("int").alias("tp_idx"))
    bounds = {"num_bins": 5, "min_sup": 0.0, "max_sup": 1.0, "min_conf": 0.4}
    return mining.mine_classes(occurrences, points, **bounds), mining.mine_rules(occurrences, points, **bounds).cache()


def test_counts_and_expansion(mined):
    found, rules = mined
    assert found.rules.where("size_a > 1").count() > 0
    assert classes.count_rules(found).first()[0] == rules.count()


def test_scores(mined):
    found, rules = mined
    bounds = (0.4, 0.0, 1.0)
    best = F.struct((-F.col("support")).alias("s"), "consequent")
    sample = interest.sample_rules(rules, N_POINTS, *bounds, rank=best)
    drawn = classes.sample_class_rules(found, N_POINTS, *bounds)
    weights = Counter()
    for r in drawn.collect():
        weights[tuple(r["hist"])] += r["weight"]
    assert weights == Counter(tuple(r["hist"]) for r in sample.collect())
    general = interest.general_pdf(sample, 5)
    assert interest.general_pdf(drawn, 5).collect() == general.collect()
    plain = interest.score_rules(rules, general, N_POINTS, *bounds)
    scored = classes.score_class_rules(found, general, N_POINTS, *bounds)
    wanted = {(r["antecedent"], r["consequent"]): r["score"] for r in plain.collect()}
    assert {(r["antecedent"], r["consequent"]): r["score"] for r in scored.expand().collect()} == wanted
    assert sum(r["rules"] for r in classes.count_scores(scored).collect()) == len(wanted)


def test_pages_and_clusters(spark, mined):
    found, rules = mined
    pages = spark.createDataFrame([(f"k{k}", f"p{k % 5}") for k in range(40)], "key STRING, page_id STRING")
    names = spark.createDataFrame([(f"p{k}", f"Page {k}") for k in range(5)], "page_id STRING, page_name STRING")
    plain = merge.merge_rules(rules, pages, names)
    merged = classes.merge_classes(found, pages, names)
    assert classes.external_rate(merged).collect() == merge.external_rate(plain).collect()
    clusters = merge.rule_clusters(plain)
    assert set(classes.rule_clusters(merged).collect()) == set(clusters.select("vertex", "component").collect())
    wanted = set(merge.cluster_pages(plain, clusters).collect())
    assert set(classes.cluster_pages(merged).collect()) == wanted and wanted
    with pytest.raises(KeyError):
        classes.merge_classes(found, pages.where("key <> 'k0'"), names)


def test_domains(spark, mined):
    found, rules = mined
    tables = spark.createDataFrame([(f"tableid{k:02d}", f"d{k // 2}") for k in range(4)], "table_id STRING, domain STRING")
    plain = domains.same_domain_rules(rules, tables)
    kept = classes.same_domain_classes(found, tables)
    wanted = Counter((r["antecedent"], r["consequent"], r["domain"], r["support"]) for r in plain.collect())
    assert Counter((r["antecedent"], r["consequent"], r["domain"], r["support"]) for r in kept.expand().collect()) == wanted
    assert 0 < len(wanted) < rules.count()


def test_members_of_groups_need_a_domain(spark):
    rules = spark.createDataFrame([("group0", "aaaa-aaaa_u", 3)], "antecedent STRING, consequent STRING, support LONG")
    groups = spark.createDataFrame([("group0", "bbbb-bbbb_u"), ("group0", "cccc-cccc_u")], "group_id STRING, change_id STRING")
    tables = [("aaaa-aaaa", "x"), ("bbbb-bbbb", "x"), ("cccc-cccc", "y")]
    known = spark.createDataFrame(tables, "table_id STRING, domain STRING")
    assert domains.same_domain_rules(rules, known, groups).first()["domain"] == "x"
    partly = spark.createDataFrame(tables[:2], "table_id STRING, domain STRING")
    with pytest.raises(KeyError):
        domains.same_domain_rules(rules, partly, groups)
    assert domains.same_domain_rules(rules, partly, groups, strict=False).count() == 1


def test_intervals(spark):
    draw = random.Random(9)
    first = dt.date(2020, 1, 1)
    spans = [(f"p{k}", first + dt.timedelta(draw.randrange(400)), draw.randrange(-3, 200)) for k in range(25)]
    spans = [(name, start, start + dt.timedelta(days)) for name, start, days in spans] + [("none", first, None)]
    days = [(f"c{k % 7}", first + dt.timedelta(draw.randrange(600))) for k in range(300)]
    intervals = spark.createDataFrame(spans, "period STRING, start DATE, end DATE")
    occurrences = spark.createDataFrame(days, "change_id STRING, tp DATE")
    wanted = Counter((c, t, name) for c, t in days for name, s, e in spans if e is not None and s <= t <= e)
    for width in (None, 1, 1000):
        found = timeline.split_by_intervals(occurrences, intervals, width_days=width)
        assert Counter((r["change_id"], r["tp"], r["period"]) for r in found.collect()) == wanted
    domain = timeline.interval_domain(intervals)
    lengths = {name: (e - s).days + 1 for name, s, e in spans if e is not None and s <= e}
    assert {r["period"]: r["count"] for r in domain.groupBy("period").count().collect()} == lengths
    assert timeline.split_by_intervals(occurrences, intervals.limit(0)).count() == 0


def test_batches_equal_one_diff(spark, tmp_path):
    draw = random.Random(5)
    start = dt.date(2020, 1, 1)
    versions = []
    for table in ("t1", "t2", "t3"):
        for day in sorted(draw.sample(range(30), 12)):
            columns = draw.sample(["a", "b", "c", "d"], 3)
            rows = [(f"r{k}", [str(draw.randrange(3)) for _ in columns]) for k in sorted(draw.sample(range(5), 3))]
            versions.append((start + dt.timedelta(day), table, columns, rows))
    snapshots = spark.createDataFrame(versions, SNAPSHOTS)
    wanted = Counter(map(tuple, snapshot_diff.find_changes(snapshots).field_changes.collect()))
    found, state = Counter(), None
    for k, until in enumerate((10, 10, 22, 40)):
        batch = snapshots.where(F.col("snapshot_date") < F.lit(start + dt.timedelta(until)))
        changes = snapshot_diff.find_changes(batch, previous=state) if state is not None else snapshot_diff.find_changes(batch)
        found += Counter(map(tuple, changes.field_changes.collect()))
        sources.write_versions(snapshot_diff.last_versions(batch, state), str(tmp_path / f"state{k}"))
        state = sources.read_versions(spark, str(tmp_path / f"state{k}"))
    assert found == wanted


def test_snapshot_round_trip_and_bad_files(spark, tmp_path):
    rows = [(dt.date(2020, 1, 1), "a/b?", ["c1", "c2"], [("r", ["1", '"x"']), ("s", ["null", "true"])]), (dt.date(2020, 1, 2), "t", [], [])]
    snapshots = spark.createDataFrame(rows, SNAPSHOTS)
    root = str(tmp_path / "tree")
    sources.write_snapshots(snapshots, root)
    assert sorted(map(repr, sources.read_snapshots(spark, root).collect())) == sorted(map(repr, snapshots.collect()))
    assert sources.bad_snapshots(spark, root).count() == 0
    other = tmp_path / "other" / "2020-01-03"
    other.mkdir(parents=True)
    (other / "good.json?").write_text('{"attributes": [{"id": "c"}], "rows": [{"id": "r", "fields": [1]}]}')
    (other / "broken.json?").write_text('{"attributes": [')
    undated = tmp_path / "other" / "undated"
    undated.mkdir()
    (undated / "lost.json?").write_text('{"attributes": [], "rows": []}')
    assert [r["table_id"] for r in sources.read_snapshots(spark, str(tmp_path / "other")).collect()] == ["good"]
    bad = {(r["file"].rsplit("/", 1)[1], r["reason"]) for r in sources.bad_snapshots(spark, str(tmp_path / "other")).collect()}
    assert {reason for _, reason in bad} == {"not a document", "no date"} and len(bad) == 2


def test_a_run_is_replaced(spark, tmp_path):
    rules = spark.createDataFrame(
        [("a", "b", 1, 1.0, 0.5, [1, 0], "p"), ("b", "c", 2, 1.0, 0.5, [1, 1], "q")],
        "antecedent STRING, consequent STRING, support LONG, confidence DOUBLE, lift DOUBLE, hist ARRAY<INT>, period STRING",
    )
    path = str(tmp_path / "rules")
    sources.write_rules(rules, path, run="one")
    sources.write_rules(rules.where("period = 'p'"), path, run="one")
    sources.write_rules(rules, path, run="two")
    read = sources.read_rules(spark, path)
    assert Counter(r["run"] for r in read.collect()) == {"one": 1, "two": 2}
