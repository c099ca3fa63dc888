"""Cells worked out in arrays: the same rules as by the joins, on domains of any length, and nothing kept that grows with them."""

import random

import pytest
from pyspark.sql import functions as F

from echolag import session
from echolag.operators import classes, components, domains, merge, mining


def _changes(spark, n_points, users, most, seed=5, copies=3):
    draw = random.Random(seed)
    rows = []
    for k in range(users):
        points = draw.sample(range(n_points), draw.randint(2, most))
        rows += [(f"g{k % 2}", f"k{k}_{copy}", t) for copy in range(1 + k % copies) for t in points]
    # a run of gaps of one window, and an occurrence outside the domain
    rows += [("g0", "run", t) for t in range(0, n_points, 4)] + [("g1", "k1_0", n_points + 5), (None, "k0_0", 1), (None, "k1_0", 1)]
    occurrences = spark.createDataFrame(rows, "g STRING, change_id STRING, tp INT")
    return occurrences, spark.range(n_points).select(F.col("id").cast("int").alias("tp"), F.col("id").cast("int").alias("tp_idx"))


def _as_set(rules):
    rows = [(*r[:-1], tuple(r[-1])) for r in rules.select(*[c for c in rules.columns if c != "hist"], "hist").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("n_points, most", [(30, 14), (150, 40)])
def test_same_rules_as_by_time_point(spark, monkeypatch, n_points, most):
    occurrences, points = _changes(spark, n_points, 30, most)
    monkeypatch.setattr(mining, "ARRAY_ROWS", 24)
    monkeypatch.setattr(mining, "MEMBER_CHUNK", 2)
    bounds = {"num_bins": 4, "min_sup": 0.0, "max_sup": 1.0, "min_conf": 0.5}
    for by, flags in (([], {}), (["g"], {"boundary_expiry": False, "tail_prune": False}), (["g"], {"min_sup": 0.06, "min_conf": 0.0})):
        plain, arrays = (
            _as_set(mining.mine_rules(occurrences, points, by=by, layout=x, **{**bounds, **flags})) for x in ("points", "arrays")
        )
        assert plain and plain == arrays
    profile = mining.within_support(mining.profile_changes(occurrences, points, ["g"]), 0.0, 1.0)
    plain, arrays = (
        _as_set(mining.mine_profile(profile, num_bins=[3, 6], min_conf=0.4, by=["g"], layout=x).expand()) for x in ("points", "arrays")
    )
    assert plain and plain == arrays


def test_long_domains_are_not_kept_either(spark, monkeypatch):
    """Many pairs that meet mostly are worked out where they are read, also on more than 64 positions."""
    occurrences, points = _changes(spark, 100, 160, 30)
    written = []
    kept = session.materialize
    monkeypatch.setattr(mining, "materialize", lambda df, label: written.append(label) or kept(df, label))
    found = mining.mine_classes(occurrences, points, num_bins=6, min_sup=0.0, max_sup=1.0, min_conf=0.8)
    assert found.mined is not None and found.mined.arrays
    rules = found.expand()
    assert not {"class-rules", "candidates"} & set(written)
    assert rules._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    plain = mining.mine_rules(occurrences, points, num_bins=6, min_sup=0.0, max_sup=1.0, min_conf=0.8, layout="points")
    assert _as_set(rules) == _as_set(plain)
    assert set(found.narrow(["sig_a", "support"]).columns) == {"sig_a", "support"}


def test_few_pairs_that_meet_are_joined(spark):
    """Pairs that hardly ever meet are not compared in full."""
    rows = [(f"c{k}_{copy}", t) for k in range(400) for copy in range(2) for t in (k, k + 1)]
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp INT")
    points = spark.range(401).select(F.col("id").cast("int").alias("tp"), F.col("id").cast("int").alias("tp_idx"))
    found = mining.mine_classes(occurrences, points, num_bins=2, min_sup=0.0, max_sup=1.0, min_conf=0.9)
    assert found.mined is None and found.rules.count() > 0


@pytest.fixture(scope="module")
def paged(spark):
    """Rules between classes in arrays, the same rules written out, and pages; one key has two pages."""
    draw = random.Random(2)
    lists = [sorted(draw.sample(range(40), draw.randint(3, 12))) for _ in range(12)]
    rows = [(f"tableid{(k + copy) % 4:02d}_{k}x{copy}_u", t) for k, points in enumerate(lists) for copy in range(1 + k % 3) for t in points]
    rows.append(("tableid09_alone_u", 39))
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp INT")
    points = spark.range(40).select(F.col("id").cast("int").alias("tp"), F.col("id").cast("int").alias("tp_idx"))
    bounds = {"num_bins": 5, "min_sup": 0.0, "max_sup": 1.0, "min_conf": 0.6}
    found = mining.mine_classes(occurrences, points, layout="arrays", **bounds)
    rules = mining.mine_rules(occurrences, points, layout="points", **bounds).cache()
    keys = sorted({row[0].split("_")[1] for row in rows} - {"alone"})
    pages = [(key, f"p{at % 5}") for at, key in enumerate(keys)]
    names = spark.createDataFrame([(f"p{k}", f"Page {k}") for k in range(5)], "page_id STRING, page_name STRING")
    return found, rules, occurrences, pages, names


def _rows(frame, columns):
    found = [tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in frame.select(*columns).collect()]
    return sorted(found, key=repr)


def test_pages_move_along_with_changes(spark, paged):
    """Merged, listed and clustered rules are the same as from rules that are written out; only what is in a rule needs a page."""
    found, rules, occurrences, pages, names = paged
    hourly = occurrences.withColumn("tp", F.format_string("2024-01-%02dT00", F.col("tp") % 28 + 1))
    for more in ([], [(pages[0][0], "p4")]):
        keyed = spark.createDataFrame(pages + more, "key STRING, page_id STRING")
        plain = merge.merge_rules(rules, keyed, names)
        merged = merge.merge_rules(found, keyed, names)
        assert sorted(merged.columns) == sorted(plain.columns) and _rows(plain, plain.columns)
        assert _rows(merged, plain.columns) == _rows(plain, plain.columns)
        kept = merge.merge_set(found, keyed, names)
        assert isinstance(kept, merge.MergedSet)
        listed = merge.list_external(plain, hourly)
        assert _rows(merge.list_external(kept, hourly), listed.columns) == _rows(listed, listed.columns)
        clusters = merge.rule_clusters(plain)
        assert _rows(merge.rule_clusters(kept), clusters.columns) == _rows(clusters, clusters.columns)
        named = _rows(merge.cluster_pages(plain, clusters), ["component", "page_id", "page_name"])
        assert _rows(merge.cluster_pages(kept, merge.rule_clusters(kept)), ["component", "page_id", "page_name"]) == named
        known = found.members.where("NOT change_id LIKE '%alone%'")
        split = classes.merge_classes(mining.RuleSet(found.rules, known, found.by, found.mined), keyed, names, wanted=[])
        assert _rows(classes.cluster_pages(split), ["component", "page_id", "page_name"]) == named
        assert _rows(classes.rule_clusters(split), clusters.columns) == _rows(clusters, clusters.columns)
        assert classes.external_rate(split).collect() == merge.external_rate(plain).collect()
    with pytest.raises(KeyError):
        merge.merge_set(found, spark.createDataFrame(pages[1:], "key STRING, page_id STRING"), names)
    with pytest.raises(KeyError):
        merge.list_external(kept, hourly.where("NOT change_id LIKE '%_0x0_%'"))


def test_domains_move_along_with_changes(spark, paged):
    found, rules, *_ = paged
    tables = spark.createDataFrame([(f"tableid{k:02d}", f"d{k // 2}") for k in range(4)], "table_id STRING, domain STRING")
    plain = domains.same_domain_rules(rules, tables)
    # the change that is in no rule has no domain
    assert _rows(domains.same_domain_rules(found, tables), plain.columns) == _rows(plain, plain.columns)
    tables = tables.union(spark.createDataFrame([("tableid09", "d0")], tables.schema))
    kept = domains.same_domain_rules(found, tables)
    assert _rows(kept, plain.columns) == _rows(plain, plain.columns) and 0 < kept.count() < rules.count()
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_contracted_edges_connect_the_same(spark, monkeypatch):
    draw = random.Random(4)
    edges = [(f"v{draw.randrange(90)}", f"v{draw.randrange(90)}") for _ in range(70)] + [("loop", "loop"), (None, "v1"), ("v2", None)]
    frame = spark.createDataFrame(edges, "src STRING, dst STRING").repartition(3)
    plain = components.connected_components(frame)
    for most in (10, 1_000):
        monkeypatch.setattr(components.cells, "CONTRACT_EDGES", most)
        few = components.contract(frame)
        assert _rows(components.connected_components(few), plain.columns) == _rows(plain, plain.columns)
        assert few.where("src = dst").count() == 1
