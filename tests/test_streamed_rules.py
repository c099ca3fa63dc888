"""Rules of a short domain: worked out in cells where they are read, and neither kept nor moved."""

import random

from pyspark.sql import functions as F

from echolag import session
from echolag.operators import classes, interest, mining

N_POINTS = 30


def _dense(spark, copies=3, users=25):
    """Busy changes that meet almost everywhere, some of them copies of each other."""
    draw = random.Random(11)
    rows = []
    for k in range(users):
        points = draw.sample(range(N_POINTS), draw.randint(4, 14))
        rows += [(f"g{k % 2}", f"k{k}_{copy}", t) for copy in range(1 + k % copies) for t in points]
    occurrences = spark.createDataFrame(rows, "g STRING, change_id STRING, tp INT")
    return occurrences, spark.range(N_POINTS).select(F.col("id").cast("int").alias("tp"), F.col("id").cast("int").alias("tp_idx"))


def _as_set(rules):
    rows = [(*r[:-1], tuple(r[-1])) for r in rules.select(*[c for c in rules.columns if c != "hist"], "hist").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_cells_joined_as_a_whole(spark, monkeypatch):
    """The same rules as by time point, also in many cells, by group, for several windows, and with classes in chunks."""
    occurrences, points = _dense(spark)
    monkeypatch.setattr(mining, "CELL_CLASSES", 4)
    monkeypatch.setattr(mining, "MEMBER_CHUNK", 2)
    bounds = {"num_bins": 5, "min_sup": 0.0, "max_sup": 1.0, "min_conf": 0.6}
    for by, flags in (([], {}), (["g"], {"boundary_expiry": False, "tail_prune": False})):
        plain = _as_set(mining.mine_rules(occurrences, points, by=by, layout="points", **bounds, **flags))
        assert plain and plain == _as_set(mining.mine_rules(occurrences, points, by=by, layout="whole", **bounds, **flags))
    profile = mining.within_support(mining.profile_changes(occurrences, points, ["g"]), 0.0, 1.0)
    found = [mining.mine_profile(profile, num_bins=[3, 6], min_conf=0.6, by=["g"], layout=x).expand() for x in ("points", "whole")]
    assert _as_set(found[0]) == _as_set(found[1])


def test_rules_are_neither_kept_nor_moved(spark, monkeypatch):
    """Nothing that grows with the rules is written or shuffled on the way to rules of changes."""
    occurrences, points = _dense(spark)
    written = []
    kept = session.materialize
    monkeypatch.setattr(mining, "materialize", lambda df, label: written.append(label) or kept(df, label))
    rules = mining.mine_rules(occurrences, points, num_bins=5, min_sup=0.0, max_sup=1.0, min_conf=0.6)
    assert "class-rules" not in written
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    # both sides move to their cells; what follows the join of these two does not move
    assert plan.count("RepartitionByExpression") == 2 and plan.count("Join Inner") == 1 and "explode(places" not in plan


def test_sample_and_scores_of_rules_worked_out_again(spark):
    occurrences, points = _dense(spark)
    bounds = {"num_bins": 5, "min_sup": 0.0, "max_sup": 1.0, "min_conf": 0.6}
    found = mining.mine_classes(occurrences, points, layout="whole", **bounds)
    rules = mining.mine_rules(occurrences, points, layout="points", **bounds).cache()
    best = F.struct((-F.col("support")).alias("s"), "consequent")
    general = interest.general_pdf(interest.sample_rules(rules, N_POINTS, 0.6, 0.0, 1.0, rank=best), 5)
    assert interest.general_pdf(classes.sample_class_rules(found, N_POINTS, 0.6, 0.0, 1.0), 5).collect() == general.collect()
    plain = interest.score_rules(rules, general, N_POINTS, 0.6, 0.0, 1.0).select("antecedent", "consequent", "score")
    scored = classes.score_class_rules(found, general, N_POINTS, 0.6, 0.0, 1.0)
    assert set(scored.expand().select("antecedent", "consequent", "score").collect()) == set(plain.collect())
