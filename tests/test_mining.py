"""Rule mining against a day-by-day brute force, hand-made cases, and planted rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from echolag.operators import interest, mining, validation


def brute_force(changes, n_points, bins, min_sup, max_sup, min_conf, boundary=True, tail=True):
    """Walk the days of every pair separately."""
    least, most = math.ceil(min_sup * n_points), math.floor(max_sup * n_points)
    kept = {c: sorted(o) for c, o in changes.items() if least <= len(o) <= most}
    rules = {}
    for a, a_days in kept.items():
        for c, c_days in kept.items():
            if a == c:
                continue
            hist, opened, first = [0] * bins, None, None
            for day in range(n_points):
                if day in a_days:
                    # the old opening ends on this very day and takes the new one with it
                    lost = boundary and opened is not None and day - opened == bins
                    opened = None if lost else day
                elif opened is not None and day - opened >= bins:
                    opened = None
                if day in c_days and opened is not None:
                    earlier = [d for d in c_days if d < day]
                    if not earlier or earlier[-1] < opened:
                        hist[day - opened] += 1
                        first = day if first is None else first
            support = sum(hist)
            if support == 0 or support < least or support / len(a_days) < min_conf:
                continue
            if tail and n_points - first < bins:
                continue
            rules[a, c] = (support, support / len(a_days), support / (len(a_days) * len(c_days)), hist)
    return rules


def frames(spark, changes, n_points):
    rows = [(c, t) for c, tps in changes.items() for t in tps]
    occurrences = spark.createDataFrame(rows, "change_id STRING, tp INT")
    timepoints = spark.range(n_points).select(F.col("id").cast("int").alias("tp"), F.col("id").cast("int").alias("tp_idx"))
    return occurrences, timepoints


def as_dict(rules):
    return {(r.antecedent, r.consequent): (r.support, r.confidence, r.lift, r.hist) for r in rules.collect()}


def mine(spark, changes, n_points, bins, **kw):
    occurrences, timepoints = frames(spark, changes, n_points)
    return as_dict(mining.mine_rules(occurrences, timepoints, num_bins=bins, **kw))


@pytest.fixture(params=["blocks", "points", "grid", "words", "bitmaps"])
def layout(request, monkeypatch):
    """Each physical layout of the join; the limits are set so low that cells, grids and member chunks are in use."""
    monkeypatch.setattr(mining, "CELL_ROWS", 500)
    if request.param == "grid":
        monkeypatch.setattr(mining, "POINT_ROWS", 3)
        monkeypatch.setattr(mining, "MEMBER_CHUNK", 2)
    return request.param if request.param in ("blocks", "words", "bitmaps") else "points"


@pytest.mark.parametrize("seed", range(2))
def test_random_against_brute_force(spark, layout, seed):
    rng = random.Random(seed)
    n_points, bins = rng.choice([(20, 4), (40, 5), (60, 7), (64, 9), (150, 6)])
    changes = {f"c{i}": set(rng.sample(range(n_points), rng.randint(1, n_points // 2))) for i in range(18)}
    # gaps of exactly one window, copies, and a point that everything shares
    changes["run"] = set(range(0, n_points, bins))
    for i in range(5):
        changes[f"copy{i}"] = set(changes["c0"])
    for i in range(9):
        changes[f"c{i}"].add(n_points // 2)
    for min_sup, max_sup, min_conf in ((0.0, 1.0, 0.0), (0.05, 0.6, 0.5), (0.1, 0.5, 0.9)):
        for boundary in (True, False) if min_conf == 0.5 else (True,):
            tail = boundary
            expected = brute_force(changes, n_points, bins, min_sup, max_sup, min_conf, boundary, tail)
            got = mine(
                spark,
                changes,
                n_points,
                bins,
                min_sup=min_sup,
                max_sup=max_sup,
                min_conf=min_conf,
                boundary_expiry=boundary,
                tail_prune=tail,
                layout=layout,
            )
            assert got == expected


WIDE = {"min_sup": 0.0, "max_sup": 1.0}


def test_lag_zero(spark):
    got = mine(spark, {"A": [3, 9, 15], "C": [3, 9, 15]}, 30, 5, min_conf=0.0, **WIDE)
    assert got["A", "C"][3] == [3, 0, 0, 0, 0] and got["C", "A"][3] == [3, 0, 0, 0, 0]


def test_consumed_antecedent(spark):
    got = mine(spark, {"A": [3], "C": [4, 5]}, 30, 5, min_conf=0.0, **WIDE)
    assert got["A", "C"][0] == 1 and got["A", "C"][3] == [0, 1, 0, 0, 0]


def test_most_recent_antecedent(spark):
    got = mine(spark, {"A": [3, 5], "C": [6]}, 30, 5, min_conf=0.0, **WIDE)
    assert got["A", "C"][1] == 0.5 and got["A", "C"][3] == [0, 1, 0, 0, 0]


def test_boundary_expiry(spark):
    changes = {"A": [0, 5, 10], "C": [1, 6, 11]}
    assert mine(spark, changes, 30, 5, min_conf=0.0, **WIDE)["A", "C"][3][1] == 2
    assert mine(spark, changes, 30, 5, min_conf=0.0, boundary_expiry=False, **WIDE)["A", "C"][3][1] == 3


def test_tail_rule(spark):
    changes = {"A": [27], "C": [28]}
    assert ("A", "C") not in mine(spark, changes, 30, 5, min_conf=0.0, **WIDE)
    assert ("A", "C") in mine(spark, changes, 30, 5, min_conf=0.0, tail_prune=False, **WIDE)


def test_out_of_domain(spark):
    got = mine(spark, {"A": [3, 40], "C": [4]}, 30, 5, min_conf=0.5, **WIDE)
    assert got["A", "C"][:2] == (1, 0.5)


def test_single_change_has_no_rule(spark):
    assert mine(spark, {"A": [3, 9]}, 30, 5, min_conf=0.0, **WIDE) == {}


def test_rules_stay_within_by(spark):
    rows = [("x", "A", 3), ("x", "B", 3), ("y", "A", 3), ("y", "C", 4)]
    occurrences = spark.createDataFrame(rows, "part STRING, change_id STRING, tp INT")
    timepoints = spark.range(30).selectExpr("int(id) tp", "int(id) tp_idx")
    rules = mining.mine_rules(occurrences, timepoints, num_bins=5, min_sup=0, max_sup=1, min_conf=0, by=["part"])
    got = {(r.part, r.antecedent, r.consequent) for r in rules.collect()}
    assert got == {("x", "A", "B"), ("x", "B", "A"), ("y", "A", "C")}


def test_whitelist(spark):
    occurrences, _ = frames(spark, {"song_a_1_u": [1], "film_a_2_u": [1]}, 3)
    templates = spark.createDataFrame([("song",)], "template STRING")
    kept = mining.whitelist_templates(occurrences, templates)
    assert [r.change_id for r in kept.collect()] == ["song_a_1_u"]


# stored goldens: pair → support, confidence, histogram (500 time points, 7 bins), with the score derived from GENERAL
INJECTED = {
    ("inject_0", "inject_1"): (83, 1.0, [0, 0, 83, 0, 0, 0, 0], 1.7504973004),
    ("inject_2", "inject_3"): (72, 0.972972972972973, [0, 38, 0, 34, 0, 0, 0], 1.5224654228),
    ("inject_4", "inject_5"): (64, 0.9696969696969697, [0, 0, 32, 0, 0, 32, 0], 1.7226663468),
    ("inject_6", "inject_7"): (49, 0.9074074074074074, [0, 0, 20, 0, 0, 29, 0], 1.7327296491),
    ("inject_8", "inject_9"): (69, 0.9583333333333334, [0, 0, 0, 0, 0, 69, 0], 1.9429112127),
}
GENERAL = [
    0.4420454545454545,
    0.2474025974025974,
    0.14253246753246754,
    0.08262987012987014,
    0.040584415584415584,
    0.029383116883116882,
    0.015422077922077922,
]


def realise(hist, n_a, step, n_points=500):
    """Occurrence lists with a given histogram: unmatched antecedents come last, after the last consequent."""
    lags = [lag for lag, count in enumerate(hist) for _ in range(count)]
    starts = [i * step for i in range(n_a)]
    assert starts[-1] < n_points
    return starts, [start + lag for start, lag in zip(starts, lags)]


def test_planted_rules(spark):
    rng = random.Random(7)
    changes = {}
    for (a, c), (support, confidence, hist, _) in INJECTED.items():
        n_a = round(support / confidence)
        changes[a], changes[c] = realise(hist, n_a, 6)
        assert max(changes[c]) < 500
    # rejected pairs: the antecedent is matched too seldom
    changes["reject_0"], changes["reject_1"] = realise([0, 0, 47, 0, 0, 0, 0], 72, 6)
    for i in range(40):
        changes[f"noise_{i}"] = sorted(rng.sample(range(500), rng.randint(25, 60)))
    occurrences, timepoints = frames(spark, changes, 500)
    rules = mining.mine_rules(occurrences, timepoints, num_bins=7, min_sup=0.05, max_sup=0.4, min_conf=0.9).cache()
    planted = spark.createDataFrame(
        [(a, c, s, f, h) for (a, c), (s, f, h, _) in INJECTED.items()],
        "antecedent STRING, consequent STRING, support BIGINT, confidence DOUBLE, hist ARRAY<INT>",
    )
    status = validation.check_injected(rules, planted).collect()
    assert {r.status for r in status} == {"ok"} and len(status) == 5
    rejected = spark.createDataFrame([("reject_0", "reject_1")], "antecedent STRING, consequent STRING")
    assert validation.check_rejected(rules, rejected).count() == 0
    changed = planted.withColumn("support", F.col("support") + 1)
    assert {r.status for r in validation.check_injected(rules, changed).collect()} == {"support"}

    general = spark.createDataFrame(list(enumerate(GENERAL)), "bin INT, p DOUBLE")
    scored = interest.score_rules(rules, general, 500, 0.9, 0.05, 0.4)
    scores = {(r.antecedent, r.consequent): r.score for r in scored.collect()}
    for pair, golden in INJECTED.items():
        assert scores[pair] == pytest.approx(golden[3], abs=1e-9)
    assert validation.injected_in_top(scored, planted, 1000).count() == 5


def test_busy_points_are_not_probed(spark):
    """A day that every change shares costs the most pairs, and the rules can be told without it."""
    rng = random.Random(2)
    busy = 50
    changes = {f"c{i}": {busy, *rng.sample(range(45), 9)} for i in range(60)}
    occurrences, timepoints = frames(spark, changes, 60)
    profile = mining.within_support(mining.profile_changes(occurrences, timepoints), 0.0, 1.0)
    classes, _ = mining.position_classes(profile, [], 3)
    probes = mining._probes(classes, [], 3, 0.9, mining.EXTRA_PROBES)
    # only changes whose other days are nearly as busy may still join it
    assert probes.count() > 300 and probes.where(F.col("idx") == busy).count() < 6
    assert mine(spark, changes, 60, 3, min_sup=0.0, max_sup=1.0, min_conf=0.9) == brute_force(
        changes, 60, 3, 0.0, 1.0, 0.9
    )


def test_copies_are_mined_once(spark):
    changes = {f"copy{i}": [3, 9, 15, 21] for i in range(50)} | {"other": [4, 10, 16, 22]}
    occurrences, timepoints = frames(spark, changes, 30)
    profile = mining.within_support(mining.profile_changes(occurrences, timepoints), 0.0, 1.0)
    found = mining.mine_profile(profile, num_bins=5, min_conf=0.9)
    # copies → copies, copies → other, other → copies falls short (three of four)
    assert found.rules.count() == 2
    assert found.expand().count() == 50 * 49 + 50
