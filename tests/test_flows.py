"""The two flows end to end."""

import datetime as dt
import json

from pyspark.sql import functions as F

from echolag import plans
from echolag.schemas import SNAPSHOTS


def test_rules_from_snapshots(spark):
    start = dt.date(2020, 1, 1)
    versions = []
    # a background table sees to it that every day is observed
    for d in range(60):
        versions.append((start + dt.timedelta(d), "back-grou", ["a"], [("r", [str(d)])]))
    # the second table follows the first a day later, the third happens together with the first
    for i, d in enumerate((0, 7, 16, 22, 33, 40)):
        for table, shift in (("aaaa-aaaa", 0), ("bbbb-bbbb", 1), ("cccc-cccc", 0)):
            versions.append((start + dt.timedelta(d + shift), table, ["a"], [("r", [str(i)])]))
    snapshots = spark.createDataFrame(versions, SNAPSHOTS)
    mapping = spark.createDataFrame(
        [("aaaa-aaaa", "x"), ("bbbb-bbbb", "x"), ("cccc-cccc", "y"), ("back-grou", "x")], "table_id STRING, domain STRING"
    )
    found = plans.rules_from_snapshots(snapshots, table_domains=mapping, num_bins=5, rule_support=(0.05, 0.5))
    got = {(r.antecedent, r.consequent): (r.support, r.hist, r.domain) for r in found.rules.collect()}
    members = {}
    for r in found.groups.collect():
        members.setdefault(r.group_id, set()).add(r.change_id)
    together = next(g for g, m in members.items() if m == {"aaaa-aaaa_u", "cccc-cccc_u"})
    # five updates each; the table inserts occur once and are too rare
    assert got[together, "bbbb-bbbb_u"] == (5, [0, 5, 0, 0, 0], "x")
    assert found.scored.count() >= 1


def test_rules_from_edits(spark, tmp_path):
    lines = []
    for d in range(60):
        day = dt.datetime(2016, 1, 5, 8) + dt.timedelta(days=8 * d)
        for key, page, shift in (("k1", "p1", 0), ("k2", "p2", 3)):
            lines.append(
                {
                    "template": "Infobox song",
                    "validFrom": (day + dt.timedelta(hours=shift)).isoformat() + "Z",
                    "type": "UPDATE",
                    "key": key,
                    "pageID": page,
                    "pageTitle": f"Title {page}",
                    "changes": [{"property": {"name": "genre"}, "previousValue": "a", "currentValue": "b"}],
                }
            )
    path = tmp_path / "edits.json"
    path.write_text("\n".join(json.dumps(line) for line in lines))
    from echolag.sources import read_edits

    listed = spark.createDataFrame([("media", "infobox-song")], "category STRING, template STRING")
    found = plans.rules_from_edits(read_edits(spark, str(path)), whitelist=listed)
    merged = found.merged.where(F.col("antecedent_page_id") == "p1").collect()
    assert {(r.consequent_page_name, r.support, r.hist[3]) for r in merged} == {("Title p2", 60, 60)}
    assert {r.page_id for r in found.clusters.collect()} == {"p1", "p2"}
