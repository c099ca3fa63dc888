"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from echolag.llm import exact_dedup, minhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, size):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def expected_groups(rows, size, percent=80):
    """Component of each id by comparing all pairs."""
    sets = defaultdict(list)
    for doc, text in rows:
        if doc is not None:
            sets[doc].append(shingles(text, size))
    least = {doc: doc for doc in sets}

    def near(a, b):
        return any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])

    links = [(a, b) for a in sets for b in sets if a < b and near(a, b)]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def noisy_copies(seed, n=120):
    """Chains of copies, each with a few words changed, some texts very short."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and draw.random() < 0.75:
            copy = draw.choice(texts[-20:]).split()
            for _ in range(draw.randint(0, 1 + len(copy) // 12)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(draw.choices(words, k=draw.choice([1, 2, 3, 6, 30, 60]))))
    ids = draw.sample(range(1000), n)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("cell", "size"), [(400_000, 2), (150, 2), (150, 5)])
def test_near_groups_against_all_pairs(spark, cell, size):
    rows = noisy_copies(cell + size)
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=size, cell_shingles=cell)
    wanted = expected_groups(rows, size)
    text = dict(rows)
    for row in found.collect():
        assert row["component_id"] == wanted[row["doc_id"]]
        assert row["kept"] == (row["doc_id"] == row["component_id"])
        assert row["n_shingles"] == len(shingles(text[row["doc_id"]], size))


def test_near_groups_of_odd_rows(edges, none):
    rows = minhash.near_groups(edges).select("doc_id", "n_shingles", "component_id", "kept").collect()
    wanted = expected_groups([(r["doc_id"], r["text"]) for r in edges.collect()], 2)
    assert len(rows) == edges.count()
    for row in rows:
        assert row["component_id"] == wanted.get(row["doc_id"])
    assert wanted[2] == wanted[3] == 1
    assert {r["doc_id"]: r["n_shingles"] for r in rows}[4] == 0
    assert minhash.near_groups(none).count() == 0
    kept = minhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 10])


def test_repeated_ids(spark):
    """Rows of one id whose other text is null, blank, equal or different; only its own sets are compared."""
    base = " ".join(f"w{k}" for k in range(60))
    near, other = base.replace("w7 ", "x7 "), " ".join(f"z{k}" for k in range(50))
    rows = [(1, base), (2, near), (2, None), (3, " \n"), (3, near + " more"), (4, other), (4, base), (5, other), (6, base), (6, base)]
    rows += [(9, None), (9, "")]
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = expected_groups(rows, 2)
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted((d, wanted[d] if (t or "").split() else d) for d, t in rows)
    assert wanted[5] == 1 and wanted[9] == 9


def test_cells_of_many_short_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_TEXTS", 7)
    rows = noisy_copies(11, 90)
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    wanted = expected_groups(rows, 2)
    assert all(r["component_id"] == wanted[r["doc_id"]] for r in found.collect())


def test_one_row_of_a_table_read_twice_stays(spark, tmp_path):
    rows = noisy_copies(2, 60)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row_number int")
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    twice = read.unionByName(read)
    for drop in (exact_dedup.drop_copies, minhash.keep_one):
        once = Counter(r["doc_id"] for r in drop(read).collect())
        assert Counter(r["doc_id"] for r in drop(twice).collect()) == once
        assert max(once.values()) == 1 and drop(twice).columns == docs.columns
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup.drop_copies(nameless).collect()] == [3]


def test_cluster_equals_all_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 60, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([draw.permutation(base)[:30], draw.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in range(12)]
    roots = minhash.cluster(sets, 60)
    least = expected_groups([], 2)
    least = list(range(len(sets)))
    near = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
    ]
    while any(least[a] != least[b] for a, b in near):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert all((roots[a] == roots[b]) == (least[a] == least[b]) for a in range(12) for b in range(12))


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(5)
    agree = []
    for _ in range(200):
        values = draw.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = minhash.signature(np.unique(values[:81])), minhash.signature(np.unique(values[9:]))
        agree.append((a == b).mean())
        assert len(a) == 2 * minhash.PERMUTATIONS
    assert abs(np.mean(agree) - 0.8) < 0.01


def test_exact_groups(edges, none):
    rows = edges.collect()
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", row["text"] or "")].append(row["doc_id"])
    wanted = Counter()
    for body, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            wanted[i, least, len(ids), i == least, hashlib.sha256(body.encode()).hexdigest()] += 1
    found = exact_dedup.find_copies(edges)
    assert Counter(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == wanted
    assert exact_dedup.find_copies(none).count() == 0
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9, 10]


def test_many_copies_leave_a_task_once(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot text', concat('t', id)) AS text")
    found = exact_dedup.find_copies(rows)
    assert found.where("group_size = 6667 AND keep_id = 0").count() == 6667
    assert found.where("group_size = 1 AND kept").count() == 20_000 - 6667


def test_directory_splits_overfull_buckets_only():
    depth, slots = exact_dedup.directory({0: 10, 1: 1, 2: 0, 3: 3}, 2, 5)
    assert (depth, slots) == (2, [0, 1, 2, 2])
    assert exact_dedup.directory({}, 0, 5) == (0, [0])
    # the deepest level takes what is left
    assert exact_dedup.directory({0: 100}, 1, 5) == (1, [0, 1])


def test_buckets_decide_owners(spark, monkeypatch):
    """Buckets split, overflow at the deepest level, and belong to one owner each."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 20)
    rows = spark.range(3_000).selectExpr("id AS doc_id", "concat('t', id % 1000) AS text")
    for deepest in (18, 3):
        monkeypatch.setattr(exact_dedup, "MAX_DEPTH", deepest)
        light, index = exact_dedup.build_index(rows)
        sizes = index.groupBy("bucket").count().collect()
        assert len(sizes) > 40 if deepest == 18 else len(sizes) == 8
        assert (max(r["count"] for r in sizes) <= 20) == (deepest == 18)
        owners = {(r["bucket"], r["owner"]) for r in index.select("bucket", "owner").collect()}
        assert len(owners) == len({b for b, _ in owners}) and len({o for _, o in owners}) == 8
        assert light.join(index, ["bucket", "key"]).count() == 3_000
        found = exact_dedup.find_copies(rows)
        assert found.where("group_size = 3 AND keep_id = doc_id % 1000").count() == 3_000
