"""Spelling variants, whitening and personal data: by brute force and by hand."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolag.llm import personal, variants, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            digest = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if digest % 97 == 0:
                run = run[: digest % len(run)] + run[digest % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    others = {w: sorted((o for o in words if near(w, o)), key=lambda o: (-words[o], o)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 2 * words[w] else None for w, o in others.items()}

    def root(word):
        return root(form[word]) if form[word] else word

    return sorted((w, form[w], root(w), n, len(others[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_variants(spark, edges, none):
    base = ["colour", "color", "colours", "honour", "honor", "aaaaa", "aaaaaa", "aaaaaaa", "abaaa", "résumé", "resumé", "thing"]
    rows = []
    for k, word in enumerate(base):
        rows += [(100 + k, f"{word} {word.capitalize()}. {word}"), (200 + k, " ".join([word] * (k * k % 17)))]
    rows += [(300 + k, "colour " * 9 + "colur colur") for k in range(5)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs = edges.select("doc_id", "text", "kept", "key").unionByName(extra.selectExpr("*", "3 AS kept", "'k' AS key").select("doc_id", "text", "kept", F.lit(1).alias("key")))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted(tuple(r) for r in variants.group_variants(docs).select(columns).collect())
    expected = variants_of((r["doc_id"], r["text"]) for r in docs.collect())
    assert found == expected and any(r[1] for r in found)
    assert variants.group_variants(none).count() == 0


def test_every_edit_keeps_a_common_key():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcd"), rng.integers(5, 13)))
        grams = [word[k : k + 2] for k in range(len(word) - 1)] + ["^" + word[0], word[-1] + "$"]
        frequent = {g for g in grams + ["ab", "bc", "dd"] if rng.random() < 0.6}
        at, letter = int(rng.integers(len(word))), str(rng.choice(list("abcd")))
        replaced = word[:at] + letter + word[at + 1 :]
        inserted = word[:at] + letter + word[at:]
        own, gaps = (set(k) for k in variants.edit_keys(word, frequent))
        assert own & set(variants.edit_keys(replaced, frequent)[0])
        assert gaps & set(variants.edit_keys(inserted, frequent)[0])


def test_no_edit_affects_all_grams():
    for length in range(5, 15):
        marked = "^" + "x" * length + "$"
        for frequent in (set(), {"xx", "^x", "x$"}, {"xx"}):
            grams = variants.decompose(marked, frequent)
            for at in range(1, len(marked)):
                for gap in (False, True):
                    left, right = variants.unaffected(grams, at, gap)
                    assert left > 0 or right < len(grams)


def whitened_by_numpy(vectors, count=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return x, n, sums, values, (x - sums / n) @ axes[:, :count] / np.sqrt(values[:count])


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_whitening(spark, block_rows):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 1, (150, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    data[100:] = data[99]
    rows = [(k, [float(np.float32(v)) for v in row], 1) for k, row in enumerate(data)]
    bad = [(500, None, 1), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (502, [1.0, float("nan")] + [0.0] * 4, 1), (503, [float("-inf")] * 6, 1)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x int")
    found = whitening.whiten(vectors, block_rows=block_rows).collect()
    x, n, sums, values, expected = whitened_by_numpy([r[1] for r in rows])
    assert len(found) == 4 * 150 and n == 100
    signs = {}
    for r in found:
        k, c = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == int(((n * x[k] - sums) ** 2).sum())
        sign = signs.setdefault(c, np.sign(r["whitened"] * expected[k, c]))
        assert abs(r["whitened"] - sign * expected[k, c]) < 1e-9
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-12
        assert r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id string, embedding array<float>"
    none = whitening.whiten(spark.createDataFrame([], schema))
    assert none.count() == 0
    same = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 2.0])], schema))
    assert same.schema == none.schema or [f.dataType for f in same.schema] == [f.dataType for f in none.schema]
    rows = same.collect()
    assert len(rows) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {
        (1, 0, None, None, None)
    }
    # a short vector counts as filled up with zeros; components without variance have no value
    rows = whitening.whiten(spark.createDataFrame([("a", [1.0]), ("b", [0.0, 0.0, 1.0]), ("b", [3e38] * 3)], schema)).collect()
    assert len(rows) == 9 and {r["component"] for r in rows if r["whitened"] is None} <= {2, 3}
    line = whitening.whiten(spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0, 2.0]), ("c", [4.0, 4.0])], schema)).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2}
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-9 and r["identity_error"] < 1e-9 for r in line)


# the base patterns as the contract writes them
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_of(text):
    found = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        matches = re.finditer(pattern, text or "")
        found += [(m.start(), number, m.end()) for m in matches if passes(kind, m.group())]
    return sorted(found)


def test_base_spans(spark, edges, none):
    texts = [
        "a@b.c_d@e.f.g x@y z@w.q, 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 é😀 10.0.0.1 0.0.0.0255 1.2.3.0256",
        "4111 1111 1111 1111 4111-1111-1111-1112 +1 (269) 555-3296 4524132264652876 +49.30 1234567 x +1+2",
        "...@..@a.b %@-.-@c.d 12 +12345678901234567890 + 1 (22) +1 2345678 90)",
        " ".join(f"{k}.{k % 300}.1.2 x{k}@y.z" for k in range(3000)),
        "9" * 40_000 + " " + "a" * 40_000 + "@" + "b." * 20_000,
        "0000000000000000 00000000000000",
    ]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("0123459.@+- ()ab%"), 400)) for _ in range(60)]
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = edges.select("doc_id", "text").unionByName(extra).withColumns({"base": F.lit(1), "items": F.lit(2), "key": F.lit(3)})
    wanted = Counter((r["doc_id"], tuple(base_of(r["text"]))) for r in docs.collect())
    found = personal.find_personal(docs).collect()
    assert Counter((r["doc_id"], tuple(map(tuple, r["base"]))) for r in found) == wanted
    assert all(set(r["base"]) <= set(r["spans"]) for r in found)
    assert personal.find_personal(none).count() == 0


def test_unseen_identifiers(spark):
    rows = [(k, f"intro {k} my secret contact: user{k}.x@mail{k}.com please write and {k * 7919 % 1000} more") for k in range(12)]
    # without a domain, in the same contexts; found elsewhere too
    rows += [(20 + k, f"again my secret contact: handle_{k}77{k}, please write or ask HANDLE_{k}77{k}!") for k in range(4)]
    # what stands around ordinary words makes no pattern
    rows += [(40 + k, f"the sum of {1000 + k} and more") for k in range(6)] + [(60, "mail of x1@y.z and of x2@y.z and of x3@y.z and")]
    rows += [(70 + k, "the rest of it and of them and of us and more") for k in range(6)]
    rows += [(20, rows[12][1]), (90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = defaultdict(set)
    for doc_id, text in rows:
        texts[doc_id].add(text)
    added = Counter()
    for r in personal.find_personal(docs).collect():
        (text,) = texts[r["doc_id"]]
        for s in set(r["spans"]) - set(r["base"]):
            added[r["doc_id"], personal.KINDS[s["kind"]], text[s["start"] : s["end"]]] += 1
    expected = Counter()
    for k in range(4):
        for value in (f"handle_{k}77{k}", f"HANDLE_{k}77{k}"):
            expected[20 + k, "email", value] += 2 if k == 0 else 1
    assert added == expected


def test_graph_scores(spark):
    """A second round: identifiers found by the first patterns teach the next one; no pattern is counted twice."""
    edges = [("p", f"s{k}") for k in range(8)] + [("p", f"u{k}") for k in range(4)]
    edges += [("q", f"u{k}") for k in range(4)] + [("q", "v0")] + [("r", "v0"), ("r", "w"), ("z", "s0"), ("z", "w")]
    seeds = spark.createDataFrame([(f"s{k}", 1) for k in range(8)], "value string, kind int")
    asked = []

    def found(edges, **totals):
        asked.clear()

        def count(patterns):
            names = [r["pattern"] for r in patterns.collect()]
            asked.extend(names)
            return spark.createDataFrame([(n, totals.get(n, 0)) for n in names], "pattern string, total long")

        rows = spark.createDataFrame([(*e, 1) for e in edges], "pattern string, value string, times long")
        return sorted(map(tuple, personal.score_graph(rows, seeds, count).collect()))

    # p alone: 8 / (8 + 4 / 4) = 0.89 is confident but finds nothing
    assert found(edges) == [] and asked == ["p"]
    edges += [("t", f"s{k}") for k in range(4)] + [("t", f"u{k}") for k in range(4)]
    assert found(edges) == [("u0", 1), ("u1", 1), ("u2", 1), ("u3", 1), ("v0", 1)]
    assert sorted(asked) == ["p", "q", "t"]
    # t's words are often around others
    assert found(edges, t=30) == []
    # another kind counts in full
    mixed = seeds.unionByName(spark.createDataFrame([("x0", 2)], "value string, kind int"))
    rows = spark.createDataFrame([(*e, 1) for e in [*edges, ("t", "x0")]], "pattern string, value string, times long")
    count = lambda patterns: patterns.selectExpr("pattern", "CAST(0 AS BIGINT) AS total")
    assert personal.score_graph(rows, mixed, count).count() == 0
