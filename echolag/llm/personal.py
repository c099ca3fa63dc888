"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

1. Base entities (e-mail, IP address, card, phone) are found by fixed patterns. Words that could be an identifier, those with
   digits or an at sign, are the instances; an instance that holds one base entity is a seed of its kind.
2. Every instance induces lexical patterns: the two words before it, the two words behind it, and the word on each side. A
   pattern needs ``SUPPORT`` different trusted instances. How often its words occur around anything else is counted over all
   texts, so words that are often around ordinary words make no pattern.
3. Patterns and instances form a graph that is scored in rounds, for each kind: a pattern's confidence is the part of what
   it finds that is trusted, where ordinary words and instances of other kinds count in full against it and unknown
   instances in part; an instance's score is the chance that not all of its confident patterns are wrong. Instances that
   pass are trusted in the next round, so that their patterns can count too, and the seeds always are.
4. Trusted instances that are no base entity are the unseen identifiers; all their occurrences are added.

Patterns and instances stay in tables: no list of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookup
from ..session import materialize
from .text import SPACE, SPACES, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# different instances that a pattern must have, and trusted ones that it must have to be believed
SUPPORT = 3
# least confidence of a pattern, and least score of an instance
CONFIDENCE = 0.8
SCORE = 0.9
ROUNDS = 5
# how much an unknown instance counts against a pattern
UNKNOWN = 0.25

# the base patterns; possessive, and begun only where a run begins or the last match ended, so that long runs take linear time
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_BYTES = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
# a word with a digit or an at sign, and the words behind it that begin with a digit
_WORD = r"[^\x20\x09-\x0D]"
_AT = r"[0-9@]|\(at\)|\[at\]"
INSTANCE = rf"(?<!{_WORD}){_WORD}*(?:{_AT}){_WORD}*+(?:\x20[(+]?[0-9]{_WORD}*+)*+"
# punctuation around an instance
_OPENING = r"^[\"'(\[<{]+"
_CLOSING = r"[.,;:!?\"')\]>}]+$"

# elements whose running sum is built at a time; a list grows by copying, so a long one is built from pieces
_CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(steps: Column) -> Column:
    """(start, end, value) of the matches in ``steps``, an array of (gap, value, length) in the order of the text."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + step["length"]
        found = F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    def piece(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("found")), add)

    def joined(pieces: Column) -> Column:
        ends = F.aggregate(
            pieces,
            F.array(F.lit(0)),
            lambda sums, p: F.concat(sums, F.array(F.element_at(sums, -1) + p["at"])),
        )

        def shift(found: Column, by: Column) -> Column:
            return F.transform(
                found,
                lambda f: F.struct(
                    (f["start"] + by).alias("start"), (f["end"] + by).alias("end"), f["value"].alias("value")
                ),
            )

        moved = F.zip_with(pieces, F.slice(ends, 1, F.size(pieces)), lambda p, by: shift(p["found"], by))
        return F.flatten(moved)

    def build(all_steps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_steps), F.lit(_CHUNK))
        pieces = F.transform(starts, lambda at: piece(F.slice(all_steps, at, F.lit(_CHUNK))))
        return F.when(F.size(all_steps) == 0, empty).otherwise(_let(pieces, joined))

    return _let(steps, build)


def _steps(text: Column, pattern: str) -> Column:
    """(gap, value, length) of each match of ``pattern``: the code points before it, the match and its code points."""
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"), F.length(value).alias("length")),
    )
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _always(value: Column) -> Column:
    return F.lit(True)


# pattern, test of a match, and what a text must hold to be searched at all
_BASE = {
    "email": (EMAIL, _always, "@"),
    "ip": (IP, lambda value: value.rlike(_BYTES), r"[0-9]\.[0-9]"),
    "card": (CARD, _is_card, r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (PHONE, _is_phone, r"\+[0-9]"),
}


def base_spans(text: Column) -> Column:
    """The base entities of ``text`` as sorted (start, kind, end), with the number of the kind and code points."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def of(number: int, pattern: str, test: Callable[[Column], Column], holds: str) -> Column:
        spans = F.filter(_placed(_steps(text, pattern)), lambda s: test(s["value"]))
        kind = F.lit(number).alias("kind")
        shaped = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), kind, s["end"].alias("end")))
        return F.when(text.rlike(holds), shaped).otherwise(none)

    return F.array_sort(F.concat(*[of(number, *base) for number, base in enumerate(_BASE.values())]))


def _kind_of(value: Column) -> Column:
    """The number of the one base kind that ``value`` holds; null for none or several."""

    def numbers(number: int, pattern: str, test: Callable[[Column], Column]) -> Column:
        inside = F.filter(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), test)
        return F.array_repeat(F.lit(number), F.size(inside))

    kinds = F.concat(*[numbers(number, pattern, test) for number, (pattern, test, _) in enumerate(_BASE.values())])
    return _let(kinds, lambda k: F.when(F.size(k) == 1, F.get(k, F.lit(0))))


def _pattern_key(place: str, first: Column, second: Column) -> Column:
    return F.xxhash64(F.lit(place), first, second)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")


def instances(text: Column) -> Column:
    """The instances of ``text``: place, value in lower case, kind if a seed, whether one word, and keys of their patterns."""

    def around(gaps: Column) -> Column:
        # the words before a match are the end of its gap, those behind it the beginning of the next one
        def keys(left: Column, right: Column) -> Column:
            l1, l2 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
            r1, r2 = F.get(right, F.lit(0)), F.get(right, F.lit(1))
            return F.struct(
                F.when(l2.isNotNull(), _pattern_key("before", l2, l1)).alias("before"),
                F.when(r2.isNotNull(), _pattern_key("behind", r1, r2)).alias("behind"),
                F.when(l1.isNotNull() & r1.isNotNull(), _pattern_key("between", l1, r1)).alias("between"),
            )

        words = F.transform(gaps, _words)
        return _let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), keys))

    def shape(place: Column, keys: Column) -> Column:
        value = place["value"]
        opening = F.length(F.regexp_extract(value, _OPENING, 0))
        bare = F.regexp_replace(F.regexp_replace(value, _OPENING, ""), _CLOSING, "")

        def of(bare: Column) -> Column:
            start = place["start"] + opening
            single = ~bare.contains(" ")
            return F.struct(
                start.alias("start"),
                (start + F.length(bare)).alias("end"),
                F.lower(bare).alias("value"),
                _kind_of(bare).alias("kind"),
                F.array_compact(F.array(keys["before"], keys["behind"], F.when(single, keys["between"]))).alias("patterns"),
            )

        return _let(bare, of)

    def worth(item: Column) -> Column:
        marked = item["value"].rlike(r"@|\(at\)|\[at\]")
        return (item["end"] - item["start"] >= 5) & (marked | (F.length(_digits(item["value"])) >= 3))

    places = _placed(_steps(text, INSTANCE))
    shaped = F.zip_with(places, around(F.split(text, INSTANCE, -1)), shape)
    none = F.array().cast(
        "array<struct<start:int,end:int,value:string,kind:int,patterns:array<bigint>>>"
    )
    return F.when(text.rlike(_AT), F.filter(shaped, worth)).otherwise(none)


def _context_counts(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of ``patterns(pattern)`` occur in their places, around anything."""
    words = docs.select(F.split(F.lower(F.trim(text_or_empty(text), F.lit(SPACES))), SPACE + "+").alias("w"))
    after = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w") - k + 1, F.lit(0)))
    triples = words.select(F.explode(F.arrays_zip(F.col("w"), after(2).alias("x"), after(3).alias("y"))).alias("t"))
    a, b, c = (F.col(f"t.{k}") for k in ("w", "x", "y"))
    keys = F.array(_pattern_key("before", a, b), _pattern_key("behind", a, b), _pattern_key("between", a, c))
    placed = triples.where(b.isNotNull()).select(F.explode(keys).alias("pattern"))
    counted = lookup(placed, patterns.select("pattern"), ["pattern"]).groupBy("pattern")
    return counted.agg(F.count(F.lit(1)).alias("total"))


def score_graph(
    edges: DataFrame, seeds: DataFrame, count: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS
) -> DataFrame:
    """(value, kind) of the instances that ``rounds`` rounds find, those of ``seeds(value, kind)`` excepted.

    ``edges(pattern, value, times)`` are the different pairs and how often they occur. ``count`` gives (pattern, total), how
    often the words of some patterns occur around anything. It is asked for a pattern once, and only where the pattern can
    still teach something: it has enough trusted instances of one kind, others that are unknown, and would be believed if
    its words were around nothing else.
    """
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_values"), F.sum("times").alias("times"))
    sizes = materialize(sizes.where(F.col("n_values") > SUPPORT), "sizes")
    edges = materialize(lookup(edges, sizes, ["pattern"], "left_semi").select("pattern", "value"), "edges")
    trusted = seeds.withColumn("score", F.lit(1.0))
    found = counts = None
    known = 0
    for _ in range(rounds):
        votes = edges.join(trusted, "value").groupBy("pattern", "kind")
        votes = votes.agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("support"))
        # at most one row per kind and pattern
        votes = votes.withColumn("known", F.sum("support").over(Window.partitionBy("pattern")))
        votes = votes.where(F.col("support") >= SUPPORT).join(sizes, "pattern").where("n_values > known")
        best_case = F.col("known") + UNKNOWN * (F.col("n_values") - F.col("known"))
        hopeful = materialize(votes.where(F.col("sum") >= CONFIDENCE * best_case), "hopeful")
        asked = hopeful.select("pattern").distinct()
        if counts is not None:
            asked = asked.join(counts, "pattern", "left_anti")
        asked = materialize(asked, "asked")
        if not asked.isEmpty():
            answered = materialize(asked.join(count(asked), "pattern", "left"), "counts")
            counts = answered if counts is None else counts.unionByName(answered)
        if counts is None:
            break
        ordinary = F.greatest(F.coalesce("total", F.col("times")) - F.col("times"), F.lit(0))
        confident = hopeful.join(counts, "pattern").withColumn("confidence", F.col("sum") / (best_case + ordinary))
        confident = confident.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence")
        confident = materialize(confident, "confident")
        if confident.isEmpty():
            break
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(0.01))))
        scored = edges.join(confident, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = scored.where(F.col("score") >= SCORE - 1e-9).groupBy("value").agg(
            F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), "kind")).alias("b")
        )
        unseen = best.join(seeds.select("value"), "value", "left_anti").select("value", "b.kind", "b.score")
        # what was found once stays
        if found is not None:
            unseen = found.unionByName(unseen.join(found.select("value"), "value", "left_anti"))
        found = materialize(unseen, "found")
        count_found = found.count()
        if count_found == known:
            break
        known = count_found
        trusted = seeds.withColumn("score", F.lit(1.0)).unionByName(found)
    return seeds.select("value", "kind").limit(0) if found is None else found.select("value", "kind")


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, base, spans) per row of ``docs``: the base entities and all spans, sorted arrays of (start, kind, end).

    ``kind`` is a place in ``KINDS``; ends are exclusive, in code points. An added span has the kind of the patterns that found
    it and overlaps no base span. A null text counts as empty; empty texts have no spans. Long texts are searched whole. Rows
    that repeat an id or a text have the same spans each. An empty table gives an empty table; other columns are ignored.
    """
    body = text_or_empty(text)
    read = docs.select("doc_id", base_spans(body).alias("base"), instances(body).alias("items"), body.alias("body"))
    # equal texts have equal spans, so that a text stands for all of its rows
    key = F.when(F.size("items") > 0, F.unhex(F.sha2("body", 256)))
    read = materialize(read.select("doc_id", "base", "items", key.alias("key")), "spans")
    items = read.where(F.col("key").isNotNull()).select("key", F.explode("items").alias("item")).select("key", "item.*")

    seen = items.select(F.explode("patterns").alias("pattern"), "value").groupBy("pattern", "value")
    seen = materialize(seen.agg(F.count(F.lit(1)).alias("times")), "seen")
    seeds = items.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind"))
    found = score_graph(seen, materialize(seeds, "seeds"), lambda asked: _context_counts(docs, text, asked))
    if found.isEmpty():
        return read.select("doc_id", "base", F.col("base").alias("spans"))
    added = lookup(items.where("kind IS NULL").drop("kind"), found, ["value"])
    added = added.select("key", F.struct("start", "kind", "end").alias("span")).distinct()
    added = added.groupBy("key").agg(F.collect_list("span").alias("added"))
    both = lookup(read, materialize(added, "added"), ["key"], "left")

    def apart(span: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"]))

    more = F.coalesce(F.filter("added", apart), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return both.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
