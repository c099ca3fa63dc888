"""Spelling variants by a variable-length gram index (Li, Wang and Yang, "VGRAM", 2007).

1. Words are counted over all texts, by expressions alone.
2. Gram dictionary: all grams of ``Q_MIN`` letters are in it, a longer one only if its beginning occurs in more than a
   ``1 / FREQUENT_SHARE`` part of all places; so frequent grams grow longer and rare ones stay short. Fewer than
   ``FREQUENT_SHARE`` grams per length can be that frequent, so what tasks must know of the dictionary is small, whatever
   the data.
3. Each word, between two marks, is decomposed: from every place the longest gram of the dictionary, unless it lies within
   an earlier one.
4. Affected grams: an edit at one place can change a gram that begins at most ``Q_MAX - 1`` letters before it, and can make a
   gram vanish that ends at most ``Q_MAX - 1`` letters behind it. All other grams of a word are found in the edited word too,
   at the same distance from the start (left of the edit) or from the end (right of it). With ``Q_MAX`` = 3, every word of
   ``LETTERS`` letters keeps at least one, so the bound of no word is empty.
5. Merging: two near words share, for the place of their edit, all unaffected grams. The lists of these grams are merged by
   one join on their common key; the longer word's places are joined with those of words of its length and of one less.
6. Candidates are verified by their edit distance. Each word takes its most frequent near word as its form, and forms are
   followed to the last by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy, lookup
from ..session import materialize
from .text import text_or_empty

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 5
LEAST = 3
RATIO = 2
NOISE = 97
Q_MIN = 2
Q_MAX = 3
# a gram is frequent if it has more than this part of all places; fewer than FREQUENT_SHARE grams can be
FREQUENT_SHARE = 2_000
# marks at both ends of a word, which are no letters
START, END = "^", "$"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(
    docs: DataFrame, text: str = "text", noise: int = NOISE, letters: int = LETTERS, least: int = LEAST
) -> DataFrame:
    """(word, n) of the words with at least ``letters`` code points and ``least`` occurrences.

    Words are maximal runs of letters, lower-cased in A-Z only. Of a run whose crc32 of ``doc_id:run`` is divisible by
    ``noise`` one letter is deleted; a null ``doc_id`` reads as an empty one.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_or_empty(text), F.lit(RUN), F.lit(0))).alias("run"),
    )
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    digest = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    place = (F.col("digest") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.withColumn("digest", digest).select(
        F.when(F.col("digest") % noise == 0, cut).otherwise(F.col("run")).alias("word")
    )
    counted = words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def frequent_grams(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, share: int = FREQUENT_SHARE) -> set[str]:
    """Grams of ``q_min`` to ``q_max - 1`` letters that have more than 1 / ``share`` of the places of their length."""
    marked = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("word"))
    lengths = F.array(*[F.lit(q) for q in range(q_min, q_max)])
    places = marked.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    grams = places.select(F.explode(lengths).alias("q"), "word", "at").where(F.col("at") + F.col("q") <= F.length("word") + 1)
    counts = grams.groupBy("q", F.substring("word", F.col("at"), F.col("q")).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "grams")
    totals = counts.groupBy("q").agg((F.sum("n") / share).alias("most"))
    # fewer than share grams per length
    return {r["gram"] for r in lookup(counts, totals, ["q"]).where("n > most").select("gram").collect()}


def decompose(word: str, frequent: set[str], q_min: int = Q_MIN, q_max: int = Q_MAX) -> list[tuple[int, int]]:
    """(start, end) of the variable-length grams of a marked word, in order; the end is exclusive."""
    grams, reached = [], 0
    for start in range(len(word) - q_min + 1):
        end = start + q_min
        while end < len(word) and end - start < q_max and word[start:end] in frequent:
            end += 1
        if end > reached:
            grams.append((start, end))
            reached = end
    return grams


def unaffected(grams: list[tuple[int, int]], at: int, gap: bool, q_max: int = Q_MAX) -> tuple[int, int]:
    """How many of ``grams`` lie left of an edit's reach, and the index of the first one right of it.

    The edit replaces or deletes the letter ``at``, or with ``gap`` inserts one before it. The grams in between are affected.
    """
    left, right = 0, len(grams)
    while left < len(grams) and grams[left][0] <= at - q_max:
        left += 1
    first, reach = (at, at + q_max - 1) if gap else (at + 1, at + q_max)
    while right > left and grams[right - 1][0] >= first and grams[right - 1][1] > reach:
        right -= 1
    return left, right


def edit_keys(word: str, frequent: set[str], q_min: int = Q_MIN, q_max: int = Q_MAX) -> tuple[list[int], list[int]]:
    """Keys of the unaffected grams of each edit of ``word``: of replacing or deleting a letter, and of inserting one.

    Equal keys mean equal lists of grams at equal distances from the start or the end, in words whose longer one has the same
    length.
    """
    marked = START + word + END
    grams = decompose(marked, frequent, q_min, q_max)
    from_start = [f"{a}{marked[a:b]}" for a, b in grams]
    from_end = [f"{len(marked) - b}{marked[a:b]}" for a, b in grams]

    def keys(places: range, gap: bool) -> list[int]:
        longer = len(word) + gap
        bounds = {unaffected(grams, at, gap, q_max) for at in places}
        texts = ["\0".join([str(longer), *from_start[:left], "", *from_end[right:]]) for left, right in bounds]
        return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in set(texts)]

    return keys(range(1, len(marked) - 1), False), keys(range(1, len(marked)), True)


_KEYED = "key bigint, word string, n bigint, longer boolean"


def keyed_words(words: DataFrame, frequent: set[str], q_min: int = Q_MIN, q_max: int = Q_MAX) -> DataFrame:
    """(key, word, n, longer): the merged lists each word of ``words(word, n)`` is in, as the longer or the shorter word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                keys, places, longer = [], [], []
                for place, word in enumerate(part["word"].to_pylist()):
                    own, gaps = edit_keys(word, frequent, q_min, q_max)
                    keys += own + gaps
                    places += [place] * (len(own) + len(gaps))
                    longer += [True] * len(own) + [False] * len(gaps)
                taken = part.take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), taken["word"], taken["n"], pa.array(longer, pa.bool_())],
                    names=["key", "word", "n", "longer"],
                )

    return words.select("word", "n").mapInArrow(run, _KEYED)


def near_words(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX) -> DataFrame:
    """(word, other, n, other_n) of words that differ by exactly one inserted, deleted or replaced letter, in both orders."""
    keyed = materialize(keyed_words(words, frequent_grams(words, q_min, q_max), q_min, q_max), "keys")
    longer = keyed.where("longer").select("key", "word", "n")
    either = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("longer").alias("same"))
    # words of equal length meet in both orders, of which one is enough
    met = join_heavy(longer, either, ["key"]).where(~F.col("same") | (F.col("word") < F.col("other")))
    near = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "n", "other_n").distinct()
    near = materialize(near, "near")
    return near.unionByName(
        near.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("other_n").alias("n"), F.col("n").alias("other_n"))
    )


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the last form that is reached. Each round doubles the steps taken."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = join_heavy(state, onward, ["root"], "left")
        moved = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def group_variants(docs: DataFrame, text: str = "text", ratio: float = RATIO, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``docs``; see ``count_words`` for what a word is.

    ``form`` is the near word with the largest ``n``, of equal ones the first in code-point order, if its ``n`` is at least
    ``ratio`` times the word's own; else it is null. Null and empty texts have no words, very long ones and very long words
    count whole, and rows that repeat an id or a text all count. An empty table gives an empty table; other columns are
    ignored.
    """
    words = materialize(count_words(docs, text, **options), "words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    named = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"),
    )
    named = materialize(
        named.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "forms"
    )
    roots = follow_forms(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
