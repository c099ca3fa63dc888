"""Quality rules: a table of thresholds compiled into one projection.

Every metric is a plain Spark expression over the text and every rule an interval of a metric. ``compile_rules`` turns the
table into one column, so a scan of the documents yields metrics and verdict without user functions or a shuffle. Repeated
five-word windows are found inside the row: where hashes of windows repeat, the windows are sorted with their places, and
equal neighbours are repeats.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, text_or_empty, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_ROW = "_row_number"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# frequent words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to a in is that it for was with as are on be this by from or not "
    "der die das und ist von zu den mit ein eine nicht sich dem auf für im als auch "
    "le la les de des et un une est en que dans du pour au par il elle sur avec "
    "el los las del y se no por con para su lo al una como es"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high] for texts of at least ``from_words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("long_enough", "n_words", low=10),
    Rule("word_length", "mean_word_chars", low=2, high=15),
    Rule("few_symbols", "symbols_per_word", high=0.1),
    Rule("some_stop_words", "stop_word_share", low=0.02, from_words=50),
    Rule("not_only_stop_words", "stop_word_share", high=0.9),
    Rule("few_repeated_lines", "dup_line_share", high=0.5),
    Rule("few_repeated_words", "repeat_word_share", high=0.2),
)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))


# ratios that rules may name besides the counts
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
}


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean column: all rules hold."""
    verdict = F.lit(True)
    for rule in rules:
        metric = _share(*RATIOS[rule.metric]) if rule.metric in RATIOS else F.col(rule.metric)
        if rule.low is not None:
            verdict = verdict & ((metric >= rule.low) | (F.col("n_words") < rule.from_words))
        if rule.high is not None:
            verdict = verdict & ((metric <= rule.high) | (F.col("n_words") < rule.from_words))
    return verdict


def _covered(starts: Column) -> Column:
    """Places covered by windows that begin at the sorted ``starts``."""
    state = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts,
        state,
        lambda s, start: F.struct((s["n"] + F.least(F.lit(WINDOW), start - s["last"])).alias("n"), start.alias("last")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metrics that the rules read, and a row number; a null text has no words.

    The columns named in ``BASE``, ``n_stop_words``, ``n_lines`` and ``_row_number`` are replaced if ``docs`` has them already.
    """
    made = [*BASE, "n_stop_words", "n_lines", _ROW]
    carried = [F.col(c) for c in docs.columns if c not in made]
    whole = F.struct(*carried)
    split = docs.select(
        whole.alias("_row"),
        text_or_empty(text).alias("_text"),
        words_of(text_or_empty(text)).alias("_words"),
        F.filter(F.split(text_or_empty(text), "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}")).alias("_lines"),
    )
    hashed = split.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    # equal windows have equal hashes, so the windows themselves are built only for texts where hashes repeat
    places = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    tags = F.transform(places, lambda p: F.xxhash64(*[F.get("_hashes", p + k) for k in range(-1, WINDOW - 1)]))
    tagged = hashed.select("*", F.when(F.size("_words") > WINDOW, tags).alias("_tags"))
    windows = F.when(
        F.size(F.array_distinct("_tags")) < F.size("_tags"),
        F.transform(places, lambda p: F.array_join(F.slice("_words", p, WINDOW), " ")),
    )
    windowed = tagged.select("_row", "_text", "_words", "_lines", windows.alias("_windows"))
    order = F.sort_array(F.transform("_windows", lambda w, place: F.struct(w.alias("w"), place.alias("place"))))
    ordered = windowed.select("*", order.alias("_order"))
    repeated = F.filter(
        "_order",
        lambda x, k: F.coalesce(x["w"] == F.get("_order", k - 1)["w"], F.lit(False))
        | F.coalesce(x["w"] == F.get("_order", k + 1)["w"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(repeated, lambda x: x["place"]))
    metrics = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(_covered(starts), F.lit(0)),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))),
        "n_lines": F.size("_lines"),
    }
    # a filter on the verdict stays above this column; Spark would else copy the metrics, unshared, into the filter
    row_number = F.monotonically_increasing_id().alias(_ROW)
    return ordered.select("_row.*", *[value.cast("long").alias(name) for name, value in metrics.items()], row_number)


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``base_failed`` and ``kept``; a text that fails the base is not kept, whatever the rules say."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumns(
        {"base_failed": failed, "kept": ~failed & compile_rules(rules) & (F.col(_ROW) >= 0)}
    ).drop(_ROW)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with metrics and verdict, one row per row.

    Null and empty texts have no words and fail the base. Long texts are measured whole. Repeated rows are judged each on
    its own, alike. An empty table gives an empty table. Columns of ``docs`` named like a result are replaced.
    """
    return judge(measure(docs, text), rules)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_whole"), F.col(text).alias("_judged"))
    return apply_rules(rows, rules, "_judged").where("kept").select("_whole.*")
