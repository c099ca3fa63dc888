"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, laid out as often as a document may be repeated. A document's
virtual finish time is the running number of its source's words up to and with it, divided by the source's target, so all
sources reach their targets at time 1. The queues are merged by one global range sort on that time, and the merged line is
cut where its running number of words passes the budget. Both running sums come from sorted partitions and the totals of the
partitions before them, so no source is summed up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_heavy
from ..functions.numbering import global_rank
from ..session import materialize
from .rows import numbered, unused
from .text import text_or_empty, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with each row, along ``order``, which should be total.

    Rows are sorted by range and written with their partition; partition totals, one row each, give the offsets.
    """
    sorted_rows = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_last() for c in order]
    )
    placed = materialize(sorted_rows.withColumn("_part", F.spark_partition_id()), "sorted")
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy("_part")
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = placed.withColumn("_inside", F.sum(value).over(inside)).join(starts, "_part")
    return summed.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """(no_source, source, n_docs, weight, source_size, target) for ``sizes(no_source, source, size)``.

    Sources by code point, null last, take the weights in turn. A target stops at ``repeats`` times its source's size, and
    the excess is shared anew by weight among the others until none is above. Every round is one sum over the sources.
    """
    sources = sizes.groupBy("no_source", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    # code points sort as UTF-8 bytes do, which is how Spark compares strings
    ranked = global_rank(sources, ["no_source", "source"], "_rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    weighed = materialize(ranked.withColumn("weight", weight).drop("_rank"), "sources")
    most = F.col("source_size") * repeats
    budget = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > most
        row = weighed.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(above, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped:
            break
        capped = row["capped"]
        rate = (budget - row["full"]) / row["weight"] if row["weight"] else rate
    target = F.when(above, most.cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return weighed.withColumn("target", target.cast("double"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = "mix",
    text: str = "text",
    row: str | None = None,
) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) per row of ``docs``; ``taken`` is 0 to ``repeats`` times the size.

    A document's size is its number of words, none for a null text; documents without words take nothing. Null sources are
    one source, the last. Rows are shuffled by the digest of seed and ``doc_id``, ties by size, so the same rows give the
    same mix however they are split up; rows equal in source, id and size may stand for each other. An empty table gives an
    empty table, and other columns are ignored. ``row`` names a column that tells rows apart; it is made where not given.
    """
    measured = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.size(words_of(text_or_empty(text))).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("place"),
    )
    measured = materialize(measured, "sizes")
    key = ["no_source", "source"]
    targets = source_targets(measured, weights, share, repeats)
    # words of all sources before a source
    laid = materialize(
        running_total(targets, key, "source_size", "upto").withColumn("before", F.col("upto") - F.col("source_size")),
        "targets",
    )
    budget = int(share * (laid.agg(F.sum("source_size")).first()[0] or 0))
    known = laid.select(*key, "source_size", "target", "before")
    weight = laid.select(*key, F.col("n_docs").alias("weight"))

    queued = running_total(measured, [*key, "place", "doc_id", "size", "row"], "size", "upto")
    timed = join_heavy(queued, known, key, weights=weight)
    timed = timed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    reached = F.col("upto") - F.col("before") + F.col("turn") * F.col("source_size")
    timed = timed.withColumn("finish", reached / F.when(F.col("target") > 0, F.col("target")))
    merged = running_total(timed, ["finish", *key, "turn", "place", "doc_id", "size", "row"], "size", "line")
    taken = F.when((F.col("line") <= budget) & F.col("finish").isNotNull(), F.col("size")).otherwise(0)
    return merged.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(taken).alias("taken"))


def mix_rows(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names."""
    placed, row = numbered(docs)
    mixed = mix(placed, text=text, row=row, **options).where("taken > 0")
    turns, turn = unused(placed, "turns"), unused(placed, "turn")
    often = mixed.select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(turns))
    taken = placed.join(often, row).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turns))))
    return taken.drop(row, turns, turn)
