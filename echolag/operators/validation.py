"""Checks of mined rules against planted ones, and of lookups against their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import global_rank, seeded_digest

_PAIR = ["antecedent", "consequent"]


def require_all(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """Raise ``KeyError`` if a key of ``left`` is missing in ``right``."""
    missing = left.select(*on).join(right.select(*on), list(on), "left_anti").first()
    if missing is not None:
        raise KeyError(f"no entry for {tuple(missing)}")


def check_injected(rules: DataFrame, injected: DataFrame) -> DataFrame:
    """Status of each expected rule: ``ok``, or the first of count, support, confidence and histogram that differs."""
    found = rules.groupBy(*_PAIR).agg(
        F.count(F.lit(1)).alias("found"),
        F.min("support").alias("f_support"),
        F.min("confidence").alias("f_confidence"),
        F.min("hist").alias("f_hist"),
    )
    status = (
        F.when(F.coalesce("found", F.lit(0)) != 1, "count")
        .when(F.col("f_support") != F.col("support"), "support")
        .when(F.col("f_confidence") != F.col("confidence"), "confidence")
        .when(F.col("f_hist") != F.col("hist"), "histogram")
        .otherwise("ok")
    )
    return injected.join(found, _PAIR, "left").select(
        *_PAIR, F.coalesce("found", F.lit(0)).alias("found"), status.alias("status")
    )


def check_rejected(rules: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rules that should not have been found."""
    return rules.join(rejected.select(*_PAIR), _PAIR, "left_semi")


def injected_in_top(ranked: DataFrame, injected: DataFrame, k: int | None = None) -> DataFrame:
    """Expected rules among the ``k`` best scored; ``k`` is their number unless given."""
    k = injected.count() if k is None else k
    top = global_rank(ranked, [F.desc("score"), *_PAIR], "_rank").where(F.col("_rank") < k).drop("_rank")
    return top.join(injected.select(*_PAIR), _PAIR, "left_semi")


def keep_changes(occurrences: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Occurrences of ``k`` changes drawn by a seeded hash."""
    changes = occurrences.select("change_id").distinct()
    shuffled = global_rank(changes, [seeded_digest(seed, "change_id"), "change_id"], "_rank")
    drawn = shuffled.where(F.col("_rank") < k).select("change_id")
    return occurrences.join(drawn, "change_id", "left_semi")
