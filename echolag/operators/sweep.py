"""Mining over periods, categories and support bands at once, from one profile for all window sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookup, support_ceiling, support_floor, template_of_change
from ..session import materialize
from .mining import mine_profile, profile_changes

# fixed values: bounds of the support bands; the first lower bound shrinks to 20 days where that is less
BAND_BOUNDS = (0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)
LEAST_DAYS = 20
# fixed values: window sizes per granularity
WINDOWS = {"d": (7, 31), "h": (24,)}


def with_category(occurrences: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Copy each occurrence into the categories that list its template; others are dropped."""
    tagged = occurrences.withColumn("template", template_of_change(F.col("change_id")))
    wanted = whitelist.select("category", "template").distinct()
    return lookup(tagged, wanted, ["template"]).drop("template")


def assign_bands(profile: DataFrame, hourly: bool = False) -> DataFrame:
    """Copy each change into the support bands it lies in, both ends included; adds ``band`` and ``min_abs``.

    ``profile`` needs ``days``, the length of its period. Hourly bands are a 24th.
    """
    scale = F.lit(1.0 / 24 if hourly else 1.0)
    lowest = F.least(F.lit(BAND_BOUNDS[0]), F.lit(float(LEAST_DAYS)) / F.col("days"))
    bounds = [lowest, *[F.lit(b) for b in BAND_BOUNDS[1:]]]
    points = F.col("n_points")
    bands = F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                support_floor(scale * low, points).alias("least"),
                support_ceiling(scale * high, points).alias("most"),
            )
            for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:]))
        ]
    )
    fitting = F.filter(bands, lambda b: (F.col("n") >= b["least"]) & (F.col("n") <= b["most"]))
    return profile.withColumn("_band", F.explode(fitting)).select(
        "*", F.col("_band.band").alias("band"), F.col("_band.least").alias("min_abs")
    ).drop("_band")


def mine_sweep(
    occurrences: DataFrame,
    timepoints: DataFrame,
    *,
    whitelist: DataFrame | None = None,
    granularity: str = "d",
    num_bins: Sequence[int] | None = None,
    min_conf: float = 0.8,
    boundary_expiry: bool = True,
    tail_prune: bool = True,
) -> DataFrame:
    """Rules per period, category, support band and window size.

    ``occurrences(period, change_id, tp)`` comes from ``split_by_period``, ``timepoints(period, tp, tp_idx, days)``
    from ``period_domain``. Both changes of a rule lie in the same period, category and band, so these are just
    further keys of one join, and so is the window size.
    """
    by = ["period"]
    changes = occurrences
    if whitelist is not None:
        changes = with_category(changes, whitelist)
        by = ["period", "category"]
    profile = profile_changes(changes, timepoints, by, domain_by=["period"])
    days = timepoints.select("period", "days").distinct()
    banded = materialize(assign_bands(lookup(profile, days, ["period"]), hourly=granularity == "h"), "banded")
    # period, category, band and window size are keys of one join
    return mine_profile(
        banded,
        num_bins=list(num_bins or WINDOWS[granularity]),
        min_conf=min_conf,
        by=[*by, "band"],
        boundary_expiry=boundary_expiry,
        tail_prune=tail_prune,
    ).expand()
