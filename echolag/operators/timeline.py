"""Time domains: which time points exist, and the position of each.

Support and lag are counted in positions of the domain, not in calendar distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dense_index, join_heavy

# fixed values: bounds that a calendar domain starts from before any occurrence is seen
LATEST_START = "2020-11-11"
EARLIEST_END = "1900-01-01"


def daily_domain(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end``, both included."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    return spark.range(days).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("tp"),
        F.col("id").cast("int").alias("tp_idx"),
    )


def hourly_domain(spark: SparkSession, start: str, end: str, hours_per_day: int = 24) -> DataFrame:
    """Hours as text ``YYYY-MM-DDTHH``; ``hours_per_day=25`` also lists an hour 24 per day."""
    days = daily_domain(spark, start, end).withColumnRenamed("tp", "day")
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours_per_day - 1))))
    return hours.select(
        F.format_string("%sT%02d", F.col("day").cast("string"), "hour").alias("tp"),
        (F.col("tp_idx") * hours_per_day + F.col("hour")).cast("int").alias("tp_idx"),
    )


def observed_domain(df: DataFrame, tp: str = "tp", by: Sequence[str] = ()) -> DataFrame:
    """Distinct time points that occur in ``df``, indexed in order."""
    return index_timepoints(df.select(*by, F.col(tp).alias("tp")).distinct(), by)


def calendar_domain(
    occurrences: DataFrame, latest_start: str | None = LATEST_START, earliest_end: str | None = EARLIEST_END
) -> DataFrame:
    """All days from the first to the last occurrence (``tp`` a date or ISO text)."""
    first, last = F.min("tp").cast("date"), F.max("tp").cast("date")
    if latest_start:
        first = F.least(first, F.lit(latest_start).cast("date"))
    if earliest_end:
        last = F.greatest(last, F.lit(earliest_end).cast("date"))
    bounds = occurrences.agg(first.alias("first"), last.alias("last"))
    return bounds.select(F.posexplode(F.sequence("first", "last")).alias("tp_idx", "tp")).select("tp", "tp_idx")


def _coarse(df: DataFrame) -> Column:
    """Order-preserving bucket of a time point: a month, a day, a text prefix or a run of integers."""
    kind = df.schema["tp"].dataType.typeName()
    if kind == "date":
        return F.trunc("tp", "month")
    if kind.startswith("timestamp"):
        return F.to_date("tp")
    if kind == "string":
        return F.substring("tp", 1, 7)
    return F.floor(F.col("tp") / 1000)


def index_timepoints(timepoints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Position of each distinct ``tp`` (per ``by`` group), starting at 0."""
    return dense_index(timepoints.select(*by, "tp"), ["tp"], _coarse(timepoints), "tp_idx", by)


def truncate(timestamp: Column, granularity: str) -> Column:
    """ISO text cut to a day (``d``) or an hour (``h``)."""
    return F.substring(timestamp, 1, {"d": 10, "h": 13}[granularity])


def year_periods(first_year: int = 2015, last_year: int = 2019, length: int = 4) -> list[tuple[str, int, int]]:
    """Overlapping periods of ``length`` years: (name, start year, end year)."""
    return [(f"{y}-{y + length - 1}", y, y + length - 1) for y in range(first_year, last_year - length + 2)]


def split_by_period(
    occurrences: DataFrame, first_year: int = 2015, last_year: int = 2019, length: int = 4
) -> DataFrame:
    """Copy each occurrence into the periods that hold its year; adds ``period``.

    The periods of a year follow from arithmetic, so no range join is needed.
    """
    year = F.substring(F.col("tp").cast("string"), 1, 4).cast("int")
    first = F.greatest(F.lit(first_year), year - (length - 1))
    last = F.least(F.lit(last_year - length + 1), year)
    starts = F.explode(F.when(first <= last, F.sequence(first, last)))
    return (
        occurrences.withColumn("_start", starts)
        .withColumn("period", F.format_string("%d-%d", F.col("_start"), F.col("_start") + (length - 1)))
        .drop("_start")
    )


def split_by_intervals(
    occurrences: DataFrame, intervals: DataFrame, name: str = "period", width_days: int | None = None
) -> DataFrame:
    """Copy each occurrence into the ``intervals(name, start, end)`` that hold its day, both ends included; adds ``name``.

    Intervals may be uneven and overlap. Both sides are dealt to stretches of ``width_days``, about an interval's mean length
    where not given, and joined by stretch, so an interval is copied to the few stretches it touches and an occurrence is
    compared with the intervals of its own stretch only. A stretch with very many occurrences is split. Intervals that end
    before they start, or lack an end, hold nothing.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    spans = intervals.select(name, day("start").alias("_from"), day("end").alias("_to")).where("_from <= _to").distinct()
    if width_days is None:
        mean = spans.agg(F.avg(F.col("_to") - F.col("_from") + 1)).first()[0]
        width_days = max(1, round(mean or 1))
    stretch = lambda c: F.floor(F.col(c) / width_days).cast("int")
    dealt = spans.withColumn("_stretch", F.explode(F.sequence(stretch("_from"), stretch("_to"))))
    dated = occurrences.withColumn("_day", F.unix_date(F.substring(F.col("tp").cast("string"), 1, 10).cast("date")))
    placed = dated.withColumn("_stretch", stretch("_day"))
    met = join_heavy(placed, dealt, ["_stretch"]).where("_day BETWEEN _from AND _to")
    return met.select(*occurrences.columns, name)


def interval_domain(intervals: DataFrame, name: str = "period") -> DataFrame:
    """Every day of each interval, indexed from its first, with its number of ``days``: the domain for mining by interval."""
    spans = intervals.select(name, F.col("start").cast("date").alias("_from"), F.col("end").cast("date").alias("_to"))
    days = spans.where("_from <= _to").distinct().select(
        name, (F.datediff("_to", "_from") + 1).alias("days"), F.posexplode(F.sequence("_from", "_to")).alias("tp_idx", "tp")
    )
    return days.select(name, "tp", "tp_idx", "days")


def period_domain(
    spark: SparkSession, first_year: int = 2015, last_year: int = 2019, length: int = 4, hours_per_day: int | None = None
) -> DataFrame:
    """Time points of every period, with the period's number of ``days``; hourly when ``hours_per_day`` is given."""
    parts = []
    for name, start, end in year_periods(first_year, last_year, length):
        span = (f"{start}-01-01", f"{end}-12-31")
        days = (date.fromisoformat(span[1]) - date.fromisoformat(span[0])).days + 1
        domain = daily_domain(spark, *span) if hours_per_day is None else hourly_domain(spark, *span, hours_per_day)
        parts.append(domain.select(F.lit(name).alias("period"), "tp", "tp_idx", F.lit(days).alias("days")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def timeline_prefixes(occurrences: DataFrame, timepoints: DataFrame, steps: int = 10) -> DataFrame:
    """Occurrences up to growing cut points of the domain; adds ``num_days``, the length of the prefix.

    Occurrences are compared with the cut's own ``tp``, so those that the domain does not list stay in every prefix that
    reaches them.
    """
    n_points = timepoints.count()
    cuts = sorted({min(round(i * n_points / steps), n_points - 1) for i in range(1, steps + 1)})
    # at most ``steps`` rows
    ends = [(row["tp_idx"] + 1, row["tp"]) for row in timepoints.where(F.col("tp_idx").isin(cuts)).collect()]
    reached = [F.when(F.col("tp") <= F.lit(end), F.lit(length)) for length, end in ends]
    return occurrences.withColumn("num_days", F.explode(F.array_compact(F.array(*reached).cast("array<int>"))))
