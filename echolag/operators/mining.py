"""Change rules: for each ordered pair of changes, how often and how late the second follows the first.

An antecedent occurrence at ``t'`` is open until its next occurrence, at most ``num_bins`` positions. A consequent
occurrence at ``t`` matches the open antecedent occurrence if the consequent did not occur in ``[t', t)``; the lag is
``t - t'``. Support counts the matches, confidence divides by the antecedent's number of occurrences.

How the work is laid out:

* Changes with the same positions get the same rules. They are mined once, as one class of copies, and only the
  finished rules are written out per member, with large classes cut into chunks.
* A rule needs ``θ = max(min_sup, min_conf·n)`` of the antecedent's ``m`` open occurrences, so any ``m - θ + k`` of them
  hold at least ``k`` matches. Only that many are joined, those at the least busy time points, so a time point shared
  by a third of all changes is hardly ever joined.
* The join runs in cells (antecedent block × consequent block) of bounded size. All time points of a pair meet in the
  same cell, so pairs are counted without a shuffle of pair rows. Where few changes share a time point, copying rows
  per block would cost more than the pairs do; then the join runs by time point, with busy points cut into a grid.
* The pairs that pass get the exact lag histogram from the two classes' position lists.
* Where many changes share the time points of a domain of up to ``MAX_WORDS`` words of 64 positions, pairs are joined by a
  few wide segments of the timeline, met at their first common one only, and kept by a bound that takes one AND and
  ``bit_count`` per word: a match needs an open antecedent occurrence with a consequent's in the window behind it.
* A domain of up to 64 positions fits into one word. Then every class carries one bitmap per lag, and a pair is counted by
  AND and ``bit_count`` right where the join by cell and time point meets it first, so pairs are neither counted up nor
  written before they are known to be rules. Where classes are so busy that a pair would meet about as often as there are
  pairs, the join runs by cell alone and meets each pair once.
* Where most pairs meet anyway and there are many, cells are worked out in arrays inside tasks (``cells``), on domains of any
  length: a pair takes a sum of few bytes per window of its antecedent, which is far less than a row of a join.
* Rules of such cells and of short domains are not kept: a ``RuleSet`` knows its classes and works the rules out again wherever
  they are read, with what is wanted of both sides (``rules_with``), such as the names of the members, moved along with the
  classes. So nothing that grows with the rules is moved or written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import join_heavy, lookup, support_ceiling, support_floor, template_of_change
from ..session import materialize
from . import cells

# pair rows that one cell of the join should produce; small enough for its pair counts to stay in cache
CELL_ROWS = 3_000_000
# most cells of one join; with more work than this allows, antecedents are joined in several passes
MAX_CELLS = 100_000
# matches beyond the first that a pair must show at the probed occurrences
EXTRA_PROBES = 3
# how much busier than the required occurrences further ones may be
BUSIER = 1.5
# rows of one time point that stay together when the join runs by time point
POINT_ROWS = 2_000
# class pairs of one cell when rules are worked out
RULE_CELL_PAIRS = 500_000
# positions of a domain whose bitmaps fit into one word
WORD = 64
# most words of the bitmaps that candidates are found with
MAX_WORDS = 32
# classes of one side of a cell that is joined as a whole
CELL_CLASSES = 10_000
# members of a class that stay together when rules are written out
MEMBER_CHUNK = 10_000
# least pairs that are worked out in arrays, in all and per group; fewer are not worth starting Python for
ARRAY_PAIRS = 20_000
ARRAY_GROUP_PAIRS = 1_000
# how many pairs in arrays cost as much as one row of a join
ARRAY_GAIN = 20
# most rows of one side of a cell in arrays, and most bytes of its array of positions by consequents
ARRAY_ROWS = 16_384
ARRAY_BYTES = 64 << 20


@dataclass(frozen=True)
class Mined:
    """What rules are worked out from by ``word_rules``, and the steps that follow on them."""

    classes: DataFrame
    num_bins: int | tuple[int, ...]
    min_conf: float
    tail_prune: bool
    whole: bool
    steps: tuple[Callable[[DataFrame, Sequence[str]], DataFrame], ...] = ()
    arrays: bool = False

    def rules(
        self,
        by: Sequence[str],
        units: DataFrame | None = None,
        carried: Sequence[str] = (),
        sides: str = "ac",
        wanted: Sequence[str] = cells.RULE,
    ) -> DataFrame:
        """The rules; of ``cells.RULE`` only the ``wanted`` columns, where no step follows."""
        wanted = cells.RULE if self.steps else wanted
        common = {"units": units, "carried": carried, "sides": sides}
        if self.arrays:
            rules = cell_rules(self.classes, by, self.num_bins, self.min_conf, self.tail_prune, wanted=wanted, **common)
        else:
            rules = word_rules(self.classes, by, self.num_bins, self.min_conf, self.tail_prune, whole=self.whole, **common)
            # keeps filters that follow above this projection, so that pairs meet the join's cheap tests first
            rules = rules.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")
            rules = rules.drop(*[c for c in cells.RULE if c not in wanted])
        for step in self.steps:
            rules = step(rules, [f"{side}_{c}" for side in sides for c in carried])
        return rules


@dataclass(frozen=True)
class RuleSet:
    """Rules between classes of copies, and the members of each class; a compact, whole result.

    With ``mined``, ``rules`` is not kept but worked out by whoever reads it.
    """

    rules: DataFrame
    members: DataFrame
    by: tuple[str, ...]
    mined: Mined | None = None
    # of classes split by values: (by…, signature, size, least, values…)
    parts: DataFrame | None = None

    def expand(self) -> DataFrame:
        return expand_rules(self)

    def then(self, step: Callable[[DataFrame, Sequence[str]], DataFrame]) -> RuleSet:
        """The rules after one more step on each by itself; ``step(rules, carried)`` has to keep the ``carried`` columns."""
        mined = self.mined and replace(self.mined, steps=(*self.mined.steps, step))
        return RuleSet(step(self.rules, []), self.members, self.by, mined)

    def narrow(self, wanted: Sequence[str]) -> DataFrame:
        """The rules with their keys and the ``wanted`` ones of ``cells.RULE`` only, so that no others are worked out."""
        rules = self.rules if self.mined is None else self.mined.rules(self.by, wanted=wanted)
        return rules.drop(*[c for c in cells.RULE if c not in wanted])

    def rules_with(
        self, values: DataFrame, columns: Sequence[str], sides: str = "ac", wanted: Sequence[str] = cells.RULE
    ) -> DataFrame:
        """The rules with ``values(by…, signature, columns…)`` of their classes, as ``a_…`` and ``c_…``.

        A class with several rows of values has its rules once for each of them, one with none has no rules. Of ``cells.RULE``
        there are the ``wanted`` columns.
        """
        by, columns = list(self.by), list(columns)
        if self.mined is not None:
            units = join_heavy(values.select(*by, "signature", *columns), self.mined.classes, [*by, "signature"])
            rules = self.mined.rules(by, materialize(units, "units"), columns, sides, wanted)
            return rules.drop(*[c for c in cells.RULE if c not in wanted])
        rules = self.rules
        for side in sides:
            named = [F.col("signature").alias(f"sig_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns]]
            # a class may be in a large share of the rules
            rules = join_heavy(rules, values.select(*by, *named), [*by, f"sig_{side}"])
        return rules.drop(*[c for c in cells.RULE if c not in wanted])


def whitelist_templates(occurrences: DataFrame, templates: DataFrame) -> DataFrame:
    """Keep changes whose first ``_`` token is in ``templates(template)``."""
    tagged = occurrences.withColumn("template", template_of_change(F.col("change_id")))
    return lookup(tagged, templates.select("template").distinct(), ["template"], "left_semi").drop("template")


def profile_changes(
    occurrences: DataFrame, timepoints: DataFrame, by: Sequence[str] = (), domain_by: Sequence[str] = ()
) -> DataFrame:
    """Attach to each occurrence its position (NULL outside the domain), the change's ``n`` and the domain's size.

    ``domain_by`` are the ``by`` columns that ``timepoints`` has too. ``n`` counts all listed occurrences, also those
    outside the domain; a repeated one counts once.
    """
    by, domain_by = list(by), list(domain_by)
    occurrences = materialize(occurrences.select(*by, "change_id", "tp").distinct(), "occurrences")
    timepoints = materialize(timepoints.select(*domain_by, "tp", "tp_idx"), "domain")
    sizes = timepoints.groupBy(*domain_by).agg(F.count(F.lit(1)).alias("n_points"))
    if domain_by:
        placed = lookup(occurrences, sizes, domain_by)
    else:
        placed = occurrences.withColumn("n_points", F.lit(sizes.first()["n_points"]))
    placed = lookup(placed, timepoints.select(*domain_by, "tp", "tp_idx"), [*domain_by, "tp"], "left")
    same_change = Window.partitionBy(*by, "change_id")
    return placed.select(
        *by,
        "change_id",
        F.col("tp_idx").alias("idx"),
        F.count(F.lit(1)).over(same_change).alias("n"),
        F.col("n_points").cast("long").alias("n_points"),
    )


def within_support(profile: DataFrame, min_sup: float, max_sup: float) -> DataFrame:
    """Support filter for both sides; adds ``min_abs``, the rule's least support."""
    least = support_floor(min_sup, F.col("n_points"))
    most = support_ceiling(max_sup, F.col("n_points"))
    return profile.where((F.col("n") >= least) & (F.col("n") <= most)).withColumn("min_abs", least)


def _width(num_bins: int | Sequence[int]) -> Column:
    """The window size; of several ones that of the row, in its column ``num_bins``."""
    return F.lit(num_bins) if isinstance(num_bins, int) else F.col("num_bins")


def _widths(num_bins: int | Sequence[int]) -> list[int]:
    return [num_bins] if isinstance(num_bins, int) else sorted(set(num_bins))


def position_classes(
    profile: DataFrame, by: Sequence[str], num_bins: int | Sequence[int], boundary_expiry: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Classes of changes with equal positions, and the members of each.

    A class is known by 128 bits of SHA-256 over count and positions (``signature``) and, for cheap pair keys, by a
    number (``class_id``). ``a_keys`` and ``c_keys`` hold ``idx·num_bins + lag`` for the positions a class covers as
    antecedent and can match as consequent; their intersection is the list of matches.
    """
    by = list(by)
    bins = _width(num_bins)
    change = Window.partitionBy(*by, "change_id").orderBy("idx")
    before, after = F.lag("idx").over(change), F.lead("idx").over(change)
    steps = profile.where(F.col("idx").isNotNull()).select(
        *by,
        "change_id",
        "n",
        "n_points",
        "min_abs",
        "idx",
        F.coalesce(F.col("idx") - before, bins).alias("gap"),
        F.least(F.col("idx") + bins, after, F.col("n_points").cast("int")).alias("hi"),
        F.row_number().over(change).alias("_place"),
    )
    if boundary_expiry:
        # in a run of gaps equal to num_bins every second occurrence is lost, beginning with the second
        so_far = change.rowsBetween(Window.unboundedPreceding, 0)
        starts_run = (F.col("gap") != bins) | (F.col("_place") == 1)
        run = F.max(F.when(starts_run, F.col("_place"))).over(so_far)
        steps = steps.withColumn("open", (F.col("_place") - run) % 2 == 0)
    else:
        steps = steps.withColumn("open", F.lit(True))
    per_change = steps.groupBy(*by, "change_id", "n", "n_points", "min_abs").agg(
        F.sort_array(F.collect_list(F.struct("idx", "gap", "hi", "open"))).alias("points")
    )
    signature = F.concat_ws(
        ",", F.col("n").cast("string"), F.col("n_points").cast("string"), F.col("points.idx").cast("array<string>")
    )
    tagged = per_change.withColumn(
        "signature", F.substring(F.unhex(F.sha2(signature, 256)), 1, 16).cast("binary")
    )
    tagged = materialize(tagged, "classes")
    members = tagged.select(*by, "signature", "change_id")
    classes = tagged.groupBy(*by, "signature").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.first(c).alias(c) for c in ("n", "n_points", "min_abs", "points")],
    )
    opened = F.filter("points", lambda p: p["open"])
    a_keys = F.flatten(
        F.transform(
            opened,
            lambda p: F.sequence(
                p["idx"].cast("long") * bins,
                p["idx"].cast("long") * bins + (p["hi"] - p["idx"] - 1) * (bins + 1),
                (bins + 1).cast("long"),
            ),
        )
    )
    c_keys = F.flatten(
        F.transform(
            "points",
            lambda p: F.sequence(
                p["idx"].cast("long") * bins,
                p["idx"].cast("long") * bins + F.least(p["gap"], bins) - 1,
            ),
        )
    )
    classes = classes.select(
        # the numbers are fixed by being written
        F.monotonically_increasing_id().alias("class_id"),
        "*",
        F.size(opened).alias("n_open"),
        a_keys.alias("a_keys"),
        c_keys.alias("c_keys"),
    )
    return materialize(classes, "points"), members


def _least_matches(min_conf: float) -> Column:
    # rounded down a little, so that it never exceeds the exact bound; the exact test follows on the finished rule
    by_confidence = F.ceil(F.lit(float(min_conf)) * F.col("n") - 1e-6)
    return F.greatest(F.lit(1), F.col("min_abs"), by_confidence).cast("int")


def _probes(
    classes: DataFrame, by: list[str], num_bins: int | Sequence[int], min_conf: float, extra: int
) -> DataFrame:
    """Antecedent occurrences to join: at least ``m - θ + k`` of each class, at the least busy time points."""
    position = Window.partitionBy(*by).orderBy("idx")
    ahead = [
        F.when(_width(num_bins) == width, F.sum("_here").over(position.rangeBetween(0, width - 1)))
        for width in _widths(num_bins)
    ]
    load = (
        classes.select(*by, F.explode("points.idx").alias("idx"))
        .groupBy(*by, "idx")
        .agg(F.count(F.lit(1)).alias("_here"))
        .withColumn("load", F.coalesce(*ahead))
        .drop("_here")
    )
    least = _least_matches(min_conf)
    least_wanted = F.least(F.col("n_open"), F.col("n_open") - F.col("theta") + 1 + extra)
    opened = (
        classes.withColumn("theta", least)
        .where(F.col("n_open") >= F.col("theta"))
        .withColumn("wanted", least_wanted)
        .withColumn("spare", F.col("n_open") - F.col("theta"))
        .select(*by, "class_id", "size", "theta", "wanted", "spare", F.explode("points").alias("p"))
        .where("p.open")
        .select(*by, "class_id", "size", "theta", "wanted", "spare", F.col("p.idx").alias("idx"), F.col("p.hi").alias("hi"))
    )
    whole = Window.partitionBy("class_id")
    cheapest = whole.orderBy("load", "idx")
    # further occurrences sharpen the test; they are worth it where they are not much busier than the required ones
    worth = F.max(F.when(F.col("_rank") <= F.col("wanted"), F.col("load"))).over(whole) * BUSIER
    return (
        lookup(opened, load, [*by, "idx"])
        .withColumn("_rank", F.row_number().over(cheapest))
        .withColumn("_worth", worth)
        .where((F.col("_rank") <= F.col("wanted")) | (F.col("load") <= F.col("_worth")))
        .withColumn("need", F.greatest(F.lit(1), F.count(F.lit(1)).over(whole) - F.col("spare")).cast("int"))
        .drop("_rank", "_worth", "wanted", "spare")
    )


def _block(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts).cast("int")


def _in_blocks(
    antecedents: DataFrame,
    consequents: DataFrame,
    by: list[str],
    blocks: DataFrame | int,
    partitions: int,
    keys: tuple[str, str] = ("a", "c"),
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Give both sides the cells they take part in and place each cell's rows together; ``keys`` deal rows to blocks."""
    parts = F.lit(blocks) if isinstance(blocks, int) else F.coalesce(F.col("_blocks"), F.lit(1))
    if not isinstance(blocks, int):
        antecedents = lookup(antecedents, blocks, by, "left")
        consequents = lookup(consequents, blocks, by, "left")
    everywhere = F.explode(F.sequence(F.lit(0), parts - 1))
    left = antecedents.withColumn("ca", _block(keys[0], parts)).withColumn("cc", everywhere)
    right = consequents.withColumn("cc", _block(keys[1], parts)).withColumn("ca", everywhere)
    cell = ["ca", "cc"]
    if by:
        # places cells; the join compares the values themselves
        left, right = (side.withColumn("place", F.xxhash64(*by)) for side in (left, right))
        cell = ["place", *cell]
    return left.repartition(partitions, *cell), right.repartition(partitions, *cell), cell


def _by_point(
    antecedents: DataFrame, consequents: DataFrame, by: list[str], partitions: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cells are time points; a busy one is cut into a grid so that no cell has more than ``POINT_ROWS`` per side."""
    splits = (
        antecedents.select(*by, "idx", F.lit(1).alias("_a"), F.lit(0).alias("_c"))
        .unionByName(consequents.select(*by, "idx", F.lit(0).alias("_a"), F.lit(1).alias("_c")))
        .groupBy(*by, "idx")
        .agg(F.sum("_a").alias("_a"), F.sum("_c").alias("_c"))
        .select(
            *by,
            "idx",
            F.ceil(F.col("_a") / POINT_ROWS).cast("int").alias("_as"),
            F.ceil(F.col("_c") / POINT_ROWS).cast("int").alias("_cs"),
        )
        .where("_as > 0 AND _cs > 0")
    )
    key = [*by, "idx"]
    left = lookup(antecedents, splits, key).select(
        "*", _block("a", F.col("_as")).alias("ca"), F.explode(F.sequence(F.lit(0), F.col("_cs") - 1)).alias("cc")
    )
    right = lookup(consequents, splits, key).select(
        "*", _block("c", F.col("_cs")).alias("cc"), F.explode(F.sequence(F.lit(0), F.col("_as") - 1)).alias("ca")
    )
    # the number of tasks follows the pairs, not the much smaller input
    place = [*by, "idx", "ca", "cc"]
    left, right = (side.drop("_as", "_cs").repartition(partitions, *place) for side in (left, right))
    return left, right, ["ca", "cc"]


def candidate_pairs(
    classes: DataFrame,
    by: Sequence[str],
    num_bins: int | Sequence[int],
    min_conf: float,
    extra: int = EXTRA_PROBES,
    layout: str = "auto",
) -> DataFrame:
    """Class pairs whose matches at the probed occurrences are enough for a rule. No rule is lost.

    ``layout`` is ``bitmaps``, ``blocks``, ``points``, or ``auto`` for the one that moves fewer rows.
    """
    by = list(by)
    probes = materialize(_probes(classes, by, num_bins, min_conf, extra), "probes")
    pairs = probes.agg(F.sum("load")).first()[0] or 0
    passes = math.ceil(2 * pairs / CELL_ROWS / MAX_CELLS)
    if passes <= 1:
        return materialize(_candidates(classes, probes, by, num_bins, layout), "candidates")
    found = None
    for k in range(passes):
        part = probes.where(F.pmod(F.xxhash64(F.lit("pass"), "class_id"), F.lit(passes)) == k)
        some = materialize(_candidates(classes, part, by, num_bins, layout), "candidates")
        found = some if found is None else found.unionByName(some)
    return found


def _candidates(
    classes: DataFrame, probes: DataFrame, by: list[str], num_bins: int | Sequence[int], layout: str
) -> DataFrame:
    work = probes.groupBy(*by).agg(
        F.sum("load").alias("pairs"), F.sum(F.col("hi") - F.col("idx")).alias("rows")
    )
    total = work.agg(
        F.sum("pairs").alias("pairs"),
        F.sum("rows").alias("rows"),
        F.max("pairs").alias("most"),
    ).first()
    antecedents = probes.select(
        *by, F.col("class_id").alias("a"), F.col("size").alias("size_a"), "theta", "need", F.col("idx").alias("_from"), "hi"
    )
    consequents = classes.select(*by, F.col("class_id").alias("c"), F.col("n").alias("n_c"), "points")

    def opened_up(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        left = left.withColumn("idx", F.explode(F.sequence(F.col("_from"), F.col("hi") - 1))).drop("hi")
        right = right.withColumn("p", F.explode("points")).drop("points")
        return (
            left.withColumn("lag", F.col("idx") - F.col("_from")).drop("_from"),
            right.withColumns({"idx": F.col("p.idx"), "gap": F.col("p.gap")}).drop("p"),
        )

    pairs, rows, most = total["pairs"] or 0, total["rows"] or 0, total["most"] or 0
    side = max(1, math.ceil(math.sqrt(most / CELL_ROWS)))
    parallel = classes.sparkSession.sparkContext.defaultParallelism
    partitions = max(parallel, 2 * math.ceil(pairs / CELL_ROWS))
    dense = side == 1 or 2 * rows * side < pairs
    if layout == "bitmaps" or (layout == "auto" and dense):
        n_points = classes.agg(F.max("n_points")).first()[0] or 0
        if n_points <= WORD * MAX_WORDS:
            return _bitmap_candidates(classes, probes, by, num_bins, n_points, work, pairs, side, partitions)
    if layout in ("blocks", "bitmaps") or (layout == "auto" and dense):
        side = max(side, math.isqrt(parallel - 1) + 1 if pairs > CELL_ROWS // 10 and not by else 1)
        blocks: DataFrame | int = side
        if by and side > 1:
            blocks = work.where(F.col("pairs") > CELL_ROWS).select(
                *by, F.ceil(F.sqrt(F.col("pairs") / CELL_ROWS)).cast("int").alias("_blocks")
            )
        left, right, cell = _in_blocks(antecedents, consequents, by, blocks, partitions)
        # time points are opened up where their cell is, so they do not move
        left, right = opened_up(left, right)
        # a pair lives in one cell, so counting by cell and pair needs no shuffle
        pair = cell
    else:
        left, right, cell = _by_point(*opened_up(antecedents, consequents), by, partitions)
        pair = []

    left, right = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*cell, *by, "idx"]]
    # a consequent matches at most as often as it occurs
    fits = (
        (F.col("lag") < F.col("gap"))
        & (F.col("n_c") >= F.col("theta"))
        & ((F.col("a") != F.col("c")) | (F.col("size_a") > 1))
    )
    matched = left.join(right, [*same, fits])
    return (
        matched.groupBy(*[F.col(f"l.{k}").alias(k) for k in pair], "a", "c")
        .agg(F.count(F.lit(1)).alias("matches"), F.max("need").alias("need"))
        .where(F.col("matches") >= F.col("need"))
        .select("a", "c")
    )


def _bitmap_candidates(
    classes: DataFrame,
    probes: DataFrame,
    by: list[str],
    num_bins: int | Sequence[int],
    n_points: int,
    work: DataFrame,
    pairs: int,
    side: int,
    partitions: int,
) -> DataFrame:
    """Class pairs with enough open antecedent occurrences that have a consequent's occurrence in the window behind them."""
    words = range(math.ceil(n_points / WORD))
    # at most 64 segments, so that a class's segments are one word
    length = max(*_widths(num_bins), math.ceil(n_points / WORD), 1)

    def segment(place: Column) -> Column:
        return F.floor(place / length).cast("int")

    def word(places: str, k: int) -> Column:
        inside = F.filter(places, lambda p: F.floor(p / WORD) == k)
        return _bits(F.transform(inside, lambda p: p - WORD * k))

    probed = probes.select(
        "class_id", "theta", F.explode(F.sequence(segment(F.col("idx")), segment(F.col("hi") - 1))).alias("segment")
    )
    probed = probed.groupBy("class_id", "theta").agg(F.collect_set("segment").alias("segments"))
    opened = F.transform(F.filter("points", lambda p: p["open"]), lambda p: p["idx"])
    left = classes.join(probed, "class_id").select(
        *by, F.col("class_id").alias("a"), F.col("size").alias("size_a"), "theta", "segments", opened.alias("opened")
    )
    left = left.select(
        *by, "a", "size_a", "theta", "segments", _bits(F.col("segments")).alias("cover"), *[word("opened", k).alias(f"a_{k}") for k in words]
    )

    width = _width(num_bins)
    ahead = F.flatten(F.transform("points.idx", lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), i)))
    right = classes.select(
        *by,
        F.col("class_id").alias("c"),
        F.col("n").alias("n_c"),
        F.array_distinct(F.transform("points.idx", segment)).alias("segments"),
        F.array_distinct(ahead).alias("ahead"),
    )
    right = right.select(
        *by, "c", "n_c", "segments", _bits(F.col("segments")).alias("met"), *[word("ahead", k).alias(f"d_{k}") for k in words]
    )

    parallel = classes.sparkSession.sparkContext.defaultParallelism
    side = max(side, math.isqrt(parallel - 1) + 1 if pairs > CELL_ROWS // 10 and not by else 1)
    blocks: DataFrame | int = side
    if by and side > 1:
        blocks = work.where(F.col("pairs") > CELL_ROWS).select(
            *by, F.ceil(F.sqrt(F.col("pairs") / CELL_ROWS)).cast("int").alias("_blocks")
        )
    left, right, cell = _in_blocks(left, right, by, blocks, partitions)
    # a class moves once per cell and is opened up into its segments there
    left, right = (side_.withColumn("segment", F.explode("segments")).drop("segments") for side_ in (left, right))
    left = left.withColumn("below", F.col("cover").bitwiseAND(_below(F.col("segment")))).drop("cover")
    left, right = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*cell, *by, "segment"]]
    bound = sum((F.bit_count(F.col(f"a_{k}").bitwiseAND(F.col(f"d_{k}"))) for k in words), F.lit(0))
    fits = (
        (F.col("below").bitwiseAND(F.col("met")) == 0)
        & (F.col("n_c") >= F.col("theta"))
        & ((F.col("a") != F.col("c")) | (F.col("size_a") > 1))
        & (bound >= F.col("theta"))
    )
    return left.join(right, [*same, fits]).select("a", "c")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _below(place: Column) -> Column:
    """All positions before ``place``, which is below 64."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), place))


def _bits(places: Column) -> Column:
    """The bitmap of an array of positions below 64."""
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda word, place: word.bitwiseOR(_bit(place)))


def meetings(classes: DataFrame, by: Sequence[str], num_bins: int | Sequence[int], min_conf: float) -> tuple[int, int, int]:
    """How often pairs of classes meet at probed positions, the number of pairs and that of groups."""
    by = list(by)
    met = _probes(classes, by, num_bins, min_conf, 0).agg(F.sum("load")).first()[0] or 0
    sizes = classes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    pairs, groups = sizes.agg(F.sum(F.col("n") * F.col("n")), F.count(F.lit(1))).first()
    return met, pairs or 0, groups


def meets_most(classes: DataFrame, by: Sequence[str], num_bins: int | Sequence[int], min_conf: float) -> bool:
    """Whether pairs of classes meet about as often at probed positions as there are pairs."""
    met, pairs, _ = meetings(classes, by, num_bins, min_conf)
    return 2 * met >= pairs


def _whole_cells(units: DataFrame, by: list[str], most: int | None = None) -> tuple[DataFrame | int, int]:
    """Blocks of up to ``CELL_CLASSES`` or ``most`` rows, more where there would be too few cells, and the number of cells."""
    most = most or CELL_CLASSES
    sizes = units.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    groups, pairs = sizes.agg(F.count(F.lit(1)), F.sum(F.col("_rows").cast("double") * F.col("_rows"))).first()
    wanted = 4 * units.sparkSession.sparkContext.defaultParallelism if (pairs or 0) > CELL_ROWS else 1
    least = math.ceil(math.sqrt(wanted / max(1, groups)))
    blocks = sizes.select(*by, F.greatest(F.lit(least), F.ceil(F.col("_rows") / most)).cast("int").alias("_blocks"))
    if not by:
        side = blocks.first()["_blocks"] if groups else 1
        return side, side * side
    return blocks, blocks.agg(F.sum(F.col("_blocks") * F.col("_blocks"))).first()[0] or 1


def word_rules(
    classes: DataFrame,
    by: Sequence[str],
    num_bins: int | Sequence[int],
    min_conf: float,
    tail_prune: bool = True,
    *,
    units: DataFrame | None = None,
    carried: Sequence[str] = (),
    sides: str = "ac",
    whole: bool = False,
) -> DataFrame:
    """The same rules as ``class_rules`` for a domain of at most ``WORD`` positions, in one join.

    For lag k, a bitmap has the positions that an open antecedent occurrence reaches, and another one the consequent's
    occurrences without another one in the k positions before; their common bits are the matches with that lag. As many lags
    as fit share a word, in ``y_0 …`` and ``c_0 …``, so that a pair takes few of them. A pair meets at every
    common position of the antecedent's probed windows and is counted at the first of them only; with ``whole`` it meets
    once, in its cell. ``units`` are the classes with ``carried`` columns, which the rules then have for the ``sides``; a
    class may have several units.
    """
    by = list(by)
    bins, lags = _width(num_bins), range(max(_widths(num_bins)))
    opened = F.filter("points", lambda p: p["open"])
    apart = carried if units is not None else []
    units = classes if units is None else units
    if whole:
        opening = units.withColumn("theta", _least_matches(min_conf)).where(F.col("n_open") >= F.col("theta"))
        probed, places = [], []
    else:
        probes = materialize(_probes(classes, by, num_bins, min_conf, 0), "probes")
        work = probes.groupBy(*by).agg(F.sum("load").alias("pairs"))
        total = work.agg(F.sum("pairs").alias("pairs"), F.max("pairs").alias("most")).first()
        pairs, most = total["pairs"] or 0, total["most"] or 0
        windows = probes.select("class_id", "theta", F.explode(F.sequence(F.col("idx"), F.col("hi") - 1)).alias("idx"))
        windows = windows.groupBy("class_id", "theta").agg(F.collect_set("idx").alias("probed"))
        opening = units.join(windows, "class_id")
        probed, places = [F.col("probed")], [F.col("points.idx").alias("places")]
    # units of a class are dealt to blocks one by one
    unit = F.xxhash64("class_id", *apart) if apart else F.col("class_id")

    def of_side(side: str) -> list[Column]:
        return [F.col(c).alias(f"{side}_{c}") for c in apart if side in sides]

    n_points = classes.agg(F.max("n_points")).first()[0] or 1
    shared = max(1, WORD // n_points)
    words = range(math.ceil(len(lags) / shared))

    def shifted(places: Column, by_points: int) -> Column:
        return F.transform(places, lambda p: p + by_points)

    def packed(lag_places: Callable[[int], Column], w: int) -> Column:
        return _bits(F.concat(*[shifted(lag_places(k), k % shared * n_points) for k in lags if k // shared == w]))

    def reached(k: int) -> Column:
        return F.transform(F.filter(opened, lambda p: p["hi"] - p["idx"] > k), lambda p: p["idx"] + k)

    def alone(k: int) -> Column:
        return F.transform(F.filter("points", lambda p: p["gap"] > k), lambda p: p["idx"])

    def of_lag(k: int) -> Column:
        bits = (1 << n_points) - 1 << k % shared * n_points
        return matches(k // shared).bitwiseAND(F.lit(bits - (1 << WORD) if bits >> WORD - 1 else bits).cast("bigint"))

    sizes = [F.col("n").alias("n_a"), F.col("size").alias("size_a"), F.col("signature").alias("sig_a")]
    antecedents = opening.select(
        *by, F.col("class_id").alias("a"), unit.alias("ua"), *sizes, "n_points", "theta", *probed, *[packed(reached, w).alias(f"y_{w}") for w in words], *of_side("a")
    )
    # a pair whose first match comes with fewer than num_bins positions left is not started
    last = F.greatest(F.col("n_points") - bins + 1, F.lit(0)).cast("int")
    early = F.when(last >= WORD, F.lit(-1).cast("bigint")).otherwise(_below(last))
    for k in range(1, shared):
        early = early.bitwiseOR(F.call_function("shiftleft", _below(last), F.lit(k * n_points)))
    antecedents = antecedents.select("*", early.alias("early"))
    if not whole:
        antecedents = antecedents.withColumn("cover", _bits(F.col("probed")))
    consequents = units.select(
        *by,
        F.col("class_id").alias("c"),
        unit.alias("uc"),
        F.col("n").alias("n_c"),
        F.col("size").alias("size_c"),
        F.col("signature").alias("sig_c"),
        *places,
        *[packed(alone, w).alias(f"c_{w}") for w in words],
        *of_side("c"),
    )
    parallel = classes.sparkSession.sparkContext.defaultParallelism
    if whole:
        blocks, partitions = _whole_cells(units, by)
        left, right, cell = _in_blocks(antecedents, consequents, by, blocks, partitions, ("ua", "uc"))
        meet = cell
    else:
        side = max(1, math.ceil(math.sqrt(most / CELL_ROWS)))
        side = max(side, math.isqrt(parallel - 1) + 1 if pairs > CELL_ROWS // 10 and not by else 1)
        blocks = side
        if by and side > 1:
            blocks = work.where(F.col("pairs") > CELL_ROWS).select(
                *by, F.ceil(F.sqrt(F.col("pairs") / CELL_ROWS)).cast("int").alias("_blocks")
            )
        partitions = max(parallel, 2 * math.ceil(pairs / CELL_ROWS))
        left, right, cell = _in_blocks(antecedents, consequents, by, blocks, partitions, ("ua", "uc"))
        # a class moves once per cell and is opened up into its time points there
        left = left.withColumn("idx", F.explode("probed")).drop("probed")
        left = left.withColumn("below", F.col("cover").bitwiseAND(_below(F.col("idx")))).drop("cover")
        right = right.withColumn("idx", F.explode("places")).drop("places")
        meet = [*cell, "idx"]
    left, right = left.alias("l"), right.alias("r")

    def matches(w: int) -> Column:
        return F.col(f"y_{w}").bitwiseAND(F.col(f"c_{w}"))

    support = sum((F.bit_count(matches(w)) for w in words), F.lit(0))
    # the cheapest tests first; the exact one on confidence stands here so that it does not move before them
    fits = [
        F.col("n_c") >= F.col("theta"),
        support >= F.col("theta"),
        (F.col("a") != F.col("c")) | (F.col("size_a") > 1),
        support / F.col("n_a") >= F.lit(float(min_conf)),
    ]
    if not whole:
        fits.insert(0, F.col("below").bitwiseAND(F.col("c_0")) == 0)
    if tail_prune:
        found = [matches(w) for w in words]
        fits.append(reduce(Column.bitwiseOR, found).bitwiseAND(F.col("early")) != 0)
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*meet, *by]]
    met = left.join(right, [*same, *fits])
    extra = [f"{side}_{c}" for side in sides for c in apart]
    of_left = bins if isinstance(num_bins, int) else F.col("l.num_bins")
    counts = met.select(
        *[F.col(f"l.{k}").alias(k) for k in by],
        "sig_a",
        "sig_c",
        "size_a",
        "size_c",
        support.cast("long").alias("support"),
        "n_a",
        "n_c",
        F.slice(F.array(*[F.bit_count(of_lag(k)) for k in lags]), F.lit(1), of_left).cast("array<int>").alias("hist"),
        "n_points",
        *extra,
    )
    return counts.select(
        *by,
        "sig_a",
        "sig_c",
        "size_a",
        "size_c",
        "support",
        (F.col("support") / F.col("n_a")).alias("confidence"),
        (F.col("support") / (F.col("n_a") * F.col("n_c"))).alias("lift"),
        "hist",
        "n_points",
        *extra,
    )


def cell_rules(
    classes: DataFrame,
    by: Sequence[str],
    num_bins: int | Sequence[int],
    min_conf: float,
    tail_prune: bool = True,
    *,
    units: DataFrame | None = None,
    carried: Sequence[str] = (),
    sides: str = "ac",
    wanted: Sequence[str] = cells.RULE,
) -> DataFrame:
    """The same rules as ``class_rules``, of all pairs in cells that are worked out in arrays.

    ``units`` and ``carried`` are as in ``word_rules``; of the columns of a rule only the ``wanted`` ones are made. A class's
    units stay together up to ``MEMBER_CHUNK``, so that it is counted once per cell.
    """
    by = list(by)
    apart = list(carried) if units is not None else []
    units = classes if units is None else units
    units = units.where(F.size("points") > 0)
    for k in by:
        # a group without a name has no rules
        units = units.where(F.col(k).isNotNull())
    widest = classes.agg(F.max(F.array_max("points.idx"))).first()[0] or 0
    blocks, n_cells = _whole_cells(units, by, max(1, min(ARRAY_ROWS, ARRAY_BYTES // (widest + 1))))
    parts = F.lit(blocks) if isinstance(blocks, int) else F.coalesce(F.col("_blocks"), F.lit(1))
    if not isinstance(blocks, int):
        units = lookup(units, blocks, by, "left")
    chunk = F.pmod(F.xxhash64("class_id", *apart), F.ceil(F.col("size") / MEMBER_CHUNK).cast("int"))
    block = F.pmod(F.xxhash64("class_id", chunk), parts).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), parts - 1))
    opened = F.filter("points", lambda p: p["open"] & (p["hi"] > p["idx"]))
    no_lengths = F.array().cast("array<int>")

    def side(rows: DataFrame, name: str, places: Column, lengths: Column, theta: Column) -> DataFrame:
        own, other = ("ca", "cc") if name == "a" else ("cc", "ca")
        values = [F.col(c) if name in sides else F.lit(None).cast(units.schema[c].dataType).alias(c) for c in apart]
        return rows.select(
            *by,
            block.alias(own),
            everywhere.alias(other),
            F.lit(name == "c").alias("right"),
            "class_id",
            *[F.col(c).cast("long").alias(c) for c in ("n", "size", "n_points")],
            theta.cast("long").alias("theta"),
            places.cast("array<int>").alias("places"),
            lengths.cast("array<int>").alias("lengths"),
            "signature",
            *[value.alias(f"of_{c}") for value, c in zip(values, apart)],
        )

    theta = _least_matches(min_conf)
    left = side(
        units.where(F.col("n_open") >= theta),
        "a",
        F.transform(opened, lambda p: p["idx"]),
        F.transform(opened, lambda p: p["hi"] - p["idx"]),
        theta,
    )
    right = side(units, "c", F.col("points.idx"), no_lengths, F.lit(0))
    cell = [*by, "ca", "cc"]
    placed = left.unionByName(right.select(*left.columns)).repartition(max(1, min(n_cells, MAX_CELLS)), *cell)
    kinds = {"sig_a": "binary", "sig_c": "binary", "confidence": "double", "lift": "double", "hist": "array<int>"}
    wanted = [c for c in cells.RULE if c in wanted]
    of_sides = [(f"{s}_{c}", s, f"of_{c}") for s in sides for c in apart]
    schema = StructType(
        [
            *[classes.schema[k] for k in by],
            *[StructField(c, StructType.fromDDL(f"x {kinds.get(c, 'bigint')}")["x"].dataType) for c in wanted],
            *[StructField(f"{s}_{c}", units.schema[c].dataType) for s in sides for c in apart],
        ]
    )
    bins = num_bins if isinstance(num_bins, int) else None
    return placed.groupBy(*cell).applyInArrow(cells.rules_of_cell(by, bins, min_conf, tail_prune, wanted, of_sides), schema)


def class_rules(
    classes: DataFrame,
    candidates: DataFrame,
    by: Sequence[str],
    num_bins: int | Sequence[int],
    min_conf: float,
    tail_prune: bool = True,
) -> DataFrame:
    """Exact support, confidence, lift and lag histogram of candidate class pairs; drops pairs below the thresholds.

    Pairs are dealt to cells (antecedent block × consequent block) and the classes are copied to the cells of their block, so
    position lists move once per cell and not once per pair, and a class with many partners is spread over many cells.
    """
    by = list(by)
    bins = _width(num_bins)
    parallel = classes.sparkSession.sparkContext.defaultParallelism
    n_pairs = candidates.count()
    side = max(math.isqrt(parallel - 1) + 1, math.ceil(math.sqrt(n_pairs / RULE_CELL_PAIRS)))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    ante = classes.select(
        *by,
        F.col("class_id").alias("a"),
        F.col("signature").alias("sig_a"),
        F.col("n").alias("n_a"),
        F.col("size").alias("size_a"),
        "n_points",
        "min_abs",
        "a_keys",
    ).join(candidates.select("a").distinct(), "a", "left_semi")
    cons = classes.select(
        F.col("class_id").alias("c"),
        F.col("signature").alias("sig_c"),
        F.col("n").alias("n_c"),
        F.col("size").alias("size_c"),
        "c_keys",
    ).join(candidates.select("c").distinct(), "c", "left_semi")
    cell = ["ca", "cc"]
    pairs = candidates.withColumns({"ca": _block("a", F.lit(side)), "cc": _block("c", F.lit(side))})
    ante = ante.withColumn("ca", _block("a", F.lit(side))).withColumn("cc", everywhere)
    cons = cons.withColumn("cc", _block("c", F.lit(side))).withColumn("ca", everywhere)
    pairs, ante, cons = (df.repartition(side * side, *cell) for df in (pairs, ante, cons))
    matches = (
        pairs.join(ante, [*cell, "a"])
        .join(cons, [*cell, "c"])
        .select(
            *by,
            *["sig_a", "sig_c", "n_a", "n_c", "size_a", "size_c", "n_points", "min_abs"],
            F.array_intersect("a_keys", "c_keys").alias("found"),
            # keeps the filters below above this projection, so that lists are intersected once
            F.monotonically_increasing_id().alias("_row"),
        )
        .withColumn("support", F.size("found").cast("long"))
        .withColumn("confidence", F.col("support") / F.col("n_a"))
        .where("_row >= 0")
    )
    kept = matches.where(
        (F.col("support") >= F.greatest(F.lit(1), F.col("min_abs"))) & (F.col("confidence") >= F.lit(float(min_conf)))
    )
    if tail_prune:
        # a pair whose first match comes with fewer than num_bins positions left is not started
        kept = kept.where(F.floor(F.array_min("found") / bins) <= F.col("n_points") - bins)
    lags = F.transform("found", lambda key: key % bins)
    hist = F.transform(
        F.sequence(F.lit(0), bins - 1), lambda k: F.size(F.filter(lags, lambda lag: lag == k))
    )
    return kept.select(
        *by,
        "sig_a",
        "sig_c",
        "size_a",
        "size_c",
        "support",
        "confidence",
        (F.col("support") / (F.col("n_a") * F.col("n_c"))).alias("lift"),
        hist.cast("array<int>").alias("hist"),
        "n_points",
    )


def expand_rules(rule_set: RuleSet) -> DataFrame:
    """Write class rules out per pair of member changes."""
    by = list(rule_set.by)
    rules, members = rule_set.rules, rule_set.members
    of_classes = {*by, "sig_a", "sig_c", "size_a", "size_c", "n_points"}
    kept = [*by, "antecedent", "consequent", *[c for c in rules.columns if c not in of_classes]]
    different = F.col("antecedent") != F.col("consequent")
    if rule_set.mined is not None and rule_set.mined.arrays:
        both = rule_set.rules_with(members, ["change_id"], wanted=[c for c in kept if c in cells.RULE])
        return both.withColumnsRenamed({"a_change_id": "antecedent", "c_change_id": "consequent"}).where(different).select(*kept)
    if rule_set.mined is not None:
        # names move with the classes; rules are opened up where they are found
        both = rule_set.rules_with(_member_lists(rule_set), ["names"])
        both = both.withColumn("antecedent", F.explode("a_names")).withColumn("consequent", F.explode("c_names"))
        return both.where(different).select(*kept)
    sizes = rules.select(*by, F.col("sig_a").alias("signature"), F.col("size_a").alias("size")).unionByName(
        rules.select(*by, F.col("sig_c").alias("signature"), F.col("size_c").alias("size"))
    )
    large = sizes.where(F.col("size") > MEMBER_CHUNK).distinct()
    chunks = lambda size: F.ceil(F.col(size) / MEMBER_CHUNK).cast("int")
    placed = lookup(members, large, [*by, "signature"], "left").select(
        *by,
        "signature",
        "change_id",
        F.coalesce(F.pmod(F.xxhash64("change_id"), chunks("size")).cast("int"), F.lit(0)).alias("chunk"),
    )

    def with_members(df: DataFrame, side: str, name: str) -> DataFrame:
        spread = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks(f"size_{side}") - 1)))
        named = placed.select(*by, F.col("signature").alias(f"sig_{side}"), "chunk", F.col("change_id").alias(name))
        # a class may be in a large share of the rules
        return join_heavy(spread, named, [*by, f"sig_{side}", "chunk"]).drop("chunk")

    both = with_members(with_members(rules, "a", "antecedent"), "c", "consequent")
    return both.where(different).select(*kept)


def _member_lists(rule_set: RuleSet) -> DataFrame:
    """(by…, signature, names): the members of each class in lists of about ``MEMBER_CHUNK`` at most."""
    key = [*rule_set.by, "signature"]
    large = rule_set.mined.classes.where(F.col("size") > MEMBER_CHUNK).select(*key, "size")
    chunk = F.pmod(F.xxhash64("change_id"), F.ceil(F.col("size") / MEMBER_CHUNK).cast("int"))
    placed = lookup(rule_set.members, large, key, "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)))
    return placed.groupBy(*key, "chunk").agg(F.collect_list("change_id").alias("names"))


def mine_profile(
    profile: DataFrame,
    *,
    num_bins: int | Sequence[int],
    min_conf: float,
    by: Sequence[str] = (),
    boundary_expiry: bool = True,
    tail_prune: bool = True,
    extra: int = EXTRA_PROBES,
    layout: str = "auto",
) -> RuleSet:
    """Mine rules from a profile that has passed a support filter (``min_abs`` set); pairs stay within ``by``.

    Several window sizes are mined in one run: the size is one more key of the join, and of the rules, as ``num_bins``.
    """
    if not isinstance(num_bins, int):
        profile = profile.withColumn("num_bins", F.explode(F.array(*[F.lit(width) for width in _widths(num_bins)])))
        by = [*by, "num_bins"]
    classes, members = position_classes(profile, by, num_bins, boundary_expiry)
    widest = classes.agg(F.max("n_points")).first()[0] if layout in ("auto", "words") else None
    met, pairs, groups = meetings(classes, by, num_bins, min_conf) if layout == "auto" else (0, 0, 0)
    many = pairs >= ARRAY_PAIRS and pairs >= ARRAY_GROUP_PAIRS * groups
    arrays = layout == "arrays" or (many and ARRAY_GAIN * met >= pairs)
    if arrays or layout == "whole" or (widest is not None and widest <= WORD):
        whole = layout == "whole" or (layout == "auto" and 2 * met >= pairs)
        bins = num_bins if isinstance(num_bins, int) else tuple(num_bins)
        mined = Mined(classes, bins, min_conf, tail_prune, whole, arrays=arrays)
        return RuleSet(mined.rules(by), members, tuple(by), mined)
    candidates = candidate_pairs(classes, by, num_bins, min_conf, extra, layout)
    rules = class_rules(classes, candidates, by, num_bins, min_conf, tail_prune)
    return RuleSet(materialize(rules, "class-rules"), members, tuple(by))


def mine_classes(
    occurrences: DataFrame,
    timepoints: DataFrame,
    *,
    num_bins: int = 11,
    min_sup: float = 0.05,
    max_sup: float = 0.1,
    min_conf: float = 0.9,
    by: Sequence[str] = (),
    domain_by: Sequence[str] = (),
    boundary_expiry: bool = True,
    tail_prune: bool = True,
    layout: str = "auto",
) -> RuleSet:
    """The rules of ``mine_rules`` between classes of changes with equal positions, with the members of each class."""
    profile = within_support(profile_changes(occurrences, timepoints, by, domain_by), min_sup, max_sup)
    return mine_profile(
        profile,
        num_bins=num_bins,
        min_conf=min_conf,
        by=by,
        boundary_expiry=boundary_expiry,
        tail_prune=tail_prune,
        layout=layout,
    )


def mine_rules(
    occurrences: DataFrame,
    timepoints: DataFrame,
    *,
    num_bins: int = 11,
    min_sup: float = 0.05,
    max_sup: float = 0.1,
    min_conf: float = 0.9,
    by: Sequence[str] = (),
    domain_by: Sequence[str] = (),
    boundary_expiry: bool = True,
    tail_prune: bool = True,
    layout: str = "auto",
) -> DataFrame:
    """Rules between all ordered pairs of different changes (within the same ``by`` values).

    ``occurrences(by…, change_id, tp)`` has one row per change and time point, ``timepoints(domain_by…, tp, tp_idx)``
    is the domain.
    """
    return mine_classes(
        occurrences,
        timepoints,
        num_bins=num_bins,
        min_sup=min_sup,
        max_sup=max_sup,
        min_conf=min_conf,
        by=by,
        domain_by=domain_by,
        boundary_expiry=boundary_expiry,
        tail_prune=tail_prune,
        layout=layout,
    ).expand()


def lift_by_domain(lift: Column, n_points: Column | int) -> Column:
    """Textbook lift: the rules' ``lift`` has no factor N."""
    return lift * n_points
