"""Connected components of an edge list.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and Beyond"
(2014): each step links neighbours to their least neighbour, and the graph becomes a set of stars after few rounds.
Minima are combined before each shuffle, vertices with many neighbours are split in the join, and each round is written
out, so that neither lineage nor one hub's neighbours gather in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy
from ..session import materialize
from . import cells


def contract(edges: DataFrame) -> DataFrame:
    """Few edges that connect what ``edges(src, dst)`` do: each task makes stars of its own ones, a bounded number at a time.

    For edges of which there are many more than vertices; they are read once and neither moved nor written.
    """
    known = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    return materialize(known.mapInArrow(cells.contract, known.schema), "contracted")


def _least_neighbour(links: DataFrame) -> DataFrame:
    """For each ``u`` of ``links(u, v)`` the least of itself and its neighbours, and their number."""
    found = links.groupBy("u").agg(
        F.least(F.col("u"), F.min("v")).alias("least"), F.count(F.lit(1)).alias("weight")
    )
    return materialize(found, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both)
    linked = join_heavy(both.where("v > u"), least.select("u", "least"), ["u"], weights=least)
    return linked.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = _least_neighbour(down)
    linked = join_heavy(down, least.select("u", "least"), ["u"], weights=least)
    neighbours = linked.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return neighbours.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``: with u > v, each v is then the least of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sums = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for ``edges(src, dst)``; a component is named by its least vertex.

    Rounds go on until the edges are stars. Edges that are so from the start take no round.
    """
    state = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")
    state = materialize(state.distinct(), "edges")
    loops = edges.where("src = dst").select(F.col("src").alias("vertex"))
    while not _are_stars(state):
        state = materialize(_small_star(_large_star(state)), "stars")
    stars = state.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    centres = state.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    settled = stars.unionByName(centres)
    alone = loops.distinct().join(settled.select("vertex"), "vertex", "left_anti")
    return settled.unionByName(alone.select("vertex", F.col("vertex").alias("component")))
