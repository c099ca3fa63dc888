"""Near-duplicates by min-max hashing.

1. Signatures: each text's set of word shingles goes through K random permutations. Of each permutation both the least and
   the greatest value are kept (Ji, Li, Yan, Tian and Zhang, "Min-Max Hash for Jaccard Similarity", 2013): 2K values of a
   signature from K evaluations per shingle, each agreeing with the probability of the Jaccard similarity and with less
   variance than 2K minima. Bands take values of different permutations.
2. Texts with equal sets are one class, known by its least document. Classes that share a band are candidates; each bucket
   links its members to its least member, and the components of these links hold every pair that shares a band.
3. Cells: the members of a component meet with their whole texts, and their sets are compared exactly, until every pair of
   different clusters has been compared. A component beyond ``CELL_SHINGLES`` is cut into blocks; every block also gets the
   same few pivots of the component, which connect the blocks' main clusters, and what stays outside the component's largest
   cluster is then compared with every block. So no pair of a group is written down, and no link is lost.
4. The components of the confirmed links are the groups.

A pair at the threshold shares no band with a probability of 5e-9, and the shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy
from ..operators.components import connected_components
from ..session import materialize
from .arrow import pieces, runs, text_bytes
from .rows import numbered, one_of_each

SHINGLE = 2
PERCENT = 80
PERMUTATIONS = 120
ROWS = 5
# shingles of the texts that are compared in one task at a time
CELL_SHINGLES = 400_000
# and most texts of a block; short texts cost comparisons, not memory
CELL_TEXTS = 10_000
PIVOTS = 24
# most words whose hashes a worker keeps
_KEPT_WORDS = 300_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KEPT_WORDS:
            self[word] = value
        return value


@lru_cache(1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; of a shorter text, of all its words as one."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    length = min(size, len(words))
    places = len(words) - length + 1
    found = np.full(places, length, np.uint64)
    for k in range(length):
        found = _mixed(found * _MIX[0] + hashes[k : k + places])
    return np.unique(found)


@lru_cache(4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20_130_601).integers(0, 1 << 32, (2, count), dtype=np.uint64).astype(np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The least value under each permutation, then the greatest."""
    factor, shift = _permutations(permutations)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(permutations, 0xFFFFFFFF, np.uint32)
    greatest = np.zeros(permutations, np.uint32)
    for at in range(0, len(values), 1024):
        moved = values[at : at + 1024, None] * factor + shift
        np.minimum(least, moved.min(0), out=least)
        np.maximum(greatest, moved.max(0), out=greatest)
    return np.concatenate([least, greatest])


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of each signature; a band has ``rows`` values of as many permutations."""
    n, width = signatures.shape
    bands = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, width // rows + 1, dtype=np.uint64) * _MIX[0], bands.shape[:2])
    for k in range(rows):
        keys = _mixed((keys ^ bands[:, :, k]) * _MIX[0])
    return keys.view(np.int64)


_SIGNED = "doc_id bigint, text_key bigint, n_shingles bigint, fingerprint binary, bands array<bigint>"


def sign(docs: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, hash of the text, n_shingles, fingerprint of the set, bands) per row; no bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(t, size) for t in text_bytes(part["text"])]
                full = [s for s in sets if len(s)]
                keys = band_keys(np.stack([signature(s) for s in full])) if full else np.zeros((0, 1), np.int64)
                ends = np.cumsum([0] + [keys.shape[1] if len(s) else 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["text_key"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "fingerprint", "bands"],
                )

    body = F.col(text).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    return rows.mapInArrow(run, _SIGNED)


class _Clusters:
    """Union-find over places 0 … n - 1."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        parent = self.parent
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        self.parent = parent
        return parent

    def join(self, places: np.ndarray) -> None:
        roots = self.roots()
        together = np.unique(roots[places])
        self.parent[np.isin(roots, together)] = together[0]


class _Cell:
    """Sets that are compared with each other."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        distinct, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.marked = np.zeros(len(distinct), bool)
        self.percent = percent

    def near(self, place: int) -> np.ndarray:
        """The places whose set is near that of ``place``, itself among them."""
        own = self.items[self.starts[place] : self.starts[place + 1]]
        self.marked[own] = True
        shared = np.add.reduceat(self.marked[self.items], self.starts[:-1], dtype=np.int64)
        self.marked[own] = False
        either = self.sizes + self.sizes[place] - shared
        return np.flatnonzero(100 * shared >= self.percent * either)


def cluster(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The cluster of each set: sets are linked where their Jaccard similarity is at least ``percent``.

    Every pair of different clusters has been compared: of any such pair one is outside the largest cluster, and all of
    those have been compared with every set.
    """
    cell, clusters = _Cell(sets, percent), _Clusters(len(sets))
    seen = np.zeros(len(sets), bool)
    place: int | None = 0
    while place is not None:
        seen[place] = True
        clusters.join(cell.near(place))
        roots = clusters.roots()
        largest = np.bincount(roots).argmax()
        left = np.flatnonzero(~seen & (roots != largest))
        place = int(left[0]) if len(left) else None
    return clusters.roots()


_LINKS = "src bigint, dst bigint"


def _links(vertices: list[int], least: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.array(least, pa.int64())], names=["src", "dst"])


def _cluster_cells(cells: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of each member of a cell(component, block) to the least member of its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["component", "block"]):
            vertices = np.array(rows["vertex"].to_pylist())
            roots = cluster([shingle_set(t, size) for t in text_bytes(rows["text"].combine_chunks())], percent)
            order = np.lexsort((vertices, roots))
            first = np.unique(roots[order], return_index=True)
            least = dict(zip(first[0].tolist(), vertices[order][first[1]].tolist(), strict=True))
            yield _links(vertices.tolist(), [least[r] for r in roots.tolist()])

    placed = cells.repartition("component", "block").sortWithinPartitions("component", "block")
    return placed.select("component", "block", "vertex", "text").mapInArrow(run, _LINKS)


def _compare_outsiders(cells: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the outsiders and the members that share a cell(component, block, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["component", "block", "chunk"]):
            vertices, outside = rows["vertex"].to_pylist(), rows["outsider"].to_pylist()
            cell = _Cell([shingle_set(t, size) for t in text_bytes(rows["text"].combine_chunks())], percent)
            for place in np.flatnonzero(outside):
                near = cell.near(int(place)).tolist()
                yield _links([vertices[k] for k in near], [vertices[place]] * len(near))

    keys = ["component", "block", "chunk"]
    placed = cells.repartition(*keys).sortWithinPartitions(*keys)
    return placed.select(*keys, "vertex", "outsider", "text").mapInArrow(run, _LINKS)


def _parts(weight, limit: int):
    return F.greatest(F.ceil(weight / limit).cast("int"), F.lit(1))


def confirmed_links(
    docs: DataFrame, candidates: DataFrame, size: int, percent: int, text: str, cell_shingles: int, repeats: bool
) -> DataFrame:
    """Links between documents whose sets are near, among ``candidates(vertex, text_key, component, n_shingles)``.

    ``repeats`` tells that rows of ``docs`` repeat an id and its text; each text is compared once.
    """
    sizes = candidates.groupBy("component").agg(
        F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("weight")
    )
    blocks = F.greatest(_parts(F.col("total"), cell_shingles), _parts(F.col("weight"), CELL_TEXTS))
    sizes = materialize(sizes.withColumn("blocks", blocks), "components")
    weights = sizes.select("component", "weight")
    placed = join_heavy(
        candidates, sizes.select("component", "blocks", F.col("weight").alias("n")), ["component"], weights=weights
    )
    drawn = F.xxhash64("vertex")
    # a pivot goes to every block; about PIVOTS of a component are drawn
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), "vertex"), F.col("n")) < PIVOTS)
    placed = placed.select(
        "vertex",
        "text_key",
        "component",
        "blocks",
        pivot.alias("pivot"),
        F.pmod(drawn, F.col("blocks")).cast("int").alias("block"),
    )
    body = F.col(text).cast("binary")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("vertex"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    # one text of each class of the document; its other rows have no set, or one that another class stands for
    key = ["vertex", "text_key"]
    met = texts.join(placed, key)
    members = materialize(met.dropDuplicates(key) if repeats else met, "members")
    everywhere = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    links = _cluster_cells(members.withColumn("block", F.explode(everywhere)), size, percent)
    links = materialize(links.where("src <> dst"), "links")
    if sizes.where("blocks > 1").isEmpty():
        return links

    # what is outside the largest cluster of a component of several blocks meets every block
    key = ["component"]
    cut = members.where("blocks > 1")
    merged = materialize(connected_components(links), "merged")
    named = cut.select("vertex", *key).join(merged.withColumnRenamed("component", "cluster"), "vertex", "left")
    named = materialize(named.withColumn("cluster", F.coalesce("cluster", "vertex")), "clusters")
    largest = named.groupBy(*key, "cluster").agg(F.count(F.lit(1)).alias("n"))
    largest = largest.groupBy(*key).agg(F.max_by("cluster", F.struct("n", "cluster")).alias("largest"))
    outside = named.join(largest, key).where("cluster <> largest").select("vertex").distinct()
    # chunks of outsiders are as large as a block
    n_outside = outside.join(candidates, "vertex").groupBy(*key).agg(F.sum("n_shingles").alias("outer"))
    chunks = n_outside.select(*key, _parts(F.col("outer"), cell_shingles).alias("chunks"))
    outsiders = cut.join(outside, "vertex").join(chunks, key).select(
        "vertex",
        *key,
        "text",
        F.lit(True).alias("outsider"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64(F.lit("chunk"), "vertex"), F.col("chunks")).cast("int").alias("chunk"),
    )
    insiders = cut.join(chunks, key).select(
        "vertex",
        *key,
        "text",
        F.lit(False).alias("outsider"),
        "block",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    more = _compare_outsiders(outsiders.unionByName(insiders), size, percent).where("src <> dst").distinct()
    return links.unionByName(materialize(more, "outer-links"))


def near_groups(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    text: str = "text",
    cell_shingles: int = CELL_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_copies) per row of ``docs``.

    Words are lower-cased in A-Z. A text with fewer words than a shingle is one shingle, and a null, empty or blank text has
    none and links with nothing. ``component_id`` is the least ``doc_id`` that is reachable by links, and the row that has it
    is kept; ``n_copies`` is the number of rows with the same set. Rows that repeat a ``doc_id`` are one document with
    several texts, all of which link it. A row without ``doc_id`` links with nothing, has no component and is kept. An empty
    table gives an empty table; other columns are ignored. Very long texts are compared whole.
    """
    signed = materialize(sign(docs, size, text), "signatures")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = signed.where(linked).groupBy("fingerprint", "n_shingles", "bands").agg(
        F.min(F.struct("doc_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("weight")
    )
    classes = materialize(
        classes.select("fingerprint", "n_shingles", "bands", F.col("least.doc_id").alias("vertex"), "least.text_key", "weight"),
        "classes",
    )
    again = signed.where(linked).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("one"), F.max("fingerprint").alias("other")
    )
    again = materialize(again.where("n > 1"), "repeated")
    repeats = not again.isEmpty()
    banded = classes.select("vertex", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("vertex").alias("least"), F.count(F.lit(1)).alias("weight"))
    buckets = materialize(buckets.where("weight > 1"), "buckets")
    starred = join_heavy(banded, buckets.select("key", "least"), ["key"], weights=buckets.select("key", "weight"))
    edges = starred.where("vertex <> least").select(F.col("vertex").alias("src"), F.col("least").alias("dst")).distinct()
    candidates = connected_components(edges)
    # of a document with several texts each is a candidate of its own
    candidates = materialize(candidates.join(classes.select("vertex", "text_key", "n_shingles"), "vertex"), "candidates")
    links = confirmed_links(docs, candidates, size, percent, text, cell_shingles, repeats)
    if repeats:
        # a document with several sets links the classes it is in
        several = signed.where(linked).join(again.where("one <> other").select("doc_id"), "doc_id", "left_semi")
        own = several.join(classes.select("fingerprint", "n_shingles", "vertex"), ["fingerprint", "n_shingles"])
        links = links.unionByName(own.select(F.col("doc_id").alias("src"), F.col("vertex").alias("dst")).where("src <> dst"))
    groups = connected_components(links)
    named = classes.select("fingerprint", "n_shingles", "vertex", "weight").join(groups, "vertex", "left")
    named = materialize(
        named.select(
            "fingerprint", "n_shingles", F.coalesce("component", "vertex").alias("component_id"), "weight"
        ),
        "named",
    )
    key = ["fingerprint", "n_shingles"]
    light = signed.select("doc_id", *key)
    grouped = join_heavy(
        light.where(linked),
        named.select(*key, "component_id", F.col("weight").alias("n_copies")),
        key,
        weights=named.select(*key, "weight"),
    )
    alone = light.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).alias("n_copies"))
    found = grouped.select("doc_id", "n_shingles", "component_id", "n_copies").unionByName(alone)
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.col("n_copies").cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of each group, with all its columns: that with the least ``doc_id``, nulls last, of these the first.

    Every row is a document of its own here, also one that repeats an id or has none. Rows without words all stay.
    """
    placed, row = numbered(docs)
    rows = placed.select(F.col(row).alias("doc_id"), F.col(text).alias("text"))
    groups = near_groups(rows, **options).where("n_shingles > 0")
    return one_of_each(placed, row, groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")))
