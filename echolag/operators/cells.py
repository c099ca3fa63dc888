"""What is worked out in arrays inside a task: the rules of one cell, which are all pairs of some antecedents with some
consequents, and stars of the edges that a task has.

``reach[p, c]`` is the distance from position ``p`` to the next occurrence of consequent ``c``. An antecedent's window of
``length`` positions from ``p`` on has a match with ``c`` if ``reach[p, c] < length``, and that distance is the lag; so a pair's
support is a sum over the few rows of ``reach`` at which the antecedent's windows begin. A pair takes a few bytes this way.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# these functions travel to the tasks as they are, so that the package need not be there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# rows of one batch of rules
BATCH_ROWS = 32_768
# columns of a rule between classes; what is not wanted is not made
RULE = ("sig_a", "sig_c", "size_a", "size_c", "support", "confidence", "lift", "hist", "n_points")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists, and the len + 1 bounds of the lists in them."""
    bounds = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]


class _Side:
    """The classes of one side of a cell, and the rows (units) of each."""

    def __init__(self, rows: pa.Table, busiest_first: bool = False):
        self.rows = rows
        ids = rows["class_id"].to_numpy()
        _, first, of = np.unique(ids, return_index=True, return_inverse=True)
        if busiest_first:
            places = np.diff(rows["places"].combine_chunks().offsets.to_numpy())[first]
            order = np.argsort(-places, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            first, of = first[order], rank[of]
        self.units = np.argsort(of, kind="stable")
        self.counts = np.bincount(of, minlength=len(first))
        self.starts = np.cumsum(self.counts) - self.counts
        self.single = len(ids) == len(first)
        classes = rows.select(["class_id", "n", "size", "n_points", "theta", "places", "lengths"]).take(pa.array(first))
        self.ids, self.n, self.size, self.n_points, self.theta = (
            classes[c].to_numpy() for c in ("class_id", "n", "size", "n_points", "theta")
        )
        self.places, self.bounds = _flat(classes["places"].combine_chunks())
        self.lengths, _ = _flat(classes["lengths"].combine_chunks())


def _reach(side: _Side, n_places: int, bins: int) -> np.ndarray:
    kind = np.uint8 if bins < 255 else np.uint16 if bins < 65_535 else np.uint32
    far = np.iinfo(kind).max
    reach = np.full((n_places, len(side.ids)), far, kind)
    reach[side.places, np.repeat(np.arange(len(side.ids)), np.diff(side.bounds))] = 0
    for p in range(n_places - 2, -1, -1):
        np.minimum(reach[p], np.minimum(reach[p + 1], far - 1) + kind(1), out=reach[p])
    return reach


def _least_support(n: np.ndarray, theta: np.ndarray, min_conf: float) -> np.ndarray:
    """The least support that passes the exact test on confidence; ``theta`` is that or one less."""
    return np.where(theta / n >= min_conf, theta, theta + 1)


def _found(a: _Side, c: _Side, bins: int, min_conf: float, tail_prune: bool, with_hist: bool) -> Iterator[tuple]:
    """(antecedent, consequents, support, hist) of each antecedent class that has rules."""
    if not len(a.places) or not len(c.places):
        return
    reach = _reach(c, int(max(a.places.max(), c.places.max())) + 1, bins)
    far, slots = reach.dtype.type(np.iinfo(reach.dtype).max), np.arange(bins, dtype=reach.dtype)[:, None, None]
    # a consequent matches at most as often as it occurs, and the busiest ones come first
    busy = -np.diff(c.bounds)
    need = _least_support(a.n, a.theta, min_conf)
    upto = np.searchsorted(busy, -need, side="right")
    own = {int(k): at for at, k in enumerate(c.ids)}
    for i in range(len(a.ids)):
        width, least = int(upto[i]), int(need[i])
        places = a.places[a.bounds[i] : a.bounds[i + 1]]
        if not width or len(places) < least:
            continue
        lengths = a.lengths[a.bounds[i] : a.bounds[i + 1], None].astype(reach.dtype)
        near = reach[places, :width] if width < reach.shape[1] else reach[places]
        counted = np.uint8 if len(places) < 256 else np.int32
        # bytes are added up faster than truth values
        counts = np.add.reduce((near < lengths).view(np.uint8), axis=0, dtype=counted)
        hits = np.flatnonzero(counts >= least)
        if a.size[i] == 1 and len(hits) and (at := own.get(int(a.ids[i]))) is not None:
            hits = hits[hits != at]
        if not len(hits):
            continue
        hist = None
        if tail_prune or with_hist:
            lags = near.take(hits, axis=1)
            if tail_prune and places[-1] + bins > a.n_points[i] - bins:
                # a pair whose first match comes with fewer than num_bins positions left is not started
                met = lags < lengths
                first = met.argmax(axis=0)
                early = places[first] + lags[first, np.arange(len(hits))] <= a.n_points[i] - bins
                if not early.all():
                    hits, lags = hits[early], lags[:, early]
                    if not len(hits):
                        continue
            if with_hist:
                lags = np.maximum(lags, (lags >= lengths).astype(lags.dtype) * far)
                hist = np.add.reduce((lags == slots).view(np.uint8), axis=1, dtype=counted)
        yield i, hits, counts[hits].astype(np.int64), hist


def _unit_pairs(a: _Side, c: _Side, of_a: np.ndarray, of_c: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(rule, row of the antecedent, row of the consequent) of all pairs of units, a bounded number at a time."""
    if a.single and c.single:
        yield np.arange(len(of_a)), a.units[of_a], c.units[of_c]
        return
    ends = np.cumsum(a.counts[of_a] * c.counts[of_c])
    starts = ends - a.counts[of_a] * c.counts[of_c]
    for begin in range(0, int(ends[-1]), BATCH_ROWS):
        at = np.arange(begin, min(begin + BATCH_ROWS, int(ends[-1])))
        rule = np.searchsorted(ends, at, side="right")
        place = at - starts[rule]
        of_right = c.counts[of_c[rule]]
        yield (
            rule,
            a.units[a.starts[of_a[rule]] + place // of_right],
            c.units[c.starts[of_c[rule]] + place % of_right],
        )


def rules_of_cell(
    by: Sequence[str],
    num_bins: int | None,
    min_conf: float,
    tail_prune: bool,
    wanted: Sequence[str],
    carried: Sequence[tuple[str, str, str]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that makes one cell's rows into rules; without ``num_bins`` it is a column of the rows.

    ``carried`` has (column of the result, side, column of the rows).
    """
    by, wanted, carried = list(by), list(wanted), list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        right = rows["right"].to_numpy()
        if right.all() or not right.any():
            return
        bins = num_bins or rows["num_bins"][0].as_py()
        a, c = _Side(rows.filter(pa.array(~right))), _Side(rows.filter(pa.array(right)), busiest_first=True)
        with_hist = "hist" in wanted

        def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            of_a = np.repeat([i for i, *_ in held], [len(hits) for _, hits, *_ in held])
            of_c = np.concatenate([hits for _, hits, *_ in held])
            support = np.concatenate([s for *_, s, _ in held])
            hists = np.concatenate([h for *_, h in held], axis=1).T.astype(np.int32, order="C") if with_hist else None
            for rule, a_row, c_row in _unit_pairs(a, c, of_a, of_c):
                yield batch(of_a[rule], of_c[rule], support[rule], None if hists is None else hists[rule], a_row, c_row)

        def batch(of_a, of_c, support, hists, a_row, c_row) -> pa.RecordBatch:
            columns = {k: rows[k].take(pa.array(np.zeros(len(support), np.int64))) for k in by}
            for name in wanted:
                if name == "support":
                    columns[name] = pa.array(support)
                elif name == "confidence":
                    columns[name] = pa.array(support / a.n[of_a])
                elif name == "lift":
                    columns[name] = pa.array(support / (a.n[of_a] * c.n[of_c]))
                elif name == "hist":
                    ends = np.arange(len(support) + 1, dtype=np.int32) * bins
                    columns[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(hists.reshape(-1)))
                elif name == "n_points":
                    columns[name] = pa.array(a.n_points[of_a])
                elif name in ("size_a", "size_c"):
                    columns[name] = pa.array(a.size[of_a] if name == "size_a" else c.size[of_c])
                else:
                    side, at = (a, a_row) if name == "sig_a" else (c, c_row)
                    columns[name] = side.rows["signature"].take(pa.array(at))
            for name, side, column in carried:
                holder, at = (a, a_row) if side == "a" else (c, c_row)
                columns[name] = holder.rows[column].take(pa.array(at))
            arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns.values()]
            return pa.RecordBatch.from_arrays(arrays, list(columns))

        held, n = [], 0
        for some in _found(a, c, bins, min_conf, tail_prune, with_hist):
            held.append(some)
            n += len(some[1])
            if n >= BATCH_ROWS:
                yield from made(held)
                held, n = [], 0
        if held:
            yield from made(held)

    return run


# -- edges --------------------------------------------------------------------------------------------------------------

# edges that a task contracts at a time, and most stars that it keeps for the next ones
CONTRACT_EDGES = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each vertex's component, for edges between the numbers 0 to n - 1."""
    roots = np.arange(n)
    while len(u):
        ru, rv = roots[u], roots[v]
        least = np.minimum(ru, rv)
        np.minimum.at(roots, ru, least)
        np.minimum.at(roots, rv, least)
        while True:
            next_roots = roots[roots]
            if np.array_equal(next_roots, roots):
                break
            roots = next_roots
        apart = roots[u] != roots[v]
        u, v = u[apart], v[apart]
    return roots


def _stars(edges: pa.Table) -> pa.Table:
    """Edges from each vertex to one of its component; a vertex without others keeps its loop."""
    n = edges.num_rows
    ends = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks], type=edges.schema.field("src").type)
    coded = ends.combine_chunks().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    roots = _roots(codes[:n], codes[n:], len(names))
    alone = np.bincount(roots, minlength=len(names))[roots] == 1
    kept = np.flatnonzero((roots != np.arange(len(names))) | alone)
    return pa.table({"src": names.take(pa.array(kept)), "dst": names.take(pa.array(roots[kept]))})


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, which are kept for the next edges as long as they are few."""
    held, n = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= 2 * CONTRACT_EDGES:
            stars = _stars(pa.concat_tables(held))
            held, n = [stars], stars.num_rows
            if n >= CONTRACT_EDGES:
                yield from stars.to_batches()
                held, n = [], 0
    if n:
        yield from _stars(pa.concat_tables(held)).to_batches()
