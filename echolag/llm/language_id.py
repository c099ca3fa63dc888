"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes is counted on training texts. With the counts frozen, a byte
after a context has the probability of PPM method C: its share of the context's count where it was seen there, else the
context's escape probability times its probability after the next shorter context, down to equal bytes. So every (context,
byte) has one exact code length per language. A text is scored by walking, for all of its bytes at once, from the empty context
back along the bytes before, as deep as any language's tree goes, and summing up the code lengths; the language with the
shortest code is predicted.

Trees are counted, as a Spark aggregate, on about ``TRAIN_ROWS`` rows of each language, drawn by hash, with whole texts. A
tree holds the contexts that make up 1 / ``CONTEXTS`` of the language's bytes, so at most ``CONTEXTS`` of each order, whatever
the texts. That bounds the model, which is sent to every executor. Scoring reads all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrow import byte_buffer, pieces, text_bytes

ORDER = 4
TRAIN_ROWS = 1_500
# size of the model: a tree keeps the contexts with 1 / CONTEXTS of its language's bytes, so at most so many of one order
CONTEXTS = 2_000
# bytes that come before a text and, for the scoring, part the texts of a batch
_START = 0x20
_CHUNK = 1 << 17


class ContextTree:
    """Contexts of all languages, and the code length of each byte after each of them."""

    def __init__(
        self, languages: list[str], children: np.ndarray, bits: np.ndarray, symbols: np.ndarray, order: int
    ) -> None:
        self.languages, self.children, self.bits, self.symbols, self.order = languages, children, bits, symbols, order

    def code_lengths(self, joined: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits per language for each text of a buffer (texts by languages)."""
        totals = np.zeros((len(bounds) - 1, len(self.languages)))
        start, n = int(self.symbols[_START]), len(self.bits)
        for at in range(0, len(joined), _CHUNK):
            # with the bytes before the chunk that its first contexts reach into
            reach = min(at, self.order)
            symbols = self.symbols[joined[at - reach : at + _CHUNK]]
            places = np.arange(at, at - reach + len(symbols))
            texts = np.searchsorted(bounds, places, side="right") - 1
            since = places - bounds[texts]
            state = np.zeros(len(places), np.int32)
            for back in range(1, self.order + 1):
                before = np.full(len(places), start, np.int32)
                skipped = max(0, back - reach)
                before[skipped:] = symbols[reach - back + skipped : len(symbols) - back]
                state = self.children[state, np.where(since >= back, before, start)]
            cost = self.bits[np.where(state < n, state, state - n), symbols[reach:]]
            edges = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
            totals[texts[edges]] += np.add.reduceat(cost, edges, axis=0, dtype=np.float64)
        return totals


def context_counts(texts: list[bytes], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order k the distinct codes of k context bytes and the byte after them, and their numbers."""
    pad = bytes([_START]) * order
    joined = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + order)])[:-1] + order
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
    found = []
    code = joined[places] if len(places) else np.zeros(0, np.int64)
    for k in range(order + 1):
        if k:
            # the nearest context byte stands right before the symbol's own
            code = code + (joined[places - k] << (8 * k))
        found.append(np.unique(code, return_counts=True))
    return found


Counts = dict[str, list[tuple[np.ndarray, np.ndarray]]]


def freeze(counts: Counts) -> ContextTree:
    """The trees of all languages as one table of code lengths.

    ``counts`` has for each language and order the codes (context bytes, the nearest lowest, above the byte itself) of the
    contexts that the tree holds, and their numbers.
    """
    languages = sorted(counts)
    deepest = max((len(c) for c in counts.values()), default=1) - 1
    nodes = [
        np.unique(np.concatenate([np.zeros(int(k == 0), np.int64), *(counts[name][k][0] >> 8 for name in languages)]))
        for k in range(deepest + 1)
    ]
    first = np.concatenate([[0], np.cumsum([len(level) for level in nodes])])
    n_nodes = int(first[-1])
    used = np.unique(np.concatenate([[_START], *(counts[name][0][0] & 255 for name in languages)])).astype(int)
    # bytes that no training text has share the last column
    symbols = np.full(256, len(used), np.int32)
    symbols[used] = np.arange(len(used))
    width = len(used) + 1
    shorter_of = [level & ((1 << (8 * max(k - 1, 0))) - 1) for k, level in enumerate(nodes)]
    bits = np.zeros((n_nodes, width, len(languages)), np.float32)
    for at, name in enumerate(languages):
        chance = np.full((1, width), 1 / 256)
        for k, level in enumerate(nodes):
            table = np.zeros((len(level), width))
            codes, n = counts[name][k]
            table[np.searchsorted(level, codes >> 8), symbols[(codes & 255).astype(int)]] = n
            total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            before = chance[np.searchsorted(nodes[k - 1], shorter_of[k])] if k else chance
            chance = np.where(table > 0, table / np.maximum(total + kinds, 1), escape * before)
            bits[first[k] : first[k + 1], :, at] = -np.log2(chance)
    # states: 0 … n_nodes - 1 while every byte before led on, then a twin of the node where the walk has ended
    children = np.tile(np.arange(2 * n_nodes, dtype=np.int32)[:, None], (1, width))
    children[:n_nodes] += n_nodes
    for k in range(1, deepest + 1):
        parents = np.searchsorted(nodes[k - 1], shorter_of[k]) + first[k - 1]
        children[parents, symbols[(nodes[k] >> (8 * (k - 1))).astype(int)]] = np.arange(first[k], first[k + 1])
    return ContextTree(languages, children, bits, symbols, deepest)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(part["lang"].to_pylist(), text_bytes(part["text"]), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, found in texts.items():
                for k, (codes, n) in enumerate(context_counts(found)):
                    size = len(codes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), pa.array(np.full(size, k, np.int32)), pa.array(codes), pa.array(n)],
                        names=["lang", "k", "code", "n"],
                    )


def learn(
    docs: DataFrame, held_out: Column, rows: int = TRAIN_ROWS, contexts: int = CONTEXTS, text: str = "text"
) -> ContextTree:
    """Trees of the languages of the rows that are not held out, on about ``rows`` rows of each."""
    usable = docs.where(~held_out & F.col("lang").isNotNull() & (F.octet_length(F.col(text)) > 0))
    # a few rows that Spark sends to every task, so that texts which are not drawn stay where they are
    counted = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")), "language-sizes")
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(counted, "lang").where(share * F.col("n_rows") < rows)
    sample = drawn.select(F.col("lang").cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    grams = sample.mapInArrow(_count, "lang string, k int, code bigint, n bigint")
    grams = materialize(grams.groupBy("lang", "k", "code").agg(F.sum("n").alias("n")), "contexts")
    context = F.shiftright("code", 8).alias("context")
    totals = grams.where("k = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    kept = grams.groupBy("lang", "k", context).agg(F.sum("n").alias("seen")).join(totals, "lang")
    kept = kept.where(F.col("seen") * contexts >= F.col("total")).select("lang", "k", "context")
    # at most contexts · order contexts of a language, with at most 256 bytes after each
    found = grams.withColumn("context", context).join(kept, ["lang", "k", "context"], "left_semi").orderBy("lang", "k", "code")
    table = found.select("lang", "k", "code", "n").toArrow()
    lang, k, code, n = (table[c].to_numpy() for c in ("lang", "k", "code", "n"))
    return freeze(
        {str(x): [(code[m], n[m]) for m in ((lang == x) & (k == o) for o in range(ORDER + 1))] for x in np.unique(lang)}
    )


def identify(docs: DataFrame, tree: ContextTree, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row; ``score`` is the language's share of 2 ** -(bits per byte · 16).

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language was learnt. Repeated rows
    are scored alike, long texts whole. An empty table gives an empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                joined, bounds = byte_buffer(part["text"])
                predicted, scores = [None] * part.num_rows, np.zeros(part.num_rows)
                if tree.languages:
                    bits = tree.code_lengths(joined, bounds)
                    rate = 16 * bits / np.maximum(np.diff(bounds), 1)[:, None]
                    share = np.exp2(rate.min(1, keepdims=True) - rate)
                    scores = 1 / share.sum(1)
                    predicted = [tree.languages[k] for k in bits.argmin(1)]
                lettered = np.array(part["lettered"].to_pylist(), bool) & bool(tree.languages)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([p if ok else "und" for p, ok in zip(predicted, lettered, strict=True)], pa.string()),
                        pa.array(np.where(lettered, scores, 0.0)),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), lettered.alias("lettered"), F.col(text).cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
