"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms, words in lower case without the marks around them, hashed to 64 bits. The model adds to a
bias and a weight per term the inner product of the two terms' factors for every pair of terms in the document (Rendle,
"Factorization Machines", 2010), so a word may count more, or less, beside another. All pairs are summed up at once as half of
the square of the summed factors less the summed squares.

Training goes by full gradients over a bounded sample of labelled documents, on all terms that enough of them hold: a term
that says nothing by itself may say much beside another. Weights and factors are drawn to zero by their squares. The model is
small, and terms it does not hold add nothing, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrow import pieces, text_bytes
from .labelled import labelled_sample

# labelled documents to train on
TRAIN_ROWS = 8_000
# a term is learnt from at least so many of them
LEAST_DOCS = 5
FACTORS = 8
_KEPT_WORDS = 1_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def term_hash(word: bytes) -> int:
    """A word's term as a signed 64-bit number."""
    value = xxhash.xxh3_64_intdigest(word.strip(_MARKS).translate(_LOWER))
    return value - (1 << 64) if value >> 63 else value


@dataclass
class FactorizationMachine:
    """Weights and factors by the sorted hashes of the terms."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Log odds of ``n`` documents, for (document, place of a term) pairs."""
        linear = np.bincount(rows, self.weights[places], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[places, f]
            pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return self.bias + linear + pairs / 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, 0.0, 0.0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.99 * self.v + 0.01 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def fit(labels: np.ndarray, terms: list[np.ndarray], factors: int = FACTORS, steps: int = 150) -> FactorizationMachine:
    """Fit on the sets of term hashes of labelled documents."""
    labels = labels.astype(float)
    n = len(labels)
    rows = np.repeat(np.arange(n), [len(t) for t in terms])
    every, places = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]), return_inverse=True)
    known = every if n and 0 < labels.mean() < 1 else every[:0]
    if not len(known):
        rows, places = rows[:0], places[:0]
    share = (labels.sum() + 1) / (n + 2)
    rng = np.random.default_rng(2010)
    machine = FactorizationMachine(
        known, float(np.log(share / (1 - share))), np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors))
    )
    by_weight, by_factor, by_bias = _Adam(0.1), _Adam(0.03), _Adam(0.05)
    for _ in range(steps if len(known) else 0):
        error = _sigmoid(machine.margins(rows, places, n)) - labels
        pull = np.zeros_like(machine.factors)
        for f in range(factors):
            v = machine.factors[places, f]
            summed = np.bincount(rows, v, n)
            pull[:, f] = np.bincount(places, error[rows] * (summed[rows] - v), len(known))
        weight_pull = np.bincount(places, error[rows], len(known)) / n + 5e-4 * machine.weights
        machine.weights = machine.weights - by_weight.step(weight_pull)
        machine.factors = machine.factors - by_factor.step(pull / n + 2e-3 * machine.factors)
        machine.bias -= float(by_bias.step(np.array(error.mean())))
    return machine


def _term_sets(docs: DataFrame) -> DataFrame:
    """(label, terms) for rows with ``text`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [sorted({term_hash(w) for w in set(t.split())}) for t in text_bytes(part["text"])]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["label"], pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "label", "terms"]
                )

    return docs.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, terms array<bigint>")


def learn(
    docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS, text: str = "text"
) -> FactorizationMachine:
    """Learn ``labels.toxic`` from about ``rows`` labelled documents that are not held out.

    Terms are counted by Spark, and only those in ``LEAST_DOCS`` documents reach the fit, so its input is bounded by the sample.
    """
    sample = labelled_sample(docs, labels, "toxic", held_out, rows, "toxicity", text)
    sets = materialize(_term_sets(sample), "term-sets")
    one = sets.select("doc_id", F.explode("terms").alias("term"))
    counted = one.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    inside = one.join(counted.select("term"), "term").groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("found"))
    table = sets.select("doc_id", "label").join(inside, "doc_id", "left").orderBy("doc_id", "label").toArrow()
    found = [np.array(t if t is not None else [], np.int64) for t in table["found"].to_pylist()]
    return fit(table["label"].to_numpy(), found)


class _KnownWords(dict):
    """The place of a word's term in the model, or -1."""

    def __init__(self, machine: FactorizationMachine) -> None:
        super().__init__()
        self.place = {int(t): k for k, t in enumerate(machine.terms)}

    def __missing__(self, word: bytes) -> int:
        found = self.place.get(term_hash(word), -1)
        if len(self) < _KEPT_WORDS:
            self[word] = found
        return found


def score(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row: the probability of label 1, and whether it reaches the threshold.

    A null or empty text, and one without a known term, scores the bias. Repeated rows score alike, long texts are read
    whole. An empty table gives an empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        known = _KnownWords(machine)
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [{known[w] for w in set(t.split())} for t in text_bytes(part["text"])]
                places = np.fromiter((p for f in found for p in f), np.int64)
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                scores = _sigmoid(machine.margins(rows[places >= 0], places[places >= 0], len(found)))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
