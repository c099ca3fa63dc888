"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A document is a vector of weighted term shares: the shapes of its words (letters as ``A`` or ``a``, digits as ``0``, runs as
one), the words themselves, repeats of the word before, repeated lines, number of lines and length. The vectors of a bounded
sample of labelled documents are decomposed by singular values; the leading right vectors map any document into a space of a
few dimensions. Every document is compared with every labelled vector, as blocked matrix products, and the ``NEIGHBOURS``
nearest vote for their labels with a power of their cosine.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, text_bytes
from .labelled import labelled_sample

# labelled documents that vote; they and the map into the space are sent to every executor, about 2 MB together
TRAIN_ROWS = 4_000
FEATURES = 8_192
DIMENSIONS = 24
NEIGHBOURS = 15
SHARPNESS = 8
WORD_WEIGHT = 0.1
_BLOCK = 2_048
_KEPT_WORDS = 500_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_MARKS = b".,;:!?"


def _feature(kind: bytes, value: bytes = b"") -> int:
    return xxhash.xxh32_intdigest(kind + value) % FEATURES


class _WordFeatures(dict):
    """The features of a word's shape and of the word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPES))[:12]
        found = _feature(b"shape ", shape), _feature(b"word ", word.strip(_MARKS).translate(_LOWER))
        if len(self) < _KEPT_WORDS:
            self[word] = found
        return found


_WORDS = _WordFeatures()
_AGAIN, _COPIED, _LINES = _feature(b"again"), _feature(b"copied"), _feature(b"lines")
_LENGTHS = [_feature(b"length ", str(k).encode()) for k in range(1, 64)]


def term_shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares of its words; none for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    weights: Counter[int] = Counter()
    for word, times in Counter(words).items():
        shape, own = _WORDS[word]
        weights[shape] += times
        weights[own] += WORD_WEIGHT * times
    weights[_AGAIN] += sum(map(bytes.__eq__, words[1:], words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    weights[_COPIED] += n * (len(lines) - len(set(lines))) / len(lines)
    weights[_LINES] += len(lines)
    for k in range((n + 1).bit_length() - 1):
        weights[_LENGTHS[k]] += n / 10
    found = np.fromiter(weights.keys(), np.int64, len(weights))
    return found, np.fromiter(weights.values(), float, len(weights)) / n


Shares = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Neighbours:
    """Map into the latent space, the labelled unit vectors in it, and their labels."""

    to_space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, shares: Shares) -> np.ndarray:
        return _unit(np.stack([weight.astype(np.float32) @ self.to_space[found] for found, weight in shares]))

    def vote(self, placed: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, weighted by similarity; 0.5 where nothing is similar."""
        if not len(self.labels):
            return np.full(len(placed), 0.5)
        alike = placed @ self.vectors.T
        n = min(NEIGHBOURS, alike.shape[1])
        nearest = np.argpartition(-alike, n - 1, axis=1)[:, :n]
        weight = np.take_along_axis(alike, nearest, 1).clip(0).astype(float) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[nearest]).sum(1) / np.where(total > 0, total, 1), 0.5)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def fit(shares: Shares, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Neighbours:
    """Decompose the labelled documents by a randomised range finder with a power step."""
    if not shares:
        return Neighbours(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    table = np.zeros((len(shares), FEATURES), np.float32)
    for row, (found, weight) in enumerate(shares):
        table[row, found] = weight
    rarity = np.log((1 + len(shares)) / (1 + (table > 0).sum(0))) + 0.3
    table *= rarity.astype(np.float32)
    rng = np.random.default_rng(1990)
    probe = rng.normal(size=(FEATURES, dimensions + 10)).astype(np.float32)
    basis = np.linalg.qr(table @ (table.T @ (table @ probe)))[0]
    leading = np.linalg.svd(basis.T @ table, full_matrices=False)[2][:dimensions].T
    return Neighbours((leading * rarity[:, None]).astype(np.float32), _unit(table @ leading), labels.astype(float))


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS, text: str = "text") -> Neighbours:
    """Learn ``labels.quality`` from about ``rows`` labelled documents that are not held out.

    Term shares are taken where the texts are; only they, at most ``FEATURES`` numbers per document, are gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                taken = [term_shares(t) for t in text_bytes(part["text"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["label"],
                        pa.array([f.tolist() for f, _ in taken], pa.list_(pa.int32())),
                        pa.array([s.tolist() for _, s in taken], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "label", "features", "shares"],
                )

    sample = labelled_sample(docs, labels, "quality", held_out, rows, "quality", text)
    schema = "doc_id bigint, label int, features array<int>, shares array<float>"
    found = sample.mapInArrow(run, schema).orderBy("doc_id", "label").toArrow()
    shares = [
        (np.asarray(f, np.int64), np.asarray(s))
        for f, s in zip(found["features"].to_pylist(), found["shares"].to_pylist(), strict=True)
    ]
    return fit(shares, found["label"].to_numpy())


def score(docs: DataFrame, neighbours: Neighbours, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row: the vote for label 1, and whether it reaches the threshold.

    A null or empty text, or one whose vector is zero, scores 0.5. Repeated rows score alike, long texts are read whole. An
    empty table gives an empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(neighbours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neighbours = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                shares = [term_shares(t) for t in text_bytes(part["text"])]
                blocks = [shares[at : at + _BLOCK] for at in range(0, len(shares), _BLOCK)]
                scores = np.concatenate([neighbours.vote(neighbours.place(block)) for block in blocks])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
