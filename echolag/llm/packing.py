"""Packing of tokenized documents into windows by the sum-of-squares rule.

After Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares algorithm for bin packing" (2006): the packer
keeps an array with the number of open windows at each fill level, and puts a piece where the sum of the squares of these
numbers becomes least. Documents of a window's length and more are first cut into full windows and a rest. Every partition
of the input packs its own rows while it reads them, so texts are never shuffled. At the end of a partition, and when too many
windows are open, the emptiest window is dissolved and its pieces are placed by the same rule, which may now also cut a piece
to fill a window up and place what is left of it anew; so all pieces stay where the rule has put them. The last window of a
partition is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import pieces
from .tokens import WordEncoder

LENGTH = 4096
END_ID = 2
# most windows that stay open in one packer; bounds its memory to as many windows of token ids
OPEN_WINDOWS = 1_500
_ROWS = 50_000

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
SPARK_SCHEMA = ", ".join(f"{name} bigint" for name in SCHEMA.names)


class Packer:
    """Places pieces (doc, start, ids as bytes, tokens of the document) and hands finished windows to ``emit``."""

    def __init__(self, emit, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> None:
        self.emit, self.length, self.most = emit, length, open_windows
        self.counts = np.zeros(length + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(length + 1)]
        self.n_open = 0

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while total - start >= self.length:
            self.emit([(doc, start, ids[4 * start : 4 * (start + self.length)], total)])
            start += self.length
        if start < total:
            self._place((doc, start, ids[4 * start :], total), total - start)

    def _place(self, piece: tuple, size: int) -> None:
        # of a window at level h the sum of squares changes by 2 (N(h + size) - N(h) + 1), or 1 - 2 N(h) where it fills
        # up; of a new window by 2 N(size) + 1
        top = self.length - size
        open_at = self.counts[1 : top + 1]
        change = 2 * (self.counts[size + 1 :] - open_at) + 2
        if top:
            change[-1] = 1 - 2 * open_at[-1]
            change = np.where(open_at > 0, change, np.iinfo(np.int64).max)
            # on a tie the fuller window, which leaves the least space
            best = top - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * self.counts[size] + 1:
                self._move(best + 1, piece, size)
                return
        while self.n_open >= self.most:
            self._dissolve()
        self._open(piece, size)

    def _open(self, piece: tuple, size: int) -> None:
        self.windows[size].append([piece])
        self.counts[size] += 1
        self.n_open += 1

    def _move(self, level: int, piece: tuple, size: int) -> None:
        window = self.windows[level].pop()
        self.counts[level] -= 1
        window.append(piece)
        if level + size == self.length:
            self.n_open -= 1
            self.emit(window)
        else:
            self.windows[level + size].append(window)
            self.counts[level + size] += 1

    def _dissolve(self) -> None:
        """Place the pieces of the emptiest window in the others, cut where the rule says so."""
        level = int(np.flatnonzero(self.counts)[0])
        window = self.windows[level].pop()
        self.counts[level] -= 1
        self.n_open -= 1
        for piece in window:
            self._place_cut(piece)

    def _place_cut(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        while ids:
            size = len(ids) // 4
            if not self.n_open:
                self._open((doc, start, ids, total), size)
                return
            levels = np.flatnonzero(self.counts)
            ends = levels + size
            # a window that fills up leaves its level, and what is cut off begins a level of its own
            inside = 2 * (self.counts[np.minimum(ends, self.length)] - self.counts[levels]) + 2
            filled = 1 - 2 * self.counts[levels]
            rest = filled + 2 * self.counts[np.maximum(ends - self.length, 0)] + 1
            change = np.select([ends < self.length, ends == self.length], [inside, filled], rest)
            # on a tie the fuller window
            level = int(levels[::-1][np.argmin(change[::-1])])
            taken = min(size, self.length - level)
            self._move(level, (doc, start, ids[: 4 * taken], total), taken)
            start, ids = start + taken, ids[4 * taken :]

    def flush(self) -> None:
        """Dissolve windows until one is left, and cut that one into powers of two."""
        while self.n_open > 1:
            self._dissolve()
        queue = [p for level in self.windows for window in level for p in window]
        self.counts[:] = 0
        self.windows = [[] for _ in range(self.length + 1)]
        self.n_open = 0
        left = sum(len(ids) // 4 for _, _, ids, _ in queue)
        window: list[tuple] = []
        room = self._next_length(left)
        for doc, start, ids, total in queue:
            while ids:
                taken = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * taken], total))
                ids, start, room, left = ids[4 * taken :], start + taken, room - taken, left - taken
                if not room:
                    self.emit(window)
                    window, room = [], self._next_length(left)

    def _next_length(self, left: int) -> int:
        return self.length if left >= self.length else 1 << (left.bit_length() - 1) if left else 0


class _Output:
    """Rows of finished windows, in columns; windows are numbered within their partition."""

    def __init__(self, partition: int) -> None:
        self.next = partition << 40
        self.rows: list[tuple] = []

    def __call__(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in window:
            size = len(ids) // 4
            self.rows.append((doc, start, size, zlib.crc32(ids), total, self.next, offset))
            offset += size
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA
        )


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a tokenizer file that every executor has. A null or empty text is only the end id.
    Repeated rows, also of one ``doc_id``, are packed each on its own; a null ``doc_id`` stays null. Long texts are cut
    into full windows. An empty table gives an empty table, and other columns are ignored. Sequences are numbered by the
    input partition, so a task that runs again makes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.shared(tokenizer)
        output = _Output(TaskContext.get().partitionId())
        packer = Packer(output, length)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in pieces(batch, "text"):
                for doc, value in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    packer.add(doc, encode(value.as_buffer().to_pybytes() if value.is_valid else b"") + end)
                if len(output.rows) > _ROWS:
                    yield output.take()
        packer.flush()
        yield output.take()

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"CAST(`{text}` AS BINARY) AS text")
    return rows.mapInArrow(run, SPARK_SCHEMA)
