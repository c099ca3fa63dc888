"""Arrow batches inside tasks: byte views of text columns and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column's texts in one array, and the len + 1 bounds of the texts in it."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    bounds = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    whole = filled.buffers()[2]
    joined = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    return joined[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``limit`` bytes at most; one longer text is a slice of its own."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False), float))
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, in order, from batches that are sorted by ``keys``. A run must fit in memory."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for at, key in enumerate(rows):
            if key != last:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], at, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
