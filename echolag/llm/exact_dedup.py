"""Exact duplicates by an extendible-hash index on shared files.

1. Every text is read once for its light entry: row, 64-bit key of the normalised text, digest and length. The entries are
   written to the shared folder.
2. Directory: distinct keys are counted by their leading bits. The directory begins with one slot and doubles while a
   bucket holds more than ``BUCKET_KEYS`` keys; only overfull buckets are split, so a bucket has its own depth and covers
   a range of keys. Copies of one text share a key, so no number of copies can overfill a bucket. At the deepest level a
   bucket is not split any more: its further keys chain on to it.
3. Insertion: the directory gives the slot's bucket and the owner task of the bucket; owners have ranges of whole buckets
   with about equally many keys. Copies that one task reads meet before the shuffle, so a hot text reaches its owner once
   per task. Owners chain the texts of a key and compare their bytes; each text is one entry of the index, which is written
   out in the order of buckets and keys.
4. Every light entry looks its text up in its bucket of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy, lookup
from ..session import materialize
from .rows import numbered, one_of_each
from .text import collapsed, text_or_empty

# most keys of a bucket, unless it has the deepest level
BUCKET_KEYS = 2_000
# deepest level of the directory; it has at most 2 ** MAX_DEPTH slots, a few MB
MAX_DEPTH = 18
# bytes of repeated texts that a task holds back, to send each of them once
HELD_BYTES = 32 << 20


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory(counts: dict[int, int], deepest: int, most: int) -> tuple[int, list[int]]:
    """Global depth and, per slot of that depth, the bucket, for keys counted by their leading ``deepest`` bits.

    Buckets are numbered along the keys, so each covers a key range.
    """
    sums = [counts.get(slot, 0) for slot in range(1 << deepest)]
    levels = [sums]
    for _ in range(deepest):
        sums = [a + b for a, b in zip(sums[::2], sums[1::2], strict=True)]
        levels.append(sums)
    levels.reverse()
    # (local depth, slot at that depth); an overfull bucket is split into two of the next depth
    settled: list[tuple[int, int]] = []
    pending = [(0, 0)]
    while pending:
        depth, slot = pending.pop()
        if depth < deepest and levels[depth][slot] > most:
            pending += [(depth + 1, 2 * slot + 1), (depth + 1, 2 * slot)]
        else:
            settled.append((depth, slot))
    depth = max(d for d, _ in settled)
    slots = [bucket for bucket, (d, _) in enumerate(settled) for _ in range(1 << (depth - d))]
    return depth, slots


def bucket_owners(counts: dict[int, int], deepest: int, depth: int, slots: list[int], n_owners: int) -> list[int]:
    """The owner of each bucket: ranges of whole buckets with about equally many keys."""
    sizes = [0] * (slots[-1] + 1)
    for slot, n in counts.items():
        sizes[slots[slot >> (deepest - depth)]] += n
    total, before, owners = max(1, sum(sizes)), 0, []
    for size in sizes:
        owners.append(min(n_owners - 1, (2 * before + size) * n_owners // (2 * total)))
        before += size
    return owners


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text of a batch, with the least id and the number of copies.

    Texts that a batch holds twice are held back in a table of bounded size, so that a hot text leaves a task once.
    """
    keys = ["owner", "bucket", "key", "body"]
    held: dict[tuple, list] = {}
    size = 0

    def table(rows: dict[tuple, list]) -> pa.RecordBatch:
        made = [{**dict(zip(keys, k, strict=True)), "doc_id": v[0], "n": v[1]} for k, v in rows.items()]
        return pa.RecordBatch.from_pylist(made, schema=schema)

    for batch in batches:
        schema = batch.schema
        merged = pa.Table.from_batches([batch]).group_by(keys, use_threads=False)
        merged = merged.aggregate([("doc_id", "min"), ("n", "sum")]).rename_columns([*keys, "doc_id", "n"]).cast(schema)
        again = pc.greater(merged["n"], 1)
        yield from merged.filter(pc.invert(again)).combine_chunks().to_batches()
        for row in merged.filter(again).to_pylist():
            key = tuple(row[k] for k in keys)
            known = held.get(key)
            if known is None:
                held[key] = [row["doc_id"], row["n"]]
                size += len(row["body"])
            else:
                known[0] = min((x for x in (known[0], row["doc_id"]) if x is not None), default=None)
                known[1] += row["n"]
        if size > HELD_BYTES:
            yield table(held)
            held, size = {}, 0
    if held:
        yield table(held)


def _entries(docs: DataFrame, text: str) -> DataFrame:
    body = collapsed(text_or_empty(text)).alias("body")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body).withColumn("key", F.xxhash64("body"))


def build_index(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The light entries (doc_id, key, text_sha256, n_bytes, bucket), and the index with one row per distinct text."""
    entries = _entries(docs, text)
    light = materialize(
        entries.select("doc_id", "key", F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").alias("n_bytes")),
        "entries",
    )
    keys = light.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = light.count()
    deepest = min(MAX_DEPTH, max(0, (total // BUCKET_KEYS).bit_length() + 3))
    # at most 2 ** MAX_DEPTH rows
    counted = keys.groupBy(_slot(F.col("key"), deepest).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {row["slot"]: row["n"] for row in counted}
    depth, slots = directory(counts, deepest, BUCKET_KEYS)
    n_owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = bucket_owners(counts, deepest, depth, slots, n_owners)
    table = [(slot, bucket, owners[bucket]) for slot, bucket in enumerate(slots)]
    placed = docs.sparkSession.createDataFrame(table, "slot int, bucket int, owner int")

    def in_bucket(rows: DataFrame) -> DataFrame:
        return lookup(rows.withColumn("slot", _slot(F.col("key"), depth)), placed, ["slot"])

    body = F.col("body").cast("binary").alias("body")
    rows = in_bucket(entries).select("owner", "bucket", "key", body, "doc_id", F.lit(1).cast("bigint").alias("n"))
    sent = rows.mapInArrow(_combine, rows.schema).repartitionById(n_owners, "owner")
    # the owner's hash table chains keys that collide and compares their bytes
    index = sent.groupBy("owner", "bucket", "key", "body").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    index = index.select("owner", "bucket", "key", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    return in_bucket(light).drop("slot", "owner"), materialize(index.sortWithinPartitions("bucket", "key"), "index")


def find_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``.

    Texts are equal when they are identical after each run of white space is replaced by one space; a null text counts as
    empty, and empty texts are copies of each other. Of equal texts the row with the least ``doc_id`` stays. Rows that
    repeat that ``doc_id`` with an equal text are ``kept`` alike, and a null ``doc_id`` only where the group has no other
    id. Long texts are compared whole. An empty table gives an empty table; other columns are ignored.
    """
    light, index = build_index(docs, text)
    place = ["bucket", "key", "text_sha256"]
    found = index.select(*place, "keep_id", "group_size")
    weights = index.select(*place, F.col("group_size").alias("weight"))
    looked_up = join_heavy(light, found, place, weights=weights)
    return looked_up.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the least ``doc_id``, nulls last, of these the
    first. Rows that repeat an id with an equal text are copies too."""
    placed, row = numbered(docs)
    found = find_copies(placed.select(F.col(row).alias("doc_id"), F.col(text).alias("text")))
    return one_of_each(placed, row, found.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")))
