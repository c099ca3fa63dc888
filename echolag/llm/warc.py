"""Web archives: one-stream gzip archives of page records, normalised to one gzip member per record.

``write_archives`` writes a WARC response record per page into archives that are each one gzip stream, as some crawlers leave
them: no record can be read without inflating all before it. ``normalise`` inflates each archive once, as a stream, rewrites
every record as a gzip member of its own, turns records whose payload another record has into revisits, and writes a sidecar
index with the byte range of every member. ``read_records`` reads records by that index, each alone.

Tasks hold one record and one output buffer at a time, archives are cut at a bounded size, and file names hold the task's
attempt: a task that runs again writes other files, and only rows of the attempt that counts name any.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import join_heavy
from ..session import materialize, scratch_path
from .arrow import pieces

# payload bytes after which an archive is closed
ARCHIVE_BYTES = 64 << 20
_CHUNK = 1 << 20
_LEVEL = 4
_DATE = "2020-01-01T00:00:00Z"

_WRITTEN = "archive string, seq bigint, page_id bigint, payload_bytes bigint, payload_digest string, payload_sha256 binary"
_INDEXED = "archive string, start bigint, length bigint"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def store_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder, from any worker."""
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def _line(value: str | None) -> str:
    """A header value in one line."""
    return "" if value is None else " ".join(value.split())


def _block(headers: list[tuple[str, str]], content: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(content)))])
    return head.encode() + b"\r\n" + content + b"\r\n\r\n"


def response_record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _block(headers, http.encode() + payload)


def as_revisit(headers: list[tuple[str, str]], content: bytes, refers_to: int) -> bytes:
    """The record without its payload; its HTTP header, and so the payload's length, stays."""
    kept = [(k, v) for k, v in headers if k not in ("WARC-Type", "Content-Length")]
    kept = [
        ("WARC-Type", "revisit"),
        *kept,
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", _record_id(refers_to)),
        ("X-Refers-To-Page-ID", str(refers_to)),
    ]
    return _block(kept, content[: content.index(b"\r\n\r\n") + 4])


class _Inflated:
    """Reads a gzip stream of one or more members piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.buffer, self.at = stream, bytearray(), 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at > _CHUNK:
            del self.buffer[: self.at]
            self.at = 0
        raw = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        raw = raw or self.stream.read(_CHUNK)
        if not raw:
            return False
        self.buffer += self.inflate.decompress(raw)
        return True

    def until(self, mark: bytes) -> bytes | None:
        searched = self.at
        while (end := self.buffer.find(mark, searched)) < 0:
            behind = len(self.buffer) - self.at
            if not self._more():
                return None
            searched = self.at + max(0, behind - len(mark))
        found = bytes(self.buffer[self.at : end])
        self.at = end + len(mark)
        return found

    def take(self, size: int) -> bytes:
        while len(self.buffer) - self.at < size:
            if not self._more():
                raise EOFError("the archive ends within a record")
        found = bytes(self.buffer[self.at : self.at + size])
        self.at += size
        return found


def records(stream) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and content of each record of a gzip stream, whatever its members."""
    inflated = _Inflated(stream)
    while (head := inflated.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")[1:]
        headers = [tuple(line.split(": ", 1)) if ": " in line else (line.rstrip(":"), "") for line in lines]
        content = inflated.take(int(dict(headers)["Content-Length"]))
        inflated.take(4)
        yield headers, content


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each page as a response record; one row per record, with its archive and place in it.

    A partition writes archives of its own and closes one after ``archive_bytes`` of payload. A null payload is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_at(folder)
        context = TaskContext.get()
        name, sink, number, rows = "", None, 0, []
        size = seq = 0

        def close() -> None:
            sink.write(gzip.flush())
            sink.close()

        for batch in batches:
            for part in pieces(batch, "payload"):
                for page_id, url, value in zip(
                    part["page_id"].to_pylist(), part["url"].to_pylist(), part["payload"], strict=True
                ):
                    payload = value.as_buffer().to_pybytes() if value.is_valid else b""
                    if sink is None:
                        name = f"whole-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz"
                        sink = store.open_output_stream(f"{base}/{name}", compression=None)
                        gzip = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                        size, seq, number = 0, 0, number + 1
                    sink.write(gzip.compress(response_record(page_id, url, payload)))
                    rows.append((name, seq, page_id, len(payload), digest_of(payload), hashlib.sha256(payload).digest()))
                    size, seq = size + len(payload), seq + 1
                    if size >= archive_bytes:
                        close()
                        sink = None
                yield _batch(rows, written)
                rows = []
        if sink is not None:
            close()

    written = _schema(_WRITTEN)
    return pages.mapInArrow(run, _WRITTEN)


def mark_revisits(written: DataFrame) -> DataFrame:
    """Add ``refers_to``: the least page with an equal payload where that is another page, else null."""
    key = ["payload_sha256", "payload_bytes"]
    first = written.groupBy(*key).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    first = materialize(first, "payloads")
    marked = join_heavy(written, first.select(*key, "first"), key, weights=first.select(*key, "weight"))
    other = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return marked.select("archive", "seq", F.when(other, F.col("first")).alias("refers_to"))


def _by_archive(rows: DataFrame) -> DataFrame:
    """The rows of an archive together. The rows are small and the archives large, so the number of tasks follows these."""
    archives = rows.select("archive").distinct().count()
    return rows.repartition(max(archives, rows.sparkSession.sparkContext.defaultParallelism), "archive")


def normalise(marked: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the archives named in ``marked(archive, seq, refers_to)``, one gzip member per record.

    Each archive is inflated once. Beside each new archive an index file lists record id, start and length of its members;
    the same ranges are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (old, old_base), (new, new_base) = store_at(source), store_at(target)
        attempt = TaskContext.get().taskAttemptId()
        read = sink = side = None
        name, at = None, 0
        rows: list[tuple] = []

        def close() -> None:
            sink.close()
            side.close()

        for batch in batches:
            for archive, refers_to in zip(batch["archive"].to_pylist(), batch["refers_to"].to_pylist(), strict=True):
                if archive != name:
                    if sink is not None:
                        close()
                    name, at = archive, 0
                    renamed = f"{archive.removesuffix('.warc.gz')}-{attempt}.warc.gz"
                    read = records(old.open_input_stream(f"{old_base}/{archive}", compression=None))
                    sink = new.open_output_stream(f"{new_base}/{renamed}", compression=None)
                    side = new.open_output_stream(f"{new_base}/{renamed}.index", compression=None)
                headers, content = next(read)
                if refers_to is None:
                    block = _block([(k, v) for k, v in headers if k != "Content-Length"], content)
                else:
                    block = as_revisit(headers, content, refers_to)
                gzip = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                member = gzip.compress(block) + gzip.flush()
                sink.write(member)
                side.write(f"{dict(headers)['WARC-Record-ID']} {at} {len(member)}\n".encode())
                rows.append((renamed, at, len(member)))
                at += len(member)
            yield _batch(rows, indexed)
            rows = []
        if sink is not None:
            close()

    indexed = _schema(_INDEXED)
    placed = _by_archive(marked).sortWithinPartitions("archive", "seq")
    return placed.select("archive", "refers_to").mapInArrow(run, _INDEXED)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row per indexed record, from its own member alone. A response's digest and length are taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_at(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, start, length in zip(*(batch[c].to_pylist() for c in ("archive", "start", "length")), strict=True):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{base}/{archive}")
                file.seek(start)
                ((headers, content),) = records(pa.BufferReader(file.read(length)))
                fields = dict(headers)
                head, payload = content.split(b"\r\n\r\n", 1)
                page_id, kind = fields["X-Page-ID"], fields["WARC-Type"]
                if kind == "response":
                    size, digest, refers_to = len(payload), digest_of(payload), None
                else:
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers_to = int(fields["X-Refers-To-Page-ID"])
                rows.append((int(page_id) if page_id else None, size, digest, kind, refers_to))
            yield _batch(rows, read)

    read = _schema(_READ)
    placed = _by_archive(index).sortWithinPartitions("archive", "start")
    return placed.select("archive", "start", "length").mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Write the pages, normalise the archives and read them back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to) per row of ``pages``.

    Of equal payloads that of the least ``page_id`` is the response and the others revisit it; rows that repeat that
    ``page_id`` are responses too, and rows without ``page_id`` revisit it like any other. Where no row of a payload has an
    id, all are responses. A null html is an empty payload, and a null url an empty one. Very long pages are streamed as one
    record each. An empty table writes no archive and gives an empty table; other columns are ignored.
    """
    spark = pages.sparkSession
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.col(html).cast("binary").alias("payload")
    )
    whole, members = scratch_path(spark, "archives"), scratch_path(spark, "members")
    for folder in (whole, members):
        spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
            spark._jvm.org.apache.hadoop.fs.Path(folder)
        )
    written = materialize(write_archives(rows, whole), "written")
    index = materialize(normalise(mark_revisits(written), whole, members), "members-index")
    return read_records(index, members)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
