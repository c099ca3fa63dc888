"""Archives, packing and the pipeline: round trips."""

import gzip
import hashlib
import io
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from echolag.llm import packing, tokens, warc
from echolag.session import materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/ é", "<html>one</html>", "x"),
        (2, None, "<html>one</html>", "x"),
        (3, "http://c", None, "x"),
        (4, "http://d", "", "x"),
        (5, "http://e\r\nX: y", "é" * 300_000, "x"),
        (5, "http://e", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x"),
        (None, "http://f", "<html>one</html>", "x"),
        (None, "http://f", "alone", "x"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string")


def test_archives_round_trip(pages):
    found = {(r["page_id"], r["payload_digest"]): r for r in warc.archive_pages(pages).collect()}
    least = {}
    for row in pages.collect():
        least.setdefault(row["html"] or "", set()).add(row["page_id"])
    for row in pages.collect():
        payload = (row["html"] or "").encode()
        got = found[row["page_id"], b32encode(hashlib.sha1(payload).digest()).decode()]
        first = min((i for i in least[row["html"] or ""] if i is not None), default=None)
        assert got["payload_bytes"] == len(payload)
        assert got["record_type"] == ("response" if row["page_id"] == first or first is None else "revisit")
        assert got["refers_to"] == (None if got["record_type"] == "response" else first)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_members_are_single_records_and_indexed(pages, tmp_path):
    whole, members = tmp_path / "whole", tmp_path / "members"
    whole.mkdir()
    members.mkdir()
    rows = pages.selectExpr("page_id", "url", "CAST(html AS BINARY) AS payload").coalesce(1)
    written = warc.write_archives(rows, str(whole), archive_bytes=400_000)
    written.write.parquet(str(tmp_path / "written"))
    written = rows.sparkSession.read.parquet(str(tmp_path / "written"))
    index = warc.normalise(warc.mark_revisits(written), str(whole), str(members)).collect()
    assert len(index) == pages.count()
    assert len({r["archive"] for r in index}) > 1
    for file in members.glob("*.warc.gz"):
        data, side = file.read_bytes(), Path(f"{file}.index").read_text().split("\n")[:-1]
        ranges = [tuple(map(int, line.split()[1:])) for line in side]
        assert ranges == sorted((r["start"], r["length"]) for r in index if r["archive"] == file.name)
        assert sum(n for _, n in ranges) == len(data)
        for start, length in ranges:
            inflater = zlib.decompressobj(31)
            record = inflater.decompress(data[start : start + length])
            assert inflater.eof and not inflater.unused_data and record.startswith(b"WARC/1.1\r\n")
        # the whole file is a valid gzip stream too
        assert len(list(warc.records(io.BytesIO(data)))) == len(ranges)
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(ranges)


ODD = [
    "ÀB ñandú's it's '’s don't 12ab3 ÿ× x÷y İstanbul ΣΑΣ éa \x1cq z\x85y x\xa0y 日本語 🙂ok ß ªº µm Æ!! (x) [y] 'll ''s",
    "<|endoftext|>x a<|startoftext|> ﻿ z",
    "",
    " \t\n",
    "The the THE the! 'THE' the,the re're",
]


def test_word_ids_equal_the_tokenizers(spark):
    encode, whole = tokens.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    for text in texts:
        ids = np.frombuffer(encode(text.encode()), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts):
    """Every id of every document lies in one piece, and sequences have no gap and no padding but to a power of two."""
    whole = Tokenizer.from_file(TOKENIZER)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.LENGTH and (at == packing.LENGTH or at & (at - 1) == 0)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_keeps_every_id(spark, edges, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check_packed(packing.pack(docs, TOKENIZER).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    once = edges.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packed(packing.pack(once, TOKENIZER).collect(), {r["doc_id"]: r["text"] for r in once.collect()})
    assert packing.pack(none, TOKENIZER).count() == 0
    twice = packing.pack(edges, TOKENIZER).where("doc_id = 1 AND start = 0").count()
    assert twice == 2


def test_piece_goes_where_squares_become_least():
    draw = np.random.default_rng(9)
    finished = []
    packer = packing.Packer(finished.append, length=16, open_windows=1000)
    for k in range(300):
        size = int(draw.integers(1, 16))
        counts = packer.counts.copy()
        options = {}
        for level in range(1, 16 - size + 1):
            if counts[level]:
                after = counts.copy()
                after[level] -= 1
                if level + size < 16:
                    after[level + size] += 1
                options[level] = int((after**2).sum())
        after = counts.copy()
        after[size] += 1
        options[0] = int((after**2).sum())
        packer.add(k, b"\0" * 4 * size)
        assert int((packer.counts**2).sum()) == min(options.values())
    packer.flush()
    assert all(sum(len(p[2]) for p in w) == 64 for w in finished[:-5])
    assert packer.n_open == 0


def test_open_windows_are_bounded():
    finished = []
    packer = packing.Packer(finished.append, length=64, open_windows=3)
    for k in range(200):
        packer.add(k, b"\1" * 4 * (1 + 7 * k % 60))
        assert packer.n_open <= 3
    packer.flush()
    assert sum(len(p[2]) for w in finished for p in w) == 4 * sum(1 + 7 * k % 60 for k in range(200))


def plain_mix(spark, rows):
    """How often each document is taken: queues by source in the order of a digest, merged by finish time, cut at the budget."""
    import hashlib

    from test_texts import fill

    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r["doc_id"])
    totals = {s: sum(size[d] for d in ids) for s, ids in sources.items()}
    target = fill(totals)
    number = {r["doc_id"]: k for k, r in enumerate(rows)}
    queue = []
    for source, ids in sources.items():
        upto = 0
        for doc in sorted(ids, key=lambda d: (hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, size[d], number[d])):
            upto += size[doc]
            for turn in range(2):
                if target[source]:
                    queue.append(((upto + turn * totals[source]) / target[source], source is None, source or "", turn, doc))
    budget, line, taken = int(1.5 * sum(totals.values())), 0, Counter()
    places = {d: hashlib.md5(f"mix:{d}".encode()).hexdigest() for d in size}
    for *_, doc in sorted(queue, key=lambda q: (q[0], q[1], q[2].encode(), q[3], places[q[4]], q[4])):
        line += size[doc]
        if line <= budget and size[doc]:
            taken[doc] += 1
    return taken


def test_pipeline_stages(spark):
    """Each stage against plain Python on what the stage before has kept."""
    from test_dedup import expected_groups
    from test_texts import WORD, base_of

    from echolag.llm.quality_rules import STOP_WORDS

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "source mix", "packing"]

    def good(text):
        n_words, chars, symbols, dup_lines, repeated = base_of(text)
        if n_words < 10 or 100 * repeated > 20 * n_words:
            return False
        lines = sum(bool(WORD.search(line)) for line in text.split("\n"))
        stop = sum(w in STOP_WORDS for w in WORD.findall(text)) / n_words
        return (
            2 <= chars / n_words <= 15
            and symbols / n_words <= 0.1
            and (n_words < 50 or stop >= 0.02)
            and stop <= 0.9
            and dup_lines / max(lines, 1) <= 0.5
        )

    def first_copies(rows):
        first = {}
        for r in rows:
            body = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
            first[body] = min(first.get(body, r["doc_id"]), r["doc_id"])
        return set(first.values())

    def first_near(rows):
        groups = expected_groups([(r["doc_id"], r["text"]) for r in rows], 5)
        return {d for d, g in groups.items() if d == g}

    plain = {"quality rules": lambda rows: {r["doc_id"] for r in rows if good(r["text"] or "")}, "exact dedup": first_copies, "near dedup": first_near}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns
        left = [r["doc_id"] for r in kept.collect()]
        assert sorted(left) == sorted(plain[name](before)) and len(left) < len(before), name
    before = kept.collect()
    mixed = corpus_pipeline.mix_sources(spark, kept, sf)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert Counter(r["doc_id"] for r in rows) == plain_mix(spark, before)
    packed = corpus_pipeline.pack_documents(spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokens = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
    pieces, wanted = Counter(), Counter()
    for r in packed:
        pieces[r["doc_id"]] += r["length"]
    for r in rows:
        wanted[r["doc_id"]] += tokens[r["doc_id"]]
    assert pieces == wanted
    lengths = Counter()
    for r in packed:
        lengths[r["sequence_id"]] += r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())
    assert corpus_pipeline.run(spark, sf).groupBy().sum("length").first()[0] == sum(r["length"] for r in packed)


def test_rule_places_nearly_all_in_small_partitions(monkeypatch):
    """Of documents shorter than a window nearly all tokens are where the rule, with or without a cut, has put them."""
    draw = np.random.default_rng(4)
    sizes = np.minimum(4095, draw.lognormal(6, 1.2, 310).astype(int) + 1)
    finished, last = [], []
    packer = packing.Packer(finished.append)
    whole_flush = packing.Packer.flush

    def flush(self):
        while self.n_open > 1:
            self._dissolve()
        last.append(sum(len(ids) // 4 for level in self.windows for window in level for _, _, ids, _ in window))
        whole_flush(self)

    monkeypatch.setattr(packing.Packer, "flush", flush)
    for k, size in enumerate(sizes):
        packer.add(k, b"\1\0\0\0" * int(size))
    packer.flush()
    assert sum(last) < 0.1 * sizes.sum()
    filled = [sum(len(ids) // 4 for _, _, ids, _ in window) for window in finished]
    assert sum(filled) == sizes.sum() and all(n == 4096 or n & (n - 1) == 0 for n in filled)
    # most documents stay in one piece
    pieces = Counter(doc for window in finished for doc, *_ in window)
    assert np.mean([n == 1 for n in pieces.values()]) > 0.6


def test_archives_are_dealt_to_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url", "cast(repeat(cast(id AS string), 500) AS binary) AS payload")
    folder = tmp_path / "whole"
    folder.mkdir()
    written = materialize(warc.write_archives(pages.repartition(6), str(folder), archive_bytes=20_000), "written")
    archives = written.select("archive").distinct().count()
    assert archives > 8
    placed = warc._by_archive(written)
    assert placed.rdd.getNumPartitions() >= archives
    assert placed.select(F.spark_partition_id()).distinct().count() > archives // 3
