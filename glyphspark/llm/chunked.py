"""Chunks of documents, and questions that chunks ask of a key's other holders.

Deduplicating operators must know, for a great many keys of a text (windows,
anchors), what the whole corpus knows of them. Sending each key through a
shuffle costs several times the input. Instead documents are packed into
chunks, once, as compressed rows of a table in the shared folder; a chunk
sends each shard of the key space one compressed message with its distinct
keys in order, and the shard answers with one message aligned to it. A key
that a third of all documents hold thus counts once for each chunk, shards are
even, and a task's memory is bounded by a chunk (or the longest document) or
a shard. Chunks grow with the number of shards, so that messages stay in
proportion to the keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of text in a chunk, about, at least and at most: a small one stays below what the JVM calls a humongous object when compressed.
CHUNK, MOST_CHUNK = 1 << 20, 64 << 20
#: Keys in a shard at most, for corpora of up to MANY shards and for larger ones.
SHARD_KEYS, LARGE_SHARD_KEYS = 16 << 20, 64 << 20
LEAST_SHARDS, MANY = 32, 8192
#: Keys of a chunk for each shard, at least, as long as chunks may grow.
MESSAGE_KEYS = 64


def sizes(total: int, key_bytes: float) -> tuple[int, int]:
    """Bytes of a chunk, and the number of shards (a power of two), for a corpus of so many bytes with a key in each key_bytes.

    Messages number chunks times shards. So that they stay in proportion to the
    keys, chunks grow with the shards: a message holds MESSAGE_KEYS keys or
    more, until chunks are MOST_CHUNK bytes.
    """
    keys = max(1, total / key_bytes)
    shards = shard_count(keys)
    return int(min(MOST_CHUNK, max(CHUNK, MESSAGE_KEYS * shards * key_bytes))), shards


def shard_count(keys: float) -> int:
    power = lambda n: 1 << max(0, math.ceil(math.log2(max(1, n))))
    shards = power(keys / SHARD_KEYS)
    return max(LEAST_SHARDS, shards if shards <= MANY else max(MANY, power(keys / LARGE_SHARD_KEYS)))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, as UTF-8; a pass over that column."""
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")).alias("n")).first()["n"] or 0


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class Chunk:
    """The documents of a chunk: ids (with a mask of nulls) and texts as bytes."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.null = np.frombuffer(row["nulls"], bool)
        data, ends = unsqueeze(row["texts"]), np.cumsum(np.frombuffer(row["sizes"], np.int64)).tolist()
        self.data = data
        self.texts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.ends = np.array(ends, np.int64)


#: Chunks are large and compressed: pages and row groups end by their bytes, not after 100 rows, so that no file is one page in the JVM.
CHUNK_FILES = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

CHUNK_SCHEMA = "chunk long, docs long, bytes long, ids binary, nulls binary, sizes binary, texts binary"


def pack(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK) -> DataFrame:
    """The documents packed into chunks. A null text is an empty one; ids are whole numbers or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            null = np.array([i is None for i in ids], bool)
            row = [part << 32 | made, len(ids), held, np.array([i or 0 for i in ids], np.int64).tobytes(), null.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeeze(b"".join(texts))]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "docs", "bytes", "ids", "nulls", "sizes", "texts"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= size:
                    yield out()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield out()

    return materialize(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, CHUNK_SCHEMA), "chunks", options=CHUNK_FILES)


def pack_sorted(values: np.ndarray, bits: int) -> bytes:
    """Distinct sorted numbers below 2**bits by Elias-Fano coding: about 2 + log2(2**bits / n) bits each."""
    n = len(values)
    low = max(0, bits - max(1, int(n).bit_length()))
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    lows = b""
    if low:
        shifts = np.arange(low - 1, -1, -1, dtype=np.uint64)
        lows = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
    return np.array([n, low, len(marks)], np.int64).tobytes() + np.packbits(marks).tobytes() + lows


def unpack_sorted(data: bytes) -> np.ndarray:
    n, low, m = np.frombuffer(data, np.int64, 3).tolist()
    at = 24 + -(-m // 8)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -(-m // 8), 24), count=m)) - np.arange(n)
    out = high.astype(np.uint64) << np.uint64(low)
    if low:
        b = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=n * low).reshape(n, low)
        for j in range(low):
            out |= b[:, j].astype(np.uint64) << np.uint64(low - 1 - j)
    return out


def tell(chunks: DataFrame, say: Callable[[Chunk], Iterator[tuple[int, list[bytes]]]], parts: int) -> DataFrame:
    """The messages (shard, chunk, p0, p1, ...) of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from _messages(say(Chunk(row)), row["chunk"], parts)

    return chunks.mapInArrow(run, message_schema(parts))


def message_schema(parts: int) -> str:
    return "shard long, chunk long" + "".join(f", p{i} binary" for i in range(parts))


def _messages(said: Iterator[tuple[int, list[bytes]]], chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
    rows = list(said)
    if rows:
        cols = [pa.array([s for s, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), *[pa.array([p[i] for _, p in rows], pa.binary()) for i in range(parts)]]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "chunk", *[f"p{i}" for i in range(parts)]])


def answer(messages: DataFrame, reply: Callable[[list[dict]], list[bytes]]) -> DataFrame:
    """(shard, chunk, bits): a shard's reply to each of its messages."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        return pa.table({"shard": pa.array([r["shard"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bits": pa.array(reply(rows), pa.binary())})

    return messages.groupBy("shard").applyInArrow(run, "shard long, chunk long, bits binary")


def resume(chunks: DataFrame, answers: DataFrame, go_on: Callable[[Chunk, list[dict]], Iterator[pa.RecordBatch] | Iterator[pa.Table]], schema: str) -> DataFrame:
    """Each chunk with the answers it got, in the order of shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(right.to_pylist(), key=lambda r: r["shard"])
        out = [go_on(Chunk(row), got) for row in left.to_pylist()]
        return pa.concat_tables([pa.Table.from_batches([x]) for y in out for x in y]) if any(out) else _empty(schema)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The sketch cell of each 64-bit key in a row of the sketch."""
    odd = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[row])
    k = (keys ^ (keys >> np.uint64(29))) * odd
    return (k ^ (k >> np.uint64(32))) * odd >> np.uint64(64 - bits)


def say_cells(keys: np.ndarray, rows: int, bits: int, shards: int) -> Iterator[tuple[int, list[bytes]]]:
    """A chunk's part of a count-min sketch, sparse: for each row and shard its cells, and which of them it has counted twice."""
    width = bits - (shards.bit_length() - 1)
    for row in range(rows):
        c, n = np.unique(cells(keys, row, bits), return_counts=True)
        cuts = np.searchsorted(c, np.arange(shards + 1, dtype=np.uint64) << np.uint64(width))
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                yield row * shards + s, [pack_sorted(c[a:b] - (np.uint64(s) << np.uint64(width)), width), np.packbits(n[a:b] > 1).tobytes()]


def merge_cells(width: int) -> Callable[[list[dict]], list[bytes]]:
    """Adds up the parts of a sketch's shard; says of each cell sent whether its count is 2 or more."""

    def reply(rows: list[dict]) -> list[bytes]:
        times = np.zeros(1 << width, np.uint8)
        for r in rows:
            c = unpack_sorted(r["p0"])
            again = np.unpackbits(np.frombuffer(r["p1"], np.uint8), count=len(c))
            times[c] = np.minimum(times[c] + 1 + again, 2)
        return [np.packbits(times[unpack_sorted(r["p0"])] > 1).tobytes() for r in rows]

    return reply


def estimated_repeated(keys: np.ndarray, got: list[dict], rows: int, bits: int, shards: int) -> np.ndarray:
    """Which keys of a chunk the merged sketch counts twice or more, from the answers to say_cells."""
    width = bits - (shards.bit_length() - 1)
    told = {g["shard"]: g["bits"] for g in got}
    out = np.ones(len(keys), bool)
    for row in range(rows):
        c, back = np.unique(cells(keys, row, bits), return_inverse=True)
        cuts = np.searchsorted(c, np.arange(shards + 1, dtype=np.uint64) << np.uint64(width))
        flags = [np.unpackbits(np.frombuffer(told[row * shards + s], np.uint8), count=int(cuts[s + 1] - cuts[s])) for s in range(shards) if cuts[s + 1] > cuts[s]]
        if flags:
            out &= np.concatenate(flags).astype(bool)[back]
    return out


def say_counts(keys: np.ndarray, bits: int, shards: int) -> Iterator[tuple[int, list[bytes]]]:
    """As say_cells() for a sketch of one row, with the chunk's count of each cell, up to 255."""
    width = bits - (shards.bit_length() - 1)
    c, n = np.unique(cells(keys, 0, bits), return_counts=True)
    cuts = np.searchsorted(c, np.arange(shards + 1, dtype=np.uint64) << np.uint64(width))
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        if b > a:
            yield s, [pack_sorted(c[a:b] - (np.uint64(s) << np.uint64(width)), width), squeeze(np.minimum(n[a:b], 255).astype(np.uint8).tobytes())]


def merge_counts(width: int, often: int) -> Callable[[list[dict]], list[bytes]]:
    """Adds up the parts of a sketch's shard; says of each cell sent whether its count is 2 or more, and whether it is ``often`` (below 255) or more."""

    def reply(rows: list[dict]) -> list[bytes]:
        total = np.zeros(1 << width, np.uint8)
        for r in rows:
            c = unpack_sorted(r["p0"])
            n = np.frombuffer(unsqueeze(r["p1"]), np.uint8)
            total[c] = np.minimum(total[c].astype(np.uint16) + n, 255)
        told = (total[unpack_sorted(r["p0"])] for r in rows)
        return [np.packbits(n > 1).tobytes() + np.packbits(n >= often).tobytes() for n in told]

    return reply


def estimated_classes(keys: np.ndarray, got: list[dict], bits: int, shards: int) -> np.ndarray:
    """For each key of a chunk, from the answers to say_counts: 0 if the merged sketch counts it once, 1 if twice or more, 2 if often."""
    width = bits - (shards.bit_length() - 1)
    told = {g["shard"]: g["bits"] for g in got}
    c, back = np.unique(cells(keys, 0, bits), return_inverse=True)
    cuts = np.searchsorted(c, np.arange(shards + 1, dtype=np.uint64) << np.uint64(width))
    out = [np.zeros(0, np.uint8)]
    for s in range(shards):
        n = int(cuts[s + 1] - cuts[s])
        if n:
            both = np.frombuffer(told[s], np.uint8).reshape(2, -1)
            out.append(np.unpackbits(both, axis=1, count=n).sum(axis=0, dtype=np.uint8))
    return np.concatenate(out)[back]
