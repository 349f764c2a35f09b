"""Removal of byte strings that occur more than once, by a sparse suffix array in sorted buckets.

A string of 200 bytes contains 137 runs of 64 bytes; the one with the least
hash, the leftmost if several have it, is its anchor. Equal strings have equal
anchors at the same place, so only suffixes that begin at anchors, one in about
70, need to be sorted, and each carries the text of all strings with that
anchor. Nothing is lost, as every string has an anchor.

Chunks first learn which anchors occur twice at all, and which occur often
(see chunked.py). The suffixes of those go to buckets: splitters, sampled from
the leading tokens of suffixes, range-partition them; a token is 8 bytes. A
splitter is as long as an anchor, so anchors with the same first tokens are
parted by those that follow, and a bucket can be as small as one anchor. A
bucket sorts its suffixes by multikey quicksort over tokens, those that are
still equal by the next token. Suffixes of one anchor are thus neighbours.
Where an anchor's suffixes differ, their 200-byte strings are sorted in the
same way and compared with their neighbours.

An anchor that occurs often, such as one inside a phrase that many texts share,
would still make a hot bucket. Its strings are taken in pieces of 17 by the
anchor's place in them. All strings of a piece share 184 bytes, which are the
piece's leading tokens: pieces have splitters of their own, of that length.
Equal strings have equal anchors at equal places, so they are in pieces with
equal leading tokens. Equal leading tokens always share a bucket: what a
boundary parts differs within them, and no string of 200 crosses one; buckets
check this against the splitters. Equal suffixes of a chunk are sent once, with
a mark, so copies make no hot bucket.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import Chunk, answer, estimated_classes, merge_counts, message_schema, pack, resume, say_counts, sizes, squeeze, tell, text_bytes, unsqueeze
from .common import materialize
from .substring_dedup import rolling

LENGTH, ANCHOR, TOKEN = 200, 64, 8
CELLS = 16
#: Occurrences from which an anchor occurs often; strings of a piece.
OFTEN, PIECE = 64, 17
#: Bytes of input for each bucket; places that are hashed at once.
BUCKET, SLICE = 4 << 20, 1 << 20
#: Keys in the sample for each splitter, of a chunk, and splitters at most, which the driver holds: beyond, the keys between two splitters are parted by a hash.
SAMPLE, SAMPLE_OF_CHUNK, MOST_SPLITTERS = 32, 512, 1 << 14
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks of w in both directions."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    blocks = full.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


class Anchors:
    """The runs of strings with one anchor in a chunk: first string, number of strings, the anchor's place and hash."""

    def __init__(self, chunk: Chunk, length: int = LENGTH, anchor: int = ANCHOR):
        data = np.frombuffer(chunk.data, np.uint8)
        out: list[tuple[np.ndarray, ...]] = []
        ends = chunk.ends
        for at in range(0, max(0, len(data) - length + 1), SLICE):
            part = data[at : at + SLICE + length - 1]
            n = len(part) - length + 1
            h = rolling(_TABLE[part], anchor, _M)
            h = (h ^ (h >> np.uint64(32))) * _M
            place = np.arange(len(h), dtype=np.uint64)
            mask = np.uint64((1 << int(SLICE + length).bit_length()) - 1)
            first = (sliding_min((h & ~mask) | place, length - anchor + 1) & mask).astype(np.int64)
            q = np.arange(at, at + n)
            doc = np.searchsorted(ends, q, side="right")
            whole = q + length <= ends[np.minimum(doc, len(ends) - 1)]
            new = np.ones(n, bool)
            new[1:] = (first[1:] != first[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, n))
            keep = whole[begin]
            begin, count = begin[keep], count[keep]
            out.append((begin + at, count, first[begin] + at, h[first[begin]]))
        self.begin, self.count, self.anchor, self.hash = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.uint64 if i == 3 else np.int64) for i in range(4))


def token(data: bytes, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as a number in the order of bytes; bytes past the end are 0."""
    b = np.frombuffer(data + b"\0" * TOKEN, np.uint8)
    out = np.zeros(len(at), np.uint64)
    for j in range(TOKEN):
        out = out << np.uint64(8) | b[at + j]
    return out


def multikey_sort(data: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings of equal length that begin at the places; also which of them, so sorted, begin a new value.

    Multikey quicksort with tokens of 8 bytes for characters: all are sorted by
    the first token, and those equal so far, group by group, by the next.
    """
    order = np.arange(len(at))
    new = np.zeros(len(at), bool)
    new[:1] = True
    tied = np.arange(len(at))  # places in the order whose group has more than one
    for depth in range(0, length, TOKEN):
        depth = min(depth, length - TOKEN)  # the last token overlaps the one before
        some = order[tied]
        t = token(data, at[some] + depth)
        group = np.cumsum(new[tied])
        put = np.lexsort((t, group)) if depth else np.argsort(t, kind="quicksort")
        order[tied] = some[put]
        t, group = t[put], group[put]
        new[tied[1:]] |= t[1:] != t[:-1]
        first = new[tied]
        alone = first & np.append(first[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
    return order, new


class Buckets:
    """The range partition of keys: those of anchors (kind 0) and those of pieces (kind 1), each with splitters of its length."""

    def __init__(self, splitters: list[list[bytes]], parts: int = 1, length: int = LENGTH, anchor: int = ANCHOR):
        self.splitters, self.parts = splitters, parts
        self.key_bytes = (anchor, length - PIECE + 1)
        self.begin = (0, (len(splitters[0]) + 1) * parts)

    def of(self, kind: int, key: bytes) -> int:
        return self.begin[kind] + bisect_right(self.splitters[kind], key) * self.parts + (zlib.crc32(key) % self.parts if self.parts > 1 else 0)

    def kind(self, bucket: int) -> int:
        return int(bucket >= self.begin[1])

    def holds(self, bucket: int, key: bytes) -> bool:
        """Whether a key is on the right side of the bucket's boundaries."""
        kind = self.kind(bucket)
        at, splitters = (bucket - self.begin[kind]) // self.parts, self.splitters[kind]
        return (at == 0 or splitters[at - 1] <= key) and (at == len(splitters) or key < splitters[at])


def quantiles(keys: list[bytes], n: int) -> list[bytes]:
    """n - 1 distinct splitters, at most, that part sorted keys evenly."""
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def pieces(a: Anchors, some: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings (first string, number, place of the key in the first, kind): whole runs of some anchors, and the pieces of those that occur often."""
    begin, count, off = a.begin[some], a.count[some], a.anchor[some] - a.begin[some]
    rare = ~often
    hi = off[often]  # the anchor's place in the run's first string, which is its greatest
    lo = hi - count[often] + 1
    n = hi // PIECE - lo // PIECE + 1
    run = np.repeat(np.arange(len(hi)), n)
    k = (lo // PIECE)[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    most, least = np.minimum(hi[run], k * PIECE + PIECE - 1), np.maximum(lo[run], k * PIECE)
    first = begin[often][run] + hi[run] - most
    return tuple(np.concatenate(x) for x in ((begin[rare], first), (count[rare], most - least + 1), (off[rare], most - k * PIECE), (np.zeros(rare.sum(), np.int64), np.ones(len(run), np.int64))))


class Entries:
    """The distinct suffixes that a chunk sends, in the order of buckets."""

    def __init__(self, chunk: Chunk, got: list[dict], bits: int, shards: int, buckets: Buckets, length: int, anchor: int):
        a = Anchors(chunk, length, anchor)
        classes = estimated_classes(a.hash, got, bits, shards)
        some = np.flatnonzero(classes)
        self.begin, self.count, off, kind = pieces(a, some, classes[some] > 1)
        known: dict[tuple[int, int, bytes], int] = {}
        self.of = np.zeros(len(self.begin), np.int64)
        for i, (k, b, c, o) in enumerate(zip(kind.tolist(), self.begin.tolist(), self.count.tolist(), off.tolist(), strict=True)):
            self.of[i] = known.setdefault((k, o, chunk.data[b : b + c + length - 1]), len(known))
        times = np.bincount(self.of, minlength=len(known))
        texts = [k[2] for k in known]
        offs = np.array([k[1] for k in known], np.int64)
        sizes_ = np.array([len(t) for t in texts], np.int64)
        bucket = np.array([buckets.of(k, t[o : o + buckets.key_bytes[k]]) for k, o, t in known], np.int64)
        order = np.argsort(bucket, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.strings = sizes_[order] - length + 1
        self.messages = []
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            o = order[i:j]
            self.messages.append((int(bucket[o[0]]), squeeze(b"".join([texts[k] for k in o])), sizes_[o].astype(np.int32).tobytes(), offs[o].astype(np.int32).tobytes(), (times[o] > 1).tobytes()))


def bucket_reply(buckets: Buckets, length: int):
    """Sorts a bucket; says of each string of each suffix sent whether it occurs again."""

    def reply(rows: list[dict]) -> list[bytes]:
        index: dict[tuple[int, bytes], int] = {}
        mine: list[list[int]] = []
        times: list[int] = []
        for r in rows:
            data, at, ids = unsqueeze(r["p0"]), 0, []
            sizes, offs = np.frombuffer(r["p1"], np.int32).tolist(), np.frombuffer(r["p2"], np.int32).tolist()
            for n, o, many in zip(sizes, offs, np.frombuffer(r["p3"], bool).tolist(), strict=True):
                i = index.setdefault((o, data[at : at + n]), len(index))
                if i == len(times):
                    times.append(0)
                times[i] += 1 + many
                ids.append(i)
                at += n
            mine.append(ids)
        texts = [k[1] for k in index]
        offs = np.array([k[0] for k in index], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        data = b"".join(texts)
        bucket = rows[0]["shard"]
        key_bytes = buckets.key_bytes[buckets.kind(bucket)]
        strings = sizes - length + 1
        first = np.cumsum(strings) - strings
        again = np.repeat(np.array(times) > 1, strings)
        order, new = multikey_sort(data, begin + offs, key_bytes)
        for i in (order[0], order[-1]):
            if not buckets.holds(bucket, texts[i][offs[i] : offs[i] + key_bytes]):
                raise ValueError("a suffix is on the wrong side of a boundary")
        group = np.cumsum(new) - 1
        mixed = np.bincount(group)[group] > 1  # keys with suffixes that differ
        members = order[mixed]
        if len(members):
            n = strings[members]
            which = np.repeat(members, n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[which] + inside
            o, fresh = multikey_sort(data, at, length)
            alone = fresh & np.append(fresh[1:], True)
            again[(first[which] + inside)[o[~alone]]] = True
        ends = (first + strings).tolist()
        first = first.tolist()
        return [np.packbits(np.concatenate([again[first[i] : ends[i]] for i in ids])).tobytes() for ids in mine]

    return reply


class Job:
    """The steps of deduplicate(): chunks, what they know of their anchors, the buckets, and the suffixes sent."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, length: int, anchor: int, chunk: int | None):
        self.length, self.anchor = length, anchor
        size = text_bytes(df, text_col)
        key_bytes = (length - anchor + 2) / 2
        fit, self.shards = sizes(size, key_bytes)
        self.bits = max((max(1, int(size / key_bytes)) * CELLS - 1).bit_length(), self.shards.bit_length() + 2)
        self.chunks = pack(df, id_col, text_col, chunk or fit)
        self.buckets = self.sampled_buckets(max(64, size // BUCKET))
        self.entries = partial(Entries, bits=self.bits, shards=self.shards, buckets=self.buckets, length=length, anchor=anchor)
        bits, shards = self.bits, self.shards

        def count(c: Chunk) -> Iterator[tuple[int, list[bytes]]]:
            return say_counts(Anchors(c, length, anchor).hash, bits, shards)

        told = answer(tell(self.chunks, count, 2), merge_counts(bits - (shards.bit_length() - 1), OFTEN))
        self.told = materialize(told, "cells", narrow=True)

    def sampled_buckets(self, wanted: int) -> Buckets:
        """Splitters from a sample that grows with them: random anchors of some chunks, seeded by the chunk, with one of each anchor's pieces."""
        length, anchor, n = self.length, self.anchor, min(wanted, MOST_SPLITTERS)

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    c = Chunk(row)
                    a = Anchors(c, length, anchor)
                    pick = np.random.default_rng(c.number).permutation(len(a.hash))[:SAMPLE_OF_CHUNK]
                    place = a.anchor[pick]
                    inside = place - a.begin[pick] - (a.hash[pick] >> np.uint64(20)).astype(np.int64) % a.count[pick]
                    core = place - inside // PIECE * PIECE
                    keys = [[c.data[i : i + m] for i in at.tolist()] for at, m in ((place, anchor), (core, length - PIECE + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()) for k in keys], names=["a", "p"])

        chunks = self.chunks.count()
        of = max(64, SAMPLE * n // SAMPLE_OF_CHUNK)
        some = self.chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(max(1, chunks // of))) == 0)
        rows = [(bytes(r["a"]), bytes(r["p"])) for r in some.mapInArrow(sample, "a binary, p binary").collect()]
        times = Counter(a for a, _ in rows)
        often = [p for a, p in rows if times[a] > 1] or [p for _, p in rows]
        splitters = [quantiles(sorted(a for a, _ in rows), n), quantiles(sorted(often), n)]
        return Buckets(splitters, -(-wanted // n), length, anchor)

    def sent(self) -> DataFrame:
        """(shard, chunk, p0 to p3): the suffixes of each chunk for each bucket; p3 has a byte for each."""

        entries = self.entries

        def send(c: Chunk, got: list[dict]) -> list[pa.RecordBatch]:
            rows = entries(c, got).messages
            if not rows:
                return []
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([c.number] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]]
            return [pa.RecordBatch.from_arrays(cols, names=["shard", "chunk", "p0", "p1", "p2", "p3"])]

        return resume(self.chunks, self.told, send, message_schema(4))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, chunk: int | None = None, texts: bool = True) -> DataFrame:
    """The bytes of each row's text less those covered by a string of ``length`` bytes that also begins elsewhere.

    Returns the id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with texts=True, kept (binary: a cut may part a
    character). Strings never cross rows; the same row counts as elsewhere.
    Null, empty and short texts lose nothing; rows with equal ids are separate.
    Ids are whole numbers or null. Each row gives one row, an empty table none;
    other columns of df are not read, which is done twice: for the size of the
    texts and for the texts.
    """
    job = Job(df, id_col, text_col, length, anchor, chunk)
    entries = job.entries
    found = answer(job.sent(), bucket_reply(job.buckets, length))
    both = job.told.withColumn("kind", F.lit(0).cast("long")).unionByName(found.withColumn("kind", F.lit(1).cast("long")))

    def remove(c: Chunk, got: list[dict]) -> list[pa.RecordBatch]:
        e = entries(c, [g for g in got if not g["kind"]])
        first = np.cumsum(e.strings) - e.strings
        replies = {g["shard"]: g["bits"] for g in got if g["kind"]}
        flags, at = [], 0
        for s, _, sizes, _, _ in e.messages:
            n = len(sizes) // 4
            flags.append(np.unpackbits(np.frombuffer(replies[s], np.uint8), count=int(e.strings[at : at + n].sum())))
            at += n
        again = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        which = np.repeat(np.arange(len(e.of)), e.count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(e.count) - e.count, e.count)
        q = np.sort((e.begin[which] + inside)[again[first[e.rank[e.of]][which] + inside]])
        doc = np.searchsorted(c.ends, q, side="right")
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] > q[:-1] + length) | (doc[1:] != doc[:-1])
        b = np.flatnonzero(new)
        starts, stops, owner = q[b], q[np.append(b[1:], len(q)) - 1] + length if len(q) else q, doc[b]
        n_spans = np.bincount(owner, minlength=len(c.texts))
        cut = np.concatenate([[0], np.cumsum(n_spans)]).tolist()
        spans = list(zip(starts.tolist(), stops.tolist(), strict=True))
        removed, shas, kept = [], [], []
        doc_begin = 0
        for i, t in enumerate(c.texts):
            at, parts, gone = 0, [], 0
            for x, y in spans[cut[i] : cut[i + 1]]:
                parts.append(t[at : x - doc_begin])
                at = y - doc_begin
                gone += y - x
            left = b"".join([*parts, t[at:]])
            removed.append(gone)
            shas.append(hashlib.sha256(left).hexdigest())
            if texts:
                kept.append(left)
            doc_begin += len(t)
        cols = [pa.array(c.ids, pa.int64(), mask=c.null), pa.array([len(t) for t in c.texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans.astype(np.int64)), pa.array(shas, pa.string())]
        return [pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * texts, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)]

    return resume(job.chunks, both, remove, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


#: Bytes are pairs of hexadecimal digits; positions are cut from blocks of 512, since cutting a long text counts from its start.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT r, x[2 * b + 1:2 * (b + 512 + {LENGTH} - 1)] AS y, b, len(x) // 2 AS n FROM (SELECT r, x, unnest(range(0, greatest(len(x) // 2 - {LENGTH} + 1, 0), 512)) AS b FROM d)),
s AS (SELECT r, b + j AS i, substring(y, 2 * j + 1, {2 * LENGTH}) AS g FROM (SELECT r, b, y, unnest(range(0, len(y) // 2 - {LENGTH} + 1)) AS j FROM p)),
hit AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
edge AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{LENGTH} - 1) > {LENGTH} AS new FROM hit),
run AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM edge),
span AS (SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS b FROM run GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t, b FROM span),
cutout AS (SELECT r, count(*)::BIGINT AS n_spans, sum(b - t)::BIGINT AS n_removed, string_agg(x[2 * f + 1:2 * t], '' ORDER BY t) || any_value(x)[2 * max(b) + 1:] AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN cutout USING (r)
"""
