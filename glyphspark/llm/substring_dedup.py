"""Removal of passages that earlier documents have, with a count-min prefilter.

Pass 1: each chunk of documents counts its windows of 50 words in a count-min
sketch, kept sparse and cut into shards; shards add the parts up and tell each
chunk which of its windows are estimated to repeat. The estimate is never below
the count, so no repeated window is lost. Pass 2 groups exactly those windows,
by a 96-bit hash of their words, and finds the least document of each. Pass 3
removes what windows of earlier documents cover.

Two rows of 4 cells for each window let about 5 % of the others through; the
sketch grows with the corpus, and the part of a task doesn't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import Chunk, answer, estimated_repeated, merge_cells, message_schema, pack, resume, say_cells, sizes, squeeze, tell, text_bytes, unsqueeze
from .common import materialize

WINDOW = 50
ROWS, CELLS = 2, 4
#: Bytes of a text for each word, about.
WORD_BYTES = 6
#: Bytes of a chunk that are hashed at once, about; words of more than LONG bytes are hashed alone.
BLOCK, LONG = 1 << 17, 256
NO_ID = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


_IN_WORD = np.array([b not in b" \t\n\v\f\r" for b in range(256)])


@lru_cache(maxsize=1)
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers that it is weighed with by its place in a word."""
    import xxhash

    values = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
    return values, np.multiply.accumulate(np.full(LONG, _M1, np.uint64))


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts, one after the other in data, that end at these places; and each text's number of words."""
    import xxhash

    raw = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate([np.zeros(1, np.int64), ends])
    at = begins[begins < len(raw)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= start
    n_words = np.diff(np.searchsorted(start, begins))
    values, powers = _byte_values()
    out = np.zeros(len(start), np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(raw) + BLOCK, BLOCK))
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            n = np.minimum(size[i:j], LONG)
            head = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(head, n)
            out[i:j] = np.add.reduceat(values[raw[np.repeat(start[i:j], n) + place]] * powers[place], head)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    out = (out ^ (out >> np.uint64(32))) * _M2
    return out ^ (out >> np.uint64(29)), n_words


@lru_cache(maxsize=8)
def _powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, m, np.uint64)
    p[0] = 1
    q = np.full(n, pow(m, -1, 1 << 64), np.uint64)
    q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def rolling(values: np.ndarray, window: int, m: np.uint64) -> np.ndarray:
    """A polynomial hash, mod 2**64, of each run of ``window`` values."""
    n = len(values)
    size = 1 << max(16, n.bit_length())
    up, down = _powers(int(m), size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
    return (sums[window:] - sums[:-window]) * down[: n - window + 1]


class Windows:
    """The windows of a chunk: two hashes of each, its document, and its first word's place."""

    def __init__(self, chunk: Chunk, window: int):
        every, self.n_words = word_hashes(chunk.data, chunk.ends)
        begin = np.cumsum(self.n_words) - self.n_words
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        if len(every) < window:
            self.at, self.doc, self.h1, self.h2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        else:
            n = len(every) - window + 1
            inside = doc[:n] == doc[window - 1 :]
            self.at = np.flatnonzero(inside)
            self.doc = doc[self.at]
            mixed = (every ^ (every >> np.uint64(31))) * _M2
            self.h1 = rolling(every, window, _M1)[self.at]
            self.h2 = (rolling(mixed ^ (mixed >> np.uint64(28)), window, _M2)[self.at] >> np.uint64(32)).astype(np.uint32)
        self.begin = begin


def _first(sorted_by: list[np.ndarray]) -> np.ndarray:
    """Where a new value begins in arrays sorted together."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for a in sorted_by:
        new[1:] |= a[1:] != a[:-1]
    return new


class Asked:
    """The distinct windows that a chunk asks about: those estimated repeated, with the least id of each."""

    def __init__(self, chunk: Chunk, got: list[dict], window: int, bits: int, shards: int):
        self.w = Windows(chunk, window)
        maybe = np.flatnonzero(estimated_repeated(self.w.h1, got, ROWS, bits, shards))
        ids = np.where(chunk.null, NO_ID, chunk.ids)[self.w.doc[maybe]]
        order = np.lexsort((ids, self.w.h2[maybe], self.w.h1[maybe]))
        self.windows, ids = maybe[order], ids[order]
        h1, h2 = self.w.h1[self.windows], self.w.h2[self.windows]
        new = _first([h1, h2])
        self.group = np.cumsum(new) - 1
        self.h1, self.h2, self.least = h1[new], h2[new], ids[new]
        self.ids = ids


def least_documents(rows: list[dict]) -> list[bytes]:
    """For each message (h1, h2, least id): how far below a chunk's least id the corpus's is, as one array."""
    parts = [(np.frombuffer(r["p0"], np.uint64), np.frombuffer(r["p1"], np.uint32), np.frombuffer(unsqueeze(r["p2"]), np.int64)) for r in rows]
    h1, h2, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, h2, h1))
    new = _first([h1[order], h2[order]])
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    less, at, out = (ids.view(np.uint64) - least.view(np.uint64)), 0, []
    for p in parts:
        out.append(squeeze(less[at : at + len(p[0])].tobytes()))
        at += len(p[0])
    return out


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int | None = None, texts: bool = True) -> DataFrame:
    """The words of each row less those covered by a window that starts in a document of smaller id.

    Returns the id, n_words, n_removed, kept_sha256 and, with texts=True, kept
    (the words left, joined by a space). Null, empty and short texts lose
    nothing. Rows of equal id don't take from each other; a row with a null id
    counts as the greatest and loses to every other. Ids are whole numbers.
    Without texts the rows are narrow and are rebalanced, so that they are
    written as few files and not as one for each task over texts.
    Each row gives one row, an empty table none; other columns of df are not
    read, which is done twice: for the size of the texts and for the texts.
    """
    size = text_bytes(df, text_col)
    keys = max(1, size // WORD_BYTES)
    fit, shards = sizes(size, WORD_BYTES)
    chunks = pack(df, id_col, text_col, chunk or fit)
    bits = max((keys * CELLS - 1).bit_length(), shards.bit_length() + 2)
    width = bits - (shards.bit_length() - 1)

    def sketch(c: Chunk) -> Iterator[tuple[int, list[bytes]]]:
        return say_cells(Windows(c, window).h1, ROWS, bits, shards)

    told = materialize(answer(tell(chunks, sketch, 2), merge_cells(width)), "cells", narrow=True)

    def ask(c: Chunk, got: list[dict]) -> list[pa.RecordBatch]:
        a = Asked(c, got, window, bits, shards)
        shard = (a.h1 >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        rows = [(s, a.h1[i:j].tobytes(), a.h2[i:j].tobytes(), squeeze(a.least[i:j].tobytes())) for s, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        if not rows:
            return []
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([c.number] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]]
        return [pa.RecordBatch.from_arrays(cols, names=["shard", "chunk", "p0", "p1", "p2"])]

    found = answer(resume(chunks, told, ask, message_schema(3)), least_documents)
    both = told.withColumn("kind", F.lit(0).cast("long")).unionByName(found.withColumn("kind", F.lit(1).cast("long")))

    def remove(c: Chunk, got: list[dict]) -> list[pa.RecordBatch]:
        a = Asked(c, [g for g in got if not g["kind"]], window, bits, shards)
        replies = [np.frombuffer(unsqueeze(g["bits"]), np.uint64) for g in got if g["kind"]]
        less = np.concatenate(replies) if replies else np.zeros(0, np.uint64)
        least = (a.least.view(np.uint64) - less).view(np.int64)
        gone = a.w.at[a.windows[least[a.group] < a.ids]]
        total = int(a.w.n_words.sum())
        edge = np.bincount(gone, minlength=total + 1)[: total + 1] - np.bincount(gone + window, minlength=total + 1)[: total + 1]
        covered = np.cumsum(edge)[:total] > 0
        removed, shas, kept = [], [], []
        for t, i, n in zip(c.texts, a.w.begin.tolist(), a.w.n_words.tolist(), strict=True):
            cover = covered[i : i + n]
            removed.append(int(cover.sum()))
            words = t.split()
            left = b" ".join([w for w, x in zip(words, cover.tolist(), strict=True) if not x] if removed[-1] else words)
            shas.append(hashlib.sha256(left).hexdigest())
            if texts:
                kept.append(left.decode())
        cols = [pa.array(c.ids, pa.int64(), mask=c.null), pa.array(a.w.n_words), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
        return [pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * texts, names=[id_col, "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)]

    out = resume(chunks, both, remove, f"{id_col} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return out if texts else out.hint("rebalance")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g FROM d WHERE len(w) >= {WINDOW}),
hit AS (SELECT r, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < coalesce(doc_id, {NO_ID})),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM hit),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
left_over AS (SELECT r, count(gone.p)::BIGINT AS n, string_agg(x, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS t FROM word LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (r)
"""
