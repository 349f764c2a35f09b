"""Token counts with the tokenizers library.

A text longer than a chunk is encoded in overlapping chunks with offsets, and
neighbouring chunks are spliced at a boundary which both have and which is
proven stable: the pattern that splits text looks ahead by a few characters at
most and never behind, so where both encodings of an overlap start a word at
the same place, away from the left chunk's end, all that follows is equal. If
there is no such place, the overlap is widened, up to the whole left chunk,
which is then encoded together with what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

MODEL = "byte_bpe_50k.json"
#: Characters of a chunk, of the first overlap, and that a left chunk may see wrongly at its end; chunks that are encoded at once.
CHUNK, OVERLAP, MARGIN, GROUP = 4096, 128, 32, 64


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def spans(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Overlapping chunks of a text of n characters; one if it is no longer than a chunk, none if it is empty."""
    last = max(1, -(-(n - overlap) // (chunk - overlap)))
    return [(k * (chunk - overlap), min(n, k * (chunk - overlap) + chunk)) for k in range(last)] if n else []


def encoded(tok, texts: list[str], chunk: int, overlap: int) -> Iterator:
    """The encodings of all chunks of all texts, in order, a group at a time."""
    held: list[str] = []
    for t in texts:
        for a, b in spans(len(t), chunk, overlap):
            held.append(t[a:b])
            if len(held) == GROUP:
                yield from tok.encode_batch(held, add_special_tokens=False)
                held = []
    if held:
        yield from tok.encode_batch(held, add_special_tokens=False)


def _word_start(enc, place: int) -> tuple[int, int] | None:
    """Of the word at a place: the place of its first character, and the tokens before it."""
    token = enc.char_to_token(place)
    word = None if token is None else enc.token_to_word(token)
    if word is None:
        return None
    first = enc.word_to_tokens(word)[0]
    return enc.token_to_chars(first)[0], first


def common_boundary(left, begin: int, right, at: int, end: int, skip: int) -> tuple[int, int] | None:
    """The tokens before the last place at which both chunks, read from begin and from at, start a word; null if there is none between at and end."""
    place = end - MARGIN
    while place > at:
        hit = _word_start(left, place - begin)
        if hit is None:
            place -= 1
            continue
        place, n = begin + hit[0], hit[1]
        if place <= at or n < skip:
            return None
        if _word_start(right, place - at) == (place - at, m := right.char_to_token(place - at)):
            return n, m
        place -= 1
    return None


def count_text(tok, text: str, ready: Iterator, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text from its chunks, whose encodings ``ready`` gives in order."""
    plan = spans(len(text), chunk, overlap)
    if not plan:
        return 0
    one = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    (begin, end), left = plan[0], next(ready)
    total, skip, k = 0, 0, 1  # tokens of what is spliced; the left chunk's tokens that are among them
    while k < len(plan):
        (at, more), right = plan[k], next(ready)
        hit = common_boundary(left, begin, right, at, end, skip)
        while hit is None and at > begin:
            at = max(begin, end - 4 * (end - at))
            if at > begin:
                right = one(at, more)
                hit = common_boundary(left, begin, right, at, end, skip)
        if hit:
            total, begin, left, skip = total + hit[0] - skip, at, right, hit[1]
        else:  # no boundary in the whole left chunk: take in as much again, so that the work stays in proportion
            for _ in range(min(len(plan) - 1 - k, (end - begin) // chunk)):
                next(ready)
                k += 1
            more = plan[k][1]
            left = one(begin, more)
        end, k = more, k + 1
    return total + len(left) - skip


def counts(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    ready = encoded(tok, texts, chunk, overlap)
    return [count_text(tok, t, ready, chunk, overlap) for t in texts]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = 512) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of every text.

    A null or empty text has no bytes and no tokens. Each row gives one row,
    whatever its id; an empty table gives none; other columns of df are not
    read. Memory is bounded by the rows of an Arrow batch and by GROUP chunks,
    but for a text without any word boundary, which is encoded whole.
    """
    path = tokenizer_path(model)
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts(tok, [t or "" for t in b.column(1).to_pylist()]), pa.int64()), b.column(2)], names=[id_col, "n_tokens", "n_bytes"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.select(F.col(id_col), text, F.octet_length(text).cast("long")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_bytes long")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
