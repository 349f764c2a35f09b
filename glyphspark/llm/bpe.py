"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a text that are encoded at once; bytes of texts whose tokens are held at once, one text at least.
PIECE, HELD = 1 << 16, 1 << 21
SAFE = re.compile(r"(?<=[0-9A-Za-z]) ")


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Cuts a long text before spaces that follow an ASCII letter or digit.

    No match of the pattern holds a letter or digit followed by white space,
    and what it matches before or after such a place does not depend on the
    other side, so the matches of the pieces are those of the whole. Where
    there is no such place for a while, a piece gets longer.
    """
    at = 0
    while len(text) - at > piece:
        cut = SAFE.search(text, at + piece)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about HELD bytes of its second column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, ids: bool = True) -> DataFrame:
    """Token ids, decoded bytes and digests of every text.

    Returns the id, n_tokens, tokens (array of int) and decoded (binary, equal
    to the text's UTF-8), with their digests; with ids=False only the digests.
    A null or empty text has no tokens and the digests of nothing. Each input
    row gives one row, an empty table none; other columns of df are not read.
    Memory is bounded by an Arrow batch and the tokens of HELD bytes, or of the
    longest text.
    """
    path = tokenizer_path(ranks)
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        names = [str(i).encode() for i in range(enc.n_vocab)]
        for batch in (part for whole in batches for part in in_parts(whole)):
            counts, shas, backs, lists, raws = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                n, got, back, all_ids, raw = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for part in safe_pieces(text or ""):
                    t = enc.encode_ordinary(part)
                    if t:
                        got.update((b"," if n else b"") + b",".join([names[i] for i in t]))
                        decoded = enc.decode_bytes(t)
                        back.update(decoded)
                        n += len(t)
                        if ids:
                            all_ids += t
                            raw.append(decoded)
                counts.append(n)
                shas.append(got.hexdigest())
                backs.append(back.hexdigest())
                lists.append(all_ids)
                raws.append(b"".join(raw))
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            names_out = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(raws, pa.binary())]
                names_out += ["tokens", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names_out)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>, decoded binary" * ids
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
