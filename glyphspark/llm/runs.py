r"""Runs of words: stretches that repeat a period, by Lyndon arrays in linear time.

After J. Ellert and J. Fischer, "Linear Time Runs over General Ordered
Alphabets" (2021). Every run has a root that is a Lyndon word, by the order of
words or by its reverse, and that root is the longest Lyndon word at its place:
it ends where the next smaller suffix begins. So the next smaller suffix of
each place, with how far the two suffixes agree, tells all runs.

Suffixes are compared from left to right against a stack of previous smaller
ones. How far two agree is found without reading a word of a matched stretch
again:

* when a suffix was popped, the agreement with the one below it is the smaller
  of two that are known, unless these are alike;
* inside a stretch that was matched with an earlier one, it is what was found
  at the earlier place, unless it reaches the stretch's end, and reading goes on
  there.

Words are only ever compared, as places in their sorted alphabet; there are no
suffix arrays or trees, and no hashes. Each text is a row of its own: Spark
spreads texts over tasks and no row depends on another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import let, words

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has so many words and so many times its period at least.
LEAST, TIMES = 6, 4
Run = tuple[int, int, int]


def ranks(items: list[str]) -> np.ndarray:
    """The place of each item in the sorted alphabet of all."""
    a = np.array(items, dtype=object)
    order = np.argsort(a, kind="stable")
    s = a[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.append(0, s[1:] != s[:-1])) if len(a) else 0
    return out


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place of w but the last, the next smaller suffix and how many words it shares with it.

    The last of w must be smaller than all others.
    """
    n = len(w) - 1
    nxt, shared = [n] * n, [0] * n
    prev, held = [-1] * n, [0] * n  # the previous smaller suffix, and how far it agrees
    lo = hi = end = 0  # w[hi:end] is w[lo:lo + end - hi], and w[end] differs
    for i in range(1, n):
        a, j, popped, m = w[i], i - 1, -1, 0
        while j >= 0:
            b = w[j]
            if b > a:
                nxt[j], popped, m = i, j, 0
                j = prev[j]
                continue
            if b < a:
                break
            if popped >= 0 and held[popped] != m:
                k = min(held[popped], m)
            else:
                k, known, left = m or 1, False, end - i
                if k < left and i > hi:
                    s = i - hi + lo
                    t = j - hi + lo if j >= hi else j
                    q = held[s] if prev[s] == t else shared[t] if nxt[t] == s else -1
                    if 0 <= q < left:
                        k, known = q, True
                    elif q >= left:
                        k, known = left, j < hi and q > left
                if not known:
                    while w[i + k] == w[j + k]:
                        k += 1
                if i + k >= end:
                    lo, hi, end = j, i, i + k
            if w[j + k] < w[i + k]:
                held[i] = k
                break
            nxt[j], shared[j], popped, m = i, k, j, k
            j = prev[j]
        prev[i] = j
    return nxt, shared


def runs_of(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The (start, length, period) of all runs of an array of whole numbers, by start and period; ``times`` is 2 or more.

    A run is told by the first of its Lyndon roots, which begins within its
    first period, so looking back from there for its start takes less than a period.
    """
    n, out = len(w), []
    for order in (1, -1):
        v = (w * order).tolist()
        v.append(-(1 << 62))
        nxt, shared = (np.array(x, np.int64) for x in next_smaller(v))
        period = nxt - np.arange(n)
        for i in np.flatnonzero((shared > (times - 2) * period) & (nxt < n)).tolist():
            p, right = int(period[i]), int(shared[i])
            if i >= p and nxt[i - p] == i and shared[i - p] >= p:
                continue
            left = 0
            while left < i and v[i - left - 1] == v[i - left - 1 + p]:
                left += 1
            length = left + p + right
            # a run up to the end is told by the first order: there the end is smaller than any word
            if length >= max(least, times * p) and (order == 1 or i - left + length < n):
                out.append((i - left, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: of each run, its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def longest(runs: list[Run]) -> Run | None:
    """The longest run; of such the first, and of those the one of least period."""
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, details: bool = True) -> DataFrame:
    """The runs of words of every text, and the text with each run cut to its first period.

    Returns the id, n_runs, the longest run's start, length, period and
    exponent_milli (four nulls if there is none), the digests runs_sha256 and
    collapsed_sha256, and with details=True runs, an array of structs by start
    and period, and collapsed, the words kept, joined by spaces. A null or
    empty text has no words and no runs, and the digests of nothing. Each row
    gives one row, whatever its id; an empty table gives none; other columns of
    df are not read. Time grows in proportion to the words, plus the sorting of
    a text's words; memory is bounded by 2 MB of texts or the longest text.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(text: str) -> tuple:
        items = _WORD.findall(text)
        runs = runs_of(ranks(items), least, times)
        told = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        kept = " ".join(compress(items, collapsed(len(items), runs).tolist()) if runs else items)
        best = longest(runs)
        exponent = None if best is None else 1000 * best[1] // best[2]
        return len(runs), *(best or (None,) * 3), exponent, told, hashlib.sha256(kept.encode()).hexdigest(), runs, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole)):
            rows = [one(t or "") for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], *[pa.array([r[k] for r in rows], pa.string()) for k in (5, 6)]]
            if details:
                cols += [pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r[7]] for r in rows], pa.list_(span)), pa.array([r[8] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["runs", "collapsed"] * details
    schema = f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * details
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def planted(id_: Column, text: Column) -> Column:
    """Texts with repeats to find: of every tenth id's text, by the crc32 of the id, the words from a place on repeat what stands there. A null id's text stays."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)

        def from_place(a: Column) -> Column:
            p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
            part = let(F.slice(w, a + 1, p), lambda r: F.flatten(F.array_repeat(r, F.ceil((n - a) / p).cast("int"))))
            return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(part, F.lit(1), n - a)), " ")

        return F.when(n == 0, "").otherwise(let((g % F.greatest(n, F.lit(1))).cast("int"), from_place))

    return F.when(h % 10 == 0, let(words(text), repeat)).otherwise(text)
