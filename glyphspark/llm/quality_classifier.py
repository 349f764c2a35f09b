r"""Quality of documents by histogram gradient-boosted trees over statistics of their texts.

Every text becomes a row of statistics: shares of kinds of bytes, lengths and
repeats of words and lines. Trees are fitted on the driver in numpy from at
most ``ROWS`` labelled rows: statistics are cut into at most ``BINS`` bins,
and splits are found on histograms of gradients. The fitted trees lie flat in
arrays, which walk all rows of a batch at once, a level at a time. Scoring is a
projection: no shuffle, and no row depends on another. Only the text is an
input of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_parts

#: Labelled rows that a fit takes at most, bins of a statistic, and words of a window whose repeats are counted.
ROWS, BINS, WINDOW = 20_000, 64, 4
#: A row counts as good from this score on. One in FOLDS of the ids is held out of the fit.
THRESHOLD, FOLDS = 0.3, 5
#: Kinds of bytes: each has its share as a statistic.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\v\f\r",
    "line": b"\n",
    "end": b".,;:?",
    "shout": b"!",
    "symbol": b"#*$%&|<>^~=+_\\/@`",
    "bracket": b"()[]{}\"'-",
    "wide": bytes(range(128, 256)),
    "control": bytes([*range(9), *range(14, 32), 127]),
}
NAMES = [*KINDS, "n_bytes", "n_words", "word_mean", "word_spread", "word_longest", "distinct", "commonest", "repeated", "n_lines", "line_words", "line_repeats", "line_ends", "entropy", "capitals", "symbol_words"]
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(KINDS.values()):
    _KIND[list(_bytes)] = _k
_MARKS = frozenset("#*$%&|<>!")


def _repeated(words: list[str]) -> float:
    """The share of windows of words that stand in the text more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0.0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.fromiter((number[x] for x in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n] + np.uint64(1)
    _, counts = np.unique(h, return_counts=True)
    return float(counts[counts > 1].sum() / n)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text, in the order of NAMES; all zero for an empty one."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(len(NAMES))
    if not len(raw):
        return out
    by_byte = np.bincount(raw, minlength=256)
    share = np.bincount(_KIND, by_byte, len(KINDS)) / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    common = Counter(words).most_common(1)
    some = by_byte[by_byte > 0] / len(raw)
    out[: len(KINDS)] = share
    out[len(KINDS) :] = [
        np.log1p(len(raw)), np.log1p(len(words)), size.mean(), size.std(), np.log1p(size.max()), len(set(words)) / n, common[0][1] / n if common else 0, _repeated(words), np.log1p(len(lines)), len(words) / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip()[-1] in ".!?:;" for x in lines) / max(len(lines), 1), -(some * np.log2(some)).sum(), share[1] / max(share[0] + share[1], 1e-9), sum(not _MARKS.isdisjoint(x) for x in words) / n,
    ]
    return out


# ---- trees


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees in flat arrays: a leaf leads to itself. ``roots`` has each tree's first node."""

    feature: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, node = np.arange(len(x))[:, None], np.tile(self.roots, (len(x), 1))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.at[node], self.low[node], self.high[node])
        return self.start + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def edges(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The upper ends of a statistic's bins, but for the last."""
    v = np.unique(column)
    if len(v) > bins:
        v = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:], method="lower"))
    return (v[1:] + v[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: float = 1.0, l2: float = 1.0, bins: int = BINS) -> Forest:
    """Trees that add up to the log odds of y. Without rows, or with one class alone, the share of the class (smoothed) is the score of all."""
    total = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    start = float(total[0]) if len(y) else 0.0
    cuts = [edges(x[:, j], bins) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else x.astype(np.int64)
    offset = np.arange(x.shape[1]) * bins
    nodes: list[list] = []  # feature, at, low, high, value
    roots = []

    def split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        """The statistic and the bin to split rows after, from histograms of all statistics at once."""
        flat = (binned[rows] + offset).ravel()
        g, h = (np.bincount(flat, np.repeat(v[rows], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(axis=1) for v in (grad, hess))
        all_g, all_h = g[:, -1:], h[:, -1:]
        gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
        gain[(h < least) | (all_h - h < least)] = 0
        best = int(np.argmax(gain))
        return divmod(best, bins) if gain.flat[best] > 1e-6 else None

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append([0, np.inf, me, me, 0.0])
        found = split(rows, grad, hess) if left else None
        if found is None:
            nodes[me][4] = float(rate * grad[rows].sum() / (hess[rows].sum() + l2))
            total[rows] += nodes[me][4]
            return me
        j, b = found
        low = binned[rows, j] <= b
        nodes[me][:2] = j, float(cuts[j][b])
        nodes[me][2:4] = grow(rows[low], grad, hess, left - 1), grow(rows[~low], grad, hess, left - 1)
        return me

    if 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    cols = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(*(np.array(c, k) for c, k in zip(cols, kinds, strict=True)), np.array(roots, np.int64), depth, start)


# ---- on tables


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    """Whether a row's label may not be learnt from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % folds == 0


def _measured(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns of keep, and each text's statistics as an array."""
    schema = df.select(*keep).schema.simpleString()[7:-1] if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, ", ".join([schema, "x array<double>"]))


def labelled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` rows that may be learnt from, on the driver.

    Labels are sampled by a hash of their id; null labels are left out; an id
    with several texts or labels gives a row for each of them, within the bound.
    """
    told = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    share = most / max(told.count(), 1)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    told = told.filter(place < int(min(share, 1) * (1 << 30))).orderBy(place, "id", "y").limit(most)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(told), "id").withColumn("place", F.xxhash64("id", "text"))
    got = _measured(rows, ["id", "place", "y"], "text").orderBy("place", "id", "y").limit(most).select("y", "x").collect()
    return np.array([r["x"] for r in got]).reshape(len(got), len(NAMES)), np.array([r["y"] for r in got], float)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """A score of every text, from 0 to 1, higher where label 1 is likelier.

    Returns the id, held_out (its label was not learnt from), score and
    predicted (1 from ``threshold`` on). Null and empty texts have statistics
    of zero and a score like any other; equal texts have equal scores; each row
    gives one row, an empty table none. Without labels all scores are 0.5.
    Other columns of df are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(fit(*labelled(df, labels, id_col, text_col, label_col, most)))
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole)):
            x = np.stack([statistics(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x), pa.float64())], names=[id_col, "score"])

    out = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
