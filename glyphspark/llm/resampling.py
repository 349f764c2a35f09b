r"""Importance resampling of documents towards a target distribution.

Features are runs of one to three words, hashed into buckets. Each task counts
the buckets of its texts in one array; the sums over documents and over the
target give each bucket a gain, the logarithm of how much likelier the target
is to have it. Gains are one array of ``BUCKETS`` whole numbers, which tasks
score whole texts with. With Gumbel noise from the id added, taking the
highest scores draws documents without replacement, by weight.

Scores are whole numbers, so the draw is exact without sorting documents: a
histogram of scores, summed from its upper end in three levels of digits, tells
how many rows score more; it tells the score at which the draw ends, and the rank at
which each surviving score begins. Only rows of one score are then numbered, by
their id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RUN, materialize

#: Lower-cased words: letters of a to z, digits, and all characters beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
#: Words of a text that are hashed at once.
PIECE = 1 << 16
#: The draw: so many of a hundred documents that have so many words at least.
SHARE, LEAST_WORDS = 5, 20
#: Bits of a score's two lower digits.
DIGIT = 12


def buckets(text: str | None, n: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text: its words, and the buckets of the features that end in it. A feature's crc32 goes on from that of the feature one word shorter."""
    words = (m.group() for m in _WORD.finditer((text or "").encode().lower()))
    before: list[bytes] = []
    while piece := list(islice(words, PIECE)):
        k, w = len(before), before + piece
        spaced = [b" " + x for x in w[1:]]
        one = list(map(crc32, w))
        two = list(map(crc32, spaced, one))
        three = list(map(crc32, spaced[1:], two))
        yield len(piece), np.array(one[k:] + two[max(k - 1, 0) :] + three, np.uint32) % n
        before = w[-2:]


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket over all texts; buckets without any are left out. A task sends one row for each bucket, however many texts it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, b in buckets(text.as_py(), n):
                    total += np.bincount(b, minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down: at most ``n`` rows of each side come to the driver."""
    held = []
    for side in (counts, target):
        a = np.zeros(n, np.int64)
        for r in side.collect():
            a[r["bucket"]] = r["n"]
        held.append(a)
    (s, t), (of_docs, of_target) = held, (int(a.sum()) for a in held)
    return np.array([math.floor(1000 * math.log(float((int(y) + 1) * (of_docs + n)) / float((int(x) + 1) * (of_target + n)))) for x, y in zip(s, t, strict=True)], np.int64)


def noise(id_: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths from an id and the seed alone; a null id's is that of an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def scored(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every text."""
    kind, sent = df.select(id_col).schema[0].dataType.simpleString(), df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n = features = weight = 0
                for k, b in buckets(text.as_py(), len(g)):
                    n, features, weight = n + k, features + len(b), weight + int(g[b].sum())
                rows.append((n, features, weight))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_words", "n_features", "weight"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def with_above(scores: DataFrame) -> DataFrame:
    """(score, n, above) from (score, n): how many rows have a greater score.

    Sums are taken over a score's leading digit, its middle and its last one.
    The leading digit alone is ordered in one task; there are as many as a longest
    text's score has 2**24 in it.
    """
    h = scores.select("score", "n", F.shiftright("score", 2 * DIGIT).alias("hi"), F.shiftright("score", DIGIT).alias("mid"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    mid = h.groupBy("hi", "mid").agg(F.sum("n").alias("n"))
    hi = mid.groupBy("hi").agg(F.sum("n").alias("n")).select("hi", before(Window.orderBy(F.col("hi").desc())).alias("at_hi"))
    mid = mid.select("hi", "mid", before(Window.partitionBy("hi").orderBy(F.col("mid").desc())).alias("at_mid"))
    low = h.withColumn("at_low", before(Window.partitionBy("hi", "mid").orderBy(F.col("score").desc())))
    return low.join(mid, ["hi", "mid"]).join(hi, "hi").select("score", "n", (F.col("at_hi") + F.col("at_mid") + F.col("at_low")).alias("above"))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = 42, n_buckets: int = BUCKETS) -> DataFrame:
    """Draws ``share`` of a hundred documents of ``least_words`` or more, those that the target's features favour more often.

    Returns the id, n_features, weight, score and rank of every row; rank is
    null for rows that aren't drawn. Null and empty texts have no features,
    weight 0, and aren't drawn. Rows of one score are ranked by id, nulls last,
    then by weight; equal rows are ranked one after another. An empty target
    has no features, an empty table gives no rows. Other columns aren't read.
    Texts are read twice, and only narrow rows are shuffled.
    """
    gain = gains(bucket_counts(df, text_col, n_buckets), bucket_counts(target, target_col, n_buckets), n_buckets)
    rows = materialize(scored(df, gain, id_col, text_col, seed), "scored", narrow=True)
    able = F.col("n_words") >= least_words
    scores = materialize(with_above(rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))), "scores", narrow=True)
    drawn = share * (scores.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]) // 100
    survive = scores.filter(F.col("above") < drawn)
    last = survive.agg(F.min("score").alias("s")).collect()[0]["s"]
    out = ["id", "n_features", "weight", "score"]
    if last is None:
        ranked = rows.select(*out, F.lit(None).cast("long").alias("rank"))
    else:
        upper = able & (F.col("score") >= F.lit(last))
        alike = rows.filter(upper).groupBy(*out).agg(F.count(F.lit(1)).alias("n")).join(survive.select("score", "above"), "score")
        turn = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "weight", "n_features").rowsBetween(Window.unboundedPreceding, -1)
        alike = alike.withColumn("at", F.col("above") + F.coalesce(F.sum("n").over(turn), F.lit(0).cast("long")))
        each = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, RUN.bit_length() - 1)))).repartition("id", "run")
        each = each.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("run") * RUN, F.lit(RUN)))))
        rank = F.col("at") + F.col("run") * RUN + F.col("k")
        ranked = each.select(*out, F.when(rank <= drawn, rank).alias("rank")).unionByName(rows.filter(~upper).select(*out, F.lit(None).cast("long").alias("rank")))
    return ranked.withColumnRenamed("id", id_col)


def _sql() -> str:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    byte = "('0x' || substr(x, 2 * i - 1, 2))::BIGINT"
    crc = f"xor(4294967295, list_reduce(list_transform(range(1, (len(x) // 2 + 1)::INT), lambda i: {byte}), lambda a, b: xor(a >> 8, list_extract({table}, (xor(a, b) & 255) + 1)), 4294967295::BIGINT))"
    upper, lower = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))
    grams = " UNION ALL ".join(f"SELECT r, array_to_string(w[i:i + {k}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {k - 1})) AS i FROM {{0}} WHERE len(w) > {k})" for k in range(3))
    counted = "SELECT (c % 10000) AS b, count(*) AS n FROM {0} JOIN crc USING (g) GROUP BY b"
    return rf"""
WITH pat AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), p) AS w FROM documents, pat),
q AS (SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), p) AS w FROM benchmark, pat),
dg AS MATERIALIZED ({grams.format('d')}), qg AS MATERIALIZED ({grams.format('q')}),
hexed AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dg UNION SELECT g FROM qg)),
crc AS MATERIALIZED (SELECT g, {crc} AS c FROM hexed),
s AS ({counted.format('dg')}), t AS ({counted.format('qg')}),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS sn, coalesce((SELECT sum(n) FROM t), 0) AS tn),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sn + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (tn + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b), tot),
wt AS (SELECT r, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM dg JOIN crc USING (g) JOIN gain ON c % 10000 = b GROUP BY r),
sc AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
       coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt USING (r)),
rk AS (SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) END AS place FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE} * (SELECT count(*) FROM sc WHERE n_words >= {LEAST_WORDS}) // 100 THEN place END::BIGINT AS rank FROM rk
"""


SQL = _sql()
