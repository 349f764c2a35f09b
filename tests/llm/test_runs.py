"""Runs of words against brute force, and the work that finding them takes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspark.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    out = []
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, times * p) and not any(all(w[x] == w[x + q] for x in range(i, i + n - q)) for q in range(1, p)):
                out.append((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(i, w):
    """The words of the query's planted text."""
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def expected(i, w):
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *head, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least, times", [(2, 2), (6, 4), (1, 3)])
def test_runs_equal_brute_force(least, times):
    r = random.Random(1)
    for _ in range(700):
        n = r.randint(0, 60)
        w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(n)]
        if n > 5 and r.random() < 0.5:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert runs.runs_of(np.array(w, np.int64), least, times) == brute(w, least, times), w


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return list.__getitem__(self, i)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(n):
    s, c = [0], 1
    while len(s) < n:
        s, c = s * 4 + [c], c + 1
    return s[:n]


@pytest.mark.parametrize("make", [fibonacci, nested, lambda n: [0] * n, lambda n: [i % 2 for i in range(n)], lambda n: [i % (n // 5) for i in range(n)], lambda n: random.Random(2).choices(range(3), k=n // 7) * 8])
def test_words_read_are_linear(make):
    for order in (1, -1):
        per = []
        for n in (1000, 16_000):
            w = Counted([x * order for x in make(n)] + [-(10**9)])
            Counted.reads = 0
            runs.next_smaller(w)
            per.append(Counted.reads / len(w))
        assert per[1] < 10 and per[1] < 1.1 * per[0] + 0.1


def test_find_runs(docs, rows, empty):
    """Null, empty, long, tied and repeated rows, and columns of clashing names."""
    short = [r for r in rows if len(WORD.findall(r[1] or "")) < 500]
    want = sorted((expected(i, WORD.findall(t or "")) for i, t, *_ in short), key=repr)
    got = [r for r in rows_of(runs.find_runs(docs)) if r in want or r[0] not in (6, 7)]
    assert got == want
    assert runs.find_runs(empty).count() == 0
    xy = [r for r in runs.find_runs(docs).filter("doc_id = 6").collect()][0]
    assert (xy.n_runs, xy.start, xy.length, xy.period, xy.exponent_milli, xy.collapsed) == (1, 0, 6000, 2, 3_000_000, "x y")
    assert [tuple(x) for x in xy.runs] == [(0, 6000, 2)]


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["a", "bb", "é", "\n"]) + str(r.randrange(30)) for _ in range(r.randint(0, 120)))) for i in range(150)] + [(150, None), (151, ""), (3, "a b " * 40), (None, "c d " * 20), (152, "a b a b a b a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [expected(i, WORD.findall(t or "") if i is None else repeated(i, WORD.findall(t or ""))) for i, t in rows]
    assert sum(x[1] > 0 for x in want) > 10
    assert rows_of(queries.op12_runs(spark, str(tmp_path))) == sorted(want, key=repr)


def test_planted_texts(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)], "i long, t string")
    for r in df.select("i", "t", runs.planted(F.col("i"), F.col("t")).alias("p")).collect():
        assert WORD.findall(r.p) == repeated(r.i, WORD.findall(r.t))
