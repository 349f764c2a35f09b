"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from glyphspark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def slow(rows, target):
    """(id, n_features, weight, score, rank) of rows (id, text)."""
    told = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in told for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_t * 0 + all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, f in told:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    drawn = Counter()
    ranks = {}
    for k, x in enumerate(able[: 5 * len(able) // 100], 1):
        ranks.setdefault(x, []).append(k)
    done = []
    for x in out:
        left = ranks.get(x, [])
        done.append((*x[:4], left[drawn[x]] if drawn[x] < len(left) else None))
        drawn[x] += 1
    return done


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_resample_odd_rows(spark, docs, rows, empty):
    """Null, empty, long, tied and repeated rows, and columns of clashing names."""
    target = [rows[20][1], "abc DEF é", None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    want = slow([(i, t) for i, t, *_ in rows], target)
    assert rows_of(resampling.resample(docs, frame)) == sorted(want, key=repr)
    assert resampling.resample(empty, frame).count() == 0
    assert rows_of(resampling.resample(docs, frame.limit(0))) == sorted(slow([(i, t) for i, t, *_ in rows], []), key=repr)


def test_draws_and_ties(spark):
    """Enough rows to draw; ids with several texts, equal rows among those drawn, and a favoured target."""
    r = random.Random(8)
    text = lambda words: " ".join(r.choice(words) for _ in range(r.randint(15, 40)))
    plain, wanted = [f"w{k}" for k in range(60)], [f"t{k}" for k in range(20)]
    rows = [(i, text(plain)) for i in range(400)] + [(1000 + i, text(wanted)) for i in range(15)]
    rows += [rows[-1]] * 8 + [(1003, text(wanted)), (None, text(wanted)), (None, text(wanted))]
    target = [text(wanted) for _ in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")))
    want = slow(rows, target)
    assert got == sorted(want, key=repr)
    ranks = sorted(x[4] for x in got if x[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 15
    assert all(x[0] is None or x[0] >= 1000 for x in got if x[4] is not None and x[4] <= 10)


def test_rows_above(spark):
    """Sums from the upper end over three levels of digits, of negative and far scores."""
    r = random.Random(4)
    scores = {r.randrange(-(10**9), 10**9) // r.choice([1, 10**3, 10**6]): r.randint(1, 5) for _ in range(500)}
    got = {x["score"]: x.above for x in resampling.with_above(spark.createDataFrame(list(scores.items()), "score long, n long")).collect()}
    total, want = 0, {}
    for s in sorted(scores, reverse=True):
        want[s], total = total, total + scores[s]
    assert got == want


def test_pieces_of_a_text(monkeypatch):
    text = " ".join(f"w{k % 37}-é{k % 11}" for k in range(500))
    whole = sorted(b for _, bs in resampling.buckets(text) for b in bs.tolist())
    assert whole == sorted(features(text)[1])
    for piece in (1, 2, 3, 64):
        monkeypatch.setattr(resampling, "PIECE", piece)
        assert sorted(b for _, bs in resampling.buckets(text) for b in bs.tolist()) == whole
    assert [n for n, _ in resampling.buckets(None)] == [] == [n for n, _ in resampling.buckets("-- ")]


@pytest.mark.parametrize("word", ["A", "É", "中x"])
def test_only_ascii_letters_are_lowered(word):
    assert features(word)[1] == [b for _, bs in resampling.buckets(word) for b in bs.tolist()]
