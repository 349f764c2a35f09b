"""Conversion by tables in layers as arrays: against the search of one text at a time, and against the joins that larger tables take."""

import random

import numpy as np
import pyarrow as pa
import pytest

from glyphspark.functions.layers import Layers, Own, Table, table
from glyphspark.functions.matcher import Matcher, _leftmost, convert_layered
from glyphspark.operators import joined
from glyphspark.plans import table_queries


def word(r, a, b):
    return "".join(r.choice("abc国é😀") for _ in range(r.randint(a, b)))


def made(r):
    """Tables of all layers for three scopes, texts, and these texts converted one at a time."""
    base = {word(r, 1, 6): word(r, 0, 3) for _ in range(r.choice([3, 40]))}
    over = {word(r, 1, 4): word(r, 0, 3) for _ in range(r.choice([0, 6]))}
    own = [{word(r, 1, 4): word(r, 0, 3) for _ in range(r.choice([0, 6]))} for _ in range(3)]
    gone = [set(r.sample(sorted(over), min(len(over), 2))) for _ in range(3)]
    off = [set(r.sample(sorted(base.values()), 3)) for _ in range(3)]
    texts = [None, "", *(word(r, 0, 60) for _ in range(40)), word(r, 300, 900)]
    scopes = [r.choice([-1, 0, 1, 2]) for _ in texts]

    def one(t, s):
        if s < 0:
            return convert_layered(Matcher(base), Matcher(over), frozenset(), t)
        return convert_layered(Matcher(base), Matcher({f: x for f, x in over.items() if f not in gone[s]} | own[s]), frozenset(off[s]), t)

    return base, over, own, gone, off, texts, scopes, [None if t is None else one(t, s) for t, s in zip(texts, scopes, strict=True)]


def layers(base, over, own, gone, off):
    rows = [(s, f, t) for s, o in enumerate(own) for f, t in o.items()]
    pairs = Table(*(pa.array([x[k] for x in rows], pa.string()) for k in (1, 2)), scopes=np.array([x[0] for x in rows], np.int64))
    flat = lambda sets: [(s, x) for s, xs in enumerate(sets) for x in xs]
    return Layers(table(base.items()), table(over.items()), Own(pairs, flat(gone), flat(off)))


@pytest.mark.parametrize("keys", [None, 7])
def test_layers_equal_search_of_one_text(monkeypatch, keys):
    """keys: so few hash values that nearly all sources share theirs with others."""
    if keys:
        monkeypatch.setattr(Table, "key", staticmethod(lambda h, scopes: h & np.uint64(keys)))
    r = random.Random(2)
    for _ in range(12):
        *tables, texts, scopes, want = made(r)
        assert layers(*tables).convert_array(pa.array(texts), np.array(scopes)).to_pylist() == want


def test_leftmost_follows_chains_of_any_length():
    r = random.Random(4)
    for count in (1, 5, 300):
        at, stop, want, end = [], [], [], 0
        for _ in range(count):
            start = end + r.randint(0, 2)
            for p in range(start, start + r.choice([1, 2, 400])):
                at.append(p)
                stop.append(p + r.randint(1, 6))
            end = max(stop)
        last = 0
        for a, b in zip(at, stop, strict=True):
            want.append(a >= last)
            last = b if a >= last else last
        keep = _leftmost(np.array(at), np.array(stop))
        assert (np.ones(len(at), bool) if keep is None else keep).tolist() == want


@pytest.mark.parametrize("most", [500_000, 0])
def test_convert_by_arrays_and_by_joins(spark, monkeypatch, capsys, most):
    """Small tables move no text; larger ones go by joins, to the same results, with overlays and what scopes lack of them."""
    monkeypatch.setattr(joined, "BROADCAST", most)
    r = random.Random(6)
    base, over, own, gone, off, texts, scopes, want = made(r)
    name = lambda s: None if s < 0 else f"s{s}"
    df = spark.createDataFrame([(i, t, name(s)) for i, (t, s) in enumerate(zip(texts, scopes, strict=True))], "id int, text string, scope string")
    pairs = lambda d: spark.createDataFrame(list(d.items()), "`from` string, `to` string")
    mine = spark.createDataFrame([(f"s{s}", f, t) for s, o in enumerate(own) for f, t in o.items()], "scope string, `from` string, `to` string")
    disabled = spark.createDataFrame([(f"s{s}", sorted(x)) for s, x in enumerate(off)], "scope string, targets array<string>")
    lack = spark.createDataFrame([(f"s{s}", f) for s, x in enumerate(gone) for f in x], "scope string, `from` string")
    out = joined.convert(df, "text", pairs(base), mine, "scope", disabled, pairs(over) if over else None, lack)
    assert [x.text for x in sorted(out.collect(), key=lambda x: x.id)] == want
    out.explain()
    assert ("Exchange" in capsys.readouterr().out) == (most == 0)


def test_word_dictionary_reads_texts_once(spark, capsys):
    docs = spark.createDataFrame([("abcdef abc, abcdef.\nabcdefg ab", 1), (None, 2)], "text string, id int")
    pairs = table_queries.word_pairs(table_queries.words_of(docs))
    assert sorted(map(tuple, pairs.collect())) == [("abc", "cba3"), ("abcd", "dcba4"), ("abcdef", "fedcba6")]
    capsys.readouterr()
    pairs.explain()
    assert "Generate" not in capsys.readouterr().out
