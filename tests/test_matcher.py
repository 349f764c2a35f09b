import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from glyphspark.functions import matcher
from glyphspark.functions.matcher import Matcher, PassingMatcher, convert_layered


def naive(text, pairs):
    out, spans, at = [], [], 0
    longest = max(map(len, pairs), default=0)
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if text[at : at + n] in pairs:
                spans.append((at, at + n, pairs[text[at : at + n]]))
                out.append(pairs[text[at : at + n]])
                at += n
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out), spans


def cases(seed, n, alphabet="abc😀"):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(r.randint(1, k)))
    for _ in range(n):
        yield {word(5): word(3) for _ in range(r.randint(0, 8))}, {word(5): word(3) for _ in range(r.randint(0, 4))}, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))


def test_leftmost_longest():
    for pairs, _, text in cases(1, 3000):
        m = Matcher(pairs)
        want, spans = naive(text, pairs)
        assert m.convert(text) == want
        assert list(m.spans(text)) == spans
        assert m.replaced(text) == sum(e - s for s, e, t in spans if text[s:e] != t)


def test_overlay_equals_one_merged_dictionary():
    for base, over, text in cases(2, 3000):
        if base:
            want = naive(text, {**base, **over})[0]
            assert convert_layered(Matcher(base), Matcher(over), frozenset(), text) == want
            assert Matcher(base).merged(Matcher(over)).convert(text) == want


def test_removed_targets():
    base = Matcher({"abcd": "foo", "abc": "bar", "x": "y"})
    assert convert_layered(base, Matcher({}), frozenset({"foo"}), "abcdx") == "abcdy"
    assert convert_layered(base, Matcher({"bc": "Z"}), frozenset({"foo"}), "abcdx") == "aZdy"
    # an overlay's own targets are never disabled, and an empty base converts nothing
    assert convert_layered(base, Matcher({"abcd": "foo"}), frozenset({"foo"}), "abcd") == "foo"
    assert convert_layered(Matcher({}), Matcher({"a": "b"}), frozenset(), "a") == "a"


@pytest.mark.parametrize("text", ["", "中", "no source here"])
def test_identity(text):
    assert Matcher({}).convert(text) == text
    assert Matcher({"龘": "x"}).convert(text) == text


def test_no_op_pairs_protect():
    m = Matcher({"后": "後", "皇后": "皇后"})
    assert m.convert("皇后后") == "皇后後"
    assert m.replaced("皇后后") == 1


def test_long_texts_and_targets_of_other_lengths():
    for seed in (5, 6):
        for pairs, _, text in cases(seed, 300):
            pairs = pairs | {"a": "", "b": "bbb"} if seed == 6 else pairs
            m = Matcher(pairs)
            text = text * 9
            want, spans = naive(text, pairs)
            assert m.convert(text) == want and list(m.spans(text)) == spans
            assert m.replaced(text) == sum(e - s for s, e, t in spans if text[s:e] != t)


def test_arrays_equal_single_texts(monkeypatch):
    """Groups of rows against one text at a time, nulls, empty texts and slices included."""
    r = random.Random(5)
    for k in range(300):
        letters = "ab国學x😀é" if k % 2 else "ab"
        some = lambda s, n: "".join(r.choice(s) for _ in range(n))  # noqa: E731, B023
        m = Matcher({some(letters, r.randint(1, 4)): some(letters + "Z", r.randint(0, 4)) for _ in range(r.randint(0, 12))})
        texts = [None if r.random() < 0.1 else some(letters, r.randint(0, 60)) for _ in range(r.randint(2, 12))]
        monkeypatch.setattr(matcher, "GROUP", r.choice([1, 50, 1 << 19]))
        a, texts = pa.array(texts, pa.string()).slice(k % 2), texts[k % 2 :]
        assert m.convert_array(a).to_pylist() == [None if t is None else m.convert(t) for t in texts]
        assert m.replaced_array(a).tolist() == [0 if t is None else m.replaced(t) for t in texts]
        spans = m.spans_array(a).to_pylist()
        assert [None if x is None else [(y["start"], y["end"], y["dst"]) for y in x] for x in spans] == [None if t is None else list(m.spans(t)) for t in texts]


def test_hashes_that_collide(monkeypatch):
    """Texts with the hash of a source are looked at again."""
    m = Matcher({"ab": "x", "cd": "yy"})
    monkeypatch.setattr(matcher._Flat, "equal", lambda self, which, codes, at: np.zeros(len(which), bool))
    assert m.convert_array(pa.array(["abcd", "zab", ""])).to_pylist() == ["xyy", "zx", ""]


def test_passing_equals_layered():
    """Disabled targets of several characters, of phrases and single characters, shadowed or not, one text at a time and in batches."""
    r = random.Random(11)
    word = lambda a, b: "".join(r.choice("abc国é😀") for _ in range(r.randint(a, b)))
    for _ in range(60):
        base, over = Matcher({word(1, 5): word(0, 3) for _ in range(30)}), Matcher({word(1, 4): word(0, 3) for _ in range(r.choice([0, 8]))})
        off = frozenset(r.sample(sorted(set(base.pairs.values())), 5))
        texts = [word(0, 120) for _ in range(20)] + ["", None]
        want = [None if t is None else convert_layered(base, over, off, t) for t in texts]
        m = pickle.loads(pickle.dumps(PassingMatcher(base, over, off)))
        assert [None if t is None else m.convert(t) for t in texts] == want
        assert m.convert_array(pa.array(texts, pa.string())).to_pylist() == want
    assert PassingMatcher(Matcher({"abcd": "foo", "abc": "bar", "bc": "x"}), Matcher({}), frozenset(["foo"])).convert("abcd abc") == "axd bar"
