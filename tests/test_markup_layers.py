"""Texts with markup by broadcast tables: against the converter of one text at a time, and against the joins that larger tables take."""

import random

import pytest

from glyphspark.functions import markup
from glyphspark.functions.markup import MarkupConverter
from glyphspark.functions.matcher import Matcher
from glyphspark.operators import joined, pages

BASE = {"国": "國", "x": "<X>", "甲x": "乙乙", "甲": "甲", "aa": "b", "a": "乙"}
RULES = ["-{H|甲=>zh-tw:丙}-", "-{-|zh-tw:國}-", "-{A|zh-cn:国;zh-tw:囯}-", "-{-|zh-cn:甲}-", "-{H|a=>zh-tw:q;x=>zh-tw:zz}-", "-{zh-cn:none;zh-tw:[-{R|-{zh-hk:甲;}-}-/-{国}-];}-", "-{国-{甲", "<code>国</code>", "<pre>国", "}-"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    return [None, "", "-{" * 12 + "甲" + "}-" * 12, *("".join(r.choice([*RULES, "国", "甲x", "aa", "a", "\n", " "]) for _ in range(r.randint(0, 30))) for _ in range(150))]


def frames(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), spark.createDataFrame(list(BASE.items()), "`from` string, `to` string")


def rows(df):
    return [x.t for x in sorted(df.collect(), key=lambda x: x.id)]


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("most", [500_000, 0])
def test_nested_rules_by_arrays_and_by_joins(spark, texts, monkeypatch, capsys, most):
    """Rules in rules, that never end, too deep, and code: broadcast tables take neither a shuffle nor a written table."""
    monkeypatch.setattr(joined, "BROADCAST", most)
    if most:
        monkeypatch.setattr(joined, "written", None)
    df, pairs = frames(spark, texts)
    out = pages.convert(df, "t", pairs, "zh-tw", global_rules=False)
    m = MarkupConverter(Matcher(BASE), "zh-tw", global_rules=False)
    assert rows(out) == [None if t is None else m.convert(t) for t in texts]
    assert ("Join" in plan(out, capsys)) == (most == 0)


def test_short_rules_are_remembered_and_long_ones_are_not():
    markup._remembered.cache_clear()
    long = "zh-tw:" + "x" * markup._SHORT_RULE
    for _ in range(3):
        assert markup.shown_text("zh-tw:a;zh-cn:b", "zh-tw") == "a" and markup.shown_text("zh-tw:a;zh-cn:b", "zh-cn") == "b"
        assert markup.shown_text(long, "zh-tw") == long[6:]
    assert markup._remembered.cache_info().currsize == 2


@pytest.mark.parametrize("most", [500_000, 0])
def test_rules_of_pages_by_arrays_and_by_joins(spark, texts, monkeypatch, capsys, most):
    """Pages of one batch keep their rules to themselves; with broadcast tables these are neither shuffled nor written."""
    monkeypatch.setattr(joined, "BROADCAST", most)
    if most:
        monkeypatch.setattr(joined, "written", None)
    own = [f"-{{H|a=>zh-tw:{i}}}-" + ("-{-|zh-tw:乙;zh-cn:x}-" if i % 3 else "") + "aa a 国x" for i in range(40)]
    df, pairs = frames(spark, [*texts, *own])
    out = pages.convert(df.coalesce(1), "t", pairs, "zh-tw")
    m = MarkupConverter(Matcher(BASE), "zh-tw")
    assert rows(out) == [None if t is None else m.convert(t) for t in [*texts, *own]]
    assert ("Exchange" in plan(pages.convert(spark.createDataFrame([(1, "国")], "id int, t string"), "t", pairs, "zh-tw"), capsys)) == (most == 0)


def test_overlay_of_pages_without_written_tables(spark, texts, monkeypatch):
    """A page's own pair wins over the overlay's, and what it removes the overlay lacks there alone, where the table's pair comes back."""
    monkeypatch.setattr(joined, "written", None)
    over = {"国": "囯", "aa": "A", "國": "丁"}
    own = ["-{-|zh-tw:国}-国aa", "国aa國", "-{H|aa=>zh-tw:B}-国aa", "-{-|aa=>zh-tw:A}-aaa国"]
    df, pairs = frames(spark, [*own, *texts])
    out = rows(pages.convert(df.coalesce(1), "t", pairs, "zh-tw", overlay=spark.createDataFrame(list(over.items()), "`from` string, `to` string")))
    assert out[:4] == ["國A", "囯A丁", "囯B", "b乙囯"]
    m = MarkupConverter(Matcher(BASE), "zh-tw", overlay=over)
    assert out[4:] == [None if t is None else m.convert(t) for t in texts]


def test_extended_markup_of_several_groups_without_written_tables(spark, texts, monkeypatch):
    """Texts of over a group's bytes beside short ones, with code that stays and rules of their own."""
    monkeypatch.setattr(joined, "written", None)
    long = "-{H|a=>zh-tw:q}-" + "国aa<code>国</code>甲x -{国}- " * 20_000
    mixed = [long, *texts[:40], "a国" * 300_000, *texts[40:], long[16:]]
    df, pairs = frames(spark, mixed)
    m = MarkupConverter(Matcher(BASE), "zh-tw")
    assert rows(pages.convert(df.coalesce(1), "t", pairs, "zh-tw")) == [None if t is None else m.convert(t) for t in mixed]


def test_disabled_targets_of_pages_without_written_tables(spark, texts, monkeypatch):
    """A disabled target passes one character on all pages; what a page removes is disabled there alone."""
    monkeypatch.setattr(joined, "written", None)
    own = ["甲xa国", "-{-|zh-tw:國}-甲xa国", "甲xaa国"]
    df, pairs = frames(spark, [*own, *texts])
    out = rows(pages.convert(df.coalesce(1), "t", pairs, "zh-tw", off=["乙乙", "b"]))
    assert out[:3] == ["甲<X>乙國", "甲<X>乙国", "甲<X>a乙國"]
    m = MarkupConverter(Matcher(BASE), "zh-tw", removed={"乙乙", "b"})
    assert out[3:] == [None if t is None else m.convert(t) for t in texts]
