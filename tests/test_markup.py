"""Golden vectors of the markup and one test for each of its quirks."""

import os

import pytest

from glyphspark.functions import markup as M
from glyphspark.functions.matcher import Matcher
from glyphspark.plans.queries import MARKUP, SHOWN, seed_pairs
from glyphspark.variants import VARIANTS, enabled, parse

SEED = {t: Matcher(seed_pairs(t)) for t in VARIANTS}


def show(text, target="zh-cn", **options):
    return M.MarkupConverter(SEED[target], target, **options).convert(text)


@pytest.mark.parametrize(("text", "shown"), [(t, s) for (t, _), s in zip(MARKUP, SHOWN, strict=True)])
def test_registered_vectors(text, shown):
    assert show(text, "zh-tw") == shown


@pytest.mark.parametrize(
    ("text", "target", "shown"),
    [
        ("天-{干}-物燥 国", "zh-hant", "天干物燥 國"),
        ("-{zh-tw:鼠麴草;zh-cn:香茅}-是", "zh-cn", "香茅是"),
        ("包括-{zh-tw:鼠麴草;zh-cn:香茅;}-等", "zh-tw", "包括鼠麴草等"),
        ("-{H|zh:馬;zh-cn:鹿;}-馬克", "zh-cn", "鹿克"),
        ("&二極\n-{-|zh-hans:二极; zh-hant:二極}-\n", "zh-tw", "&二極\n\n"),
        ("-{H|zh-cn:雾;zh-tw:霧}-雾", "zh-tw", "霧"),
        ("-{简-{简}", "zh-hant", "-{簡-{簡}"),
        ("-{N|zh-hk}-", "zh-cn", "香港"),
        ("-{D|zh-cn:老挝;zh-hk:寮國}-", "zh-cn", "大陆：老挝；香港：寮國；"),
        ("-{D|a=>zh-cn:b}-", "zh-cn", "a⇒zh-cn: b"),
        ("-{R| 干 }-", "zh-hant", " 干 "),
        ("-{ 干 }-", "zh-hant", "干"),
        ("-{A|zh-cn:甲;zh-tw:乙}-乙", "zh-cn", "甲甲"),
        ("-{H|巨集=>zh-cn:宏}-巨集", "zh-cn", "宏"),
        ("-{巨集=>zh-cn:宏}-", "zh-cn", ""),
        ("-{H|zh-hans:甲;zh-hant:乙}-乙", "zh-hans", "乙"),
        ("-{H|乙=>zh:甲}-乙", "zh", "乙"),
        ("<code>-{H|乙=>zh-cn:甲}-</code>乙", "zh-cn", "<code>-{H|乙=>zh-cn:甲}-</code>甲"),
        ("<pre>\n国\n</pre>", "zh-hant", "<pre>\n國\n</pre>"),
        ("<PRE>国</PRE>", "zh-hant", "<PRE>國</PRE>"),
        ("-{" * 11 + "x" + "}-" * 11, "zh-cn", "x}-"),
        ("-{H|a;b}-", "zh-cn", "H|a;b"),
        ("-{zh-cn:a|b}-", "zh-cn", "zh-cn:a|b"),
        ("-{zh-cn:a&nbsp;b;zh-tw:c}-", "zh-cn", "a&nbsp;b;zh-tw:c"),
        ("-{zh-cn:a&;zh-tw:c}-", "zh-tw", "c"),
        ("-{=>zh-cn:x}-", "zh-cn", "=>zh-cn:x"),
        ("-{zh-cn:a\nb}-", "zh-cn", "a\nb"),
        ("-{H|zh-cn:甲\n;zh-tw:乙}-乙", "zh-cn", "乙"),
        ("-{}-", "zh-cn", ""),
        ("-{T|甲}-", "zh-cn", "T|甲"),
        ("a-{b", "zh-cn", "a-{b"),
        ("}-a-{b}-", "zh-cn", "}-ab"),
    ],
)
def test_vectors(text, target, shown):
    assert show(text, target) == shown


def test_options():
    assert show("<code>国</code>", "zh-tw", skip_code=False) == "<code>國</code>"
    assert show("-{H|zh-cn:甲;zh-tw:乙}-乙", global_rules=False) == "乙"
    assert show("乙", overlay={"乙": "甲"}) == "甲"
    assert show("国", "zh-tw", removed={"國"}) == "国"


def test_rules():
    r = M.parse_rule("H|zh-cn:甲;x=>zh-tw:y")
    assert (r.action, r.output, r.conv.both, r.conv.one_way) == ("add", None, {"zh-cn": "甲"}, [("zh-tw", "x", "y")])
    assert M.parse_rule("-A|zh-cn:甲").action == "add" and M.parse_rule("-A|zh-cn:甲").output is None
    for text, kind in (("Q|a", "InvalidFlag"), ("N|xx", "InvalidVariant"), ("H|zh-cn:a;b", "InvalidConv"), ("T|a", "InvalidConvForTitle")):
        with pytest.raises(M.RuleError) as e:
            M.parse_rule(text)
        assert e.value.kind == kind
    assert M.parse_rule_or_text("Q|a").conv.asis == "Q|a"
    assert M.parse_conv_or_text("zh-cn:a;b").asis == "zh-cn:a;b"
    assert M.parse_conv(" 甲 ").pairs_for("zh-cn") == [("甲", "甲")]
    assert M.parse_conv("ZH-CN :a").both == {"zh-cn": "a"}


def test_pairs_by_target():
    c = M.parse_conv("zh:z;zh-hans:s;zh-tw:;甲=>zh-sg:乙")
    assert c.pairs_for("zh-sg") == [("z", "s"), ("s", "s"), ("甲", "乙")]
    assert c.pairs_for("zh-cn") == [("z", "s"), ("s", "s")]
    assert c.pairs_for("zh-tw") == [("z", ""), ("s", "")]
    assert c.pairs_for("zh-hans") == c.pairs_for("zh-hk")[:0] == []


def test_page_rules():
    p = M.PageRules.of("-{T|zh-cn:甲;zh-tw:乙}- -{T|zh-hk:丙}- -{A|a=>zh-cn:b}- -{-|zh-cn:c}- -{x -{H|zh-cn:d}-")
    assert p.title == {"zh-hk": "丙"} and p.title_for("zh-mo") == "丙" and p.title_for("zh-cn") is None
    assert [a for a, _ in p.actions] == ["add", "remove"]
    assert p.overlay("zh-cn") == ({"a": "b"}, {"c"})


def test_variant_maps_and_lines():
    assert M.parse_variant_map(" zh-cn: a ; zh-TW:b ") == {"zh-cn": "a", "zh-tw": "b"}
    for bad in ("zh-cn:a;b", "xx:a", "a"):
        with pytest.raises(M.RuleError):
            M.parse_variant_map(bad)
    assert M.conv_lines("zh-cn:a;zh-tw:b\r\n\n bad;zh-cn:x; \nc=>zh-cn:d", "zh-cn") == {"a": "a", "b": "a", "c": "d"}


def test_variants():
    assert parse("ZH-Hant").tag == "zh-hant"
    with pytest.raises(ValueError, match="no such"):
        parse("zh_tw")
    assert enabled({"hant", "tw"}) == ["zh", "zh-hant", "zh-tw"]


FULL = os.environ.get("GLYPHSPARK_RULESETS")


@pytest.mark.skipif(not FULL, reason="the full tables are not at hand")
def test_full_tables(spark):
    from pyspark.sql import functions as F

    from glyphspark.functions.columns import Converter

    c = Converter(spark, path=FULL)
    n = {r["table"]: r["n"] for r in c.pairs.groupBy("table").agg(F.count("*").alias("n")).collect()}
    assert n == {"hant": 9776, "hans": 4685, "tw": 971, "hk": 2531, "cn": 2125}
    assert [len(c.matchers[t].pairs) for t in ("zh-cn", "zh-tw", "zh-hk")] == [6803, 10714, 11997]
    for text, target, want in [
        ("天干物燥 小心火烛", "zh-hant", "天乾物燥 小心火燭"), ("鼠曲草", "zh-hant", "鼠麴草"), ("阿拉伯联合酋长国", "zh-hant", "阿拉伯聯合酋長國"), ("阿拉伯联合酋长国", "zh-tw", "阿拉伯聯合大公國"),
        ("驛寄梅花，魚傳尺素", "zh-hans", "驿寄梅花，鱼传尺素"), ("《三劍客》是亞歷山大·仲馬的作品。《孤雛淚》是查爾斯·狄更斯的作品。", "zh-cn", "《三剑客》是亚历山大·仲马的作品。《孤雏泪》是查尔斯·狄更斯的作品。"),
    ]:
        assert c.matchers[target].convert(text) == want
    hant, hans = c.matchers["zh-hant"], c.matchers["zh-hans"]
    for text, a, b in [("清乾隆嘉庆间刻本", 2, 0), ("秋冬濁而春夏清，晞於朝而生於夕", 0, 3), ("滴瀝明花苑，葳蕤泫竹叢", 0, 2), ("简体字", 2, 0)]:
        assert (hant.replaced(text), hans.replaced(text)) == (a, b)
