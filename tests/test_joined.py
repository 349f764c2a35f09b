"""Conversion by joins and folds against the kernel and the parser, on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from glyphspark.functions import markup, rules
from glyphspark.functions.arrays import fold
from glyphspark.functions.markup import MarkupConverter
from glyphspark.functions.matcher import Matcher, convert_layered
from glyphspark.operators import joined, pages

ATOMS = ["-{", "}-", "-{", "}-", "}-{", "|", "H|", "A|", "T", "N|", "D|", "R|", "S", "-|", "+|", "zh-cn:", "zh-tw:", " ZH-HK :", "zh:", "甲", "乙", "=>", ";", "&nbsp;", "&;", "&a", "x", " ", "\n", "<code>", "</code>", "<pre a>", "<pre", "</pre>", "<script", ">", "</script>", "国", "zh-hant", "q|"]


def same(got, want):
    order = lambda r: (r[0], r[1] or "")
    assert sorted(got, key=order) == sorted(want, key=order)


def pairs_frame(spark, pairs):
    return spark.createDataFrame(list(pairs.items()), "`from` string, `to` string")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    flat = ["".join(r.choice(ATOMS) for _ in range(r.randint(0, 25))) for _ in range(250)]

    def nested(depth):
        if not depth:
            return r.choice(["甲", "国x", "zh-cn:甲;zh-tw:乙", "H|zh-cn:甲;zh-tw:乙", "N|zh-hk", "a"])
        return r.choice(["", "x", "国"]) + "-{" + r.choice(["", "H|", "D|", "zh-tw:", "R|"]) + nested(depth - 1) + r.choice(["}-", "}-y", "", "}-;zh-cn:z}-"])

    rule = ["-{H|甲=>zh-tw:丙}-", "-{-|zh-tw:國}-", "-{A|zh-cn:国;zh-tw:囯}-", "-{-|zh-cn:甲}-", "-{H|a=>zh-tw:q;x=>zh-tw:zz}-"]
    return [*flat, *(nested(r.randint(0, 13)) for _ in range(100)), "-{" * 12 + "甲" + "}-" * 12, "", *("".join(r.choice(rule) for _ in range(r.randint(1, 3))) + t for t in flat[:120])]


def test_fold_gathers_outputs(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("v"))
    sums = df.select(fold(F.col("v"), F.lit(0), "int", lambda s, v: (s + v, s), lambda s: s).alias("o")).first().o
    assert sums == [sum(range(k)) for k in range(1, 1002)]


def test_convert_equals_kernel(spark):
    """Sources of all lengths over places where they overlap, in short, long, repeated, empty and null texts, with columns of clashing names."""
    r = random.Random(5)
    word = lambda a, b: "".join(r.choice("abc国é😀") for _ in range(r.randint(a, b)))
    pairs = {word(1, 5): word(0, 3) for _ in range(60)}
    texts = [None, "", "a", *(word(0, 900) for _ in range(30)), word(300, 700) * 4]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(texts)]
    rows += rows[5:8]
    df = spark.createDataFrame(rows, "id long, text string, scope string, start int")
    base, table = Matcher(pairs), pairs_frame(spark, pairs)
    out = joined.convert(df, "text", table)
    assert out.columns == df.columns
    same([(x.id, x.text) for x in out.collect()], [(i, None if t is None else base.convert(t)) for i, t, _, _ in rows])
    own = {(f"s{k}", word(1, 4)): word(0, 3) for k in range(3) for _ in range(12)}
    off = {None: r.sample(sorted({t for t in pairs.values() if t}), 4), "s1": [t for (s, _), t in own.items() if s == "s1"]}
    mine = spark.createDataFrame([(s, f, t) for (s, f), t in own.items()], "scope string, `from` string, `to` string")
    got = joined.convert(df, "text", table, mine, "scope", spark.createDataFrame(list(off.items()), "scope string, targets array<string>"))
    layered = lambda t, s: convert_layered(base, Matcher({f: x for (k, f), x in own.items() if k == s}), frozenset([*off[None], *off.get(s, [])]), t)
    same([(x.id, x.text) for x in got.collect()], [(i, None if t is None else layered(t, s)) for i, t, s, _ in rows])
    assert joined.convert(df.limit(0), "text", table).count() == 0
    same([(x.id, x.text) for x in joined.convert(df, "text", table.limit(0)).collect()], [(i, t) for i, t, _, _ in rows])


def test_no_python_in_plans(spark, capsys):
    df = spark.createDataFrame([("-{H|a=>zh-tw:b}-a",)], "text string")
    rows = joined.matches(df.select(*joined.keys(F.col("text")), F.lit(None).cast("string").alias("scope"), "text"), pairs_frame(spark, {"a": "b"}))
    for plan in (rows, df.select(rules.segments(F.col("text"), "zh-tw"), rules.page_actions(F.col("text"), "zh-tw"))):
        plan.explain("formatted")
    shown = capsys.readouterr().out
    assert "Physical Plan" in shown and not any(x in shown for x in ("EvalPython", "PythonUDF", "InArrow", "InPandas"))


def test_rules_equal_parser(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    cols = [rules.shown(F.col("t"), g).alias(g) for g in ("zh-tw", "zh")]
    for x in df.select("id", *cols, rules.page_actions(F.col("t"), "zh-tw").alias("acts")).collect():
        t = texts[x.id]
        assert [x["zh-tw"], x["zh"]] == [markup.parse_rule_or_text(t).shown(g) for g in ("zh-tw", "zh")], t
        assert [(a.action, [(p.src, p.dst) for p in a.pairs]) for a in x.acts] == [(a, c.pairs_for("zh-tw")) for a, c in markup.PageRules.of(t).actions], t


@pytest.mark.parametrize("options", [(True, True), (False, False)])
def test_pages_equal_parser(spark, texts, options):
    """Nested, unclosed and too deep rules, code blocks, and rules that each text adds and removes for itself."""
    base = {"国": "國", "x": "<X>", "甲x": "乙乙", "甲": "甲", "aa": "b", "a": "乙"}
    rows = [*enumerate(texts), (len(texts), None), (9, texts[9])]
    df = spark.createDataFrame(rows, "id int, t string").repartition(4)
    m = MarkupConverter(Matcher(base), "zh-tw", *options)
    got = pages.convert(df, "t", pairs_frame(spark, base), "zh-TW", *options)
    same([(x.id, x.t) for x in got.collect()], [(i, None if t is None else m.convert(t)) for i, t in rows])
    assert pages.convert(df.limit(0), "t", pairs_frame(spark, base), "zh-tw").count() == 0


def test_pages_with_overlay_and_disabled_targets(spark, texts):
    base, over, off = {"国": "國", "x": "<X>", "甲x": "乙乙", "甲": "甲", "aa": "b", "a": "乙"}, {"国": "囯", "aa": "A", "國": "丁"}, ["乙", "<X>"]
    rows = list(enumerate(texts))
    got = pages.convert(spark.createDataFrame(rows, "id int, t string"), "t", pairs_frame(spark, base), "zh-tw", overlay=pairs_frame(spark, over), off=off)
    removed = {i for i, t in rows if any(f in over for a, c in markup.PageRules.of(t).actions if a == "remove" for f, _ in c.pairs_for("zh-tw"))}
    assert removed
    same([(x.id, x.t) for x in got.collect()], [(i, MarkupConverter(Matcher(base), "zh-tw", True, True, {f: t for f, t in over.items() if f not in off}, set(off)).convert(t)) for i, t in rows])
