"""Column functions, rulesets, groups, sources and streams on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphspark import cli
from glyphspark.functions import columns as C
from glyphspark.functions.expressions import convert_expression
from glyphspark.functions.matcher import Matcher
from glyphspark.functions.sql import register
from glyphspark.operators import groups, rulesets
from glyphspark.plans import compose
from glyphspark.plans.queries import LATIN, seed_pairs
from glyphspark.sources import rulesets as sources
from glyphspark.streaming import streams


@pytest.fixture(scope="module")
def conv(spark):
    return C.Converter(spark, spark.createDataFrame(sources.seed_rows(), sources.PAIRS))


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_convert(spark, conv):
    d = frame(spark, "国学", None, "", "abc")
    assert column(d, conv.convert(d.t, "ZH-TW")) == ["國學", None, "", "abc"]
    assert column(d, conv.convert(d.t, "zh", {"国": "x"}.items())) == ["国学", None, "", "abc"]
    assert column(d, conv.convert(d.t, "zh-tw", [("国", "囯")])) == ["囯學", None, "", "abc"]
    assert column(d, conv.convert(d.t, "zh-tw", removed=["國"])) == ["国學", None, "", "abc"]
    with pytest.raises(ValueError, match="no such"):
        conv.convert(d.t, "zh-xx")
    small = C.Converter(spark, spark.createDataFrame([("hant", "国", "國", 0)], sources.PAIRS))
    assert small.enabled() == ["zh", "zh-hant"] and column(d, small.convert(d.t, "zh-hant"))[0] == "國学"
    with pytest.raises(ValueError, match="no tables"):
        small.convert(d.t, "zh-tw")


def test_expression_equals_kernel(spark):
    texts = ["then the den", "", None, "and\nand", "oder tion", "中文 the"]
    d = frame(spark, *texts)
    want = [None if t is None else Matcher(LATIN).convert(t) for t in texts]
    assert column(d, convert_expression(d.t, LATIN.items())) == want
    assert column(d, C.convert_with_pairs(spark, d.t, LATIN)) == want
    assert "ArrowEval" not in d.select(convert_expression(d.t, LATIN.items()))._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="at most"):
        convert_expression(d.t, {str(i): "x" for i in range(500)}.items())


def test_matches_and_counts(spark, conv):
    d = frame(spark, "软件x皇后", None, "")
    got = column(d, conv.matches(d.t, "zh-tw"))
    assert [(m.start, m.end, m.src, m.dst) for m in got[0]] == [(0, 2, "软件", "軟體"), (3, 5, "皇后", "皇后")]
    assert got[1:] == [None, []]
    assert column(d, conv.replaced(d.t, "zh-tw")) == [2, None, 0]


def test_detection(spark, conv):
    d = frame(spark, "国学语言", "國學語言", "", None, "xyz")
    share = column(d, conv.is_hans_confidence(d.t))
    assert share[:2] == [1.0, 0.0] and math.isnan(share[2]) and share[3] is None
    assert column(d, conv.is_hans(d.t))[:3] == [True, False, False]
    assert column(d, conv.infer(d.t)) == ["zh-hans", "zh-hant", "zh-tw", None, "zh-tw"]
    assert column(d, conv.infer(d.t, default="zh"))[2] == "zh"
    ranked = column(d, conv.infer_confidence(d.t))
    assert [r.variant for r in ranked[2]] == ["zh-tw", "zh-hk", "zh-hant", "zh-hans", "zh-cn"]
    assert column(d, C.q_values(conv.infer_confidence(d.t)))[2].startswith("zh-tw;q=NaN, ")


@pytest.mark.parametrize(("n", "want"), [(15, "鵲飛空繞樹"), (13, "鵲飛空繞樹"), (100, "鵲飛空繞樹月輪殊未圓"), (30, "鵲飛空繞樹月輪殊未圓"), (29, "鵲飛空繞樹月輪殊未圓"), (0, "")])
def test_truncated(spark, n, want):
    d = frame(spark, "鵲飛空繞樹月輪殊未圓", "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop", None)
    assert column(d, C.truncated(d.t, n)) == [want, "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop"[:n], None]


def test_markup_columns(spark, conv):
    d = frame(spark, "-{T|zh-cn:甲;zh-tw:乙}-x-{A|国=>zh-tw:囯}-国", None, "国")
    assert column(d, conv.convert_markup(d.t, "zh-tw")) == ["x囯", None, "國"]
    assert column(d, C.page_title(d.t, "zh-mo")) == ["乙", None, None]
    assert column(d, C.extracted_rules(d.t))[0] == ["T|zh-cn:甲;zh-tw:乙", "A|国=>zh-tw:囯"]
    p = column(d, C.page_rules(d.t))[0]
    assert p.title == {"zh-cn": "甲", "zh-tw": "乙"} and p.actions[0].action == "add"
    r = frame(spark, "H|zh-cn:a", "Q|x", None)
    got = column(r, C.parsed_rule(r.t))
    assert got[0].action == "add" and got[0].conv.both == {"zh-cn": "a"} and got[1].error == "InvalidFlag" and got[2] is None
    assert column(r, C.shown_rule(r.t, "zh-cn")) == ["", "Q|x", None]
    c = frame(spark, "a=>zh-cn:b", "text")
    assert [x.asis for x in column(c, C.parsed_conv(c.t))] == [None, "text"]
    assert column(c, C.normal_tag(F.lit("ZH-TW"))) == ["zh-tw"] * 2 and column(c, C.variant_name(F.lit("zh-HK")))[0] == "香港"


def test_sql_functions(spark, conv):
    register(spark, conv)
    r = spark.sql("SELECT convert_variant('国', 'zh-tw'), convert_markup('-{国}-国', 'zh-hk'), count_replaced('国学', 'zh-hant'), is_hans_confidence('国'), page_title('-{T|zh-cn:a}-', 'zh-cn'), convert_variant(NULL, 'zh-tw')").first()
    assert tuple(r) == ("國", "国國", 2, 1.0, "a", None)
    for t in ("国学语言", "國學語言", "", "xyz", "软件", "計程車", "皇后里"):
        d = frame(spark, t)
        assert spark.sql(f"SELECT infer_variant('{t}'), is_hans('{t}')").first() == d.select(conv.infer(d.t), conv.is_hans(d.t)).first()
    assert [x.src for x in spark.sql("SELECT * FROM variant_matches('国x学', 'zh-tw')").collect()] == ["国", "学"]
    assert [(x.place, x.error) for x in spark.sql("SELECT * FROM markup_rules('-{a}- -{Q|b}-')").collect()] == [(0, None), (1, "InvalidFlag")]


def test_ruleset_algebra(spark):
    p = lambda *rows: spark.createDataFrame([(t, f, to, i) for i, (t, f, to) in enumerate(rows)], sources.PAIRS)
    pairs = lambda df: sorted((r["from"], r["to"]) for r in df.collect())
    base, more = p(("a", "x", "1"), ("a", "x", "2"), ("a", "", "e"), ("a", "y", "y")), p(("b", "x", "3"), ("b", "z", "4"))
    assert pairs(rulesets.layered(base, more)) == [("x", "3"), ("y", "y"), ("z", "4")]
    assert pairs(rulesets.mapping(base, more, p(("r", "x", "")))) == [("y", "y"), ("z", "4")]
    assert pairs(rulesets.first_of_each(base)) == [("", "e"), ("x", "1"), ("y", "y")]
    assert pairs(rulesets.delta(p(("b", "y", "y"), ("b", "x", "9")), base)) == [("x", "9")]
    assert [r["from"] for r in rulesets.longest_first(p(("a", "é", ""), ("a", "b", ""), ("a", "abc", ""))).collect()] == ["abc", "é", "b"]
    assert rulesets.matcher(base).pairs["y"] == "y" and rulesets.regional(base, "zh").count() == 0


def test_sources(spark, tmp_path):
    php = "<?php\n" + "\n".join(f"public const {n} = [\n'甲{i}' => '乙',\n'x' => '',\n];" for i, n in enumerate(sources.ARRAYS))
    (tmp_path / "t.php").write_text(php, encoding="utf-8")
    got = sources.read_arrays(spark, str(tmp_path / "t.php"))
    assert got.count() == 10 and {r["table"] for r in got.collect()} == set(sources.ARRAYS.values())
    with pytest.raises(ValueError, match="checksum"):
        sources.read_arrays(spark, str(tmp_path / "t.php"), sha256="00")
    (tmp_path / "bad.php").write_text("public const ZH_TO_TW = [];", encoding="utf-8")
    with pytest.raises(ValueError, match="missing"):
        sources.read_arrays(spark, str(tmp_path / "bad.php"))
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(ValueError, match="UTF-8"):
        sources.checked_text(spark, str(tmp_path / "latin.txt"))
    (tmp_path / "d.txt").write_text("# head\n甲\t乙 丙\n范\t範 范\n\n丁 乙\nlone\n", encoding="utf-8")
    pairs = lambda df: sorted((r["from"], r["to"]) for r in df.collect())
    assert pairs(sources.read_dictionary(spark, str(tmp_path / "d.txt"), "d")) == [("丁", "乙"), ("甲", "乙")]
    assert pairs(sources.read_dictionary(spark, str(tmp_path / "d.txt"), "d", reverse=True)) == [("丙", "甲"), ("乙", "甲"), ("範", "范"), ("范", "范")]
    (tmp_path / "p.txt").write_text("# c\na b\n\nc  d e\n", encoding="utf-8")
    assert pairs(sources.read_pairs(spark, str(tmp_path / "p.txt"))) == [("a", "b"), ("c", "d e")]
    fn = C.make_converter(spark, None, str(tmp_path / "p.txt"))
    d = frame(spark, "aca")
    assert column(d, fn(d.t)) == ["bd eb"]
    (tmp_path / "p.txt").write_text("nopair\n", encoding="utf-8")
    with pytest.raises(ValueError, match="not a pair"):
        sources.read_pairs(spark, str(tmp_path / "p.txt"))
    with pytest.raises(ValueError, match="no such"):
        C.make_converter(spark, "nope", [("a", "b")])
    (tmp_path / "r.txt").write_text("zh-cn:a;\n\n  b \n", encoding="utf-8")
    assert [(r.line, r.ord) for r in sources.read_rule_lines(spark, str(tmp_path / "r.txt")).collect()] == [("zh-cn:a;", 0), ("b", 2)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text('{"name": "n", "description": "d", "path": "p", "rules": [{"original": null, "conv": "zh-cn:a;"}]}')
    (tmp_path / "g/b.json").write_text("")
    read = sources.read_groups(spark, str(tmp_path / "g"))
    assert [r.name for r in read.collect()] == ["n"]
    sources.write_groups(groups.pack(read), str(tmp_path / "packed"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "packed")).collect()] == [("n / d", "zh-cn:a;")]


def test_dictionary_folder(spark, tmp_path):
    (tmp_path / "STCharacters.txt").write_text("国\t國\n干\t乾 干\n", encoding="utf-8")
    (tmp_path / "STPhrases.txt").write_text("干燥\t乾燥\n", encoding="utf-8")
    (tmp_path / "HKVariants.txt").write_text("# made up\n國\t囯\n", encoding="utf-8")
    cfg = compose.RulesetConfig(tables=("hk",), arrays=False, dictionaries=True)
    got = compose.compose(spark, cfg, None, compose.dictionary_reader(spark, str(tmp_path)))
    assert {(r["from"], r["to"]) for r in got.collect()} == {("国", "囯"), ("國", "囯"), ("干燥", "乾燥")}
    assert C.Converter(spark, got.unionByName(spark.createDataFrame([("hant", "x", "x", 0)], sources.PAIRS))).enabled() == ["zh", "zh-hant", "zh-hk", "zh-mo"]


def slow_flatten(stages):
    """One dictionary that does what (forward, reverse) stages do one after another."""
    pairs, origin = {}, {}  # origin: what stages have written, to what they read
    for forward, back in stages:
        step, undo = Matcher(forward), Matcher(origin)
        pairs = {f: step.convert(t) for f, t in pairs.items()}
        for f in sorted(forward):
            t, written = forward[f], undo.convert(f)
            pairs[f] = t
            if written not in (f, t):
                pairs[written] = t
        origin = {**{f: undo.convert(t) for f, t in back.items()}, **{step.convert(f): t for f, t in sorted(origin.items())}, **origin}
    return pairs


def test_composition(spark):
    two = lambda d: spark.createDataFrame(list(d.items()), "`from` string, `to` string")
    files = {"STCharacters": ({"国": "國"}, {"國": "国"}), "STPhrases": ({}, {}), "TWVariants": ({"國": "囯"}, {"囯": "國"})}
    cfg = compose.RulesetConfig(tables=("hant", "tw"), arrays=True, dictionaries=True)
    arrays = spark.createDataFrame([("hant", "国", "圀", 0)], sources.PAIRS)
    got = {(r["table"], r["from"], r["to"]) for r in compose.compose(spark, cfg, arrays, {k: (two(f), two(b)) for k, (f, b) in files.items()}.__getitem__).collect()}
    assert got == {("hant", "国", "圀"), ("tw", "国", "囯"), ("tw", "國", "囯")}
    with pytest.raises(ValueError, match="at least one"):
        compose.RulesetConfig(arrays=False)


def test_composition_equals_model(spark):
    """Random dictionaries that overlap, reversed ones among them, in chains of one to three stages."""
    r = random.Random(9)
    word = lambda a, b: "".join(r.choice("abcd") for _ in range(r.randint(a, b)))
    files = {n: ({word(1, 3): word(0, 3) for _ in range(8)}, {word(1, 3): word(0, 3) for _ in range(6)}) for n in "ABCDE"}
    chains = {"x": [["A", "!B"], ["C"], ["D", "E"]], "y": [["E", "D"], ["!A"]], "z": [["B"]]}

    def stage(names):
        forward, back = {}, {}
        for n in names:
            f, b = files[n.removeprefix("!")][:: -1 if n.startswith("!") else 1]
            forward, back = {**forward, **f}, {**b, **back}
        return forward, back

    two = lambda d: spark.createDataFrame(list(d.items()), "`from` string, `to` string")
    frames = {n: (two(f), two(b)) for n, (f, b) in files.items()}
    got = sorted((x["scope"], x["from"], x["to"]) for x in compose.flatten(spark, chains, frames.__getitem__).collect())
    assert got == sorted((c, f, t) for c, stages in chains.items() for f, t in slow_flatten([stage(s) for s in stages]).items() if f)


def test_group_pages(spark):
    module = 'return { name = "组", description = "述",\n{ original = "A", rule = "zh-cn:甲;" },\n-- Item("B", "zh-cn:乙;")\nItem("C", "zh-cn:丙;"),\n}' + " " * 60
    rows = [("Module:CGroup/X", module, 100, ""), ("Module:CGroup/X/doc", module, 100, ""), ("Module:CGroup/core", module, 100, ""), ("Template:CGroup/Y", "{{CGroupH|name=名|desc=述}}\n{{CItem|zh-cn:丁{{=}}>|original=D}}", 100, ""), ("Template:CGroup/Z", "x", 100, "#REDIRECT"), ("Module:CGroup/S", module, 5, "")]
    got = {r.path: r for r in groups.harvest(spark.createDataFrame(rows, "title string, text string, size int, snippet string")).collect()}
    assert set(got) == {"Module:CGroup/X", "Template:CGroup/Y"}
    assert (got["Module:CGroup/X"].name, [tuple(x) for x in got["Module:CGroup/X"].rules]) == ("组", [("A", "zh-cn:甲;"), ("C", "zh-cn:丙;")])
    assert got["Template:CGroup/Y"].description == "述"


def test_template_calls(spark):
    lines = {
        "x {{ CItemHidden | desc=q | zh-cn:丁{{=}}>|original=D}}": ("D", "zh-cn:丁{{=}}>"), "{{CItemLan|zh-cn:a;|Orig|}}": ("Orig", "zh-cn:a;"), "{{CItemLan/R|1=o|2=zh:1}}": ("o", "zh:1"),
        "{{CI|1=zh-cn:a;zh-tw:[[b|c]]|desc=|original= [[x|y]] }}": ("[[x|y]]", "zh-cn:a;zh-tw:[[b|c]]"), "{{foo|{{CNoteA|甲=>zh-tw:乙}}}}": (None, "甲=>zh-tw:乙"), "{{Other|zh-cn:a}}": None, "{{CItem|original=X}}": None, "{{CI": None, "": None,
    }
    d = frame(spark, *lines, None)
    assert [None if r is None else tuple(r) for r in column(d, groups.template_line(d.t))] == [*lines.values(), None]
    pages = {"{{CGroupH|name={{lang|en|N}}|desc=}}": ("N", ""), "x{name = 'a', description = \"b\"}": ("a", "b"), "t.name = 'a' description='b'": None, "{{CGroupH|name=a}}": None}
    d = frame(spark, *pages, None)
    assert [None if r is None else tuple(r) for r in column(d, groups.header(d.t))] == [*pages.values(), None]
    d = frame(spark, "zh-cn:<span class='x'>甲</span>;a{{=}}>zh-tw:b")
    assert column(d, groups.clean(d.t)) == ["zh-cn:甲;a=>zh-tw:b"]


def test_stream_equals_batch(spark, conv, tmp_path):
    d = frame(spark, "国学", None, "软件", "-{国}-国")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    for markup in (False, True):
        s = streams.converted(streams.read_files(spark, str(tmp_path / "in"), d.schema, files=1), conv, "t", "zh-tw", markup)
        streams.run_available(s, str(tmp_path / f"out{markup}"), str(tmp_path / f"state{markup}"))
        batch = streams.converted(d, conv, "t", "zh-tw", markup)
        assert sorted(map(str, spark.read.parquet(str(tmp_path / f"out{markup}")).collect())) == sorted(map(str, batch.collect()))


def test_requests(spark, conv):
    rows = [(1, "zh-tw", False, "国" * 10, None), (2, "zh-tw", True, "-{国}-国", None), (3, None, False, "国", None)]
    d = spark.createDataFrame(rows, "id int, target string, wikitext boolean, body string, token string")
    assert {tuple(r) for r in streams.requests(d, conv, limit=20).collect()} == {(1, 400, None), (2, 200, "国國"), (3, 404, None)}


def test_text_job(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("国\r\n学\n".encode())
    (tmp_path / "in/b.txt").write_bytes(b"\xff")
    (tmp_path / "in/c.txt").write_bytes(b" \n")
    for k in "xy":
        (tmp_path / "in" / k).mkdir()
        (tmp_path / "in" / k / "a.txt").write_bytes(f"国{k}\n".encode())
    assert cli.main(["zh-tw", str(tmp_path / "in"), str(tmp_path / "out"), "--rule", "学=>zh-tw:斈"]) == 0
    out = {p.parent.name: p.read_bytes().decode() for p in (tmp_path / "out").rglob("part-*") if p.stat().st_size}
    assert {k: v for k, v in out.items() if k != "_left_out"} == {"file=a.txt": "國\r\n斈\n", "file=x%2Fa.txt": "國x\n", "file=y%2Fa.txt": "國y\n"}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/_left_out")).collect()) == ["b.txt", "c.txt"]
    assert "left out: 2 files" in capsys.readouterr().err
    assert cli.main(["zh-tw", "--dump-table", "--rule", "新=>zh-tw:薪"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert "新 薪" in lines and len(lines) == len(seed_pairs("zh-tw")) + 1
    with pytest.raises(SystemExit):
        cli.main(["zh-xx"])


def test_deep_documents(spark):
    """Arrays of structs, maps, nested arrays and nulls on every level; keys and other leaves stay."""
    from glyphspark.functions.columns import Converter

    c = Converter(spark)
    schema = "id int, a array<struct<t:string,n:int>>, m map<string,struct<t:string>>, x array<array<string>>, s struct<m:map<string,array<string>>,d:double>, t string"
    rows = [
        (1, [("国", 1), (None, 2), None], {"国": ("国",), "x": None}, [["国", None], None, []], ({"国": ["国", "里"]}, 1.5), "国"),
        (2, None, None, None, None, None),
        (3, [], {}, [], ({}, None), ""),
        (4, [("国国", 3)], {"a": (None,)}, [["国"]], (None, 2.0), "国"),
    ]
    df = spark.createDataFrame(rows, schema).repartition(1).sortWithinPartitions("id")
    every = [tuple(r) for r in c.convert_struct(df, None, "zh-tw").collect()]
    some = [tuple(r) for r in c.convert_struct(df, ["a.t", "s.m"], "zh-tw").collect()]
    li = c.convert(F.lit("里"), "zh-tw")
    li = spark.range(1).select(li.alias("x")).first().x
    assert every[0] == (1, [("國", 1), (None, 2), None], {"国": ("國",), "x": None}, [["國", None], None, []], ({"国": ["國", li]}, 1.5), "國")
    assert every[1] == (2, None, None, None, None, None) and every[2] == (3, [], {}, [], ({}, None), "") and every[3] == (4, [("國國", 3)], {"a": (None,)}, [["國"]], (None, 2.0), "國")
    assert some[0] == (1, [("國", 1), (None, 2), None], {"国": ("国",), "x": None}, [["国", None], None, []], ({"国": ["國", li]}, 1.5), "国")
    assert c.convert_struct(df.limit(0), None, "zh-tw").count() == 0
    with pytest.raises(ValueError, match="no texts"):
        c.convert_struct(df, ["s.d"], "zh-tw")


def test_sql_detection_equals_columns(spark, conv):
    """The SQL functions' arithmetic against the column functions', on random texts with ties, nothing to tell, and nulls."""
    r = random.Random(12)
    register(spark, conv)
    texts = ["".join(r.choice("国國发發髮头頭里裡這这a天后皇車车軟软件") for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    d.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT i, infer_variant(t) AS v, is_hans(t) AS h, is_hans_confidence(t) AS c FROM sql_texts").collect()
    want = d.select("i", conv.infer(d.t).alias("v"), conv.is_hans(d.t).alias("h"), conv.is_hans_confidence(d.t).alias("c")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    spans = spark.sql("SELECT i, m.* FROM sql_texts, LATERAL variant_matches(t, 'zh-tw') m").collect()
    flat = d.select("i", F.inline(conv.matches(d.t, "zh-tw"))).collect()
    assert sorted(map(tuple, spans)) == sorted(map(tuple, flat)) and len(spans) > 300
