"""The registered queries and the SQL that must give the same rows.

The tables hold no Chinese text, so queries on it put one of sixteen fixed
sentences before each document's own. The SQL finds matches by another way than
the engine: an alternation of all sources, the longest first, gives tokens,
which a join looks up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.expressions import convert_expression, token_pattern
from ..functions.sql import engine_info, register
from ..operators import groups, rulesets
from ..scratch import shared_dir
from ..sources import rulesets as sources
from ..sources.rulesets import ARRAYS, PAIRS, seed_rows
from ..streaming import streams
from ..variants import DETECTED, VARIANTS, variants_frame

SENTENCES = [
    "天干物燥 小心火烛", "他们在计算机上写软件。", "皇后的头发又长又黑", "請問這個資訊在哪裡？", "出租车司机说东边有雨", "網路影片很長", "发展经济要靠劳动", "我們坐計程車去醫院",
    "方便面是面条的一种", "天后宮在臺灣", "这里有公里数", "軟體工程師愛喝茶", "云云众生", "龍馬精神", "干部读书学习", "abc 123",
]
LATIN = {"the": "THE", "then": "THEN", "and": "&", "tion": "ción", "er": "er", "den": "DEN", "de": "DE"}
OVERLAY = {"软件": "软件程序", "计算": "算", "皇": "王", "天": "地"}
PROTECT = {"软件": "软件", "发展": "发展", "出租车": "出租车"}
MARKUP = [
    ("A-{干}-B干", "zh-tw"), ("-{zh-tw:甲;zh-cn:乙}-国", "zh-tw"), ("-{H|zh-cn:软体;zh-tw:甲甲}-软体国", "zh-tw"), ("-{-|zh-cn:国;zh-tw:國}-国学", "zh-tw"), ("x-{国-{学}-}-书", "zh-tw"), ("-{国-{学", "zh-tw"),
    ("<code>国</code>国", "zh-tw"), ("<pre>\n国\n</pre>", "zh-tw"), ("-{N|zh-hk}-", "zh-tw"), ("-{D|zh-cn:甲;zh-hk:乙}-", "zh-tw"), ("-{R| 国 }-|-{ 国 }-", "zh-tw"), ("-{T|zh-cn:甲;zh-tw:乙}-国", "zh-tw"),
    ("-{A|zh-cn:甲;zh-tw:乙}-甲", "zh-tw"), ("-{H|甲=>zh-tw:乙}-甲", "zh-tw"), ("-{甲=>zh-tw:乙}-甲", "zh-tw"), ("-{zh-tw:甲|乙}-", "zh-tw"),
]
#: What these texts become, found by hand from the rules of the markup.
SHOWN = [
    "A干B乾", "甲國", "甲甲國", "国學", "x国学書", "-{國-{學", "<code>国</code>國", "<pre>\n國\n</pre>", "香港", "大陆：甲；香港：乙；", " 国 |国", "國", "乙乙", "乙", "甲", "zh-tw:甲|乙",
]
GROUP_PAIRS = [("甲组", "甲组 乙", "a:1"), ("[[链|接]]", "说明", "zh-cn:甲;zh-tw:乙;"), ("名", "名", "zh-cn:丙;")]

_HELD: dict[tuple, C.Converter] = {}


def converter(spark: SparkSession) -> C.Converter:
    key = (spark.sparkContext.applicationId, id(spark))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = C.Converter(spark, seed(spark))
    return _HELD[key]


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_rows(), PAIRS)


def seed_pairs(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for table in VARIANTS[tag].tables:
        out.update({f: t for name, f, t, _ in seed_rows() if name == table})
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sentence(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (F.pmod(number, F.lit(len(SENTENCES))) + 1).cast("int"))


def chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a sentence before each text."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(sentence(F.col("doc_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


# ---- SQL pieces


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else q(x) for x in r) + ')' for r in rows)}) v({names})"


CHINESE = f"SELECT doc_id, lang, source, list_extract([{', '.join(map(q, SENTENCES))}], (doc_id % {len(SENTENCES)} + 1)::INT) || ' ' || coalesce(text, '') AS text FROM documents"


def sql_tokens(pairs: dict[str, str], source: str, key: str, name: str = "tok") -> str:
    """CTEs ``name``_kv and ``name``: (key, p, t, to) for each token; ``to`` is null for tokens that are no source."""
    pat = q(token_pattern(pairs.items()))
    return (
        f"{name}_kv AS (SELECT * FROM {sql_values(list(pairs.items()), 'f, r')}), "
        f"{name}_raw AS (SELECT {key}, regexp_extract_all(text, {pat}) AS l FROM {source}), "
        f"{name}_flat AS (SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM {name}_raw), "
        f"{name} AS (SELECT {key}, p, t, r AS \"to\" FROM {name}_flat LEFT JOIN {name}_kv ON t = f)"
    )


def sql_converted(pairs: dict[str, str], source: str = "src", key: str = "doc_id") -> str:
    """A CTE ``conv``: (key, text) after conversion."""
    return sql_tokens(pairs, source, key) + f', conv AS (SELECT {key}, CASE WHEN count({source}.text) > 0 THEN coalesce(string_agg(coalesce("to", t), \'\' ORDER BY p), \'\') END AS text FROM {source} LEFT JOIN tok USING ({key}) GROUP BY {key})'


def sql_replaced(pairs: dict[str, str], name: str) -> str:
    """A CTE ``name``_n: (doc_id, n) of replaced characters."""
    return sql_tokens(pairs, "src", "doc_id", name) + f', {name}_n AS (SELECT doc_id, coalesce(sum(length(t)) FILTER ("to" <> t), 0)::BIGINT AS n FROM src LEFT JOIN {name} USING (doc_id) GROUP BY doc_id)'


DIGEST_SQL = "SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM conv"


def digest(df: DataFrame, text: Column) -> DataFrame:
    return df.select("doc_id", text.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return put


# ---- conversion with pairs

LATIN_SRC = "src AS (SELECT doc_id, lang, text FROM documents)"


@query(f"WITH {LATIN_SRC}, {sql_converted(LATIN)} {DIGEST_SQL}")
def convert_pairs_docs(spark, sf_dir):
    return digest(read(spark, sf_dir, "documents"), C.convert_with_pairs(spark, F.col("text"), LATIN))


@query(f"WITH {LATIN_SRC}, {sql_converted(LATIN)} {DIGEST_SQL}")
def convert_pairs_expr(spark, sf_dir):
    return digest(read(spark, sf_dir, "documents"), convert_expression(F.col("text"), LATIN.items()))


@query(f"WITH {LATIN_SRC}, {sql_replaced(LATIN, 'x')} SELECT lang, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_replaced FROM src JOIN x_n USING (doc_id) GROUP BY lang")
def convert_pairs_by_lang(spark, sf_dir):
    c = C.Converter(spark, spark.createDataFrame([("hans", f, t, i) for i, (f, t) in enumerate(LATIN.items())], PAIRS))
    docs = read(spark, sf_dir, "documents").select("lang", c.replaced(F.col("text"), "zh-hans").alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_replaced"))


@query(f"WITH src AS (SELECT conv_id || '/' || turn AS k, conv_id, turn, text FROM conversations), {sql_converted(LATIN, key='k')} SELECT conv_id, string_agg(conv.text, '|' ORDER BY turn, k) AS talk FROM src JOIN conv USING (k) GROUP BY conv_id")
def convert_pairs_conversations(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", C.convert_with_pairs(spark, F.col("text"), LATIN).alias("t"))
    told = F.array_sort(F.collect_list(F.struct("turn", "t")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(told, lambda s: s["t"]), "|").alias("talk"))


@query(f"WITH src AS (SELECT p_partkey AS doc_id, p_name AS text FROM part), {sql_converted(LATIN)} {DIGEST_SQL}")
def make_converter_parts(spark, sf_dir):
    fn = C.make_converter(spark, None, spark.createDataFrame(list(LATIN.items()), "`from` string, `to` string"))
    return digest(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), fn(F.col("p_name")))


# ---- conversion with tables


def _table_query(name: str, tag: str) -> None:
    pairs = seed_pairs(tag)

    def run(spark, sf_dir):
        return digest(d := chinese(spark, sf_dir), converter(spark).convert(d["text"], tag))

    query(f"WITH src AS ({CHINESE}), {sql_converted(pairs)} {DIGEST_SQL}" if pairs else f"WITH conv AS ({CHINESE}) {DIGEST_SQL}", name)(run)


for _name, _tag in [("convert_seed_hans", "zh-hans"), ("convert_seed_hant", "zh-hant"), ("convert_seed_cn", "zh-cn"), ("convert_seed_tw", "zh-tw"), ("convert_seed_hk", "zh-hk"), ("convert_alias_mo", "zh-mo"), ("convert_alias_sg", "zh-sg"), ("convert_alias_my", "zh-my"), ("convert_zh_identity", "zh")]:
    _table_query(_name, _tag)


def _overlay_query(name: str, tag: str, over: dict[str, str]) -> None:
    def run(spark, sf_dir):
        return digest(d := chinese(spark, sf_dir), converter(spark).convert(d["text"], tag, over.items()))

    query(f"WITH src AS ({CHINESE}), {sql_converted({**seed_pairs(tag), **over})} {DIGEST_SQL}", name)(run)


_overlay_query("overlay_shadow", "zh-tw", OVERLAY)
_overlay_query("overlay_longest_wins", "zh-cn", {"計程": "慢", "計程車去": "车往", "網": "鱼网"})
_overlay_query("overlay_protect", "zh-hk", PROTECT)


REMOVED = ["國", "學"]


@query(f"WITH src AS ({CHINESE}), {sql_converted({f: f if t in REMOVED else t for f, t in seed_pairs('zh-tw').items()})} {DIGEST_SQL}")
def convert_removed_targets(spark, sf_dir):
    """Disabled targets, all of single characters: these stay as they are."""
    d = chinese(spark, sf_dir)
    return digest(d, converter(spark).convert(d["text"], "zh-tw", removed=REMOVED))


@query(f"WITH src AS ({CHINESE}), {sql_converted({**seed_pairs('zh-tw'), '火烛': '蠟燭', '黑': '烏黑'})} {DIGEST_SQL}")
def overlay_rule_lines(spark, sf_dir):
    lines = "zh-cn:火烛;zh-tw:蠟燭;\n\nnot a rule\n黑=>zh-tw:烏黑;\n黑=>zh-hk:黧"
    d = chinese(spark, sf_dir)
    # a rule also protects the target's own text
    return digest(d, converter(spark).convert(d["text"], "zh-tw", lines=lines))


@query(f"WITH src AS ({CHINESE}), {sql_converted(seed_pairs('zh-hk'))} {DIGEST_SQL}")
def convert_sql_function(spark, sf_dir):
    register(spark, converter(spark))
    chinese(spark, sf_dir).createOrReplaceTempView("glyph_docs")
    return spark.sql("SELECT doc_id, cast(length(t) AS bigint) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, convert_variant(text, 'zh-hk') AS t FROM glyph_docs)")


@query(f"WITH src AS ({CHINESE}), {sql_converted(seed_pairs('zh-tw'))} SELECT doc_id, md5(src.text) AS raw, md5(conv.text) AS digest, source AS kept FROM src JOIN conv USING (doc_id)")
def convert_struct_leaves(spark, sf_dir):
    d = chinese(spark, sf_dir).select("doc_id", F.struct(F.struct("text", "source").alias("inner"), F.array("text", "text").alias("list"), F.col("text").alias("raw")).alias("s"))
    d = converter(spark).convert_struct(d, ["s.inner.text"], "zh-tw")
    return d.select("doc_id", F.md5("s.raw").alias("raw"), F.md5("s.inner.text").alias("digest"), F.col("s.inner.source").alias("kept"))


# ---- matches

_SPANS = sql_tokens(seed_pairs("zh-tw"), "src", "doc_id") + ', spans AS (SELECT doc_id, t AS src, "to" AS dst, (sum(length(t)) OVER (PARTITION BY doc_id ORDER BY p) - length(t))::BIGINT AS s, length(t) AS n, "to" IS NOT NULL AS hit FROM tok)'


def _spans(spark, sf_dir) -> DataFrame:
    d = chinese(spark, sf_dir)
    return d.select("doc_id", "source", F.posexplode(converter(spark).matches(d["text"], "zh-tw")).alias("place", "m")).select("doc_id", "source", "place", F.col("m.start").cast("long").alias("start_at"), F.col("m.end").cast("long").alias("end_at"), F.col("m.src").alias("src"), F.col("m.dst").alias("dst"))


@query(f"WITH src AS ({CHINESE}), {_SPANS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS place, s AS start_at, s + n AS end_at, src, dst FROM spans WHERE hit")
def match_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("doc_id", F.col("place").cast("long").alias("place"), "start_at", "end_at", "src", "dst")


@query(f"WITH src AS ({CHINESE}), {_SPANS} SELECT n::BIGINT AS n_chars, count(*)::BIGINT AS n FROM spans WHERE hit GROUP BY ALL")
def match_histogram(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy((F.col("end_at") - F.col("start_at")).alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH src AS ({CHINESE}), {_SPANS} SELECT src, dst, count(*)::BIGINT AS n FROM spans WHERE hit GROUP BY ALL ORDER BY n DESC, src LIMIT 20")
def top_matched_words(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "src").limit(20)


@query(f"WITH src AS ({CHINESE}), {_SPANS} SELECT doc_id, count(*)::BIGINT AS n FROM spans WHERE hit GROUP BY doc_id")
def match_table_function(spark, sf_dir):
    register(spark, converter(spark))
    chinese(spark, sf_dir).createOrReplaceTempView("glyph_docs")
    return spark.sql("SELECT doc_id, count(*) AS n FROM glyph_docs, LATERAL variant_matches(text, 'zh-tw') GROUP BY doc_id")


# ---- detection

_COUNTS = f"src AS ({CHINESE}), " + ", ".join(sql_replaced(seed_pairs(t), t[3:]) for t in DETECTED)
_JOINED = "c AS (SELECT src.doc_id, lang, source, " + ", ".join(f"{t[3:]}_n.n AS {t[3:]}" for t in DETECTED) + " FROM src " + " ".join(f"JOIN {t[3:]}_n USING (doc_id)" for t in DETECTED) + ")"
_CONF = "f AS (SELECT *, cn + tw + hk - hant AS total FROM c), g AS (SELECT *, " + ", ".join(f"CASE WHEN total = 0 THEN NULL ELSE 1::FLOAT - (least({t[3:]}, total)::FLOAT / total::FLOAT)::FLOAT END AS q_{t[3:]}" for t in DETECTED) + " FROM f)"
_ORDER = "long AS (SELECT doc_id, source, v, CASE v " + " ".join(f"WHEN '{t}' THEN q_{t[3:]}" for t in DETECTED) + " END AS q, CASE WHEN q_tw = q_hk THEN list_position(['zh-hans', 'zh-hant', 'zh-tw', 'zh-cn', 'zh-hk'], v) ELSE list_position(['zh-tw', 'zh-hk', 'zh-hant', 'zh-hans', 'zh-cn'], v) END AS o FROM g, (VALUES " + ", ".join(f"('{t}')" for t in DETECTED) + ") x(v)), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q DESC NULLS FIRST, o) AS place FROM long)"


def _counted(spark, sf_dir) -> DataFrame:
    d = chinese(spark, sf_dir)
    return d.select("doc_id", "lang", "source", converter(spark).counts(d["text"]).alias("c"))


def _no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), F.round(c.cast("double"), 4))


@query(f"WITH {_COUNTS}, {_JOINED} SELECT doc_id, {', '.join(f'{t[3:]} AS n_{t[3:]}' for t in DETECTED)} FROM c")
def replaced_counts(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", *[F.col(f"c.{t.replace('-', '_')}").cast("long").alias(f"n_{t[3:]}") for t in DETECTED])


@query(f"WITH src AS ({CHINESE}), {sql_replaced(seed_pairs('zh-hant'), 'x')} SELECT source, sum(n)::BIGINT AS n_replaced FROM src JOIN x_n USING (doc_id) GROUP BY source")
def replaced_chars_by_source(spark, sf_dir):
    d = chinese(spark, sf_dir)
    return d.select("source", converter(spark).replaced(d["text"], "zh-hant").alias("n")).groupBy("source").agg(F.sum("n").alias("n_replaced"))


@query(f"WITH {_COUNTS}, {_JOINED} SELECT doc_id, round((hant / nullif(hans + hant, 0))::FLOAT::DOUBLE, 4) AS confidence FROM c")
def hans_confidence(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", _no_nan(C.hans_confidence(F.col("c"))).alias("confidence"))


@query(f"WITH {_COUNTS}, {_JOINED} SELECT source, count(*)::BIGINT AS n FROM c WHERE hant / nullif(hans + hant, 0) > 0.5 GROUP BY source")
def is_hans_filter(spark, sf_dir):
    d = chinese(spark, sf_dir)
    return d.filter(converter(spark).is_hans(d["text"])).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_COUNTS}, {_JOINED}, {_CONF}, {_ORDER} SELECT doc_id, v AS variant FROM ranked WHERE place = 1")
def infer_variant(spark, sf_dir):
    d = chinese(spark, sf_dir)
    return d.select("doc_id", converter(spark).infer(d["text"]).alias("variant"))


@query(f"WITH {_COUNTS}, {_JOINED}, {_CONF}, {_ORDER} SELECT doc_id, (place - 1)::BIGINT AS place, v AS variant, round(q::DOUBLE, 4) AS confidence FROM ranked")
def infer_confidence_long(spark, sf_dir):
    rows = _counted(spark, sf_dir).select("doc_id", F.posexplode(C.ranked_confidences(F.col("c"))).alias("place", "r"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.col("r.variant").alias("variant"), _no_nan(F.col("r.confidence")).alias("confidence"))


@query(f"WITH {_COUNTS}, {_JOINED}, {_CONF}, {_ORDER} SELECT doc_id, string_agg(v || ';q=' || coalesce(printf('%.3f', q::DOUBLE), 'NaN'), ', ' ORDER BY place) AS q_values FROM ranked GROUP BY doc_id")
def q_value_string(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", C.q_values(C.ranked_confidences(F.col("c"))).alias("q_values"))


@query(f"WITH src AS ({CHINESE}) SELECT doc_id, left(text, coalesce(list_min(list_filter(range(0, 41), lambda k: strlen(left(text, k)) >= 40)), 41)) AS head FROM src")
def truncate_around(spark, sf_dir):
    return chinese(spark, sf_dir).select("doc_id", C.truncated(F.col("text"), 40).alias("head"))


@query(f"WITH src AS (SELECT doc_id, left(text, 3) AS text FROM ({CHINESE})), {sql_replaced(seed_pairs('zh-hant'), 'a')}, {sql_replaced(seed_pairs('zh-hans'), 'b')} SELECT doc_id, round((a_n.n / nullif(a_n.n + b_n.n, 0))::FLOAT::DOUBLE, 4) AS confidence FROM a_n JOIN b_n USING (doc_id)")
def truncate_then_detect(spark, sf_dir):
    d = chinese(spark, sf_dir)
    return d.select("doc_id", _no_nan(converter(spark).is_hans_confidence(C.truncated(d["text"], 9))).alias("confidence"))


@query(f"WITH {_COUNTS}, {_JOINED}, {_CONF}, {_ORDER} SELECT source, v AS variant, count(*)::BIGINT AS n FROM ranked WHERE place = 1 GROUP BY ROLLUP (source, v)")
def corpus_rollup(spark, sf_dir):
    d = chinese(spark, sf_dir)
    return d.select("source", converter(spark).infer(d["text"]).alias("variant")).rollup("source", "variant").agg(F.count(F.lit(1)).alias("n"))


# ---- markup


def marked(spark, sf_dir) -> DataFrame:
    """documents with markup before each text."""
    texts = F.array(*[F.lit(t) for t, _ in MARKUP])
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.element_at(texts, (F.pmod("doc_id", F.lit(len(MARKUP))) + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def _by_number(values: list[str | None], name: str) -> str:
    return f"SELECT doc_id, list_extract([{', '.join('NULL' if v is None else q(v) for v in values)}], (doc_id % {len(values)} + 1)::INT) AS {name}"


def _markup_query(name: str, shown: list[str], **options) -> None:
    """The texts hold no markup and nothing to convert, so each comes after what its markup shows."""

    def run(spark, sf_dir):
        return digest(d := marked(spark, sf_dir), converter(spark).convert_markup(d["text"], "zh-tw", **options))

    query(f"WITH s AS ({_by_number(shown, 'shown')}, coalesce(text, '') AS text FROM documents), conv AS (SELECT doc_id, shown || ' ' || text AS text FROM s) {DIGEST_SQL}", name)(run)


_NO_GLOBAL, _NO_SKIP = {2: "軟體國", 3: "國學", 12: "乙甲", 13: "甲"}, {6: "<code>國</code>國"}
_markup_query("markup_extended", SHOWN)
_markup_query("markup_basic", [(_NO_GLOBAL | _NO_SKIP).get(i, s) for i, s in enumerate(SHOWN)], skip_code=False, global_rules=False)
_markup_query("markup_no_global_rules", [_NO_GLOBAL.get(i, s) for i, s in enumerate(SHOWN)], global_rules=False)
_markup_query("markup_no_code_skipping", [_NO_SKIP.get(i, s) for i, s in enumerate(SHOWN)], skip_code=False)
_markup_query("markup_overlay", [s.replace("國", "囯") for s in SHOWN], pairs=[("国", "囯")])
_markup_query("markup_removed_targets", [s.replace("國", "国") for s in SHOWN], removed=["國"])


@query(_by_number([None] * 11 + ["乙"] + [None] * 4, "title") + " FROM documents")
def markup_title(spark, sf_dir):
    d = marked(spark, sf_dir)
    return d.select("doc_id", C.page_title(d["text"], "zh-tw").alias("title"))


_INNERS = f"r AS (SELECT doc_id, unnest(regexp_extract_all(text, '-\\{{([^\\n]+?)\\}}-', 1)) AS inner_text FROM (SELECT doc_id, list_extract([{', '.join(q(t) for t, _ in MARKUP)}], (doc_id % {len(MARKUP)} + 1)::INT) || ' ' || coalesce(text, '') AS text FROM documents))"


@query(f"WITH {_INNERS} SELECT doc_id, inner_text FROM r")
def extract_rules_long(spark, sf_dir):
    d = marked(spark, sf_dir)
    return d.select("doc_id", F.explode(C.extracted_rules(d["text"])).alias("inner_text"))


@query(f"WITH {_INNERS}, s AS (SELECT CASE WHEN contains(inner_text, '|') THEN split_part(inner_text, '|', 1) ELSE '' END AS flags FROM r) SELECT CASE WHEN flags = 'zh-tw:甲' THEN 'InvalidFlag' END AS error, CASE flags WHEN 'H' THEN 'add' WHEN 'A' THEN 'add' WHEN '-' THEN 'remove' END AS action, CASE WHEN flags IN ('H', '-', 'T') THEN NULL WHEN flags = 'N' THEN 'name' WHEN flags = 'D' THEN 'description' ELSE 'text' END AS output, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def rule_flag_counts(spark, sf_dir):
    d = marked(spark, sf_dir)
    rules = d.select(F.explode(C.extracted_rules(d["text"])).alias("i")).select(C.parsed_rule(F.col("i")).alias("r"))
    return rules.groupBy(F.col("r.error").alias("error"), F.col("r.action").alias("action"), F.col("r.output").alias("output")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_INNERS} SELECT doc_id, count(*)::BIGINT AS n FROM r GROUP BY doc_id")
def rule_table_function(spark, sf_dir):
    register(spark, converter(spark))
    marked(spark, sf_dir).createOrReplaceTempView("glyph_marked")
    return spark.sql("SELECT doc_id, count(*) AS n FROM glyph_marked, LATERAL markup_rules(text) GROUP BY doc_id")


@query("SELECT doc_id, CASE WHEN lang IS NULL THEN NULL ELSE lang || '甲' END AS cn, source AS tw FROM documents")
def variant_map_parse(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", C.variant_map(F.concat(F.lit(" zh-cn : "), "lang", F.lit("甲; ZH-TW:"), "source", F.lit(" "))).alias("m"))
    return d.select("doc_id", F.element_at("m", "zh-cn").alias("cn"), F.element_at("m", "zh-tw").alias("tw"))


# ---- rulesets

SEED_SQL = f"seed AS (SELECT * FROM {sql_values(seed_rows(), 'tab, f, t, ord')})"
_REGIONAL = "d AS (SELECT * FROM seed WHERE tab = 'tw' AND NOT EXISTS (SELECT 1 FROM seed b WHERE b.tab = 'hant' AND b.f = seed.f AND b.t = seed.t)), m AS (SELECT f, t FROM d UNION ALL SELECT f, t FROM seed WHERE tab = 'hant' AND f NOT IN (SELECT f FROM d))"


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("from").alias("f"), F.col("to").alias("t"))


@query(f"WITH {SEED_SQL}, a AS (SELECT p_type AS tab, p_brand AS f, p_name AS t, p_partkey AS ord FROM part) SELECT tab, f, t FROM a QUALIFY row_number() OVER (PARTITION BY tab, f ORDER BY ord) = 1")
def table_dedup_precedence(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_type").alias("table"), F.col("p_brand").alias("from"), F.col("p_name").alias("to"), F.col("p_partkey").alias("ord"))
    return rulesets.first_of_each(p).select(F.col("table").alias("tab"), F.col("from").alias("f"), F.col("to").alias("t"))


def _file(spark: SparkSession, text: str) -> str:
    """A small file in the shared folder, written by Spark."""
    path = f"{shared_dir(spark).rstrip('/')}/glyphspark/file-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "text string").coalesce(1).write.text(path)
    return path


# ---- groups


def _groups(spark) -> DataFrame:
    rows = [(n, d, f"p{i}", [(None, c), ("x", "zh-hk:丁;")]) for i, (n, d, c) in enumerate(GROUP_PAIRS)] + [("名", " 名 ", "p9", [("y", "zh-cn:戊;")])]
    return spark.createDataFrame(rows, "name string, description string, path string, rules array<struct<original:string,conv:string>>")


@query("SELECT p_partkey, p_name AS name, p_type AS description FROM part")
def cgroup_headers(spark, sf_dir):
    module = F.concat(F.lit('return {\n  name = "'), "p_name", F.lit("\",\n  description = '"), "p_type", F.lit("',\n}"))
    template = F.concat(F.lit("{{CGroupH|name="), "p_name", F.lit("|desc={{lang|en|"), "p_type", F.lit("}}}}\ntext"))
    p = read(spark, sf_dir, "part").select("p_partkey", groups.header(F.when(F.col("p_partkey") % 2 == 0, module).otherwise(template)).alias("h"))
    return p.select("p_partkey", "h.name", "h.description")


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 200 >= 66 GROUP BY p_brand")
def cgroup_pages(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 2 == 0, "Module:CGroup/").otherwise("Template:CGroup/"), "p_name", F.when(k % 5 == 0, "/doc").otherwise(""))
    snippet = F.when(k % 7 != 0, "text").when(k % 2 == 0, "x return require('y')").otherwise("#REDIRECT [[z]]")
    return read(spark, sf_dir, "part").filter(groups.is_group_page(title, (k % 200).cast("int"), snippet)).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path, name, description, len(rules)::BIGINT AS n_rules, rules[1] AS first FROM (SELECT 'Module:CGroup/' || p_partkey AS path, p_name AS name, p_type AS description, ['zh-cn:' || p_brand || ';', 'zh-tw:' || p_name] AS rules FROM part)")
def cgroup_harvest(spark, sf_dir):
    text = F.concat(F.lit('return { name = "'), "p_name", F.lit('", description = "'), "p_type", F.lit('",\n{ original = "a", rule = "zh-cn:'), "p_brand", F.lit(';" },\n-- Item("no", "zh-cn:no")\nItem("b", "<span>zh-tw:'), "p_name", F.lit('</span>"),\n}'))
    pages = read(spark, sf_dir, "part").select(F.concat(F.lit("Module:CGroup/"), F.col("p_partkey").cast("string")).alias("title"), text.alias("text"), F.lit(100).alias("size"), F.lit("").alias("snippet"))
    return groups.harvest(pages).select("path", "name", "description", F.size("rules").cast("long").alias("n_rules"), F.get(F.col("rules.conv"), F.lit(0)).alias("first"))


@query(f"WITH src AS ({CHINESE}), {sql_converted({**seed_pairs('zh-tw'), '甲': '乙', '乙': '乙'})} {DIGEST_SQL}")
def cgroup_apply(spark, sf_dir):
    d = chinese(spark, sf_dir)
    return digest(d, converter(spark).convert(d["text"], "zh-tw", lines=groups.chosen_lines(groups.pack(_groups(spark)), ["链 / 说明", "none"])))


# ---- service and streams


@query(f"WITH src AS ({CHINESE}), {sql_converted(seed_pairs('zh-tw'))} SELECT lang, count(*)::BIGINT AS n_docs, sum(length(conv.text))::BIGINT AS n_chars FROM src JOIN conv USING (doc_id) GROUP BY lang")
def stream_convert_counts(spark, sf_dir):
    """The documents as a stream of files, converted, written, and read again as a batch."""
    path = f"{sf_dir}/documents.parquet"
    stream = streams.read_files(spark, path + "*", spark.read.parquet(path).schema)
    stream = stream.select("doc_id", "lang", F.concat(sentence(F.col("doc_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    base = f"{shared_dir(spark).rstrip('/')}/glyphspark/stream-{uuid.uuid4().hex}"
    out = streams.converted(stream, converter(spark), "text", "zh-tw").select("lang", F.length("text").cast("long").alias("n"))
    streams.run_available(out, f"{base}/out", f"{base}/state")
    return spark.read.schema("lang string, n long").parquet(f"{base}/out").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start_at, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return streams.windowed_counts(e, "ts", "event_type", "1 hour", "1 hour").withColumnRenamed("start", "start_at")
