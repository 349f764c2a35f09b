"""Queries whose dictionaries and rules are made from the tables themselves, and run as joins and folds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import Converter, make_converter, normal_tag, page_pairs, variant_name
from ..functions.sql import engine_info
from ..operators import groups, joined, pages, rulesets
from ..operators.joined import written
from ..operators.rulesets import bounded, regional
from ..scratch import shared_dir
from ..sources import rulesets as sources
from ..sources.rulesets import ARRAYS
from ..streaming.streams import requests
from ..variants import DETECTED, VARIANTS, enabled_tags, variants_frame
from .compose import RulesetConfig, compose
from .queries import CHINESE, DIGEST_SQL, LATIN, ORACLE_SQL, OVERLAY, chinese, converter, digest, marked, q, query, read, seed, seed_pairs, sql_converted, sql_tokens, sql_values


def sql_matches(source: str, least: int, most: int, own: str | None = None, off: str = "FALSE") -> str:
    """CTEs up to ``conv`` (doc_id, text): texts of ``source`` (doc_id, scope, text) converted with pairs of ``kv`` (f, t), and ``own`` (scope, f, t) over them.

    All places and lengths are looked up; of each place the longest stays, and
    a reduction over places takes the leftmost. Where ``off`` holds for a match
    of kv, one character is passed over.
    """
    mine = f" UNION ALL SELECT doc_id, p, n, 0 AS layer, t, FALSE AS gone FROM g JOIN {own} o ON g.scope IS NOT DISTINCT FROM o.scope AND g.s = o.f" if own else ""
    return f"""
pc AS (SELECT doc_id, scope, unnest(l) AS a, unnest(list_append(l[2:], '')) AS nxt, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, scope, regexp_extract_all(text, '(?s).{{1,64}}') AS l FROM {source})),
pos AS (SELECT doc_id, scope, 64 * i + j AS p, substr(a || nxt, j, {most}) AS r FROM (SELECT *, unnest(range(1, length(a) + 1)) AS j FROM pc)),
g AS (SELECT doc_id, scope, p, n, left(r, n) AS s FROM pos, (SELECT unnest(range({least}, {most + 1})) AS n) WHERE n <= length(r)),
hit AS (SELECT doc_id, p, n, 1 AS layer, t, {off} AS gone FROM g JOIN kv ON g.s = kv.f{mine}),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY n DESC, layer) = 1),
walk AS (SELECT doc_id, list_reduce(list({{'p': p, 'e': p + CASE WHEN gone THEN 1 ELSE n END, 'l': CASE WHEN gone THEN []::BIGINT[] ELSE [p] END}} ORDER BY p),
         lambda a, x: CASE WHEN x.p >= a.e THEN {{'p': x.p, 'e': x.e, 'l': list_concat(a.l, x.l)}} ELSE a END).l AS taken FROM best GROUP BY doc_id),
m AS (SELECT doc_id, p, n, t FROM (SELECT doc_id, unnest(taken) AS p FROM walk) JOIN best USING (doc_id, p)),
part AS (SELECT doc_id, p, p + n AS e, t, coalesce(lag(p + n) OVER (PARTITION BY doc_id ORDER BY p), 1) AS b FROM m),
made AS (SELECT doc_id, string_agg(text[b:p - 1] || t, '' ORDER BY p) AS head, max(e) AS e FROM part JOIN {source} USING (doc_id) GROUP BY doc_id),
conv AS (SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || text[e:] END AS text FROM {source} LEFT JOIN made USING (doc_id))"""


# ---- dictionaries made from the documents

LEAST, MOST, PREFIX = 3, 6, 4


def words_of(docs: DataFrame, *cols: str) -> DataFrame:
    """The words of texts that make a dictionary, each time they stand, with columns of their row."""
    return docs.select(*cols, F.explode(F.regexp_extract_all("text", F.lit(r"[^\n .,]+"), F.lit(0))).alias("w")).filter(F.length("w").between(LEAST, MOST))


def word_pairs(words: DataFrame) -> DataFrame:
    """(from, to): words and their first letters, each with its letters reversed and counted; written once, as what converts reads it several times."""
    both = F.when(F.length("w") > PREFIX + 1, F.array("w", F.substring("w", 1, PREFIX))).otherwise(F.array("w"))
    sources = words.select("w").distinct().select(F.explode(both).alias("w")).distinct()
    return written(sources.select(F.col("w").alias("from"), F.concat(F.reverse("w"), F.length("w").cast("string")).alias("to")), "words")


_WORDS = f"""w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[^\\n .,]+')) AS w FROM documents) WHERE length(w) BETWEEN {LEAST} AND {MOST}),
kv AS (SELECT w AS f, reverse(w) || length(w)::VARCHAR AS t FROM (SELECT w FROM w UNION SELECT left(w, {PREFIX}) FROM w WHERE length(w) > {PREFIX + 1}))"""


@query(f"WITH src AS (SELECT doc_id, NULL AS scope, text FROM documents), {_WORDS}, {sql_matches('src', LEAST, MOST)} {DIGEST_SQL}")
def convert_table_words(spark, sf_dir):
    """Every document by a dictionary of all documents' words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(joined.convert(docs, "text", word_pairs(words_of(docs))), F.col("text"))


_OWN = f"""own AS (SELECT source AS scope, w AS f, '<' || source || '>' AS t FROM (SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w) AS k
  FROM (SELECT source, unnest(regexp_extract_all(text, '[^\\n .,]+')) AS w FROM documents WHERE source IS NOT NULL) WHERE length(w) BETWEEN {LEAST} AND {MOST} GROUP BY source, w) WHERE k % 5 = 1 AND k <= 50)"""


@query(f"WITH src AS (SELECT doc_id, source AS scope, text FROM documents), {_WORDS}, {_OWN}, {sql_matches('src', LEAST, MOST, 'own', off="right(kv.t, 1) IN ('4', '6')")} {DIGEST_SQL}")
def convert_table_scoped(spark, sf_dir):
    """The same with words of each source that shadow the dictionary in its documents, and targets that are disabled everywhere: shorter words at their places are lost."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counts = written(words_of(docs, "source").groupBy("source", "w").agg(F.count(F.lit(1)).alias("n")), "counts")
    pairs = word_pairs(counts)
    ranked = counts.filter("source is not null").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "w"))).filter("k <= 50")
    own = ranked.filter("k % 5 = 1").select(F.col("source").alias("scope"), F.col("w").alias("from"), F.concat(F.lit("<"), "source", F.lit(">")).alias("to"))
    off = pairs.filter(F.substring("to", -1, 1).isin("4", "6")).select(F.lit(None).cast("string").alias("scope"), F.array("to").alias("targets"))
    return digest(joined.convert(docs, "text", pairs, own, "source", off), F.col("text"))


@query(f"WITH src AS (SELECT doc_id, NULL AS scope, text FROM documents), {_WORDS.replace('FROM documents', 'FROM benchmark')}, {sql_matches('src', LEAST, MOST, off="right(kv.t, 1) IN ('4', '6')")} {DIGEST_SQL}")
def convert_removed_words(spark, sf_dir):
    """Disabled targets of several characters in the kernel, with the words of the benchmark: those that have them are passed over by one character."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = word_pairs(words_of(read(spark, sf_dir, "benchmark")))
    c = Converter(spark, pairs.select(F.lit("hans").alias("table"), "from", "to", F.lit(0).alias("ord")))
    off = [r["to"] for r in bounded(pairs.filter(F.substring("to", -1, 1).isin("4", "6")))]
    return digest(docs, c.convert(F.col("text"), "zh-hans", removed=off))


# ---- markup made from columns

SENTENCE_END = ". "


def ruled(docs: DataFrame) -> Column:
    """Texts with rules before them that differ from page to page: a word for each source, a tag for each language, and a removal."""
    s, g = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    return F.concat(F.lit("-{H|the=>zh-tw:"), s, F.lit("}--{A|zh-cn:"), g, F.lit(";zh-tw:"), F.upper(s), F.lit("}--{-|the"), g, F.lit("=>zh-tw:x}-"), F.coalesce("text", F.lit("")))


_RULED = f"""src AS (SELECT doc_id, doc_id AS scope, upper(s) || text AS text FROM (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(text, '') AS text FROM documents)),
kv AS (SELECT * FROM {sql_values(list(LATIN.items()), 'f, t')}),
own AS (SELECT doc_id AS scope, unnest(['the', lang, upper(s)]) AS f, unnest([s, upper(s), upper(s)]) AS t FROM (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS lang FROM documents))"""


@query(f"WITH {_RULED}, {sql_matches('src', 2, 6, 'own')} {DIGEST_SQL}")
def markup_page_rules(spark, sf_dir):
    """Page-global rules as rows: each page's own pairs over the table of pairs, joined by page and source."""
    docs = read(spark, sf_dir, "documents")
    marked = docs.select("doc_id", ruled(docs).alias("text"))
    return digest(pages.convert(marked, "text", spark.createDataFrame(list(LATIN.items()), "`from` string, `to` string"), "zh-tw"), F.col("text"))


_NESTED = f"""src AS (SELECT doc_id || '/' || p AS k, doc_id, p, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), {q(SENTENCE_END)}) AS l FROM documents))),
{sql_tokens(LATIN, 'src', 'k')},
piece AS (SELECT k, coalesce(string_agg(coalesce("to", t), '' ORDER BY tok.p), '') AS text FROM src LEFT JOIN tok USING (k) GROUP BY k),
conv AS (SELECT d.doc_id, string_agg(CASE WHEN s.p > 1 THEN '[' || coalesce(d.source, 'none') || '/' || coalesce(d.lang, 'none') || ']' ELSE '' END || piece.text, '' ORDER BY s.p) AS text FROM piece JOIN src s USING (k) JOIN documents d ON d.doc_id = s.doc_id GROUP BY d.doc_id)"""


@query(f"WITH {_NESTED} {DIGEST_SQL}")
def markup_nested_rules(spark, sf_dir):
    """A rule of three levels, of a document's source and language, at the end of every sentence: what it shows isn't converted, and parts what is."""
    docs = read(spark, sf_dir, "documents")
    s, g = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    rule = F.concat(F.lit("-{zh-cn:none;zh-tw:[-{R|-{zh-hk:"), s, F.lit(";}-}-/-{"), g, F.lit("}-];}-"))
    marked = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(SENTENCE_END), rule).alias("text"))
    return digest(pages.convert(marked, "text", spark.createDataFrame(list(LATIN.items()), "`from` string, `to` string"), "zh-tw", global_rules=False), F.col("text"))


def _joined_markup(name: str, options: Callable[[SparkSession], dict]) -> None:
    """A query of markup by joins and folds that must give the rows of the kernel's."""

    def run(spark, sf_dir):
        return digest(pages.convert(marked(spark, sf_dir), "text", regional(seed(spark), "zh-tw"), "zh-tw", **options(spark)), F.col("text"))

    query(ORACLE_SQL[name], f"{name}_joined")(run)


_joined_markup("markup_extended", lambda spark: {})
_joined_markup("markup_basic", lambda spark: {"skip_code": False, "global_rules": False})
_joined_markup("markup_overlay", lambda spark: {"overlay": spark.createDataFrame([("国", "囯")], "`from` string, `to` string")})
_joined_markup("markup_removed_targets", lambda spark: {"off": ["國"]})


# ---- rulesets made from part

PARTS = "pt AS (SELECT * FROM (SELECT list_extract(['hant', 'hans', 'tw', 'hk', 'cn'], (p_partkey % 5 + 1)::INT) AS tab, p_name || ' ' || p_size % 4 AS f, p_type || p_size % 2 AS t, p_partkey AS ord FROM part) QUALIFY row_number() OVER (PARTITION BY tab, f ORDER BY ord) = 1)"
REGIONS = {"zh-tw": ("tw", "hant"), "zh-hk": ("hk", "hant"), "zh-cn": ("cn", "hans")}


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables of pairs (table, from, to, ord) with names and types of parts, many alike in two tables."""
    size = F.col("p_size")
    name = F.element_at(F.array(*[F.lit(t) for t in ("hant", "hans", "tw", "hk", "cn")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(name.alias("table"), F.concat_ws(" ", "p_name", (size % 4).cast("string")).alias("from"), F.concat("p_type", (size % 2).cast("string")).alias("to"), F.col("p_partkey").alias("ord"))
    return rulesets.first_of_each(rows)


def named(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(*more, F.col("from").alias("f"), F.col("to").alias("t"))


@query(f"WITH {PARTS} " + " UNION ALL ".join([f"SELECT '{g}' AS tag, coalesce(r.f, b.f) AS f, coalesce(r.t, b.t) AS t FROM (FROM pt WHERE tab = '{r}') r FULL JOIN (FROM pt WHERE tab = '{b}') b ON r.f = b.f" for g, (r, b) in REGIONS.items()] + [f"SELECT 'zh-{b}', f, t FROM pt WHERE tab = '{b}'" for b in ("hans", "hant")]))
def table_merge(spark, sf_dir):
    """The merged tables of all five targets."""
    t = part_tables(spark, sf_dir)
    return reduce(DataFrame.unionByName, [named(rulesets.regional(t, g), F.lit(g).alias("tag")) for g in DETECTED])


@query(f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT tab, f, t FROM pt WHERE tab = '{r}' AND NOT EXISTS (FROM pt b WHERE b.tab = '{b}' AND b.f = pt.f AND b.t = pt.t)" for r, b in REGIONS.values()))
def table_delta(spark, sf_dir):
    t = part_tables(spark, sf_dir)
    return reduce(DataFrame.unionByName, [named(rulesets.delta(rulesets.table(t, r), rulesets.table(t, b)), F.lit(r).alias("tab")) for r, b in REGIONS.values()])


_TW = f"{PARTS}, tw AS (SELECT coalesce(r.f, b.f) AS f, coalesce(r.t, b.t) AS t FROM (FROM pt WHERE tab = 'tw') r FULL JOIN (FROM pt WHERE tab = 'hant') b ON r.f = b.f)"


@query(f"WITH {_TW}, a AS (SELECT p_name || ' ' || p_size % 4 AS f, arg_max(p_brand, p_partkey) AS t FROM part WHERE p_size > 40 GROUP BY f), m AS (SELECT coalesce(a.f, tw.f) AS f, coalesce(a.t, tw.t) AS t FROM a FULL JOIN tw ON a.f = tw.f) FROM m WHERE f NOT IN (SELECT p_name || ' ' || p_size % 4 FROM part WHERE p_partkey % 7 = 0)")
def table_removes(spark, sf_dir):
    """Pairs of large parts added to a table, the last of a source, and those of every seventh part removed, whatever added them."""
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    p = p.select("p_partkey", "p_size", "p_brand", F.concat_ws(" ", "p_name", (size % 4).cast("string")).alias("from"))
    adds = p.filter("p_size > 40").select(F.lit("c").alias("table"), "from", F.col("p_brand").alias("to"), F.col("p_partkey").alias("ord"))
    return named(rulesets.mapping(rulesets.regional(part_tables(spark, sf_dir), "zh-tw"), adds, p.filter("p_partkey % 7 = 0").select("from").distinct()))


@query(f"WITH {_TW} SELECT (row_number() OVER (ORDER BY strlen(f), f) - 1)::BIGINT AS place, f, t FROM tw")
def dump_table(spark, sf_dir):
    return named(rulesets.dump_places(rulesets.regional(part_tables(spark, sf_dir), "zh-tw")), F.col("place"))


@query(f"WITH {PARTS} SELECT tab, count(*)::BIGINT AS n_pairs, count(DISTINCT f)::BIGINT AS n_sources, count(*) FILTER (f = t)::BIGINT AS n_same, count(*) FILTER (length(f) = 1)::BIGINT AS n_single, count(*) FILTER (length(f) <> length(t))::BIGINT AS n_length_changes, max(length(f))::BIGINT AS longest FROM pt GROUP BY tab")
def ruleset_stats(spark, sf_dir):
    return rulesets.stats(part_tables(spark, sf_dir)).withColumnRenamed("table", "tab")


@query(f"WITH {PARTS} SELECT tab, count(*)::BIGINT AS n FROM pt GROUP BY tab")
def engine_information(spark, sf_dir):
    return engine_info(spark, Converter(spark, part_tables(spark, sf_dir))).select(F.explode("pairs").alias("tab", "n"))


@query(f"WITH {PARTS}, h AS (SELECT p_brand, list(DISTINCT list_extract(['hant', 'hans', 'tw', 'hk', 'cn'], (p_partkey % 5 + 1)::INT)) AS l FROM part WHERE p_size > 35 GROUP BY p_brand) SELECT p_brand, tag FROM h, {sql_values([(v.tag, ','.join(v.tables)) for v in VARIANTS.values()], 'tag, need')} WHERE need = '' OR list_has_all(l, string_split(need, ','))")
def enabled_variants(spark, sf_dir):
    """The targets that each brand's tables of large parts are enough for."""
    t = read(spark, sf_dir, "part").filter("p_size > 35").select("p_brand", F.element_at(F.array(*[F.lit(t) for t in ("hant", "hans", "tw", "hk", "cn")]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("table"))
    return t.groupBy("p_brand").agg(F.collect_set("table").alias("l")).select("p_brand", F.explode(enabled_tags(F.col("l"))).alias("tag"))


_SPELLED = ["ZH", "zh-Hant", "ZH-HANS", "zh-tw", "Zh-Hk", "zh-MO", "zh-my", "ZH-sg", "zh-CN", "zh_cn", "en"]


@query(f"SELECT tag, name, script, fallbacks, count(*)::BIGINT AS n FROM documents JOIN {sql_values([(v.tag, v.name, v.script or '', ','.join(v.fallbacks)) for v in VARIANTS.values()], 'tag, name, script, fallbacks')} ON tag = lower(list_extract([{', '.join(map(q, _SPELLED))}], (doc_id % {len(_SPELLED)} + 1)::INT)) GROUP BY ALL")
def variant_table(spark, sf_dir):
    """Documents counted by the variant that each names in some spelling; unknown ones have none."""
    raw = F.element_at(F.array(*[F.lit(t) for t in _SPELLED]), (F.col("doc_id") % len(_SPELLED) + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select(normal_tag(raw).alias("tag"), variant_name(raw).alias("name"))
    v = variants_frame(spark).select("tag", F.coalesce("script", F.lit("")).alias("script"), F.array_join("fallbacks", ",").alias("fallbacks"))
    return d.join(v, "tag").groupBy("tag", "name", "script", "fallbacks").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH src AS ({CHINESE}), " + ", ".join(f"c{k} AS (WITH s{k} AS (FROM src WHERE doc_id % 4 = {k}), {sql_converted(seed_pairs(g), f's{k}') if seed_pairs(g) else f'conv AS (SELECT doc_id, text FROM s{k})'} SELECT doc_id, text FROM conv)" for k, g in enumerate(("zh-tw", "zh-cn", "zh-hk", "zh"))) + f", conv AS (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2 UNION ALL FROM c3) {DIGEST_SQL}")
def convert_by_tag_column(spark, sf_dir):
    """Each document to the variant that its row names."""
    d = chinese(spark, sf_dir)
    tags = F.array(*[F.lit(t) for t in ("ZH-TW", "zh-cn", "zh-Hk", "zh")])
    return digest(d, converter(spark).convert_by(d["text"], F.element_at(tags, (F.col("doc_id") % 4 + 1).cast("int"))))


# ---- files written from part


def _lines_file(rows: DataFrame) -> str:
    """One file with the lines of rows (at, line), in order, in the shared folder."""
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/glyphspark/file-{uuid.uuid4().hex}"
    rows.coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    return path


@query(f"WITH {PARTS} SELECT tab, f, t, (row_number() OVER (PARTITION BY tab ORDER BY ord) - 1)::BIGINT AS place FROM pt")
def table_from_arrays(spark, sf_dir):
    """The tables of part written as constant arrays and read again."""
    names = {table: (k, name) for k, (name, table) in enumerate(ARRAYS.items())}
    at = lambda k, ord_: F.struct(k.alias("k"), ord_.alias("o"))
    number = F.create_map(*[F.lit(x) for t, (k, _) in names.items() for x in (t, k)])
    rows = part_tables(spark, sf_dir).select(at(number[F.col("table")], F.col("ord").cast("long")).alias("at"), F.concat(F.lit("        '"), "from", F.lit("' => '"), "to", F.lit("',")).alias("line"))
    frame = spark.createDataFrame([x for k, name in names.values() for x in ((k, -1, f"    public const {name} = ["), (k, 1 << 60, "    ];"))], "k int, o long, line string")
    path = _lines_file(frame.select(at(F.col("k"), F.col("o")).alias("at"), "line").union(rows))
    return named(sources.read_arrays(spark, path), F.col("table").alias("tab"), F.col("ord").alias("place"))


@query(f"WITH {PARTS}, h AS (SELECT replace(f, ' ', '_') AS f, t, ord FROM pt WHERE tab = 'hant') SELECT 'forward' AS tab, f, t FROM h UNION ALL SELECT 'reverse', t, arg_min(f, ord) FROM h GROUP BY t UNION ALL SELECT 'reverse', f || 'x', f FROM h")
def table_from_dictionary(spark, sf_dir):
    """A dictionary of two values a key written from part, and read forward and in reverse."""
    h = rulesets.table(part_tables(spark, sf_dir), "hant").select("ord", F.replace("from", F.lit(" "), F.lit("_")).alias("f"), "to")
    rows = h.select(F.col("ord").alias("at"), F.concat("f", F.lit("\t"), "to", F.lit(" "), "f", F.lit("x")).alias("line"))
    path = _lines_file(spark.createDataFrame([(-1, "# a comment")], "at long, line string").union(rows))
    both = sources.read_dictionary(spark, path, "forward").unionByName(sources.read_dictionary(spark, path, "reverse", reverse=True))
    return named(both, F.col("table").alias("tab"))


# ---- groups made from part

_DESCRIBED = "CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_type ELSE '[[' || p_type || '|x]]' END"
_COMBINED = "CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_type ELSE p_name || ' / ' || p_type END"


def _described() -> Column:
    k = F.col("p_size") % 3
    return F.when(k == 0, F.concat_ws(" ", "p_name", "p_type")).when(k == 1, F.col("p_type")).otherwise(F.concat(F.lit("[["), "p_type", F.lit("|x]]")))


@query(f"SELECT name, arg_max('zh-cn:' || p_brand || ';' || chr(10) || 'zh-hk:' || p_size || ';', p_partkey) AS rules FROM (SELECT *, {_COMBINED} AS name FROM part) GROUP BY name")
def cgroup_pack(spark, sf_dir):
    """Groups of parts; of those of one combined name the last path's rules stay."""
    rule = lambda original, conv: F.struct(F.lit(original).cast("string").alias("original"), conv.alias("conv"))
    rules_ = F.array(rule(None, F.concat(F.lit("zh-cn:"), "p_brand", F.lit(";"))), rule("x", F.concat(F.lit("zh-hk:"), F.col("p_size").cast("string"), F.lit(";"))))
    p = read(spark, sf_dir, "part")
    return groups.pack(p.select(F.col("p_name").alias("name"), _described().alias("description"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"), rules_.alias("rules")))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE {_COMBINED} END AS name FROM part")
def cgroup_names(spark, sf_dir):
    """All branches: a description that holds the name, a name that holds the description, links, and neither."""
    p = read(spark, sf_dir, "part")
    inside = F.substring_index("p_name", " ", -1)
    return p.select("p_partkey", groups.combined_name(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 3, inside).otherwise(_described())).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN '' WHEN 5 THEN NULL ELSE p_name END AS original, CASE p_partkey % 8 WHEN 0 THEN 'zh-cn:' || p_brand || '=>' || p_type ELSE 'zh-tw:' || p_brand || ';' END AS conv FROM part WHERE p_partkey % 8 NOT IN (1, 7)""")
def cgroup_lines(spark, sf_dir):
    """Lines of modules and templates in all their forms, comments and others, of each part."""
    k, name, brand = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_brand")
    forms = [
        ("  {{ original = '{n}', rule = 'zh-cn:{b}{{{{=}}}}>{t}' }},", 0), ("-- Item('no', 'zh-tw:{b};')", 1), ('{{ rule = "zh-tw:{b};" }},', 2), ("Item('{n}', '<span class=\"x\">zh-tw:{b};</span>'),", 3),
        ("{{{{CItem|original={n}|zh-tw:{b};}}}}", 4), ("Item(nil, 'zh-tw:{b};'),", 5), ("{{{{CItemLan/R|{n}|zh-tw:{b};}}}}", 6), ("plain {n}", 7),
    ]
    line = F.lit(None).cast("string")
    for text, i in forms:
        parts = re.split("([{][nbt][}])", text.replace("{{", "\x01").replace("}}", "\x02"))
        made = [{"{n}": name, "{b}": brand, "{t}": F.col("p_type")}.get(x, F.lit(x.replace("\x01", "{").replace("\x02", "}"))) for x in parts]
        line = F.when(k == i, F.concat(*made)).otherwise(line)
    r = read(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    r = r.select("p_partkey", F.coalesce(groups.module_line(F.col("line")), groups.template_line(F.col("line"))).alias("r")).filter("r is not null")
    return r.select("p_partkey", "r.original", groups.clean(F.col("r.conv")).alias("conv"))


# ---- rules and requests made from columns


@query("SELECT doc_id, action, f, t FROM (SELECT doc_id, unnest(['add', 'add', 'remove']) AS action, unnest([s, g, s || 'x']) AS f, unnest([g, g, g || 'y']) AS t FROM (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS g FROM documents))")
def page_pairs_of_rules(spark, sf_dir):
    """What a page's rules add and remove, of its source and language."""
    d = read(spark, sf_dir, "documents")
    s, g = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    text = F.concat(F.lit("-{H|zh:"), s, F.lit(";zh-mo:"), g, F.lit("}- -{-|"), s, F.lit("x=>zh-hk:"), g, F.lit("y;x=>zh-cn:z}- -{D|zh-tw:q}- -{Q|bad}- "), F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.explode(page_pairs(text, "zh-hk")).alias("p")).select("doc_id", "p.action", F.col("p.from").alias("f"), F.col("p.to").alias("t"))


@query("""SELECT id, status, CASE WHEN status = 200 THEN CASE WHEN wiki THEN CASE turn % 4 WHEN 2 THEN 'x' ELSE role END ELSE '-{zh-tw:' || role || ';zh-hk:x}-' END || CASE turn % 4 WHEN 3 THEN '国 ' ELSE '國 ' END || text END AS body
FROM (SELECT *, conv_id * 1000 + turn AS id, role = 'user' AS wiki, CASE WHEN conv_id % 6 = 5 THEN 401 WHEN turn % 4 = 1 THEN 404 WHEN turn % 5 = 4 OR strlen('-{zh-tw:' || role || ';zh-hk:x}-国 ' || text) > 600 THEN 400 ELSE 200 END AS status FROM conversations)""")
def service_requests(spark, sf_dir):
    """Turns of conversations as requests: to several targets and an unknown one, without a token, without a body, and beyond the limit."""
    c, turn = read(spark, sf_dir, "conversations"), F.col("turn")
    target = F.element_at(F.array(*[F.lit(t) for t in ("zh-TW", "xx", "zh-hk", "ZH")]), (turn % 4 + 1).cast("int"))
    body = F.concat(F.lit("-{zh-tw:"), "role", F.lit(";zh-hk:x}-国 "), "text")
    d = c.select((F.col("conv_id") * 1000 + turn).alias("id"), target.alias("target"), (F.col("role") == "user").alias("wikitext"), F.when(turn % 5 != 4, body).alias("body"), F.when(F.col("conv_id") % 6 != 5, "t").alias("token"))
    return requests(d, converter(spark), limit=600, token="t")


_TALKS = f"src AS (SELECT conv_id || '/' || turn AS k, conv_id, turn, role, text FROM conversations), {sql_converted(LATIN, key='k')}"


@query(f"WITH {_TALKS} SELECT conv_id, string_agg(turn || role || conv.text || '/' || src.text || '/' || conv.text || '=' || conv.text, '|' ORDER BY turn) AS talk FROM src JOIN conv USING (k) GROUP BY conv_id")
def convert_deep_conversations(spark, sf_dir):
    """Conversations gathered into arrays of structs that hold texts, arrays of structs, and maps whose keys are texts too."""
    c = read(spark, sf_dir, "conversations")
    turn = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), t["text"].alias("raw"), F.array(F.struct(t["text"].alias("said"))).alias("parts"), F.create_map(t["text"], t["text"]).alias("by"))
    talks = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l")).select("conv_id", F.struct(F.transform("l", turn).alias("turns")).alias("talk"))
    latin = Converter(spark, spark.createDataFrame([("hans", f, t, i) for i, (f, t) in enumerate(LATIN.items())], "`table` string, `from` string, `to` string, ord long"))
    done = latin.convert_struct(talks, ["talk.turns.text", "talk.turns.parts.said", "talk.turns.by"], "zh-hans")
    # the key of a map is the text as it was
    shown = lambda t: F.concat(t["turn"].cast("string"), t["role"], t["text"], F.lit("/"), t["raw"], F.lit("/"), t["parts"][0]["said"], F.lit("="), t["by"][t["raw"]])
    return done.select("conv_id", F.array_join(F.transform("talk.turns", shown), "|").alias("talk"))


# ---- dictionaries composed in stages, made from part


def part_dictionaries(spark: SparkSession, sf_dir: str) -> Callable[[str], tuple[DataFrame, DataFrame]]:
    """Dictionaries between names, <name>, types, [type], and types as regions write them, {type} and |type|, with phrases, <name>! and [type!]."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", (F.col("p_size") % 4).cast("string")).alias("a"), F.concat("p_type", (F.col("p_size") % 2).cast("string")).alias("t"))
    of_name = p.groupBy("a").agg(F.min_by("t", "p_partkey").alias("t"), F.min("p_partkey").alias("k"))
    of_type = of_name.groupBy("t").agg(F.min_by("a", "k").alias("a"))
    text = lambda form: F.concat(*[F.col(x) if x in ("a", "t") else F.lit(x) for x in form])

    def pairs(rows: DataFrame, src: tuple, dst: tuple) -> DataFrame:
        return rows.select(text(src).alias("from"), text(dst).alias("to"))

    name, phrase, kind, kinds, tw, hk, words = ("<", "a", ">"), ("<", "a", ">!"), ("[", "t", "]"), ("[", "t", "!]"), ("{", "t", "}"), ("|", "t", "|"), ("(", "t", ")")
    made = {
        "STCharacters": (pairs(of_name, name, kind), pairs(of_type, kind, name)), "STPhrases": (pairs(of_name, phrase, kinds), pairs(of_type, kinds, phrase)), "TSCharacters": (pairs(of_type, kind, name), pairs(of_type, name, kind)), "TSPhrases": (pairs(of_type, kinds, ("<", "t", ">")), pairs(of_type, ("<", "t", ">"), kinds)),
        "TWVariants": (pairs(of_type, kind, tw), pairs(of_type, tw, kind)), "TWPhrases": (pairs(of_type, kinds, words), pairs(of_type, words, kinds)), "HKVariants": (pairs(of_type, kind, hk), pairs(of_type, hk, kind)), "TWVariantsRevPhrases": (pairs(of_type, tw, kind), pairs(of_type, kind, tw)), "HKVariantsRevPhrases": (pairs(of_type, hk, kind), pairs(of_type, kind, hk)),
    }
    return made.__getitem__


_NAMES = "n AS (SELECT p_name || ' ' || p_size % 4 AS a, arg_min(p_type || p_size % 2, p_partkey) AS t, min(p_partkey) AS k FROM part GROUP BY a), y AS (SELECT t, arg_min(a, k) AS a FROM n GROUP BY t)"
_PLAIN = """SELECT 'hans' AS tab, '[' || t || ']' AS f, '<' || a || '>' AS t FROM y UNION ALL SELECT 'hans', '[' || t || '!]', '<' || t || '>' FROM y
UNION ALL SELECT 'hant', '<' || a || '>', '[' || t || ']' FROM n UNION ALL SELECT 'hant', '<' || a || '>!', '[' || t || '!]' FROM n
UNION ALL SELECT 'hk', '<' || a || '>', '|' || t || '|' FROM n UNION ALL SELECT 'hk', '<' || a || '>!', '[' || t || '!]' FROM n UNION ALL SELECT 'hk', '[' || t || ']', '|' || t || '|' FROM y
UNION ALL SELECT 'tw', '<' || a || '>', '{' || t || '}' FROM n UNION ALL SELECT 'tw', '[' || t || ']', '{' || t || '}' FROM y
UNION ALL SELECT 'cn', '{' || t || '}', '<' || a || '>' FROM y UNION ALL SELECT 'cn', '|' || t || '|', '<' || a || '>' FROM y UNION ALL SELECT 'cn', '[' || t || ']', '<' || a || '>' FROM y UNION ALL SELECT 'cn', '[' || t || '!]', '<' || t || '>' FROM y"""


@query(f"WITH {_NAMES} {_PLAIN} UNION ALL SELECT 'tw', '<' || a || '>!', '[' || t || '!]' FROM n")
def table_composed(spark, sf_dir):
    """All five tables in stages."""
    made = compose(spark, RulesetConfig(arrays=False, dictionaries=True), None, part_dictionaries(spark, sf_dir))
    return named(made, F.col("table").alias("tab"))


@query(f"WITH {_NAMES} {_PLAIN} UNION ALL SELECT 'tw', '<' || a || '>!', '(' || t || ')' FROM n UNION ALL SELECT 'tw', '[' || t || '!]', '(' || t || ')' FROM y UNION ALL SELECT 'cn', '(' || t || ')', '<' || t || '>' FROM y")
def flattened_stages(spark, sf_dir):
    """All five tables with the phrases of one region between the stages of others."""
    made = compose(spark, RulesetConfig(arrays=False, dictionaries=True, taiwan_phrases=True), None, part_dictionaries(spark, sf_dir))
    return named(made, F.col("table").alias("tab"))


# ---- converters over a base


@query(f"WITH src AS ({CHINESE}), {sql_converted({**seed_pairs('zh-tw'), **OVERLAY, **LATIN})} {DIGEST_SQL}")
def make_converter_based(spark, sf_dir):
    """A converter of a file of pairs over a variant's tables."""
    rows = spark.createDataFrame([(i, f"{f} {t}") for i, (f, t) in enumerate({**OVERLAY, **LATIN}.items())], "at int, line string")
    fn = make_converter(spark, "zh-tw", _lines_file(rows))
    d = chinese(spark, sf_dir)
    return digest(d, fn(d["text"]))


@query(f"WITH {PARTS} SELECT tab, f, t, row_number() OVER (PARTITION BY tab, strlen(f) ORDER BY f)::BIGINT AS place, strlen(f)::BIGINT AS n FROM pt")
def table_longest_first(spark, sf_dir):
    """The tables of part from the longest source: places within a table and a length, as the rows stand."""
    rows = rulesets.longest_first(part_tables(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("table", F.octet_length("from")).orderBy("at")).cast("long")
    return named(rows, F.col("table").alias("tab"), place.alias("place"), F.octet_length("from").cast("long").alias("n"))
