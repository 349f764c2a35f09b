"""SQL functions and table functions.

After register(spark): convert_variant(text, tag), convert_markup(text, tag),
count_replaced(text, tag), is_hans(text), is_hans_confidence(text),
infer_variant(text), page_title(text, tag), matched_spans(text, tag),
parsed_rules(text), and over the last two, which work on Arrow batches, the
table functions variant_matches(text, tag) and markup_rules(text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..variants import DETECTED, TIES, parse
from .columns import _SPANS, SPANS, Converter, Shared, by_tag, each, nulls
from .markup import MarkupConverter, PageRules, RuleError, extract_rules, parse_rule
from .matcher import groups_of


RULES = pa.list_(pa.struct([("place", pa.int32()), *((n, pa.string()) for n in ("inner", "action", "output", "error"))]))


def parsed_rules(text: str) -> list[dict]:
    """The one-line rules of a text, each with what it does or why it can't be read."""
    out = []
    for i, inner in enumerate(extract_rules(text)):
        row = {"place": i, "inner": inner, "action": None, "output": None, "error": None}
        try:
            r = parse_rule(inner)
            out.append(row | {"action": r.action, "output": r.output})
        except RuleError as e:
            out.append(row | {"error": e.kind})
    return out


def register(spark: SparkSession, converter: Converter | None = None) -> Converter:
    c = converter or Converter(spark)
    held = Shared(spark, c.matchers)
    markup = Shared(spark, {t: MarkupConverter(m, t) for t, m in c.matchers.items()})

    def two(fn, kind=pa.string()):  # noqa: B008
        return lambda texts, tags: by_tag(texts, tags, fn, kind)

    def of_each(fn, kind):
        return lambda tag, texts: each(lambda t: fn(t, tag), kind)(texts)

    def put(name: str, fn, kind: str) -> None:
        spark.udf.register(name, F.arrow_udf(fn, kind))

    def counted(texts: pa.Array, names) -> list[np.ndarray]:
        groups = groups_of(texts)
        return [held.get()[v].replaced_array(texts, groups) for v in names]

    def share(texts: pa.Array) -> np.ndarray:
        hant, hans = counted(texts, ("zh-hant", "zh-hans"))
        return np.where(hant + hans > 0, hant / np.maximum(hant + hans, 1), np.nan)

    def likeliest(texts: pa.Array) -> list[str]:
        """As columns.ranked_confidences(): zero counts leave the order of ties."""
        n = dict(zip(DETECTED, counted(texts, DETECTED), strict=True))
        total = (n["zh-cn"] + n["zh-tw"] + n["zh-hk"] - n["zh-hant"]).astype(np.float32)
        part = np.where(total == 0, np.float32(1), total)
        conf = {v: np.where(total == 0, np.float32(0), np.float32(1) - np.minimum(k.astype(np.float32), total) / part) for v, k in n.items()}
        alike = (conf["zh-tw"] == conf["zh-hk"]) & (total != 0)
        best = {a: np.stack([conf[v] for v in TIES[a]]).argmax(axis=0) for a in (True, False)}
        return [TIES[a][best[a][i]] for i, a in enumerate(alike.tolist())]

    put("convert_variant", two(lambda g, t: held.get()[g].convert_array(t)), "string")
    put("convert_markup", two(of_each(lambda t, g: markup.get()[g].convert(t), pa.string())), "string")
    put("count_replaced", lambda ts, gs: by_tag(ts, gs, lambda g, t: pa.array(held.get()[g].replaced_array(t), pa.int32(), mask=nulls(t)), pa.int32()), "int")
    put("page_title", two(of_each(lambda t, g: PageRules.of(t).title_for(g), pa.string())), "string")
    put("infer_variant", lambda ts: pa.array(likeliest(ts), pa.string(), mask=nulls(ts)), "string")
    put("is_hans", lambda ts: pa.array(share(ts) > 0.5, pa.bool_(), mask=nulls(ts)), "boolean")
    put("is_hans_confidence", lambda ts: pa.array(share(ts), pa.float32(), mask=nulls(ts)), "float")

    put("matched_spans", two(lambda g, t: held.get()[g].spans_array(t), _SPANS), SPANS)
    put("parsed_rules", each(parsed_rules, RULES), "array<struct<place:int,inner:string,action:string,output:string,error:string>>")
    table = lambda name, args, cols, of: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({cols}) RETURN SELECT m.* FROM explode({of}) AS t(m)")
    table("variant_matches", "text STRING, tag STRING", "start INT, `end` INT, src STRING, dst STRING", "matched_spans(text, tag)")
    table("markup_rules", "text STRING", "place INT, inner STRING, action STRING, output STRING, error STRING", "parsed_rules(text)")
    return c


def engine_info(spark: SparkSession, converter: Converter):
    """One row: version, pairs by table, and the variants that can be converted to."""
    from .. import __version__

    n = {r["table"]: r["n"] for r in converter.pairs.groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()}
    return spark.createDataFrame([(__version__, n, converter.enabled())], "version string, pairs map<string,long>, variants array<string>")
