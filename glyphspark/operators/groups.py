"""Conversion groups: reading rules from module and template lines, naming, packing and applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Templates that hold a rule, by where the rule and its original stand.
RULE_FIRST = ["CI", "CItem", "CItemHidden", "CNoteA", "CItemLan"]
RULE_SECOND = ["CItemLan/R"]
NAMED_ORIGINAL = ["CI", "CItem", "CItemHidden", "CNoteA"]
HEADER = "CGroupH"
_QUOTED = r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')"""
# The size of the smallest page, and pages that are no groups.
LEAST_SIZE = 66
NOT_MODULES = ["Module:CGroup/core", "Module:CGroup/preload", "Module:CGroup/sandbox", "Module:CGroup/Sandbox"]
NOT_TEMPLATES = ["Template:CGroup/doc", "Template:CGroup/list", "Template:CGroup/preload", "Template:CGroup/sandbox", "Template:CGroup/CHead", "Template:CGroup/editintro", "Template:CGroup/New Style"]


def _pick(text: Column, pattern: str, *groups: int) -> Column:
    """The first of some groups that isn't empty, else the empty text."""
    found = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]
    return F.coalesce(*found, F.lit(""))


def module_line(line: Column) -> Column:
    """struct<original, conv> of a table or Item line of a module; null for others and for comments. Nothing is evaluated."""
    s = F.rtrim(F.regexp_replace(F.trim(line), r",+$", ""))
    table = F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")) & F.regexp_like(s, F.lit(r"\b(?:original|rule)\s*=\s*['\"]"))
    item = r"^Item\(\s*(?:" + _QUOTED + r"|nil)\s*,\s*" + _QUOTED + r".*\)$"
    by_key = F.struct(_pick(s, r"\boriginal\s*=\s*" + _QUOTED, 1, 2).alias("original"), _pick(s, r"\brule\s*=\s*" + _QUOTED, 1, 2).alias("conv"))
    first = F.when(F.regexp_like(s, F.lit(r"^Item\(\s*nil")), F.lit(None).cast("string")).otherwise(_pick(s, item, 1, 2))
    by_place = F.struct(first.alias("original"), _pick(s, item, 3, 4).alias("conv"))
    return F.when(F.startswith(s, F.lit("--")), None).when(table, by_key).when(F.regexp_like(s, F.lit(item)), by_place)


def calls(text: Column) -> Column:
    """array<struct<name, args: array<struct<key, value>>>> of the template calls of a text that hold no other call.

    The bars of a call part its arguments, but for those of links. An argument
    is named by what stands before its first equal sign, or else numbered;
    an escaped equal sign, ``{{=}}``, names nothing and stays as it is.
    """
    escaped, bar = "\u0001", "\u0002"
    t = F.replace(text, F.lit("{{=}}"), F.lit(escaped))
    t = F.regexp_replace(t, r"(\[\[[^\[\]|]*)\|([^\[\]]*\]\])", f"$1{bar}$2")
    shown = lambda x: F.replace(F.replace(x, F.lit(escaped), F.lit("{{=}}")), F.lit(bar), F.lit("|"))
    name = r"^\s*([A-Za-z0-9]+)\s*=(?!>)"

    def parsed(inner: Column) -> Column:
        def of(parts: Column) -> Column:
            args = F.slice(parts, 2, F.size(parts))
            free = lambda x: ~F.regexp_like(x, F.lit(name))
            number = lambda i: F.size(F.filter(F.slice(args, 1, i + 1), free)).cast("string")
            pairs = F.transform(args, lambda x, i: F.when(free(x), F.struct(number(i).alias("key"), F.ltrim(shown(x)).alias("value"))).otherwise(F.struct(F.regexp_extract(x, name, 1).alias("key"), F.trim(shown(F.regexp_replace(x, name, ""))).alias("value"))))
            return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), pairs.alias("args"))

        return F.get(F.transform(F.array(F.split(inner, r"\|", -1)), of), F.lit(0))

    return F.transform(F.regexp_extract_all(t, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1)), parsed)


def argument(call: Column, key: str) -> Column:
    """The last value of an argument; null if the call has none."""
    return F.try_element_at(F.filter(call["args"], lambda a: a["key"] == key), F.lit(-1))["value"]


def template_line(line: Column) -> Column:
    """struct<original, conv> of the first rule template of a line that has a rule; null if there is none."""

    def rule(call: Column) -> Column:
        second = F.when(call["name"].isin(*NAMED_ORIGINAL), argument(call, "original")).otherwise(argument(call, "2"))
        reverse = call["name"].isin(*RULE_SECOND)
        original, conv = F.when(reverse, argument(call, "1")).otherwise(second), F.when(reverse, argument(call, "2")).otherwise(argument(call, "1"))
        return F.struct(F.nullif(F.trim(original), F.lit("")).alias("original"), conv.alias("conv"))

    rules = F.transform(F.filter(calls(line), lambda c: c["name"].isin(*RULE_FIRST, *RULE_SECOND)), rule)
    return F.get(F.filter(rules, lambda r: F.length(F.trim(r["conv"])) > 0), F.lit(0))


def header(text: Column) -> Column:
    """struct<name, description> of a page, from assigned strings or else a header template; null if it has none. Language templates give their text."""
    t = F.regexp_replace(text, r"\{\{\s*lang\s*\|[^{}|]*\|([^{}|]*)\}\}", "$1")
    assigned = lambda word: r"(?<![\w.])" + word + r"\s*=\s*" + _QUOTED
    name, desc = assigned("name"), assigned("description")
    module = F.struct(_pick(t, name, 1, 2).alias("name"), _pick(t, desc, 1, 2).alias("description"))
    both = F.regexp_like(t, F.lit(name)) & F.regexp_like(t, F.lit(desc)) & (module["name"] != "")
    found = F.transform(F.filter(calls(t), lambda c: c["name"] == HEADER), lambda c: F.struct(argument(c, "name").alias("name"), argument(c, "desc").alias("description")))
    return F.when(both, module).otherwise(F.get(F.filter(found, lambda h: h["name"].isNotNull() & h["description"].isNotNull()), F.lit(0)))


def clean(conv: Column) -> Column:
    """A rule with escaped equal signs restored and notices' spans stripped."""
    return F.regexp_replace(F.replace(conv, F.lit("{{=}}"), F.lit("=")), r"(?i)</?span\b[^<>]*>", "")


def is_group_page(title: Column, size: Column, snippet: Column) -> Column:
    """Whether a page holds a group: no helper, sub-page or redirect, and not too small."""
    module, template = F.startswith(title, F.lit("Module:CGroup/")), F.startswith(title, F.lit("Template:CGroup/"))
    direct = ~F.contains(F.regexp_replace(title, "^(?:Module|Template):CGroup/", ""), F.lit("/"))
    redirect = (module & F.contains(snippet, F.lit("return require("))) | (template & (F.contains(snippet, F.lit("#重定向")) | F.contains(snippet, F.lit("#REDIRECT"))))
    return (module | template) & direct & ~title.isin(*NOT_MODULES, *NOT_TEMPLATES) & (size >= LEAST_SIZE) & ~redirect


def harvest(pages: DataFrame) -> DataFrame:
    """Groups (name, description, path, rules) from pages (title, text, size, snippet)."""
    kept = pages.filter(is_group_page(F.col("title"), F.col("size"), F.col("snippet"))).withColumn("h", header(F.col("text"))).filter("h is not null")
    line = lambda x: F.when(F.startswith(F.col("title"), F.lit("Module:")), module_line(x)).otherwise(template_line(x))
    rules = F.transform(F.filter(F.transform(F.split("text", "\n"), line), lambda r: r.isNotNull()), lambda r: F.struct(r["original"].alias("original"), clean(r["conv"]).alias("conv")))
    return kept.select("h.name", "h.description", F.col("title").alias("path"), rules.alias("rules"))


def combined_name(name: Column, description: Column) -> Column:
    """One name for a group: the one that holds the other, or both; links by their target."""
    n, d = F.trim(name), F.trim(description)
    both = F.when(F.contains(d, n), d).when(F.contains(n, d), n).otherwise(F.concat(n, F.lit(" / "), d))
    return F.regexp_replace(both, r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]", "$1")


def pack(groups: DataFrame) -> DataFrame:
    """(name, rules): the rules of each group as lines; of groups with one name the last path's stay."""
    rows = groups.select(combined_name(F.col("name"), F.col("description")).alias("name"), F.array_join(F.transform("rules", lambda r: r["conv"]), "\n").alias("rules"), "path")
    return rows.groupBy("name").agg(F.max_by("rules", "path").alias("rules"))


def chosen_lines(packed: DataFrame, names: list[str]) -> str:
    """The rules of some groups as one text, in the order of names."""
    got = {r.name: r.rules for r in packed.filter(F.col("name").isin(*names)).collect()}
    return "\n".join(got[n] for n in names if n in got)
