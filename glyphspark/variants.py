"""Variant tags, their names, fallbacks and the tables they are built from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Variant:
    """A tag with its display name, script, base table, regional table, and the tags whose text stands in for its own."""

    tag: str
    name: str
    script: str | None
    tables: tuple[str, ...]
    fallbacks: tuple[str, ...]


# Tags, display names, tables and fallback orders.
_ALL = [
    Variant("zh", "原文", None, (), ("zh-hans", "zh-hant", "zh-cn", "zh-tw", "zh-hk", "zh-sg", "zh-mo", "zh-my")),
    Variant("zh-hant", "繁体", "hant", ("hant",), ("zh-tw", "zh-hk", "zh-mo")),
    Variant("zh-hans", "简体", "hans", ("hans",), ("zh-cn", "zh-sg", "zh-my")),
    Variant("zh-tw", "臺灣", "hant", ("hant", "tw"), ("zh-hant", "zh-hk", "zh-mo")),
    Variant("zh-hk", "香港", "hant", ("hant", "hk"), ("zh-hant", "zh-mo", "zh-tw")),
    Variant("zh-mo", "澳門", "hant", ("hant", "hk"), ("zh-hant", "zh-hk", "zh-tw")),
    Variant("zh-my", "大马", "hans", ("hans", "cn"), ("zh-hans", "zh-sg", "zh-cn")),
    Variant("zh-sg", "新加坡", "hans", ("hans", "cn"), ("zh-hans", "zh-cn", "zh-my")),
    Variant("zh-cn", "大陆", "hans", ("hans", "cn"), ("zh-hans", "zh-sg", "zh-my")),
]
VARIANTS = {v.tag: v for v in _ALL}
#: Tags with a table of their own, for detection.
DETECTED = ("zh-cn", "zh-tw", "zh-hk", "zh-hant", "zh-hans")
# The order of tied confidences, by whether Taiwan's and Hong Kong's are alike.
TIES = {True: ["zh-hans", "zh-hant", "zh-tw", "zh-cn", "zh-hk"], False: ["zh-tw", "zh-hk", "zh-hant", "zh-hans", "zh-cn"]}
#: Tags that global rules have no two-way pairs for.
WITHOUT_PAIRS = ("zh", "zh-hant", "zh-hans")


def parse(tag: str) -> Variant:
    """The variant of a tag, in any case of ASCII letters; ValueError if there is none."""
    try:
        return VARIANTS["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in tag)]
    except (KeyError, TypeError):
        raise ValueError(f"no such variant: {tag!r}") from None


def enabled(tables: set[str]) -> list[str]:
    """Tags that can be converted to with the tables at hand."""
    return [v.tag for v in _ALL if set(v.tables) <= tables]


def enabled_tags(tables: Column) -> Column:
    """enabled() of an array column of tables."""
    all_ = F.array(*[F.struct(F.lit(v.tag).alias("tag"), F.array(*[F.lit(t) for t in v.tables]).cast("array<string>").alias("tables")) for v in _ALL])
    return F.transform(F.filter(all_, lambda v: F.size(F.array_except(v["tables"], tables)) == 0), lambda v: v["tag"])


def variants_frame(spark: SparkSession) -> DataFrame:
    """One row for each variant: tag, name, script, tables, fallbacks, alias_of."""
    rows = [(v.tag, v.name, v.script, list(v.tables), list(v.fallbacks), {"zh-mo": "zh-hk", "zh-sg": "zh-cn", "zh-my": "zh-cn"}.get(v.tag)) for v in _ALL]
    return spark.createDataFrame(rows, "tag string, name string, script string, tables array<string>, fallbacks array<string>, alias_of string")
