"""Column functions: conversion, matches, markup and detection of variants.

A ``Converter`` holds compiled dictionaries behind a broadcast, which each
Python worker unpacks once. Its functions take and return Columns and work alike
on batch and streaming frames. Texts cross to Python in Arrow batches; only the
text column does. Counting and choosing around them are Spark's own
expressions. Null in, null out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rulesets
from ..sources import rulesets as sources
from ..variants import DETECTED, TIES, VARIANTS, enabled, parse
from . import rules
from .arrays import let
from .markup import MarkupConverter, conv_lines
from .matcher import Matcher, PassingMatcher, groups_of

SPANS = "array<struct<start:int,`end`:int,src:string,dst:string>>"
CONV = "struct<asis:string,both:map<string,string>,one_way:array<struct<variant:string,`from`:string,`to`:string>>>"
RULE = f"struct<action:string,output:string,variant:string,sets_title:boolean,conv:{CONV},error:string>"
PAGE = f"struct<title:map<string,string>,actions:array<struct<action:string,conv:{CONV}>>>"

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("src", pa.string()), ("dst", pa.string())]))
_COUNTS = pa.struct([(t.replace("-", "_"), pa.int32()) for t in DETECTED])


@lru_cache(maxsize=64)
def _unpacked(digest: str, data: bytes) -> object:
    return pickle.loads(data)


class Shared:
    """A value that each worker unpickles once: the bytes go by broadcast."""

    def __init__(self, spark: SparkSession, value: object):
        data = pickle.dumps(value)
        self.digest = hashlib.sha256(data).hexdigest()
        self.sent = spark.sparkContext.broadcast(data)

    def get(self):
        return _unpacked(self.digest, self.sent.value)


def each(fn: Callable[[str], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """An Arrow function from one of a text; nulls stay."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], kind)

    return run


def nulls(texts: pa.Array) -> np.ndarray:
    return texts.is_null().to_numpy(zero_copy_only=False)


def by_tag(texts: pa.Array, tags: pa.Array, fn: Callable[[str, pa.Array], pa.Array], kind: pa.DataType = pa.string()) -> pa.Array:
    """fn(tag, texts) of the texts of each tag, in their order; null where either is."""
    rows, done = [np.flatnonzero(nulls(tags))], [pa.nulls(tags.null_count, kind)]
    for name in pc.unique(tags.drop_null()).to_pylist():
        at = np.flatnonzero(pc.fill_null(pc.equal(tags, name), False).to_numpy(zero_copy_only=False))
        rows.append(at)
        done.append(fn(parse(name).tag, texts.take(pa.array(at))))
    order = np.argsort(np.concatenate(rows), kind="stable")
    return pa.concat_arrays(done).take(pa.array(order))


def _arrow(kind: str, fn: Callable[..., pa.Array], *cols: Column) -> Column:
    return F.arrow_udf(fn, kind)(*cols)


class Converter:
    """Conversion to all variants with a set of tables.

    ``pairs`` are rows (table, from, to, ord); by default those of ``path``,
    of the environment, or the packaged seed.
    """

    def __init__(self, spark: SparkSession, pairs: DataFrame | None = None, path: str | None = None):
        self.spark = spark
        self.pairs = pairs if pairs is not None else sources.load(spark, path)
        rows = rulesets.bounded(self.pairs)
        found = rulesets.compiled(rows)
        self.matchers = {v.tag: found.get(v.tag) or found.get("zh-hk" if v.tag == "zh-mo" else "zh-cn") if v.tables else Matcher({}) for v in VARIANTS.values()}
        self.tables = {r["table"] for r in rows}
        self._shared: dict[tuple, Shared] = {}

    def shared(self, key: tuple, make: Callable[[], object]) -> Shared:
        if key not in self._shared:
            self._shared[key] = Shared(self.spark, make())
        return self._shared[key]

    def enabled(self) -> list[str]:
        """Tags that can be converted to."""
        return enabled(self.tables)

    def _base(self, target: str) -> Matcher:
        v = parse(target)
        if missing := set(v.tables) - self.tables:
            raise ValueError(f"no tables for {v.tag}: {sorted(missing)}")
        return self.matchers[v.tag]

    def overlay(self, target: str, pairs: Iterable[tuple[str, str]] = (), lines: str | None = None) -> dict[str, str]:
        """Conversions from pairs, and over them those of rule lines for a target."""
        return {**dict(pairs), **(conv_lines(lines, parse(target).tag) if lines else {})}

    def convert(self, text: Column, target: str, pairs: Iterable[tuple[str, str]] = (), lines: str | None = None, removed: Iterable[str] = ()) -> Column:
        """Leftmost-longest conversion; given rules shadow the tables, and removed targets are disabled."""
        tag, over, off = parse(target).tag, self.overlay(target, pairs, lines), frozenset(removed)
        base = self._base(tag)
        if not base:
            return text  # nothing to convert with, overlays included
        if off:
            held = self.shared((tag, "passing", tuple(over.items()), off), lambda: PassingMatcher(base, Matcher(over), off))
            return _arrow("string", lambda t: held.get().convert_array(t), text)
        held = self.shared((tag, tuple(over.items())), lambda: base.merged(Matcher(over)) if over else base)
        return _arrow("string", lambda t: held.get().convert_array(t), text)

    def convert_by(self, text: Column, tag: Column) -> Column:
        """Conversion to the variant that each row names; an unknown tag is an error."""
        held = self.shared(("all",), lambda: self.matchers)
        return _arrow("string", lambda texts, tags: by_tag(texts, tags, lambda tag, t: held.get()[tag].convert_array(t)), text, tag)

    def convert_markup_by(self, text: Column, tag: Column) -> Column:
        """Conversion of text with markup to the variant that each row names; an unknown tag is an error."""
        held = self.shared(("all", "markup"), lambda: {t: MarkupConverter(m, t) for t, m in self.matchers.items()})
        return _arrow("string", lambda texts, tags: by_tag(texts, tags, lambda tag, t: each(held.get()[tag].convert, pa.string())(t)), text, tag)

    def convert_markup(self, text: Column, target: str, skip_code: bool = True, global_rules: bool = True, pairs: Iterable[tuple[str, str]] = (), lines: str | None = None, removed: Iterable[str] = ()) -> Column:
        """Conversion of text with markup. Texts without rules or code take the path of convert()."""
        tag, over, off = parse(target).tag, self.overlay(target, pairs, lines), set(removed)
        marked = F.contains(text, F.lit("-{"))
        if skip_code:
            marked |= F.regexp_like(text, F.lit("<(?:script|style|code>|pre)"))
        held = self.shared((tag, "markup", skip_code, global_rules, tuple(over.items()), frozenset(off)), lambda: MarkupConverter(self._base(tag), tag, skip_code, global_rules, over, off))
        rich = _arrow("string", lambda t: each(held.get().convert, pa.string())(t), F.when(marked, text))
        return F.when(marked, rich).otherwise(self.convert(F.when(~marked, text), target, over.items(), removed=off))

    def matches(self, text: Column, target: str) -> Column:
        """All matches as array<struct<start, end, src, dst>>, in code points, end exclusive."""
        held = self.shared((parse(target).tag, ()), lambda: self._base(target))
        return _arrow(SPANS, lambda t: held.get().spans_array(t), text)

    def replaced(self, text: Column, target: str) -> Column:
        """Characters that conversion to the target would replace by others."""
        held = self.shared((parse(target).tag, ()), lambda: self._base(target))
        return _arrow("int", lambda t: pa.array(held.get().replaced_array(t), pa.int32(), mask=nulls(t)), text)

    def counts(self, text: Column) -> Column:
        """struct of replaced characters for the five detected variants, in one pass of a batch: the texts' code points are found once."""
        held = self.shared(("counts",), lambda: {t.replace("-", "_"): self._base(t) for t in DETECTED})

        def run(texts: pa.Array) -> pa.Array:
            groups = groups_of(texts)
            n = [pa.array(m.replaced_array(texts, groups), pa.int32()) for m in held.get().values()]
            return pa.StructArray.from_arrays(n, fields=list(_COUNTS), mask=texts.is_null())

        kind = "struct<" + ",".join(f"{t.replace('-', '_')}:int" for t in DETECTED) + ">"
        return _arrow(kind, run, text)

    def is_hans_confidence(self, text: Column) -> Column:
        return hans_confidence(self.counts(text))

    def is_hans(self, text: Column) -> Column:
        c = self.is_hans_confidence(text)
        return ~F.isnan(c) & (c > 0.5)

    def infer_confidence(self, text: Column) -> Column:
        return ranked_confidences(self.counts(text))

    def infer(self, text: Column, default: str | None = None) -> Column:
        """The likeliest variant. Where nothing tells, it is zh-tw by the order of ties, or the default given."""
        best = F.element_at(self.infer_confidence(text), 1)
        return best["variant"] if default is None else F.when(F.isnan(best["confidence"]), F.lit(default)).otherwise(best["variant"])

    def convert_struct(self, df: DataFrame, paths: list[str] | None, target: str) -> DataFrame:
        """Converts the texts of nested columns, of any depth.

        A path names fields by dots; arrays, and maps by their values, are
        walked through, keys stay. It may end above texts: then all below are
        converted. No paths: all texts of all columns. Nulls stay on every level.
        """
        tag = parse(target).tag
        if not self._base(tag):
            return df
        held = self.shared((tag, ()), lambda: self._base(tag))
        kinds = {f.name: f.dataType for f in df.schema.fields}
        by_top: dict[str, list[list[str]]] = {c: [[]] for c, kind in kinds.items() if paths is None and _reaches(kind, [])}
        for p in paths or []:
            top, *rest = p.split(".")
            by_top.setdefault(top, []).append(rest)
        missing = [t for t in by_top if t not in kinds] + [".".join([t, *rest]) for t, rs in by_top.items() if t in kinds for rest in rs if not _reaches(kinds[t], rest)]
        if missing:
            raise ValueError(f"no texts at {missing}")

        def one(name: str, rests: list[list[str]]) -> Column:
            return _arrow(kinds[name].simpleString(), lambda a: walked(a, rests, lambda t: held.get().convert_array(t)), F.col(f"`{name}`")).alias(name)

        return df.select(*[one(c, by_top[c]) if c in by_top else F.col(f"`{c}`") for c in df.columns])


def _reaches(kind: T.DataType, rest: list[str]) -> bool:
    """Whether there are texts at a path."""
    if isinstance(kind, T.ArrayType):
        return _reaches(kind.elementType, rest)
    if isinstance(kind, T.MapType):
        return _reaches(kind.valueType, rest)
    if isinstance(kind, T.StructType):
        return any(_reaches(f.dataType, rest[1:]) for f in kind.fields if not rest or f.name == rest[0])
    return not rest and isinstance(kind, T.StringType)


def walked(a: pa.Array, paths: list[list[str]], fn: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A nested Arrow array with fn applied to the arrays of texts at paths, each a whole array of all rows."""
    if pa.types.is_string(a.type):
        return fn(a) if [] in paths else a
    if pa.types.is_list(a.type) or pa.types.is_map(a.type):
        gaps = nulls(a)
        sizes = np.diff(np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)) if len(a) else np.zeros(0, np.int32)
        offsets = pa.array(np.append(0, np.cumsum(np.where(gaps, 0, sizes))).astype(np.int32))
        mask = pa.array(gaps) if a.null_count else None
        inner = a.flatten() if pa.types.is_list(a.type) else pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.StructArray.from_arrays([a.keys, a.items], names=["k", "v"]).slice(*_extent(a)), mask=mask).flatten()
        if pa.types.is_list(a.type):
            return pa.ListArray.from_arrays(offsets, walked(inner, paths, fn), mask=mask)
        return pa.MapArray.from_arrays(offsets, inner.field("k"), walked(inner.field("v"), paths, fn), mask=mask)
    if pa.types.is_struct(a.type):
        fields = list(a.type)
        below = [[p[1:] if p else [] for p in paths if not p or p[0] == f.name] for f in fields]
        return pa.StructArray.from_arrays([walked(x, b, fn) if b else x for x, b in zip(a.flatten(), below, strict=True)], names=[f.name for f in fields], mask=a.is_null() if a.null_count else None)
    return a


def _extent(a: pa.Array) -> tuple[int, int]:
    """Where the items of a sliced map array begin among all, and how many there are."""
    at = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4) if len(a) else np.zeros(1, np.int32)
    return int(at[0]), int(at[-1] - at[0])


def hans_confidence(counts: Column) -> Column:
    """Share of hant among the characters that either script's table replaces; NaN if there are none."""
    hant, total = counts["zh_hant"], counts["zh_hant"] + counts["zh_hans"]
    return F.when(counts.isNull(), None).when(total == 0, F.lit(float("nan"))).otherwise(hant / total).cast("float")


def ranked_confidences(counts: Column) -> Column:
    """Five struct<variant, confidence> from the most confident, in single precision; ties by a fixed order."""
    total = (counts["zh_cn"] + counts["zh_tw"] + counts["zh_hk"] - counts["zh_hant"]).cast("float")
    one = F.lit(1.0).cast("float")
    conf = {t: F.when(total == 0, F.lit(float("nan"))).otherwise(one - (F.least(counts[t.replace("-", "_")].cast("float"), total) / total).cast("float")).cast("float") for t in DETECTED}
    alike = (conf["zh-tw"] == conf["zh-hk"]) & ~F.isnan(conf["zh-tw"])
    rows = [F.struct((-conf[t]).alias("key"), F.when(alike, TIES[True].index(t)).otherwise(TIES[False].index(t)).alias("place"), F.lit(t).alias("variant"), conf[t].alias("confidence")) for t in DETECTED]
    ranked = F.transform(F.array_sort(F.array(*rows)), lambda r: F.struct(r["variant"].alias("variant"), r["confidence"].alias("confidence")))
    return F.when(counts.isNotNull(), ranked)


def q_values(ranked: Column) -> Column:
    """Confidences as ``tag;q=0.000`` items, joined by a comma."""
    return F.array_join(F.transform(ranked, lambda r: F.format_string("%s;q=%s", r["variant"], F.when(F.isnan(r["confidence"]), "NaN").otherwise(F.format_string("%.3f", r["confidence"])))), ", ")


def convert_with_pairs(spark: SparkSession, text: Column, pairs: Iterable[tuple[str, str]] | DataFrame) -> Column:
    """Conversion with ad-hoc pairs alone."""
    held = Shared(spark, rulesets.matcher(pairs) if isinstance(pairs, DataFrame) else Matcher(pairs))
    return _arrow("string", lambda t: held.get().convert_array(t), text)


def make_converter(spark: SparkSession, base: str | None, pairs: Iterable[tuple[str, str]] | DataFrame | str, path: str | None = None) -> Callable[[Column], Column]:
    """A reusable conversion: a variant's tables under pairs, a frame (from, to), or a file of pairs. No base: the pairs alone."""
    if isinstance(pairs, str):
        pairs = sources.read_pairs(spark, pairs)
    over = rulesets.matcher(pairs) if isinstance(pairs, DataFrame) else Matcher(pairs)
    below = Matcher({}) if base is None or not parse(base).tables else rulesets.matcher(rulesets.regional(sources.load(spark, path), base))
    held = Shared(spark, below.merged(over))
    return lambda text: _arrow("string", lambda t: held.get().convert_array(t), text)


def truncated(text: Column, n_bytes: int) -> Column:
    """The shortest prefix of whole characters with at least n bytes; all of a shorter text. A plain prefix where it is ASCII."""

    def one(t: str) -> str:
        b = t.encode()
        while (cut := n_bytes) and n_bytes < len(b):
            while cut < len(b) and b[cut] & 0xC0 == 0x80:
                cut += 1
            return b[:cut].decode()
        return t if n_bytes else ""

    head = F.substring(text, 1, n_bytes)
    wide = F.octet_length(head) > F.length(head)
    return F.when(F.octet_length(text) <= n_bytes, text).when(~wide, head).otherwise(_arrow("string", each(one, pa.string()), F.when(wide, head)))


def extracted_rules(text: Column) -> Column:
    """The inner of each one-line rule, by Spark's own regular expressions."""
    return F.regexp_extract_all(text, F.lit(r"-\{([^\n]+?)\}-"), F.lit(1))


def _conv(c: Column) -> Column:
    """A conv of ``rules`` with its two-way texts as a map."""
    one_way = F.transform(c["one_way"], lambda u: F.struct(u["tag"].alias("variant"), u["src"].alias("from"), u["dst"].alias("to")))
    return F.when(c.isNotNull(), F.struct(c["asis"].alias("asis"), rules.as_map(c["both"]).alias("both"), one_way.alias("one_way"))).cast(CONV)


def parsed_rule(inner: Column) -> Column:
    """The parsed rule as a struct, by Spark expressions; error names why one can't be read, and such a rule shows its own text."""
    asis = F.struct(inner.alias("asis"), F.create_map().cast("map<string,string>").alias("both"), F.array().cast("array<struct<variant:string,from:string,to:string>>").alias("one_way")).cast(CONV)
    null = F.lit(None).cast("string")

    def told(r: Column) -> Column:
        bad = r["error"].isNotNull()
        one = lambda name, instead: F.when(bad, instead).otherwise(r[name]).alias(name)
        return F.struct(one("action", null), one("output", F.lit("text")), one("variant", null), one("sets_title", F.lit(False)), F.when(bad, asis).otherwise(_conv(r["conv"])).alias("conv"), r["error"].alias("error")).cast(RULE)

    return F.when(inner.isNotNull(), let(rules.parsed_rule(inner), told))


def parsed_conv(body: Column) -> Column:
    """A body as a struct; one that can't be read is its own text."""
    asis = F.struct(body.alias("asis"), F.create_map().cast("map<string,string>").alias("both"), F.array().cast("array<struct<variant:string,from:string,to:string>>").alias("one_way")).cast(CONV)
    return F.when(body.isNotNull(), let(rules.parsed_conv(body), lambda c: F.when(c["error"], asis).otherwise(_conv(c))))


def shown_rule(inner: Column, target: str) -> Column:
    """What a rule shows for a target."""
    return F.when(inner.isNotNull(), rules.shown(inner, parse(target).tag))


def page_rules(text: Column) -> Column:
    """The title and the actions of a text's rules."""
    told = lambda p: F.struct(p["title"].alias("title"), F.transform(p["actions"], lambda a: F.struct(a["action"].alias("action"), _conv(a["conv"]).alias("conv"))).alias("actions"))
    return F.when(text.isNotNull(), let(rules.page_rules(text), told)).cast(PAGE)


def page_pairs(text: Column, target: str) -> Column:
    """array<struct<action, from, to>>: the conversions that a text's rules add and remove."""
    each_ = lambda a: F.transform(a["pairs"], lambda p: F.struct(a["action"].alias("action"), p["src"].alias("from"), p["dst"].alias("to")))
    return F.when(text.isNotNull(), F.flatten(F.transform(rules.page_actions(text, parse(target).tag), each_)))


def text_for(texts: Column, target: str) -> Column:
    """A variant's text in a map<variant, text>, with fallback."""
    v = parse(target)
    return F.coalesce(*[F.element_at(texts, t) for t in (v.tag, *v.fallbacks)])


def page_title(text: Column, target: str) -> Column:
    return text_for(page_rules(text)["title"], target)


def variant_map(text: Column) -> Column:
    """map<variant, text> of two-way texts; null if a part is none."""
    return rules.variant_map(text)


def normal_tag(tag: Column) -> Column:
    """A tag in lower case; null if there is no such variant."""
    return F.when(F.lower(tag).isin(*VARIANTS), F.lower(tag))


def variant_name(tag: Column) -> Column:
    names = F.create_map(*[F.lit(x) for v in VARIANTS.values() for x in (v.tag, v.name)])
    return names[F.lower(tag)]
