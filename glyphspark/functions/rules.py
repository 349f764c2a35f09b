"""Conversion markup as Spark expressions: rules parsed, shown and resolved without Python workers.

The same reading as ``markup``: a rule is ``flags|body``, a body is two-way
texts by variant, one-way pairs, or a text as it is. Nested rules are read by a
fold over brackets and the text between them, with a stack of open rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..variants import VARIANTS, WHITE, WITHOUT_PAIRS
from .arrays import cut, fold, let, text_blocks
from .markup import MAX_DEPTH

BOTH = "struct<tag:string,text:string>"
ONE_WAY = "struct<tag:string,src:string,dst:string>"
CONV = f"struct<asis:string,both:array<{BOTH}>,one_way:array<{ONE_WAY}>,error:boolean>"
PAIR = "struct<src:string,dst:string>"
SEGMENT = "struct<shown:string,plain:string>"
_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"
#: An entity with what may still be of one behind it; a semicolon behind & with what follows such; a semicolon; other text.
_BODY = r"(?s)&[#0-9A-Za-z][#0-9A-Za-z;]*+|(?<=&);[#0-9A-Za-z;]*+|;|[^;&]++|&"
_CUT = "\x00"
_UPPER, _LOWER = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}++|{_SPACE}++$", "")


def tag_of(text: Column) -> Column:
    """The tag that a text is, in any case of ASCII letters; null if it is none."""
    low = F.translate(text, _UPPER, _LOWER)
    return F.when(low.isin(*VARIANTS), low)


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    return F.substring(text, F.length(_before(text, mark)) + len(mark) + 1, F.length(text))


def parts(body: Column) -> Column:
    """The parts of a body, parted by semicolons that end no entity; the last is what stands behind all. A zero character stands for a cut, and is dropped from bodies."""
    tokens = F.regexp_extract_all(F.replace(body, F.lit(_CUT), F.lit("")), F.lit(_BODY), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit(";")), F.concat(F.lit(_CUT), F.substring(t, 2, 1 << 30))).otherwise(t))
    return F.split(F.array_join(marked, ""), _CUT, -1)


def parsed_conv(body: Column) -> Column:
    """A body as a CONV struct; error if it is neither a map nor plain text."""

    def part(p: Column) -> Column:
        arrow = F.contains(p, F.lit("=>"))
        src, rest = _before(p, "=>"), F.when(arrow, _after(p, "=>")).otherwise(p)
        tag = tag_of(stripped(_before(rest, ":")))
        good = F.contains(rest, F.lit(":")) & tag.isNotNull() & ~(arrow & (src == ""))
        return F.struct((stripped(p) == "").alias("blank"), F.coalesce(good, F.lit(False)).alias("good"), arrow.alias("arrow"), tag.alias("tag"), src.alias("src"), _after(rest, ":").alias("dst"))

    def told(body: Column, ps: Column) -> Column:
        good = F.filter(ps, lambda p: ~p["blank"] & p["good"])
        bad = F.filter(F.slice(ps, 1, F.size(ps) - 1), lambda p: ~p["blank"] & ~p["good"])
        last = F.element_at(ps, -1)
        odd = ~last["blank"] & ~last["good"]
        error = (F.size(bad) > 0) | (odd & (F.size(good) > 0))
        asis = F.when(~error & odd, body)
        both = F.transform(F.filter(good, lambda p: ~p["arrow"]), lambda p: F.struct(p["tag"].alias("tag"), p["dst"].alias("text")))
        one_way = F.transform(F.filter(good, lambda p: p["arrow"]), lambda p: F.struct(p["tag"].alias("tag"), p["src"].alias("src"), p["dst"].alias("dst")))
        return F.struct(asis.alias("asis"), both.alias("both"), one_way.alias("one_way"), error.alias("error")).cast(CONV)

    return let(stripped(body), lambda b: let(F.transform(parts(b), part), lambda ps: told(b, ps)))


def _asis(text: Column) -> Column:
    return F.struct(text.alias("asis"), F.array().cast(f"array<{BOTH}>").alias("both"), F.array().cast(f"array<{ONE_WAY}>").alias("one_way"), F.lit(False).alias("error")).cast(CONV)


def last_text(both: Column, tag: str | Column) -> Column:
    return F.try_element_at(F.filter(both, lambda b: b["tag"] == tag), F.lit(-1))["text"]


def text_for(both: Column, target: str) -> Column:
    """A variant's own text, or the first of its fallbacks'."""
    return F.coalesce(*[last_text(both, t) for t in (target, *VARIANTS[target].fallbacks)])


def parsed_rule(inner: Column) -> Column:
    """struct<action, output, variant, sets_title, conv, error> of what stands between brackets; error names why it can't be read."""
    bar = F.contains(inner, F.lit("|"))
    flags, body = F.when(bar, _before(inner, "|")).otherwise(""), F.when(bar, _after(inner, "|")).otherwise(inner)
    null = F.lit(None).cast("string")
    start = F.struct(null.alias("action"), F.lit("text").alias("output"), null.alias("variant"), F.lit(False).alias("sets_title"), F.lit(False).alias("raw"), null.alias("error"))

    def flag(s: Column, f: Column) -> Column:
        put = lambda **new: F.struct(*[new.get(k, s[k]).alias(k) for k in ("action", "output", "variant", "sets_title", "raw", "error")])
        named = F.when(tag_of(body).isNull(), put(error=F.lit("InvalidVariant"))).otherwise(put(output=F.lit("name"), variant=tag_of(body)))
        return (
            F.when(s["raw"] | s["error"].isNotNull() | (f == "S"), s)
            .when(f.isin("+", "A"), put(action=F.lit("add")))
            .when(f == "-", put(action=F.lit("remove"), output=null))
            .when(f == "H", put(action=F.lit("add"), output=null))
            .when(f == "R", put(action=null, output=F.lit("text"), variant=null, sets_title=F.lit(False), raw=F.lit(True)))
            .when(f == "N", named)
            .when(f == "D", put(output=F.lit("description")))
            .when(f == "T", put(sets_title=F.lit(True), output=null))
            .otherwise(put(error=F.lit("InvalidFlag")))
        )

    def whole(s: Column) -> Column:
        conv = F.when(s["raw"], _asis(body)).when(s["error"].isNull() & (F.coalesce(s["output"], F.lit("")) != "name"), parsed_conv(body))

        def judged(c: Column) -> Column:
            titled = s["sets_title"] & (c.isNull() | (F.size(c["both"]) < 1))
            error = F.when(s["error"].isNotNull(), s["error"]).when(c["error"], F.lit("InvalidConv")).when(titled, F.lit("InvalidConvForTitle"))
            return F.struct(s["action"].alias("action"), s["output"].alias("output"), s["variant"].alias("variant"), s["sets_title"].alias("sets_title"), c.alias("conv"), error.alias("error"))

        return let(conv, judged)

    return let(F.aggregate(F.regexp_extract_all(flags, F.lit("(?s)."), F.lit(0)), start, flag), whole)


def describe(conv: Column) -> Column:
    """What a rule's description shows: two-way texts by the order of writing, then one-way ones by variant."""
    names = F.create_map(*[F.lit(x) for v in VARIANTS.values() for x in (v.tag, v.name)])
    two_way = F.transform(F.array_distinct(F.transform(conv["both"], lambda b: b["tag"])), lambda t: F.concat(names[t], F.lit("："), last_text(conv["both"], t), F.lit("；")))
    order = F.array_distinct(F.transform(conv["one_way"], lambda u: u["tag"]))
    one_way = F.transform(F.flatten(F.transform(order, lambda t: F.filter(conv["one_way"], lambda u: u["tag"] == t))), lambda u: F.concat(u["src"], F.lit("⇒"), u["tag"], F.lit(": "), u["dst"]))
    return F.when(conv["asis"].isNotNull(), conv["asis"]).otherwise(F.concat(F.array_join(two_way, ""), F.array_join(one_way, "")))


def shown(inner: Column, target: str) -> Column:
    """What a rule shows for a target; one that can't be read shows itself, flags included."""
    names = F.create_map(*[F.lit(x) for v in VARIANTS.values() for x in (v.tag, v.name)])

    def of(r: Column) -> Column:
        c = r["conv"]
        plain = F.coalesce(c["asis"], text_for(c["both"], target), F.lit(""))
        return F.when(r["error"].isNotNull(), inner).when(r["output"] == "name", names[r["variant"]]).when(r["output"].isNull(), "").when(r["output"] == "description", describe(c)).otherwise(plain)

    return let(parsed_rule(inner), of)


def pairs_for(conv: Column, target: str) -> Column:
    """array<PAIR>: conversions to a target. Script variants have no two-way ones; one-way ones don't fall back."""
    values = F.transform(F.array_distinct(F.transform(conv["both"], lambda b: b["tag"])), lambda t: last_text(conv["both"], t))
    to = F.lit(None).cast("string") if target in WITHOUT_PAIRS else text_for(conv["both"], target)
    pair = lambda f, t: F.struct(f.alias("src"), t.alias("dst"))
    two_way = F.when(to.isNull(), F.array().cast(f"array<{PAIR}>")).otherwise(F.transform(values, lambda f: pair(f, to)))
    one_way = F.transform(F.filter(conv["one_way"], lambda u: u["tag"] == target), lambda u: pair(u["src"], u["dst"]))
    rules = F.filter(F.concat(two_way, one_way), lambda p: F.length(p["src"]) > 0)
    return F.when(conv.isNull(), F.array().cast(f"array<{PAIR}>")).when(conv["asis"].isNotNull(), F.array(pair(conv["asis"], conv["asis"]))).otherwise(rules).cast(f"array<{PAIR}>")


def page_actions(text: Column, target: str) -> Column:
    """array<struct<action, pairs>> of the one-line rules of a text that can be read and add or remove, in order."""
    rules = F.transform(F.regexp_extract_all(text, F.lit(r"-\{([^\n]+?)\}-"), F.lit(1)), parsed_rule)
    kept = F.filter(rules, lambda r: r["error"].isNull() & r["action"].isNotNull())
    return F.transform(kept, lambda r: F.struct(r["action"].alias("action"), pairs_for(r["conv"], target).alias("pairs")))


_MAP = "map<string,string>"


def as_map(both: Column) -> Column:
    """Two-way texts as map<tag, text>, in the order of writing; of one tag's texts the last."""
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(both, lambda b: b["tag"])), lambda t: F.struct(t, last_text(both, t)))).cast(_MAP)


def variant_map(text: Column) -> Column:
    """map<tag, text> of two-way texts only, trimmed; null if a part is none."""

    def part(p: Column) -> Column:
        return F.struct(F.when(F.contains(p, F.lit(":")), tag_of(stripped(_before(p, ":")))).alias("tag"), stripped(_after(p, ":")).alias("text"))

    def told(ps: Column) -> Column:
        both = F.transform(F.when(F.element_at(ps, -1) == "", F.slice(ps, F.lit(1), F.size(ps) - 1)).otherwise(ps), part)
        return let(both, lambda b: F.when(F.exists(b, lambda x: x["tag"].isNull()), F.lit(None).cast(_MAP)).otherwise(as_map(b)))

    return let(parts(stripped(text)), told)


def page_rules(text: Column) -> Column:
    """struct<title, actions>: the last title, as a map, and the actions of a text's one-line rules; what can't be read is passed over."""

    def told(rs: Column) -> Column:
        title = F.try_element_at(F.filter(rs, lambda r: r["sets_title"]), F.lit(-1))["conv"]["both"]
        kept = F.filter(rs, lambda r: r["action"].isNotNull() & r["conv"].isNotNull())
        return F.struct(F.when(title.isNotNull(), as_map(title)).alias("title"), F.transform(kept, lambda r: F.struct(r["action"].alias("action"), r["conv"].alias("conv"))).alias("actions"))

    rules = F.transform(F.regexp_extract_all(text, F.lit(r"-\{([^\n]+?)\}-"), F.lit(1)), parsed_rule)
    return F.when(text.isNotNull(), let(F.filter(rules, lambda r: r["error"].isNull()), told))


# ---- nested rules

_CODE = {"<script": "</script>", "<style": "</style>", "<code>": "</code>", "<pre": "</pre>"}

_BLOCK = "|".join(re.escape(o) + ("" if o.endswith(">") else r"[^\n]*?>") + r"[^\n]*?" + re.escape(c) for o, c in _CODE.items())


def _tokens(skip_code: bool) -> str:
    """Brackets, the starts of code blocks that end on their line, their ends, and what lies between."""
    opener = lambda o, c: re.escape(o) + (r"(?=[^\n]*?" if o.endswith(">") else r"(?=[^\n]*?>[^\n]*?") + re.escape(c) + ")"
    code = "|".join([opener(o, c) for o, c in _CODE.items()] + [re.escape(c) for c in _CODE.values()])
    return r"(?s)-\{|\}-\{|\}-|" + (code + "|" if skip_code else "") + r"[^-}<]++|[-}<]"


def segments(text: Column, target: str, skip_code: bool = True) -> Column:
    """A text with markup as array<SEGMENT>: what is shown as it is, and plain text behind it that is still to be converted.

    A rule within a rule is shown in the outer one's text; deeper than
    MAX_DEPTH an opening bracket is dropped; rules that never end show their
    brackets, and their text is plain. Time grows with the text and its brackets.
    """
    kind = "struct<kind:string,start:int,stop:int,text:string,pieces:array<string>>"
    nothing = F.lit(None).cast(kind)
    no_pieces = F.array().cast("array<string>")

    def seg(k: str, start=None, stop=None, text=None, pieces=None) -> Column:
        value = lambda v, t: F.lit(v).cast(t) if v is None else v.cast(t)
        return F.struct(F.lit(k).alias("kind"), value(start, "int").alias("start"), value(stop, "int").alias("stop"), value(text, "string").alias("text"), value(pieces, "array<string>").alias("pieces")).cast(kind)

    first = F.struct(F.lit(0).alias("mode"), F.lit("").alias("code"), F.lit(False).alias("gt"), F.lit(0).alias("start"), F.lit(0).alias("pos"), no_pieces.alias("stack"))
    ends = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])

    def step(blocks: Column, s: Column, t: Column) -> tuple[Column, Column]:
        opens, joint, closes = t == "-{", t == "}-{", t == "}-"
        begins = t.isin(*_CODE) if skip_code else F.lit(False)
        after = s["pos"] + F.length(t)
        put = lambda **new: F.struct(*[new.get(k, s[k]).alias(k) for k in ("mode", "code", "gt", "start")], after.alias("pos"), new.get("stack", s["stack"]).alias("stack"))
        both = lambda state, out=nothing: F.struct(state.alias("s"), out.alias("o"))
        top = F.concat(F.element_at(s["stack"], -1), cut(blocks, s["start"], s["pos"] - s["start"]))
        below = F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)
        outside = (
            F.when(opens | joint, both(put(mode=F.lit(1), start=after, stack=F.array(F.lit(""))), seg("plain", s["start"], s["pos"] + joint.cast("int"))))
            .when(begins, both(put(mode=F.lit(2), code=t, gt=t == "<code>", start=s["pos"]), seg("plain", s["start"], s["pos"])))
            .otherwise(both(put()))
        )
        in_code = F.when(s["gt"] & (t == ends[s["code"]]), both(put(mode=F.lit(0), start=after), seg("code", s["start"], after))).otherwise(both(put(gt=s["gt"] | F.contains(t, F.lit(">")))))
        # what stands behind the brackets that close a rule, a brace too, is read with what follows
        closed = lambda x: F.when(F.size(below) == 0, both(put(mode=F.lit(0), start=s["pos"] + 2, stack=no_pieces), seg("shown", text=x))).otherwise(
            both(put(start=s["pos"] + 2, stack=F.concat(F.slice(below, F.lit(1), F.size(below) - 1), F.array(F.concat(F.element_at(below, -1), x)))))
        )
        opened = F.concat(below, F.array(top), F.when(F.size(s["stack"]) < MAX_DEPTH, F.array(F.lit(""))).otherwise(no_pieces))
        in_rule = F.when(opens, both(put(start=after, stack=opened))).when(joint | closes, let(shown(top, target), closed)).otherwise(both(put()))
        r = F.when(s["mode"] == 0, outside).when(s["mode"] == 2, in_code).otherwise(in_rule)
        return r["s"], r["o"]

    def last(s: Column) -> Column:
        return F.when(s["mode"] == 1, seg("open", s["start"], s["pos"], pieces=s["stack"])).otherwise(seg("plain", s["start"], s["pos"]))

    def of(blocks: Column) -> Column:
        segment = lambda shown_, plain: F.struct(shown_.alias("shown"), plain.alias("plain")).cast(SEGMENT)
        part = lambda o: cut(blocks, o["start"], o["stop"] - o["start"])

        def behind(rest: Column) -> Column:
            """What stands behind the last bracket of rules that never end is read as if outside."""
            if not skip_code:
                return F.array(segment(F.lit(""), rest))
            code = F.concat(F.array(F.lit("")), F.regexp_extract_all(rest, F.lit(_BLOCK), F.lit(0)))
            return F.zip_with(code, F.split(rest, _BLOCK, -1), segment)

        told = lambda o: (
            F.when(o["kind"] == "plain", F.array(segment(F.lit(""), part(o))))
            .when(o["kind"] == "code", F.array(segment(part(o), F.lit(""))))
            .when(o["kind"] == "shown", F.array(segment(o["text"], F.lit(""))))
            .otherwise(F.concat(F.transform(o["pieces"], lambda p: segment(F.lit("-{"), p)), let(part(o), behind)))
        )
        tokens = F.regexp_extract_all(text, F.lit(_tokens(skip_code)), F.lit(0))
        made = fold(tokens, first, kind, lambda s, t: step(blocks, s, t), last)
        return F.flatten(F.transform(F.filter(made, lambda o: o.isNotNull()), told))

    return let(text_blocks(text), of)
