"""Conversion markup: ``-{flags|body}-`` in running text.

A rule shows a text, and may add or remove conversions for the whole page. The
parsers return plain dataclasses; ``MarkupConverter`` applies them to texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from ..variants import VARIANTS, WHITE, WITHOUT_PAIRS, parse
from .matcher import Matcher, convert_layered

# The depth of rules, and the patterns of rules and of code that stays as it is.
MAX_DEPTH = 10
_EXTRACT = re.compile(r"-\{(.+?)\}-")
_OPEN = re.compile(r"-\{")
_OPEN_OR_CODE = re.compile(r"-\{|<script.*?>.*?</script>|<style.*?>.*?</style>|<code>.*?</code>|<pre.*?>.*?</pre>")
_BRACKET = re.compile(r"-\{|\}-")
#: Characters of a rule that is remembered, at most: pages repeat the same short ones.
_SHORT_RULE = 200


class RuleError(ValueError):
    """A rule that can't be read; ``kind`` says why."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


@dataclass
class Conv:
    """What a rule converts: a text as it is, or two-way texts by variant and one-way (variant, from, to)."""

    asis: str | None = None
    both: dict[str, str] = field(default_factory=dict)
    one_way: list[tuple[str, str, str]] = field(default_factory=list)

    def text_for(self, target: str) -> str | None:
        return self.asis if self.asis is not None else text_for(self.both, target)

    def pairs_for(self, target: str) -> list[tuple[str, str]]:
        """Conversions to a target. Script variants have no two-way ones; one-way ones don't fall back."""
        if self.asis is not None:
            return [(self.asis, self.asis)]
        to = None if target in WITHOUT_PAIRS else text_for(self.both, target)
        two_way = [(f, to) for f in self.both.values()] if to is not None else []
        return [(f, t) for f, t in two_way + [(f, t) for v, f, t in self.one_way if v == target] if f]

    def describe(self) -> str:
        if self.asis is not None:
            return self.asis
        order = list(dict.fromkeys(v for v, _, _ in self.one_way))
        return "".join(f"{VARIANTS[v].name}：{t}；" for v, t in self.both.items()) + "".join(f"{f}⇒{v}: {t}" for w in order for v, f, t in self.one_way if v == w)


@dataclass
class Rule:
    """A parsed rule. ``action`` is add, remove or None; ``output`` is text, name, description or None."""

    action: str | None = None
    output: str | None = "text"
    conv: Conv | None = None
    sets_title: bool = False
    variant: str | None = None

    def shown(self, target: str) -> str:
        if self.output == "name":
            return VARIANTS[self.variant].name
        if self.output is None or self.conv is None:
            return ""
        return self.conv.describe() if self.output == "description" else self.conv.text_for(target) or ""


def text_for(texts: dict[str, str], target: str) -> str | None:
    """A variant's own text, or the first of its fallbacks'."""
    return next((texts[v] for v in (target, *VARIANTS[target].fallbacks) if v in texts), None)


#: An entity with what may still be of one behind it, or a semicolon that ends a part; behind one right after & such characters follow as well.
_ENTITY_OR_END = re.compile(r"&[#0-9A-Za-z][#0-9A-Za-z;]*|(?P<end>;)(?:(?<=&;)[#0-9A-Za-z;]*)?")


def _segments(body: str) -> tuple[list[str], str]:
    """The parts that semicolons end, and the rest. A semicolon after an entity's name ends none."""
    ends = [m.start() for m in _ENTITY_OR_END.finditer(body) if m["end"]]
    starts = [0, *(e + 1 for e in ends)]
    return [body[a:e] for a, e in zip(starts, ends, strict=False)], body[starts[-1] :]


def parse_conv(body: str) -> Conv:
    """The inner of a rule without flags; RuleError if it is neither a map nor plain text."""
    body = body.strip(WHITE)
    conv = Conv()

    def take(part: str) -> None:
        if not part.strip(WHITE):
            return
        source, arrow, rest = part.partition("=>")
        tag, colon, to = (rest if arrow else part).partition(":")
        if not colon or (arrow and not source):
            raise RuleError("InvalidConv")
        try:
            tag = parse(tag.strip(WHITE)).tag
        except ValueError:
            raise RuleError("InvalidConv") from None
        if arrow:
            conv.one_way.append((tag, source, to))
        else:
            conv.both[tag] = to

    parts, rest = _segments(body)
    for p in parts:
        take(p)
    try:
        take(rest)
    except RuleError:
        if conv.both or conv.one_way:
            raise
        return Conv(asis=body)
    return conv


def parse_rule(inner: str) -> Rule:
    """What stands between the brackets; RuleError if it can't be read. A later flag overrides an earlier one."""
    flags, bar, body = inner.partition("|")
    if not bar:
        flags, body = "", inner
    rule = Rule()
    for f in flags:
        match f:
            case "+" | "A":
                rule.action = "add"
            case "-":
                rule.action, rule.output = "remove", None
            case "H":
                rule.action, rule.output = "add", None
            case "R":
                return Rule(conv=Conv(asis=body))
            case "N":
                try:
                    rule.output, rule.variant = "name", parse(body).tag
                except ValueError:
                    raise RuleError("InvalidVariant") from None
            case "D":
                rule.output = "description"
            case "T":
                rule.sets_title, rule.output = True, None
            case "S":
                pass
            case _:
                raise RuleError("InvalidFlag")
    if rule.output != "name":
        rule.conv = parse_conv(body)
    if rule.sets_title and not (rule.conv and rule.conv.both):
        raise RuleError("InvalidConvForTitle")
    return rule


def parse_rule_or_text(inner: str) -> Rule:
    """As parse_rule(); what can't be read is a text that shows itself, flags included."""
    try:
        return parse_rule(inner)
    except RuleError:
        return Rule(conv=Conv(asis=inner))


def parse_conv_or_text(body: str) -> Conv:
    try:
        return parse_conv(body)
    except RuleError:
        return Conv(asis=body)


def parse_variant_map(text: str) -> dict[str, str]:
    """Two-way texts only, trimmed; RuleError for any part that is none."""
    out = {}
    parts, rest = _segments(text.strip(WHITE))
    for p in [*parts, *([rest] if rest else [])]:
        tag, colon, to = p.partition(":")
        try:
            out[parse(tag.strip(WHITE)).tag] = to.strip(WHITE)
        except ValueError:
            colon = ""
        if not colon:
            raise RuleError("InvalidConv")
    return out


def shown_text(inner: str, target: str) -> str:
    """What a rule, or a text that can't be read as one, shows for a target."""
    return _remembered(inner, target) if len(inner) <= _SHORT_RULE else parse_rule_or_text(inner).shown(target)


@lru_cache(maxsize=1 << 14)
def _remembered(inner: str, target: str) -> str:
    return parse_rule_or_text(inner).shown(target)


def extract_rules(text: str) -> Iterator[str]:
    """The inner of each rule on a line; unlike conversion it knows no nesting."""
    return (m.group(1) for m in _EXTRACT.finditer(text))


@dataclass
class PageRules:
    """The last title and all actions of a text's rules; what can't be read is passed over."""

    title: dict[str, str] | None = None
    actions: list[tuple[str, Conv]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> PageRules:
        page = cls()
        for inner in extract_rules(text):
            try:
                rule = parse_rule(inner)
            except RuleError:
                continue
            if rule.sets_title:
                page.title = rule.conv.both
            if rule.action and rule.conv is not None:
                page.actions.append((rule.action, rule.conv))
        return page

    def title_for(self, target: str) -> str | None:
        return text_for(self.title, target) if self.title else None

    def overlay(self, target: str) -> tuple[dict[str, str], set[str]]:
        adds, removes = {}, set()
        for action, conv in self.actions:
            pairs = conv.pairs_for(target)
            if action == "add":
                adds.update(pairs)
            else:
                removes.update(f for f, _ in pairs)
        return adds, removes


def conv_lines(text: str, target: str) -> dict[str, str]:
    """Conversions from lines of rules; blank lines and those that can't be read have none."""
    out: dict[str, str] = {}
    for line in re.split(r"\r?\n", text):
        line = line.strip(WHITE)
        if line:
            try:
                out.update(parse_conv(line).pairs_for(target))
            except RuleError:
                continue
    return out


class MarkupConverter:
    """Converts texts with markup to a target.

    ``skip_code`` leaves script, style, code and pre blocks on one line as they
    are; ``global_rules`` applies each text's own rules to all of it;
    ``overlay`` and ``removed`` are rules given from outside.
    """

    def __init__(self, base: Matcher, target: str, skip_code: bool = True, global_rules: bool = True, overlay: dict[str, str] | None = None, removed: set[str] | None = None):
        self.base, self.target, self.global_rules = base, parse(target).tag, global_rules
        self.outer = _OPEN_OR_CODE if skip_code else _OPEN
        self.adds, self.removes = dict(overlay or {}), set(removed or ())

    def _plain(self, text: str) -> Callable[[str], str]:
        adds, removes = self.adds, self.removes
        if self.global_rules and "-{" in text:
            more, less = PageRules.of(text).overlay(self.target)
            adds, removes = {**adds, **more}, removes | less
        if not adds and not removes:
            return self.base.convert if self.base else str
        over = Matcher({f: t for f, t in adds.items() if f not in removes})
        return lambda part: convert_layered(self.base, over, frozenset(removes), part)

    def _rule(self, text: str, at: int) -> tuple[str | None, list[str], int]:
        """Reads the rule whose inner begins at a place: what it shows, or the open pieces if it never ends, and where reading stopped."""
        stack = [""]
        for m in _BRACKET.finditer(text, at):
            stack[-1] += text[at : m.start()]
            at = m.end()
            if m.group() == "-{":
                if len(stack) < MAX_DEPTH:
                    stack.append("")
                continue
            shown = shown_text(stack.pop(), self.target)
            if not stack:
                return shown, [], at
            stack[-1] += shown
        return None, stack, at

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """The plain texts of a text, each still to be converted, and what is shown between them: one less."""
        plain, shown, at = [], [], 0
        outer = self.outer if "<" in text else _OPEN
        while m := outer.search(text, at):
            plain.append(text[at : m.start()])
            at = m.end()
            if m.group() != "-{":
                shown.append(m.group())
                continue
            told, pieces, at = self._rule(text, at)
            if told is not None:
                shown.append(told)
            else:
                plain += pieces
                shown += ["-{"] * len(pieces) + [""]
        return [*plain, text[at:]], shown

    def convert(self, text: str) -> str:
        plain, shown = self.parts(text)
        one = self._plain(text)
        return joined_parts([one(p) for p in plain], shown)


def joined_parts(plain: list[str], shown: list[str]) -> str:
    """What parts() parted, put together again."""
    out = [""] * (len(plain) + len(shown))
    out[::2], out[1::2] = plain, shown
    return "".join(out)
