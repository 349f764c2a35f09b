"""The matching kernel: leftmost-longest replacement from a dictionary, in one pass.

A dictionary is compiled into two parts. Sources of one character with targets
of one become a table over all code points, through which whole texts go as
arrays. All other sources are phrases: a text's code points are tested, as
arrays, for pairs of neighbours that begin one, and only there are phrases
tried, the longest first. A phrase is always longer than the single characters
it covers, so looking for phrases and mapping what lies between gives the
leftmost-longest result.

Arrow arrays of texts are taken in groups of rows: all code points of a group
are tested at once, hashes of what begins at candidates are looked up length by
length, and the result is put together by array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are taken at once.
GROUP = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)
#: Texts shorter than this are taken character by character.
SHORT = 48
_PAIR_BITS = 20
#: Chains of overlapping spans that are followed one by one, at most.
_FEW = 64

Span = tuple[int, int, str]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _PAIR_BITS)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_M) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class _Flat:
    """Texts as code points, one after another."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def _steps(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each distance from a text's start, which of some texts are longer."""
        size = self.size[which]
        live = np.arange(len(which))
        for j in range(int(size.max(initial=0))):
            live = live[size[live] > j]
            yield j, live

    def equal(self, which: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the texts stand in the code points at places."""
        out = np.ones(len(which), bool)
        for j, i in self._steps(which):
            out[i] &= codes[at[i] + j] == self.codes[self.begin[which[i]] + j]
        return out

    def put(self, which: np.ndarray, codes: np.ndarray, at: np.ndarray) -> None:
        """Writes the texts into the code points at places."""
        for j, i in self._steps(which):
            codes[at[i] + j] = self.codes[self.begin[which[i]] + j]

    def fill(self, which: np.ndarray, values: np.ndarray, at: np.ndarray, value) -> None:
        """Writes a value, or one for each text, over as many places as the texts are long."""
        for j, i in self._steps(which):
            values[at[i] + j] = value[i] if isinstance(value, np.ndarray) else value


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in groups of about GROUP bytes, one text at least."""
    texts = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _codes(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes, their code points, and where each text ends in these."""
    data = _bytes(texts)
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return data, np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), ends


def _bytes(texts: pa.Array) -> bytes:
    """The bytes of all texts in a row, as Arrow holds them."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    return data.slice(int(o[0]), int(o[-1] - o[0])).to_pybytes() if data is not None else b""


def _strings(text: str, ends: np.ndarray, like: pa.Array) -> pa.Array:
    """The texts that end at places in one text, null where ``like`` is."""
    data = text.encode()
    if len(data) > len(text):
        b = np.frombuffer(data, np.uint8)
        begin = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))  # of each code point
        ends = begin[ends]
    out = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data))
    return pc.if_else(like.is_null(), pa.scalar(None, pa.string()), out) if like.null_count else out


def _leftmost(at: np.ndarray, stop: np.ndarray) -> np.ndarray | None:
    """Which of some spans, sorted by their starts, are left if each drops those that begin inside it; None for all."""
    if not (at[1:] < stop[:-1]).any():
        return None
    apart = np.append(True, at[1:] >= np.maximum.accumulate(stop)[:-1])
    heads = np.flatnonzero(apart)
    follows = np.searchsorted(at, stop)  # the first span behind each
    limits = np.append(heads[1:], len(at))
    keep = apart.copy()
    here = heads
    while len(here) > _FEW:  # a step of all chains at once
        here = follows[here]
        more = here < limits
        here, limits = here[more], limits[more]
        keep[here] = True
    for i, limit in zip(here.tolist(), limits.tolist(), strict=True):
        i = int(follows[i])
        while i < limit:
            keep[i] = True
            i = int(follows[i])
    return keep


def groups_of(texts: pa.Array) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Groups of texts as code points, which several dictionaries can share."""
    return [_codes(t) for t in _groups(texts)]


class Matcher:
    """A compiled dictionary of sources and targets. Empty sources are left out."""

    def __init__(self, pairs: Mapping[str, str] | Iterable[tuple[str, str]]):
        self.pairs = {f: t for f, t in dict(pairs).items() if f}

    def __bool__(self) -> bool:
        return bool(self.pairs)

    def __reduce__(self):
        return Matcher, (self.pairs,)

    @cached_property
    def single(self) -> dict[int, str]:
        return {ord(f): t for f, t in self.pairs.items() if len(f) == 1}

    @cached_property
    def lengths(self) -> dict[str, tuple[int, ...]]:
        """For each character that begins a phrase, the phrases' lengths from the longest."""
        out: dict[str, set[int]] = {}
        for f in self.pairs:
            if len(f) > 1:
                out.setdefault(f[0], set()).add(len(f))
        return {c: tuple(sorted(n, reverse=True)) for c, n in out.items()}

    @cached_property
    def heads(self) -> re.Pattern | None:
        """Characters that begin a source which the table can't map."""
        first = set(self.lengths) | {chr(c) for c, t in self.single.items() if len(t) != 1}
        return re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if first else None

    @cached_property
    def starts(self) -> re.Pattern | None:
        """Characters that begin any source."""
        first = {f[0] for f in self.pairs}
        return re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if first else None

    @cached_property
    def ascii(self) -> bool:
        return any(f.isascii() for f in self.pairs)

    @cached_property
    def table(self) -> np.ndarray:
        """What each code point becomes; itself for sources with longer or no targets."""
        out = np.arange(0x110000, dtype=np.uint32)
        for c, t in self.single.items():
            if len(t) == 1:
                out[c] = ord(t)
        return out

    @cached_property
    def alone(self) -> np.ndarray:
        """Code points that are phrases by themselves, as their targets aren't one character."""
        out = np.zeros(0x110000, bool)
        out[[c for c, t in self.single.items() if len(t) != 1]] = True
        return out

    @cached_property
    def beginnings(self) -> dict[str, tuple[int, ...]]:
        """For the first two characters of phrases, and single ones that are phrases, the lengths from the longest."""
        out: dict[str, set[int]] = {}
        for f, t in self.pairs.items():
            if len(f) > 1:
                out.setdefault(f[:2], set()).add(len(f))
            elif len(t) != 1:
                out[f] = set()
        return {c: tuple(sorted(n, reverse=True)) for c, n in out.items()}

    @cached_property
    def neighbours(self) -> np.ndarray:
        """Which hashes pairs of neighbours have that begin phrases."""
        out = np.zeros(1 << _PAIR_BITS, bool)
        two = [b for b in self.beginnings if len(b) == 2]
        if two:
            codes = np.array([[ord(b[0]), ord(b[1])] for b in two], np.uint32)
            out[_pair_hash(codes[:, 0], codes[:, 1])] = True
        return out

    def candidates(self, text: str) -> list[int]:
        """Places where phrases may begin, in order."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        may = self.alone[codes]
        may[:-1] |= self.neighbours[_pair_hash(codes[:-1], codes[1:])]
        return np.flatnonzero(may).tolist()

    def _phrases(self, text: str) -> Iterator[tuple[int, str]]:
        """Places and sources of phrases, leftmost-longest."""
        if not self.heads or not self.heads.search(text):
            return
        begin, pairs, last, most = self.beginnings.get, self.pairs, 0, len(text)
        for at in self.candidates(text) if most >= SHORT else range(most):
            if at < last:
                continue
            for n in begin(text[at : at + 2], ()):
                if at + n <= most and text[at : at + n] in pairs:
                    break
            else:
                n = int(text[at] in self.beginnings)
            if n:
                yield at, text[at : at + n]
                last = at + self.step(text[at : at + n])

    def step(self, source: str) -> int:
        """How many characters a match of a source takes."""
        return len(source)

    def phrases(self, text: str) -> list[Span]:
        """Spans of sources that the table can't map, leftmost-longest."""
        return [(at, at + self.step(f), self.pairs[f]) for at, f in self._phrases(text)]

    def mapped(self, text: str) -> str:
        """The text with its single characters mapped, phrases or not; of equal length."""
        if len(text) < SHORT:
            one = self.single
            return "".join([t if len(t := one.get(ord(c), c)) == 1 else c for c in text])
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes().decode("utf-32-le", "surrogatepass")

    def convert(self, text: str) -> str:
        if text.isascii() and not self.ascii:
            return text
        out, last, mapped = [], 0, self.mapped(text)
        for start, end, target in self.phrases(text):
            out += (mapped[last:start], target)
            last = end
        return "".join([*out, mapped[last:]]) if out else mapped

    def longest(self, text: str, at: int) -> int:
        """Length of the longest source at a place, 0 if there is none."""
        for n in self.lengths.get(text[at], ()):
            if at + n <= len(text) and text[at : at + n] in self.pairs:
                return n
        return int(text[at] in self.pairs)

    def spans(self, text: str) -> Iterator[Span]:
        """All spans (start, end, target) in code points, end exclusive."""
        at = 0
        while self.starts and (hit := self.starts.search(text, at)):
            at = hit.start()
            n = self.longest(text, at)
            if n:
                yield at, at + n, self.pairs[text[at : at + n]]
            at += n or 1

    def replaced(self, text: str) -> int:
        """Characters of sources that differ from their targets."""
        if text.isascii() and not self.ascii:
            return 0
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        differ = self.table[codes] != codes
        for start, end, target in self.phrases(text):
            differ[start:end] = text[start:end] != target
        return int(differ.sum())

    @cached_property
    def phrase_list(self) -> list[str]:
        """Sources that the table can't map."""
        return [f for f, t in self.pairs.items() if len(f) > 1 or len(t) != 1]

    @cached_property
    def phrase_table(self) -> tuple[np.ndarray, ...]:
        """Of phrases in the order of hashes: hashes, places in phrase_list, and by these the code points of sources and targets, flat, with their first places."""
        src, tgt = (_Flat(x) for x in (self.phrase_list, [self.pairs[f] for f in self.phrase_list]))
        h = np.array([_hash(f) for f in self.phrase_list], np.uint64)
        order = np.argsort(h)
        return h[order], order, src, tgt

    @cached_property
    def steps(self) -> np.ndarray:
        """How many characters a match of each phrase takes."""
        return np.array([self.step(f) for f in self.phrase_list], np.int64)

    @cached_property
    def reach(self) -> np.ndarray:
        """By the hash of two neighbours: the length of the longest phrase that may begin with them."""
        out = np.zeros(1 << _PAIR_BITS, np.uint8)
        two = [f for f in self.phrase_list if len(f) > 1]
        if two:
            codes = np.array([[ord(f[0]), ord(f[1])] for f in two], np.uint32)
            np.maximum.at(out, _pair_hash(codes[:, 0], codes[:, 1]), np.minimum([len(f) for f in two], 255).astype(np.uint8))
        return out

    @cached_property
    def maps(self) -> bool:
        return any(len(t) == 1 for t in self.single.values())

    @cached_property
    def has_alone(self) -> bool:
        return any(len(f) == 1 for f in self.phrase_list)

    @cached_property
    def lengths_of_phrases(self) -> list[int]:
        return sorted({len(f) for f in self.phrase_list})

    def found(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers in phrase_list of phrases in the code points of texts that end at ``ends``, leftmost-longest in each."""
        none = np.zeros(0, np.int64)
        if not self.phrase_list or not len(codes):
            return none, none
        reach = np.zeros(len(codes), np.uint8)
        reach[:-1] = self.reach[_pair_hash(codes[:-1], codes[1:])]
        if self.has_alone:
            np.maximum(reach, self.alone[codes], out=reach)
        at = np.flatnonzero(reach)
        if not len(at):
            return none, none
        far, end = reach[at], ends[np.searchsorted(ends, at, side="right")]
        far = np.where(far == 255, self.lengths_of_phrases[-1], far)
        keys, number, src, _ = self.phrase_table
        which = np.full(len(at), -1, np.int64)
        far = np.minimum(far, end - at)
        live, place, h = np.arange(len(at)), at.copy(), np.zeros(len(at), np.uint64)
        for n in range(1, self.lengths_of_phrases[-1] + 1):
            more = far >= n
            if not more.all():
                live, place, h, far = live[more], place[more], h[more], far[more]
            if not len(live):
                break
            h *= _M
            h += codes[place]
            h += np.uint64(1)
            place += 1
            if n in self.lengths_of_phrases:
                hit = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = keys[hit] == h
                which[live[same]] = number[hit[same]]
        hit = which >= 0
        at, which = at[hit], which[hit]
        good = src.equal(which, codes, at)
        if not good.all():  # another text of the same hash: look again, without hashes
            text, starts = codes.tobytes().decode("utf-32-le"), [0, *ends.tolist()]
            spans = [(a + s, self.phrase_number[f]) for a, b in zip(starts, ends.tolist(), strict=False) for s, f in self._phrases(text[a:b])]
            return np.array([s for s, _ in spans], np.int64), np.array([i for _, i in spans], np.int64)
        keep = _leftmost(at, at + self.steps[which])
        return (at, which) if keep is None else (at[keep], which[keep])

    @cached_property
    def phrase_number(self) -> dict[str, int]:
        return {f: i for i, f in enumerate(self.phrase_list)}

    def convert_array(self, texts: pa.Array) -> pa.Array:
        """convert() of each text; nulls stay."""
        if not self.pairs or not len(texts):
            return texts
        return pa.concat_arrays([self._converted(t) for t in _groups(texts)])

    def _converted(self, texts: pa.Array) -> pa.Array:
        data, codes, ends = _codes(texts)
        if not self.ascii and data.isascii():
            return texts
        at, which = self.found(codes, ends)
        out = np.take(self.table, codes) if self.maps else codes.copy()
        text = None
        if len(at):
            tgt = self.phrase_table[3]
            more = tgt.size[which] - self.steps[which]
            tgt.put(which[more == 0], out, at[more == 0])
            if more.any():  # those that change the length part the text
                text, parts, last = out.tobytes().decode("utf-32-le"), [], 0
                at, which, more = at[more != 0], which[more != 0], more[more != 0]
                targets = [self.pairs[f] for f in self.phrase_list]
                for a, b, i in zip(at.tolist(), (at + self.steps[which]).tolist(), which.tolist(), strict=True):
                    parts += (text[last:a], targets[i])
                    last = b
                text = "".join([*parts, text[last:]])
                ends = ends + np.append(0, np.cumsum(more))[np.searchsorted(at, ends)]
        return _strings(out.tobytes().decode("utf-32-le") if text is None else text, ends, texts)

    def replaced_array(self, texts: pa.Array, shared: list | None = None) -> np.ndarray:
        """replaced() of each text, 0 for null; ``shared`` are its groups as groups_of() gives them."""
        return np.concatenate([np.zeros(0, np.int64), *[self._replaced(*g) for g in (groups_of(texts) if shared is None else shared)]])

    def _replaced(self, data: bytes, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not self.ascii and data.isascii():
            return np.zeros(len(ends), np.int64)
        differ = np.take(self.table, codes) != codes if self.maps else np.zeros(len(codes), bool)
        at, which = self.found(codes, ends)
        if len(at):
            src = self.phrase_table[2]
            changed = np.array([f != self.pairs[f] for f in self.phrase_list])
            src.fill(which, differ, at, changed[which])
        return np.diff(np.append(0, np.cumsum(differ))[ends], prepend=0)

    def spans_array(self, texts: pa.Array) -> pa.Array:
        """All spans of each text as a list of struct<start, end, src, dst>; nulls stay."""
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("src", pa.string()), ("dst", pa.string())])
        sources = [f for f, t in self.pairs.items() if not (len(f) > 1 or len(t) != 1)]
        one = np.full(0x110000, -1, np.int32)
        one[[ord(f) for f in sources]] = np.arange(len(sources)) + len(self.phrase_list)
        every = [*self.phrase_list, *sources]
        src, dst = pa.array(every, pa.string()), pa.array([self.pairs[f] for f in every], pa.string())
        size = np.array([len(f) for f in every], np.int64)
        out = []
        for t in _groups(texts):
            _, codes, ends = _codes(t)
            at, which = self.found(codes, ends)
            single = one[codes]
            if len(at):
                self.phrase_table[2].fill(which, single, at, -1)
            alone = np.flatnonzero(single >= 0)
            place, number = np.concatenate([at, alone]), np.concatenate([which, single[alone]])
            order = np.argsort(place, kind="stable")
            place, number = place[order], number[order]
            starts = np.append(0, ends)[:-1]
            row = np.searchsorted(ends, place, side="right")
            begin = (place - starts[row] if len(place) else place).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(begin), pa.array((begin + size[number]).astype(np.int32)) if len(place) else pa.array([], pa.int32()), src.take(pa.array(number, pa.int64())), dst.take(pa.array(number, pa.int64()))], fields=list(kind))
            offsets = np.append(0, np.searchsorted(place, ends, side="left")).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), items, mask=t.is_null()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    def merged(self, overlay: Matcher) -> Matcher:
        """One dictionary that searches like this one shadowed by an overlay."""
        return Matcher({**self.pairs, **overlay.pairs})


class PassingMatcher(Matcher):
    """A dictionary shadowed by an overlay, with disabled targets, searched like convert_layered().

    A phrase of the base with a disabled target is still found where it is the
    longest, but stands for its first character alone, which stays: the search
    begins again behind it, and shorter sources at its place are lost.
    """

    def __init__(self, base: Matcher, overlay: Matcher, removed: frozenset[str]):
        self.layers = base, overlay, removed
        off = {f for f, t in base.pairs.items() if t in removed and f not in overlay.pairs}
        super().__init__({**base.pairs, **overlay.pairs, **{f: f[0] for f in off}})
        self.passed = {f for f in off if len(f) > 1}

    def __reduce__(self):
        return PassingMatcher, self.layers

    def step(self, source: str) -> int:
        return 1 if source in self.passed else len(source)


def convert_layered(base: Matcher, overlay: Matcher, removed: frozenset[str], text: str) -> str:
    """Conversion with an overlay and disabled targets, without compiling both into one.

    At each place the longer source wins, the overlay's if they tie. Where the
    base's wins and its target is disabled, one character stays and matching
    goes on behind it. An empty base converts nothing.
    """
    if not base:
        return text
    if not removed and not overlay:
        return base.convert(text)
    places = [m.starts.pattern[1:-1] for m in (base, overlay) if m.starts]
    find = re.compile("[" + "".join(places) + "]").search
    out, last = [], 0
    hit = find(text)
    while hit:
        at = hit.start()
        b, o = base.longest(text, at), overlay.longest(text, at) if overlay else 0
        step = 1
        if b or o:
            layer, n = (overlay, o) if o >= b else (base, b)
            target = layer.pairs[text[at : at + n]]
            if layer is overlay or target not in removed:
                out += (text[last:at], target)
                last, step = at + n, n
        hit = find(text, at + step)
    return "".join([*out, text[last:]])
