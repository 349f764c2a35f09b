"""Conversion of Arrow arrays of texts by tables in layers, as arrays throughout.

A table holds sources and targets as code points, and its sources by their
hashes, so that one of half a million pairs takes some tens of MB and is built
without a loop over pairs. All places of a group of texts are looked up at once,
length by length; what a hash finds is compared with the text. The pairs of a
text's own scope win over an overlay's, and these over the table's; disabled
targets pass one character, as in ``matcher.convert_layered``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa

from .markup import MarkupConverter, PageRules, joined_parts
from .matcher import _PAIR_BITS, Matcher, _codes, _groups, _leftmost, _pair_hash, _strings

_STEP, _LAST, _SCOPE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ONE = np.uint64(1)
#: Bits of a table's index at least and at most.
_INDEX = 10, 24


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Table:
    """Sources with their targets; in a scope, a number from 0, if ``scopes`` are given. Sources must be distinct (in a scope) and not empty."""

    def __init__(self, src: pa.Array, dst: pa.Array, off: np.ndarray | None = None, scopes: np.ndarray | None = None):
        self.given = src, dst, off, scopes
        if not len(src):
            src = dst = pa.array([""])[:0]
        _, self.src, ends = _codes(src)
        self.n = np.diff(ends, prepend=0)
        self.begin = ends - self.n
        _, self.dst, ends = _codes(dst)
        self.n_dst = np.diff(ends, prepend=0)
        self.begin_dst = ends - self.n_dst
        self.off = np.zeros(len(src), bool) if off is None else off
        self.scopes = scopes
        self.lengths = np.unique(self.n).tolist()
        h, live = np.zeros(len(src), np.uint64), np.arange(len(src))
        for j in range(self.lengths[-1] if self.lengths else 0):
            live = live[self.n[live] > j]
            h[live] = h[live] * _STEP + self.src[self.begin[live] + j] + _ONE
        keys = self.key(h, scopes)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        bits = int(np.clip((4 * len(src)).bit_length(), *_INDEX))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.n)

    def __reduce__(self):
        return Table, self.given

    @staticmethod
    def key(h: np.ndarray, scopes: np.ndarray | None) -> np.ndarray:
        k = h * _LAST
        return k if scopes is None else k ^ ((scopes + 1).astype(np.uint64) * _SCOPE)

    def reach(self, out: np.ndarray, alone: np.ndarray) -> None:
        """Notes, by the hash of two neighbours, the length of the longest source that may begin with them, 255 for more, and sources of one character."""
        two = self.n > 1
        at = self.begin[two]
        np.maximum.at(out, _pair_hash(self.src[at], self.src[at + 1]), np.minimum(self.n[two], 255).astype(np.uint8))
        alone[self.src[self.begin[~two]]] = 1

    def find(self, h: np.ndarray, at: np.ndarray, n: int, codes: np.ndarray, scopes: np.ndarray | None) -> np.ndarray:
        """The number of the source of n characters at each place, -1 for none; h are the hashes of what stands there, scopes the places' scopes."""
        keys = self.key(h, scopes)
        slot = (keys >> self.shift).astype(np.int64)
        place, stop = self.first[slot], self.first[slot + 1]
        out = np.full(len(at), -1, np.int64)
        live = np.flatnonzero(place < stop)
        place, stop, keys = place[live], stop[live], keys[live]
        while len(live):
            hit = np.flatnonzero(self.keys[place] == keys)
            if len(hit):
                number = self.order[place[hit]]
                good = self.n[number] == n
                begin, where = self.begin[number], at[live[hit]]
                if scopes is not None:
                    good &= self.scopes[number] == scopes[live[hit]]
                begin = np.where(good, begin, 0)
                for j in range(n):
                    good &= self.src[np.minimum(begin + j, len(self.src) - 1)] == codes[where + j]
                out[live[hit[good]]] = number[good]
            place = place + 1
            more = (place < stop) & (out[live] < 0)
            live, place, stop, keys = live[more], place[more], stop[more], keys[more]
        return out

    @cached_property
    def of_target(self) -> dict[str, list[int]]:
        """The numbers of the pairs that have a target."""
        out: dict[str, list[int]] = {}
        for i, t in enumerate(self.given[1].to_pylist()):
            out.setdefault(t, []).append(i)
        return out

    @cached_property
    def of_source(self) -> dict[str, list[int]]:
        return {f: [i] for i, f in enumerate(self.given[0].to_pylist())}


def table(pairs: Iterable[tuple[str, str]]) -> Table:
    rows = list(pairs)
    return Table(pa.array([f for f, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()))


def _barred(rows: Iterable[tuple[int, str]], numbers: dict[str, list[int]], size: int) -> np.ndarray:
    """(scope, text) as numbers of scope and pair in one."""
    return np.unique(np.array([s * size + i for s, t in rows for i in numbers.get(t, ())], np.int64))


@dataclass
class Own:
    """What holds in scopes alone: pairs, sources that the overlay lacks, and targets of the table that are disabled."""

    pairs: Table | None = None
    gone: list[tuple[int, str]] = field(default_factory=list)
    off: list[tuple[int, str]] = field(default_factory=list)


class Layers:
    """A table under an overlay, and what holds in scopes."""

    def __init__(self, base: Table, overlay: Table | None = None, own: Own | None = None):
        self.base, self.over, self.own = base, overlay, own or Own()

    def __reduce__(self):
        return Layers, (self.base, self.over, self.own)

    @cached_property
    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        out, alone = np.zeros(1 << _PAIR_BITS, np.uint8), np.zeros(0x110000, np.uint8)
        for t in (self.base, self.over, self.own.pairs):
            if t is not None and len(t):
                t.reach(out, alone)
        return out, alone

    @cached_property
    def _bars(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        gone = _barred(self.own.gone, self.over.of_source, len(self.over)) if self.own.gone and self.over is not None else none
        return gone, _barred(self.own.off, self.base.of_target, len(self.base)) if self.own.off else none

    def convert_array(self, texts: pa.Array, scopes: np.ndarray | None = None, own: Own | None = None) -> pa.Array:
        """The texts converted, each in its scope (-1 for none); nulls stay. ``own`` may replace what holds in scopes."""
        it = self if own is None else self.with_own(own)
        done, at = [], 0
        for t in _groups(texts):
            done.append(it._converted(t, None if scopes is None else scopes[at : at + len(t)]))
            at += len(t)
        return pa.concat_arrays(done) if done else texts

    def with_own(self, own: Own) -> Layers:
        """These layers with other scopes; what is known of the tables is kept."""
        out = Layers(self.base, self.over, own)
        plain = self.__dict__.setdefault("_plain_layers", Layers(self.base, self.over))
        out.__dict__["_reach"] = plain._reach
        if own.pairs is not None and len(own.pairs):
            out.__dict__["_reach"] = tuple(x.copy() for x in plain._reach)
            own.pairs.reach(*out._reach)
        return out

    def _places(self, codes: np.ndarray, ends: np.ndarray, scopes: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(place, length, layer, number, whether disabled) of the longest source at each place that has one."""
        reach, alone = self._reach
        far = np.zeros(len(codes), np.uint8)
        far[:-1] = reach[_pair_hash(codes[:-1], codes[1:])]
        np.maximum(far, alone[codes], out=far)
        at = np.flatnonzero(far)
        row = np.searchsorted(ends, at, side="right")
        most = max(t.lengths[-1] for t in (self.base, self.over, self.own.pairs) if t is not None and len(t))
        far = far[at].astype(np.int64)
        far = np.minimum(np.where(far == 255, most, far), ends[row] - at)
        scope = None if scopes is None else scopes[row]
        size, layer, number, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        gone, barred = self._bars
        tables = [(k, t, set(t.lengths)) for k, t in ((2, self.base), (1, self.over), (0, self.own.pairs)) if t is not None and len(t)]
        live, place, h = np.arange(len(at)), at.copy(), np.zeros(len(at), np.uint64)
        for n in range(1, most + 1):
            more = far >= n
            if not more.all():
                live, place, h, far = live[more], place[more], h[more], far[more]
            if not len(live):
                break
            h *= _STEP
            h += codes[place]
            h += _ONE
            place += 1
            for k, t, lengths in tables:
                if n not in lengths or (k == 0 and scope is None):
                    continue
                hit = t.find(h, at[live], n, codes, scope[live] if k == 0 else None)
                good = np.flatnonzero(hit >= 0)
                where, hit = live[good], hit[good]
                dead = np.zeros(len(where), bool) if k < 2 else t.off[hit]
                bars = (None, gone, barred)[k]
                if scope is not None and bars is not None and len(bars):
                    barring = np.isin(scope[where] * len(t) + hit, bars) & (scope[where] >= 0)
                    if k == 1:
                        where, hit, dead = where[~barring], hit[~barring], dead[~barring]
                    else:
                        dead = dead | barring
                size[where], layer[where], number[where], off[where] = n, k, hit, dead
        found = np.flatnonzero(size)
        return at[found], size[found], layer[found], number[found], off[found]

    def _converted(self, texts: pa.Array, scopes: np.ndarray | None) -> pa.Array:
        _, codes, ends = _codes(texts)
        if not len(codes) or not any(t is not None and len(t) for t in (self.base, self.over, self.own.pairs)):
            return texts
        at, size, layer, number, off = self._places(codes, ends, scopes)
        keep = _leftmost(at, at + np.where(off, 1, size))
        keep = ~off if keep is None else keep & ~off
        at, size, layer, number = at[keep], size[keep], layer[keep], number[keep]
        if not len(at):
            return texts
        tables = {2: self.base, 1: self.over, 0: self.own.pairs}
        to = np.zeros(len(at), np.int64)
        for k, t in tables.items():
            if t is not None and len(t):
                to[layer == k] = t.n_dst[number[layer == k]]
        shift = np.zeros(len(codes) + 1, np.int64)
        shift[at + size] = to - size
        np.cumsum(shift, out=shift)
        kept = np.ones(len(codes), bool)
        kept[np.repeat(at, size) + _ramp(size)] = False
        kept = np.flatnonzero(kept)
        out = np.empty(len(codes) + int(shift[-1]), np.uint32)
        out[kept + shift[kept]] = codes[kept]
        begin = at + shift[at]
        for k, t in tables.items():
            if t is not None and len(t):
                mine = layer == k
                ramp, n = _ramp(to[mine]), to[mine]
                out[np.repeat(begin[mine], n) + ramp] = t.dst[np.repeat(t.begin_dst[number[mine]], n) + ramp]
        return _strings(out.tobytes().decode("utf-32-le"), ends + shift[ends], texts)


class MarkupLayers:
    """Conversion of arrays of texts with markup by layers; a text's own rules are its scope, and ``gone`` and ``off`` of these what it removes."""

    def __init__(self, layers: Layers, target: str, skip_code: bool, global_rules: bool):
        self.given = layers, target, skip_code, global_rules
        self.layers, self.target, self.global_rules = layers, target, global_rules and len(layers.base) > 0
        self.parser = MarkupConverter(Matcher({}), target, skip_code, global_rules)

    def __reduce__(self):
        return MarkupLayers, self.given

    def convert_array(self, texts: pa.Array) -> pa.Array:
        """The texts converted; nulls stay."""
        done = [self._converted(t) for t in _groups(texts)]
        return pa.concat_arrays(done) if done else texts

    def _converted(self, texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        parted = [None if t is None else self.parser.parts(t) for t in rows]
        plain = [p for x in parted if x for p in x[0]]
        if not len(self.layers.base):
            done = plain
        elif self.global_rules:
            scopes = np.repeat(np.arange(len(rows)), [len(x[0]) if x else 0 for x in parted])
            done = self.layers.convert_array(pa.array(plain, pa.string()), scopes, self._own(rows)).to_pylist()
        else:
            done = self.layers.convert_array(pa.array(plain, pa.string())).to_pylist()
        out, at = [], 0
        for x in parted:
            out.append(joined_parts(done[at : at + len(x[0])], x[1]) if x else None)
            at += len(x[0]) if x else 0
        return pa.array(out, pa.string())

    def _own(self, rows: list[str | None]) -> Own:
        scopes, pairs, gone = [], [], []
        for i, t in enumerate(rows):
            if t is None or "-{" not in t:
                continue
            adds, removes = PageRules.of(t).overlay(self.target)
            mine = [(f, x) for f, x in adds.items() if f not in removes]
            pairs += mine
            scopes += [i] * len(mine)
            gone += [(i, f) for f in removes]
        if not pairs and not gone:
            return Own()
        src, dst = (pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))
        return Own(Table(src, dst, scopes=np.array(scopes, np.int64)), gone, gone)
