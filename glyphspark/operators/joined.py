"""Conversion with the dictionary as a table, of any size.

Tables within BROADCAST and BROADCAST_CHARS are broadcast as arrays, by which
texts go in Arrow batches. With larger ones, joins and folds run without Python
workers: each distinct text is cut into pieces with what follows them. At each place
the first characters are joined with the stems of all sources, which tells the
lengths to try; what has these lengths there is joined with the sources. A
dictionary of up to BROADCAST rows, which are counted first, is broadcast; a
larger one is shuffled, and what stands at the places with it. A fold over the matches of a
text, by place and from the longest, takes the leftmost-longest ones.

A text may have pairs of its own besides, by a scope that its row names; they
win over the table's where both have a source. Disabled targets restart the
search: where the match to take is the table's and has one, a single character
is passed over and the search begins again behind it, so shorter sources at
that place are lost.
"""

from __future__ import annotations

import pickle
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import HELD, cut, let, text_blocks
from ..functions.columns import Shared
from ..functions.layers import Layers, Own, Table
from ..scratch import shared_dir

#: Characters of a piece and of a stem, at most.
PIECE, STEM = 64, 3
#: Rows of a dictionary that are broadcast, at most; a larger one is shuffled.
BROADCAST = 500_000
#: Characters of all tables that are broadcast as arrays, at most: in a Python worker they take some eight bytes each, and rows some 60.
BROADCAST_CHARS = 1 << 23
KEY = ("__k1", "__k2")
MATCH = "struct<start:int,n:int,dst:string>"


def keys(*cols: Column) -> list[Column]:
    """Two hashes, 128 bits together, that stand for the values of some columns."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*marked).alias(KEY[0]), F.xxhash64(F.lit(1), *marked).alias(KEY[1])]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table below the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/glyphspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _places(texts: DataFrame, longest: int) -> DataFrame:
    """The key and scope of a text with each of its places and what begins there, ``longest`` characters at most."""

    def with_rest(pieces: Column) -> Column:
        more = -(-(longest - 1) // PIECE)
        return F.transform(pieces, lambda p, i: F.struct((i * PIECE).alias("base"), F.length(p).alias("n"), F.concat(p, F.substring(F.array_join(F.slice(pieces, i + 2, more), ""), 1, longest - 1)).alias("body")))

    pieces = let(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), with_rest)
    rows = texts.select(*KEY, "scope", F.explode(pieces).alias("p")).select(*KEY, "scope", "p.base", "p.body", F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("i"))
    return rows.select(*KEY, "scope", (F.col("base") + F.col("i")).alias("start"), F.substring(F.col("body"), F.col("i") + 1, F.lit(longest)).alias("rest"))


def matches(texts: DataFrame, pairs: DataFrame, own: DataFrame | None = None, overlay: DataFrame | None = None, gone: DataFrame | None = None, off: DataFrame | None = None) -> DataFrame:
    """(key, start, n, layer, dst, off): every source at every place of texts (key, scope, text).

    ``pairs`` and ``overlay`` are (from, to) with distinct sources; ``own`` are
    (scope, from, to) with sources distinct in a scope; ``gone`` are (scope,
    from) that the overlay lacks for a scope. layer is 0 for a text's own
    pairs, 1 for the overlay's, 2 for the table's. off says whether a match of
    the table has a disabled target, by rows ``off`` (scope, targets).
    """
    named = lambda d, *more: d.select(*more, F.col("from").alias("src"), F.coalesce("to", F.lit("")).alias("dst")).filter("length(src) > 0")
    layers = [(k, d) for k, d in enumerate((own if own is None else named(own, "scope"), overlay if overlay is None else named(overlay), named(pairs))) if d is not None]
    sources = layers[0][1].select("src")
    for _, d in layers[1:]:
        sources = sources.unionByName(d.select("src"))
    size = sources.agg(F.min(F.length("src")).alias("least"), F.max(F.length("src")).alias("most"), F.count(F.lit(1)).alias("n")).first()
    sized = F.broadcast if size["n"] <= BROADCAST else lambda d: d
    k = min(size["least"] or 1, STEM)
    stems = sources.groupBy(F.substring("src", 1, k).alias("stem")).agg(F.collect_set(F.length("src")).alias("lengths"))
    at = _places(texts, size["most"] or 1).withColumn("stem", F.substring("rest", 1, k)).join(sized(stems), "stem")
    grams = at.select(*KEY, "scope", "start", "rest", F.explode("lengths").alias("n")).withColumn("src", F.substring(F.col("rest"), F.lit(1), F.col("n"))).filter(F.length("src") == F.col("n"))
    out = [*KEY, "start", "n"]
    found = []
    disabled = None if off is None else off.select("scope", F.explode("targets").alias("dst")).distinct()
    for k, d in layers:
        if k == 2 and disabled is not None:
            d = d.join(disabled.filter("scope is null").select("dst", F.lit(True).alias("all_off")), "dst", "left")
        hits = grams.join(sized(d), ["scope", "src"] if k == 0 else "src")
        if k == 1 and gone is not None:
            hits = hits.join(gone.select("scope", F.col("from").alias("src")).distinct(), ["scope", "src"], "left_anti")
        flag = F.lit(False)
        if k == 2 and disabled is not None:
            hits = hits.join(disabled.filter("scope is not null").withColumn("own_off", F.lit(True)), ["scope", "dst"], "left")
            flag = F.coalesce("all_off", "own_off", F.lit(False))
        found.append(hits.select(*out, F.lit(k).alias("layer"), "dst", flag.alias("off")))
    return reduce(DataFrame.unionByName, found)


def leftmost_longest(found: Column) -> Column:
    """Of array<struct<start, order, layer, dst, off>>, order being less the length, the matches that replace, as array<MATCH>."""

    def take(a: Column, m: Column) -> Column:
        one, full = F.array(F.struct(m["start"].alias("start"), (-m["order"]).alias("n"), m["dst"].alias("dst")).cast(MATCH)), F.size(a["held"]) >= HELD
        held = F.when(m["off"], a["held"]).when(full, one).otherwise(F.concat(a["held"], one))
        done = F.when(full & ~m["off"], F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"])
        behind = m["start"] + F.when(m["off"], 1).otherwise(-m["order"])
        return F.when(m["start"] < a["end"], a).otherwise(F.struct(behind.alias("end"), held.alias("held"), done.alias("done")))

    def chosen(ms: Column) -> Column:
        longest = F.filter(ms, lambda m, i: (i == 0) | (F.get(ms, i - 1)["start"] != m["start"]))
        start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{MATCH}>").alias("held"), F.array().cast(f"array<array<{MATCH}>>").alias("done"))
        return F.aggregate(longest, start, take, lambda a: F.flatten(F.concat(a["done"], F.array(a["held"]))))

    return let(F.sort_array(found), chosen)


def replaced(text: Column, taken: Column) -> Column:
    """A text with its matches, an array<MATCH> by place, replaced."""

    def of(blocks: Column) -> Column:
        ends = F.transform(taken, lambda m: m["start"] + m["n"])
        before = F.concat(F.array(F.lit(0)), ends)
        parts = F.zip_with(taken, F.slice(before, 1, F.size(taken)), lambda m, at: F.concat(cut(blocks, at, m["start"] - at), m["dst"]))
        return F.concat(F.array_join(parts, ""), let(F.element_at(before, -1), lambda at: cut(blocks, at, F.length(text) - at)))

    return let(text_blocks(text), of)


def _named(d: DataFrame, *more: str | Column) -> DataFrame:
    return d.select(*more, F.col("from").alias("src"), F.coalesce("to", F.lit("")).alias("dst")).filter("length(src) > 0")


class Held:
    """Layers with the numbers of the scopes that have something of their own."""

    def __init__(self, layers: Layers, scopes: pa.Array):
        self.layers, self.scopes = layers, scopes

    def numbers(self, scopes: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(scopes, self.scopes), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.scopes) else np.full(len(scopes), -1, np.int64)

    def convert(self, texts: pa.Array, scopes: pa.Array | None = None) -> pa.Array:
        return self.layers.convert_array(texts, None if scopes is None else self.numbers(scopes))


class SharedTables(Shared):
    """As Shared, but a worker keeps the last two alone, since tables are large."""

    def get(self):
        return _tables(self.digest, self.sent.value)


@lru_cache(maxsize=2)
def _tables(digest: str, data: bytes) -> object:
    return pickle.loads(data)


def held(pairs: DataFrame, own: DataFrame | None = None, off: DataFrame | None = None, overlay: DataFrame | None = None, gone: DataFrame | None = None) -> Held | None:
    """All tables as arrays for a broadcast; None if they have over BROADCAST rows or BROADCAST_CHARS characters, which are counted first."""
    targets = None if off is None else off.select(F.col("scope").cast("string").alias("scope"), F.explode("targets").alias("dst")).distinct()
    barred = None if gone is None else gone.select(F.col("scope").cast("string").alias("scope"), F.col("from").alias("src")).distinct()
    mine = None if own is None else _named(own, F.col("scope").cast("string").alias("scope")).filter("scope is not null")
    tables = [_named(pairs), mine, None if overlay is None else _named(overlay), targets, barred]
    rows, chars = BROADCAST, BROADCAST_CHARS
    for d in tables:
        if d is not None:
            size = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.concat_ws("", *d.columns)).cast("long")).alias("chars")).first()
            rows, chars = rows - size["n"], chars - (size["chars"] or 0)
        if rows < 0 or chars < 0:
            return None
    base, mine, over, dead, less = (None if d is None else d.toArrow() for d in tables)
    col = lambda t, name: t.column(name).combine_chunks().cast(pa.string())
    names = pa.concat_arrays([pa.array([], pa.string()), *[col(t, "scope") for t in (mine, dead, less) if t is not None]]).drop_null().unique()
    numbers = lambda t: pc.index_in(col(t, "scope"), names)
    numbered = lambda t, name: [] if t is None else [(s, x) for s, x in zip(numbers(t).to_pylist(), col(t, name).to_pylist(), strict=True) if s is not None and x is not None]
    everywhere = pa.array([], pa.string()) if dead is None else col(dead.filter(pc.is_null(dead.column("scope"))), "dst")
    flags = pc.is_in(col(base, "dst"), value_set=everywhere).to_numpy(zero_copy_only=False)
    scoped = None if mine is None else Table(col(mine, "src"), col(mine, "dst"), scopes=numbers(mine).to_numpy(zero_copy_only=False).astype(np.int64))
    made = Layers(Table(col(base, "src"), col(base, "dst"), flags), None if over is None else Table(col(over, "src"), col(over, "dst")), Own(scoped, numbered(less, "src"), numbered(dead, "dst")))
    return Held(made, names)


def convert(df: DataFrame, text_col: str, pairs: DataFrame, own: DataFrame | None = None, scope_col: str | None = None, off: DataFrame | None = None, overlay: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """df with the texts of a column converted by a table of pairs (from, to).

    ``own`` has pairs (scope, from, to) for rows by ``scope_col``; ``off`` has
    disabled targets (scope, targets array<string>), a null scope's for all
    rows; ``overlay`` has pairs for all rows that win over the table's, but for
    those in ``gone`` (scope, from). A null text stays null; an empty table of pairs or texts changes
    nothing. Equal texts of a scope are converted once; the other columns are
    joined to the results, of which Spark splits hot ones. Columns of any
    names but the keys' pass through. What is converted is written to the shared folder.

    Tables of up to BROADCAST rows and BROADCAST_CHARS characters in all are broadcast as arrays instead, by
    which the texts go in Arrow batches, without a shuffle.
    """
    small = held(pairs, own, off, overlay, gone)
    if small is not None:
        shared = SharedTables(df.sparkSession, small)
        text = F.col(f"`{text_col}`").cast("string")
        if scope_col:
            done = F.arrow_udf(lambda t, s: shared.get().convert(t, s), "string")(text, F.col(f"`{scope_col}`").cast("string"))
        else:
            done = F.arrow_udf(lambda t: shared.get().convert(t), "string")(text)
        return df.select(*[done.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
    scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    keyed = df.select("*", *keys(scope, text))
    texts = df.select(*keys(scope, text), scope.alias("scope"), text.alias("text")).filter("text is not null").dropDuplicates(list(KEY))
    found = F.collect_set(F.struct("start", (-F.col("n")).alias("order"), "layer", "dst", "off")).alias("found")
    rows = texts.join(matches(texts, pairs, own, overlay, gone, off).groupBy(*KEY).agg(found), list(KEY), "left")
    taken = leftmost_longest(F.col("found"))
    done = F.when(F.col("found").isNull(), F.col("text")).otherwise(let(taken, lambda t: replaced(F.col("text"), t)))
    converted = written(rows.select(*KEY, done.alias("__done")), "converted")
    return keyed.join(converted, list(KEY), "left").select(*[F.col("__done").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
