"""Helpers for Spark's array functions: values named once, folds with outputs, texts in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block of a text, and outputs of a fold that are held in one array.
BLOCK, HELD = 512, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(values: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """The outputs, of a type ``out``, of a state that takes an array's elements in turn.

    ``step(state, element)`` gives the next state and the output; ``last(state)``
    gives one more output at the end. Outputs are gathered in arrays of HELD
    elements, since appending to an array copies it.
    """
    none = F.array().cast(f"array<{out}>")
    start = F.struct(state.alias("at"), none.alias("held"), F.array().cast(f"array<array<{out}>>").alias("done"))

    def take(a: Column, v: Column) -> Column:
        def put(r: Column) -> Column:
            full, one = F.size(a["held"]) >= HELD, F.array(r["out"])
            held = F.when(full, one).otherwise(F.concat(a["held"], one))
            return F.struct(r["at"].alias("at"), held.alias("held"), F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"))

        at, made = step(a["at"], v)
        return let(F.struct(at.alias("at"), made.cast(out).alias("out")), put)

    def finish(a: Column) -> Column:
        parts = F.concat(a["done"], F.array(a["held"]))
        return F.flatten(F.concat(parts, F.array(F.array(last(a["at"]).cast(out)))) if last else parts)

    return F.aggregate(values, start, take, finish)


def text_blocks(text: Column) -> Column:
    """A text as an array of blocks, for cut(): a place in a text is found by counting characters from its start."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def cut(blocks: Column, at: Column, n: Column) -> Column:
    """The n characters from a place, counted from 0, of a text in blocks."""
    at, n = at.cast("int"), n.cast("int")
    shift = BLOCK.bit_length() - 1
    first, last = F.shiftright(at, shift), F.shiftright(at + F.greatest(n, F.lit(1)) - 1, shift)
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), at - first * BLOCK + 1, n)
