"""Helpers shared by the operators: written tables, words, prefix sums, blocks of texts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import shared_dir

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Equal rows that one row of a plan is turned into at once.
RUN = 1 << 16


def materialize(df: DataFrame, name: str, narrow: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df below the shared folder and reads it back, which cuts its lineage.

    A narrow table, small for the texts it comes from, is rebalanced first:
    adaptive execution then writes few files of the advised size, not one for
    each task. The files survive the loss of executors. They stay until the shared
    folder is cleaned: the caller may still be reading them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/glyphspark/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if narrow else df).write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


Step = Callable[[Column, Column], Column]


def _scan(values: Column, start: Column, step: Step) -> Column:
    zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        values,
        zero,
        lambda a, v: F.struct(step(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )


def exclusive_scan(values: Column, start: Column, step: Step, block: int = 256) -> Column:
    """For each element of an array of longs, what ``step`` makes of those before it, from ``start``, which changes nothing.

    Scans go by blocks: appending to an array copies it, so one pass over n
    elements would take time in n squared.
    """

    def joined(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, start, step))
        return F.flatten(F.zip_with(bs, _scan(totals, start, step), lambda b, at: _scan(b, at, step)))

    return let(let(values, lambda v: in_blocks(v, block)), joined)


def in_blocks(values: Column, block: int) -> Column:
    """An array as an array of arrays of so many elements; one empty one for an empty array."""
    n = F.greatest(F.size(values), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))


def exclusive_sums(values: Column) -> Column:
    return exclusive_scan(values, F.lit(0).cast("long"), lambda a, b: a + b)


#: Code points of a block of a text.
BLOCK = 4096


def text_blocks(text: Column) -> Column:
    """A text as an array of blocks, for cut(): a substring is found by counting characters from the start of a text, so many of a long one would take time in its square."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def cut(blocks: Column, at: Column, n: Column) -> Column:
    """The n characters from a place, counted from 0, of a text in blocks."""
    at, n = at.cast("int"), n.cast("int")
    first = F.shiftright(at, BLOCK.bit_length() - 1)
    last = F.shiftright(at + F.greatest(n, F.lit(1)) - 1, BLOCK.bit_length() - 1)
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), at - first * BLOCK + 1, n)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    at = public_tokenizers.path(name)
    if not os.path.exists(at):
        raise FileNotFoundError(at)
    return at
