"""Composition of dictionaries in stages, as source lists name them.

A stage is a list of dictionary names, a leading ! reversing one. A later stage
converts the targets of those before it, adds its own pairs, and adds its
sources as the earlier stages' inputs would write them. The stages of all
tables go in step, each table a scope of its own: a stage is two conversions by
joins, and collisions are settled by a window, the last in sorted order winning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joined
from ..operators.rulesets import first_of_each
from ..sources.rulesets import PAIRS, read_dictionary

Dictionary = tuple[DataFrame, DataFrame]  # forward and reverse pairs (from, to)

# The dictionaries of each table, in stages.
STAGES: dict[str, list[list[list[str]]]] = {
    "hans": [[["TSCharacters", "TSPhrases"]]],
    "hant": [[["STCharacters", "STPhrases"]]],
    "tw": [[["STPhrases", "STCharacters"], ["TWVariants"]]],
    "hk": [[["STPhrases", "STCharacters"], ["HKVariants"]]],
    "cn": [[["TWVariantsRevPhrases"], ["TSPhrases", "TSCharacters"]], [["HKVariantsRevPhrases"], ["TSPhrases", "TSCharacters"]]],
}
PHRASES: dict[str, list[list[list[str]]]] = {
    "tw": [[["STPhrases", "STCharacters"], ["TWPhrases"], ["TWVariants"]]],
    "cn": [[["!TWPhrases", "TWVariantsRevPhrases"], ["TSPhrases", "TSCharacters"]], [["HKVariantsRevPhrases"], ["TSPhrases", "TSCharacters"]]],
}


@dataclass(frozen=True)
class RulesetConfig:
    """Which sources feed which tables."""

    tables: tuple[str, ...] = ("hant", "hans", "tw", "hk", "cn")
    arrays: bool = True
    dictionaries: bool = False
    taiwan_phrases: bool = False

    def __post_init__(self):
        if not (self.arrays or self.dictionaries):
            raise ValueError("at least one kind of source is needed")

    def stages(self, table: str) -> list[list[list[str]]]:
        return (PHRASES if self.taiwan_phrases and table in PHRASES else STAGES)[table]


def _last(rows: DataFrame, *order: str) -> DataFrame:
    """(scope, from, to): of one source's pairs in a scope the last in an order; empty sources go."""
    w = Window.partitionBy("scope", "from").orderBy(*[F.col(c).desc() for c in order])
    return rows.filter("length(`from`) > 0").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("scope", "from", "to")


def read_stage(chains: dict[str, list[list[str]]], stage: int, back: bool, read: Callable[[str], Dictionary], empty: DataFrame) -> DataFrame:
    """(scope, from, to) of a stage of all chains: of forward pairs the later dictionary's win, of reverse ones the earlier's."""
    rows = [empty.select(F.lit("").alias("scope"), "from", "to", F.lit(0).alias("layer"))]
    for scope, stages in chains.items():
        for k, name in enumerate(stages[stage] if stage < len(stages) else []):
            pair = read(name.removeprefix("!"))
            rows.append(pair[back != name.startswith("!")].select(F.lit(scope).alias("scope"), "from", "to", F.lit(-k if back else k).alias("layer")))
    return joined.written(_last(reduce(DataFrame.unionByName, rows), "layer", "to"), "stage")


def flatten(spark: SparkSession, chains: dict[str, list[list[str]]], read: Callable[[str], Dictionary]) -> DataFrame:
    """(scope, from, to): for each chain of stages one dictionary that does what they do one after another."""
    empty = spark.createDataFrame([], "`from` string, `to` string")
    row = lambda d, text, kind: d.select("scope", "from", "to", F.col(text).alias("text"), F.lit(kind).alias("kind"))
    at = lambda n, of, then: F.struct(F.lit(n).alias("n"), of.alias("of"), F.lit(then).alias("then")).alias("at")

    def placed(d: DataFrame, kind: str, source: str, to: str, where: Column) -> DataFrame:
        return d.filter(F.col("kind") == kind).select("scope", F.col(source).alias("src"), F.col(to).alias("dst"), where).select("scope", F.col("src").alias("from"), F.col("dst").alias("to"), "at")

    pairs, origin = (read_stage(chains, 0, back, read, empty) for back in (False, True))
    for k in range(1, max(map(len, chains.values()))):
        forward, back = (read_stage(chains, k, b, read, empty) for b in (False, True))
        stepped = joined.convert(row(pairs, "to", "pair").unionByName(row(origin, "from", "origin")), "text", empty, forward, "scope")
        undone = joined.convert(row(forward, "from", "new").unionByName(row(back, "to", "back")), "text", empty, origin, "scope")
        stepped, undone = joined.written(stepped, "stepped"), joined.written(undone, "undone")
        old = placed(stepped, "pair", "from", "text", at(0, F.lit(""), 0))
        new = placed(undone, "new", "from", "to", at(1, F.col("from"), 0))
        other = placed(undone.filter((F.col("text") != F.col("from")) & (F.col("text") != F.col("to"))), "new", "text", "to", at(1, F.col("from"), 1))
        wrote = placed(undone, "back", "from", "text", at(0, F.col("from"), 0)), placed(stepped, "origin", "text", "to", at(1, F.col("from"), 0))
        kept = origin.select("scope", "from", "to", at(2, F.col("from"), 0))
        pairs = joined.written(_last(reduce(DataFrame.unionByName, [old, new, other]), "at"), "pairs")
        origin = joined.written(_last(reduce(DataFrame.unionByName, [*wrote, kept]), "at"), "origin")
    return pairs


def dictionary_reader(spark: SparkSession, folder: str, checksums: dict[str, str] | None = None) -> Callable[[str], Dictionary]:
    """Reads NAME.txt of a folder as forward and reverse pairs, with its checksum if one is given."""

    def read(name: str) -> Dictionary:
        path, known = f"{folder.rstrip('/')}/{name}.txt", (checksums or {}).get(name)
        return tuple(read_dictionary(spark, path, name, back, known).select("from", "to") for back in (False, True))

    return read


def compose(spark: SparkSession, config: RulesetConfig, arrays: DataFrame | None, read: Callable[[str], Dictionary] | None = None) -> DataFrame:
    """All tables of a configuration: array pairs first, so that they win where the first of a source does; of a table's chains the later wins."""
    made = spark.createDataFrame([], PAIRS)
    if config.dictionaries:
        chains = {f"{name}:{i}": stages for name in config.tables for i, stages in enumerate(config.stages(name))}
        known = flatten(spark, chains, read).withColumn("table", F.substring_index("scope", ":", 1))
        w = Window.partitionBy("table", "from").orderBy(F.col("scope").desc())
        made = known.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("table", "from", "to", F.lit(1_000_000_000).cast("long").alias("ord"))
    if config.arrays and arrays is not None:
        made = arrays.filter(arrays["table"].isin(*config.tables)).select("table", "from", "to", "ord").unionByName(made)
    return first_of_each(made)
