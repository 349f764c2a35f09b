"""The algebra of rulesets on (table, from, to, ord) rows.

Tables have thousands of rows, so their joins broadcast by Spark's own size
check; nothing here touches texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.matcher import Matcher
from ..variants import DETECTED, parse

#: A dictionary for the driver and broadcasts: rows beyond this are refused.
MOST_PAIRS = 2_000_000


def layered(*tables: DataFrame) -> DataFrame:
    """Tables in layers: of one source's pairs the last layer's stays, and in a layer the last in order. Empty sources go."""
    rows = tables[0].withColumn("layer", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        rows = rows.unionByName(t.withColumn("layer", F.lit(i)))
    w = Window.partitionBy("from").orderBy(F.col("layer").desc(), F.col("ord").desc())
    return rows.filter("length(`from`) > 0").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "layer")


def removed(pairs: DataFrame, removes: DataFrame) -> DataFrame:
    """Pairs less those whose source is removed; removal wins whatever the order."""
    return pairs.join(removes.select("from"), "from", "left_anti").select(pairs.columns)


def mapping(base: DataFrame, adds: DataFrame | None = None, removes: DataFrame | None = None) -> DataFrame:
    """Base and added pairs less the removed ones; added ones win over the base's."""
    rows = layered(base, adds) if adds is not None else layered(base)
    return removed(rows, removes) if removes is not None else rows


def first_of_each(pairs: DataFrame) -> DataFrame:
    """One pair for each table and source: the first in order."""
    w = Window.partitionBy("table", "from").orderBy("ord")
    return pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def longest_first(pairs: DataFrame) -> DataFrame:
    """From the longest source in bytes, then by code point: the order in which the first of a source wins."""
    return pairs.orderBy("table", F.octet_length("from").desc(), "from")


def delta(regional: DataFrame, base: DataFrame) -> DataFrame:
    """Regional pairs that the base doesn't have alike."""
    return regional.join(base.select("from", "to"), ["from", "to"], "left_anti").select(regional.columns)


def table(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.filter(F.col("table") == name)


def regional(pairs: DataFrame, target: str) -> DataFrame:
    """The merged table of a target: its script's pairs, its region's over them; none for zh."""
    names = parse(target).tables
    if not names:
        return pairs.limit(0)
    script = table(pairs, names[0])
    return layered(script) if len(names) == 1 else layered(script, delta(table(pairs, names[1]), script))


def dump(pairs: DataFrame) -> DataFrame:
    """(from, to) from the shortest source in bytes, then by code point."""
    return pairs.select("from", "to").orderBy(F.octet_length("from"), "from")


def dump_places(pairs: DataFrame) -> DataFrame:
    """dump() with the place of each pair, from 0. Places are numbered within a length, after the counts of all shorter ones, so no task holds all pairs."""
    n = F.octet_length("from").alias("n")
    shorter = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = pairs.groupBy(n).agg(F.count(F.lit(1)).alias("many")).select("n", F.coalesce(F.sum("many").over(shorter), F.lit(0)).alias("before"))
    rows = pairs.select("from", "to", n).withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy("from"))).join(before, "n")
    return rows.select((F.col("before") + F.col("rn") - 1).cast("long").alias("place"), "from", "to")


def stats(pairs: DataFrame) -> DataFrame:
    """Counts of each table: pairs, sources, no-ops, single characters, length changes, the longest source."""
    return pairs.groupBy("table").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("from").alias("n_sources"),
        F.count_if(F.col("from") == F.col("to")).alias("n_same"),
        F.count_if(F.length("from") == 1).alias("n_single"),
        F.count_if(F.length("from") != F.length("to")).alias("n_length_changes"),
        F.max(F.length("from")).cast("long").alias("longest"),
    )


def bounded(pairs: DataFrame) -> list[Row]:
    """The rows of a dictionary, which is broadcast, so they are bounded."""
    rows = pairs.limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"a dictionary has at most {MOST_PAIRS} pairs")
    return rows


def matcher(pairs: DataFrame) -> Matcher:
    """The compiled dictionary of distinct sources."""
    return Matcher((r["from"], r["to"]) for r in bounded(pairs.select("from", "to")))


def compiled(rows: list[Row]) -> dict[str, Matcher]:
    """Dictionaries of the five targets with tables of their own, as regional() makes them, from rows that the driver holds."""
    held: dict[str, dict[str, str]] = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        held.setdefault(r["table"], {})[r["from"]] = r["to"]
    return {t: Matcher({f: to for name in parse(t).tables for f, to in held.get(name, {}).items()}) for t in DETECTED}
