"""Conversion of texts with markup: by broadcast tables in Arrow batches, or as joins and folds without Python workers where tables are large.

For the joins, the rules of all texts become rows: pairs that a text adds for itself, and
sources that it removes. A fold over brackets parts each text into what is
shown as it is and what is plain; the plain parts are converted by a join with
the table of pairs and with the pairs of their own text, and put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.layers import MarkupLayers
from ..variants import parse
from . import joined


def actions(texts: DataFrame, target: str) -> DataFrame:
    """(scope, place, action, from, to): the pairs that the rules of texts (scope, text) add and remove, in order."""
    rows = texts.select("scope", F.posexplode(rules.page_actions(F.col("text"), target)).alias("rule", "a"))
    rows = rows.select("scope", "rule", "a.action", F.posexplode("a.pairs").alias("pair", "p"))
    return rows.select("scope", F.struct("rule", "pair").alias("place"), "action", F.col("p.src").alias("from"), F.col("p.dst").alias("to"))


def added(rows: DataFrame) -> DataFrame:
    """(scope, from, to) of actions: of one source's pairs the last stays; a removed source has none, whatever the order."""
    adds = rows.filter("action = 'add'").withColumn("rn", F.row_number().over(Window.partitionBy("scope", "from").orderBy(F.col("place").desc()))).filter("rn = 1")
    return adds.join(rows.filter("action = 'remove'").select("scope", "from").distinct(), ["scope", "from"], "left_anti").select("scope", "from", "to")


def removed(rows: DataFrame) -> DataFrame:
    """(scope, targets): the words that the rules of a text remove, which disable targets of the table."""
    return rows.filter("action = 'remove'").groupBy("scope").agg(F.collect_set("from").alias("targets"))


def convert(df: DataFrame, text_col: str, pairs: DataFrame, target: str, skip_code: bool = True, global_rules: bool = True, overlay: DataFrame | None = None, off: list[str] | None = None) -> DataFrame:
    """df with the texts of a column, which may hold markup, converted to a target by a table of pairs (from, to).

    ``global_rules`` applies the rules of a text to all of its plain parts;
    ``skip_code`` leaves code blocks as they are. ``overlay`` has pairs for all
    texts that win over the table's, ``off`` targets of the table that are disabled. A null text stays null, an
    empty one empty; an empty table of pairs leaves plain parts as they are.
    Columns of any names but the keys' pass through. Pairs of up to
    joined.BROADCAST rows (and joined.BROADCAST_CHARS characters), overlay included, are broadcast as arrays, by which
    the texts go in Arrow batches; each batch reads the rules of its own texts,
    so that nothing is shuffled or written. With more, equal texts are read once.
    """
    tag, text = parse(target).tag, F.col(f"`{text_col}`").cast("string")
    disabled = df.sparkSession.createDataFrame([(None, off)], "scope string, targets array<string>") if off else None
    small = joined.held(pairs, off=disabled, overlay=overlay)
    if small is not None:
        shared = joined.SharedTables(df.sparkSession, MarkupLayers(small.layers, tag, skip_code, global_rules))
        done = F.arrow_udf(lambda t: shared.get().convert_array(t), "string")(text)
        return df.select(*[done.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
    keyed = df.select("*", *joined.keys(text))
    texts = df.select(*joined.keys(text), text.alias("text")).filter("text is not null").dropDuplicates(list(joined.KEY))
    texts = texts.withColumn("scope", F.concat_ws(":", *joined.KEY))
    parts = texts.select(*joined.KEY, "scope", F.posexplode(rules.segments(F.col("text"), tag, skip_code)).alias("place", "s")).select(*joined.KEY, "scope", "place", "s.shown", "s.plain")
    parts = joined.written(parts.withColumnsRenamed(dict(zip(joined.KEY, ("__p1", "__p2"), strict=True))), "parts")
    own = gone = None
    if pairs.isEmpty():
        overlay = None
    elif global_rules:
        rows = joined.written(actions(texts.filter(F.contains("text", F.lit("-{"))), tag), "rules")
        own, gone = added(rows), rows.filter("action = 'remove'").select("scope", "from")
        disabled = removed(rows) if disabled is None else disabled.unionByName(removed(rows))
    done = joined.convert(parts, "plain", pairs, own, "scope", disabled, overlay, gone)
    whole = done.groupBy("__p1", "__p2").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("shown", "plain").alias("t")))).alias("parts"))
    whole = whole.select(F.col("__p1").alias(joined.KEY[0]), F.col("__p2").alias(joined.KEY[1]), F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("__whole"))
    return keyed.join(whole, list(joined.KEY), "left").select(*[F.col("__whole").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
