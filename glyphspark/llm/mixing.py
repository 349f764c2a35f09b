"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

The documents of a source stand in a fixed order. Each has the same expected
number of copies, target / source size, kept as a whole number of 2**-24ths so
that prefix sums are exact in any order of evaluation. With one random offset
for each source, a document is emitted once for every whole number that its
part of the prefix sum crosses.

The prefix sum of a source is taken in three levels, so that no task holds a
source: over size classes, over slices of a class by a hash of the id, and over
the documents of a slice. There are 256 slices, and sixteen times as many
whenever a slice of all documents would have more than ``SLICE``. A class is a size's number of digits with its two leading digits;
neighbouring documents are thus of like size, which keeps the words taken near
the target. The two upper levels have a bounded number of rows for each source.
Rows alike in all that matters are one row with a count until the end, so many
of them are no hot slice; documents without an id are dealt by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RUN, materialize, word_count

#: One expected copy.
ONE = 1 << 24
#: Documents of a slice, of all sources and classes together, at most; hex digits that name a slice, at least.
SLICE, DIGITS = 1 << 16, 2


def size_class(size: Column) -> Column:
    """100 times the number of digits, plus the two leading digits; sizes below 100 are their own class."""
    s = size.cast("string")
    return F.when(size < 100, size).otherwise(F.length(s) * 100 + F.substring(s, 1, 2).cast("long")).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in 2**-24ths, from its name and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 6), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """The target of each source, from its rows (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the
    sum of all sizes by weight; a target stops at ``cap`` times the source's
    size, and the excess is shared again until no target is above. In order of
    cap / weight the sources that stop come first, so running sums give the
    same result as repeated sharing: the first that doesn't stop has the largest
    share per weight. One row for each source is sorted here,
    never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ranked = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, every = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    s = w.withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
    s = s.withColumn("share", F.when(F.col("left_size") * F.col("w") <= F.col("most") * F.col("left_w"), F.col("left_size") / F.col("left_w")))
    rate = F.max("share").over(every)
    return s.select("source", "source_size", F.when(F.col("share").isNull(), F.col("most")).otherwise(rate * F.col("w")).alias("target"))


def slice_digits(n: int) -> int:
    """Hex digits of a slice's name for so many documents."""
    digits = DIGITS
    while n > SLICE << 4 * digits:
        digits += 1
    return digits


def _alike(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Rows of equal id, source, size and columns of ``keep`` as one, with their number n and their place; written."""
    slice_ = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))), 1, 8)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), slice_.alias("slice"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    ).withColumn("class", size_class(F.col("size")))
    alike = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "mix", narrow=True)
    digits = slice_digits(alike.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"])
    return alike.withColumn("slice", F.substring("slice", 1, digits))


def _placed(rows: DataFrame, cap: float, seed: int) -> DataFrame:
    """Rows of _alike with ``each``, the expected copies of one, and ``start``, the sum of those before them from the offset."""
    keep = [c for c in rows.columns if c.startswith("keep_")]
    aim = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap)
    aim = aim.withColumn("each", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE + 0.5)).otherwise(0).cast("long")).withColumn("none", F.col("source").isNull())
    key = ["none", "source_key"]
    keyed = lambda d: d.withColumn("none", F.col("source").isNull()).withColumn("source_key", F.coalesce("source", F.lit("")))
    rows, aim = keyed(rows), keyed(aim).select(*key, "source_size", "target", "each")
    slices = rows.groupBy(*key, "class", "slice").agg(F.sum("n").alias("n"))
    classes = slices.groupBy(*key, "class").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    classes = classes.select(*key, "class", earlier(Window.partitionBy(*key).orderBy("class")).alias("class_at"))
    slices = slices.select(*key, "class", "slice", earlier(Window.partitionBy(*key, "class").orderBy("slice")).alias("slice_at"))
    starts = slices.join(classes, [*key, "class"]).join(aim, key)
    in_slice = Window.partitionBy(*key, "class", "slice").orderBy("size", "id", *keep)
    rows = rows.withColumn("at", earlier(in_slice)).join(starts, [*key, "class", "slice"])
    return rows.withColumn("start", (F.col("class_at") + F.col("slice_at") + F.col("at")) * F.col("each") + offset(F.col("source"), seed))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, seed: int = 42) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns doc_id, size, source, source_size, target, copies and taken. A null
    text has size 0; a null source is a source of its own; rows with equal ids
    are separate documents, in an order fixed by id, size and source alone, so
    that rerunning agrees. Sources of size 0 and empty tables have target 0 and
    no copies. Other columns of docs are not read.
    """
    alike = _alike(docs, id_col, text_col, source_col, [])
    rows = _placed(alike, cap, seed).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, RUN.bit_length() - 1))))
    if not alike.filter(F.col("n") > RUN).isEmpty():
        rows = rows.repartition("id", "source", "size", "run")
    rest = F.least(F.col("n") - F.col("run") * RUN, F.lit(RUN))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), rest)))
    upto = F.col("start") + (F.col("run") * RUN + F.col("k")) * F.col("each")
    rows = rows.withColumn("upto", upto).withColumn("copies", F.shiftright("upto", 24) - F.shiftright(F.col("upto") - F.col("each"), 24))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, seed: int = 42) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    Rows of equal id, text and source share the copies of those evenly. Texts
    are shuffled once, to meet their copies. Where equal rows get one copy more
    than others, such rows are written and numbered by the task that read them.
    An empty table stays empty.
    """
    text = F.col(text_col).cast("string")
    names = ["__h1", "__h2"]
    keyed = docs.select("*", *[F.xxhash64(F.lit(k), F.col(id_col), text.isNull(), text, F.col(source_col)).alias(h) for k, h in enumerate(names)])
    groups = _placed(_alike(keyed, id_col, text_col, source_col, names), cap, seed)
    copies = F.shiftright(F.col("start") + F.col("n") * F.col("each"), 24) - F.shiftright("start", 24)
    groups = groups.select(*[F.col(f"keep_{h}").alias(h) for h in names], "n", copies.alias("__all")).filter("__all > 0")
    groups = materialize(groups.select(*names, F.expr("__all div n").alias("__copies"), F.expr("__all % n").alias("__more")), "copies", narrow=True)
    taken = keyed.join(groups.filter("__more = 0"), names).select(*docs.columns, "__copies")
    uneven = groups.filter("__more > 0")
    if not uneven.isEmpty():
        rows = materialize(keyed.withColumn("__task", F.spark_partition_id()).join(uneven, names), "uneven")
        task = [*names, "__task"]
        counts = rows.groupBy(*task).agg(F.count(F.lit(1)).alias("__n"))
        earlier = Window.partitionBy(*names).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*task, F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")).alias("__before"))
        rows = rows.join(counts, task).withColumn("__turn", F.row_number().over(Window.partitionBy(*task).orderBy(F.lit(0))) + F.col("__before"))
        rows = rows.withColumn("__copies", F.col("__copies") + (F.col("__turn") <= F.col("__more")).cast("long")).filter("__copies > 0")
        taken = taken.unionByName(rows.select(*docs.columns, "__copies"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS m FROM documents),
n AS (SELECT {DIGITS} + {" + ".join(f"(count(*) > {SLICE << 4 * k})::INT" for k in range(DIGITS, 8))} AS digits FROM documents),
k AS (SELECT d.*, left(m, digits) AS slice, CASE WHEN size < 100 THEN size ELSE length(size::VARCHAR) * 100 + left(size::VARCHAR, 2)::BIGINT END AS class FROM d, n),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / w AS ratio FROM s),
t AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
      (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_w FROM r),
u AS (SELECT *, CASE WHEN left_size * w <= most * left_w THEN left_size / left_w END AS share FROM t),
v AS (SELECT source, source_size, CASE WHEN share IS NULL THEN most ELSE max(share) OVER () * w END AS target FROM u),
z AS (SELECT k.*, v.source_size, v.target, CASE WHEN v.source_size > 0 THEN floor(v.target / v.source_size * {ONE} + 0.5)::BIGINT ELSE 0 END AS each,
      row_number() OVER (PARTITION BY k.source ORDER BY k.class, k.slice, k.size, k.doc_id) AS place,
      ('0x' || left(md5('42:' || coalesce(k.source, '')), 6))::BIGINT AS u
      FROM k JOIN v ON k.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target, (((place * each + u) // {ONE}) - (((place - 1) * each + u) // {ONE})) * size AS taken FROM z
"""
