"""Readers of conversion rules: constant-array tables, dictionaries, pair files, rule lines, groups, and the packaged seed.

Files are read through Spark, so any path it can open will do. All readers
return rows (table, from, to, ord); ord is the order within a source.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = "`table` string, `from` string, `to` string, ord long"
#: Names of the constant arrays and the tables that they hold. Fixed values.
ARRAYS = {"ZH_TO_HANT": "hant", "ZH_TO_HANS": "hans", "ZH_TO_TW": "tw", "ZH_TO_HK": "hk", "ZH_TO_CN": "cn"}
#: Where the full tables are looked for if no path is given.
PATH_VARIABLE = "GLYPHSPARK_RULESETS"
GROUP = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rules", T.ArrayType(T.StructType([T.StructField("original", T.StringType()), T.StructField("conv", T.StringType())]))),
    ]
)


def checked_text(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(path, text) of files in UTF-8; ValueError if one isn't, or has another checksum than asked for."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("good"))
    for r in files.select("path", "sha256", "good").collect():  # one small row a file
        if not r.good:
            raise ValueError(f"not UTF-8: {r.path}")
        if sha256 and r.sha256 != sha256.lower():
            raise ValueError(f"checksum of {r.path} is {r.sha256}")
    return files.select("path", F.col("content").cast("string").alias("text"))


def read_arrays(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Tables from ``public const NAME = [ 'from' => 'to', ... ];`` blocks; all five names must be there."""
    text = checked_text(spark, path, sha256).select("text")
    block = r"public const \w+ = \[[^\]]*\];"
    blocks = text.select(F.explode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("b"))
    blocks = blocks.select(F.regexp_extract("b", r"public const (\w+)", 1).alias("name"), "b")
    names = {r.name for r in blocks.select("name").collect()}
    if missing := set(ARRAYS) - names:
        raise ValueError(f"tables are missing: {sorted(missing)}")
    tables = F.create_map(*[F.lit(x) for kv in ARRAYS.items() for x in kv])
    line = r"'([^']*)' => '([^']*)',"
    pairs = blocks.filter(F.col("name").isin(*ARRAYS)).select(
        tables[F.col("name")].alias("table"),
        F.posexplode(F.arrays_zip(F.regexp_extract_all("b", F.lit(line), F.lit(1)).alias("from"), F.regexp_extract_all("b", F.lit(line), F.lit(2)).alias("to"))).alias("ord", "p"),
    )
    return pairs.select("table", "p.from", "p.to", F.col("ord").cast("long").alias("ord"))


def read_dictionary(spark: SparkSession, path: str, name: str, reverse: bool = False, sha256: str | None = None) -> DataFrame:
    """``key value ...`` lines; lines that begin with # are comments.

    The first value is taken, unless there are several and the key is one of
    them: then the key is left alone. In reverse, each value goes to the first
    key that has it.
    """
    lines = checked_text(spark, path, sha256).select(F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    lines = lines.select(F.col("ord").cast("long").alias("ord"), F.filter(F.split("line", r"\s+"), lambda w: w != "").alias("w")).filter((F.size("w") > 1) & ~F.startswith(F.get("w", F.lit(0)), F.lit("#")))
    key, values = F.get("w", F.lit(0)), F.slice("w", 2, 1_000_000)
    if not reverse:
        return lines.filter((F.size("w") == 2) | ~F.array_contains(values, key)).select(F.lit(name).alias("table"), key.alias("from"), F.get("w", F.lit(1)).alias("to"), "ord")
    each = lines.select(key.alias("key"), "ord", F.posexplode(values).alias("place", "value"))
    return each.groupBy("value").agg(F.min_by("key", F.struct("ord", "place")).alias("to"), F.min("ord").alias("ord")).select(F.lit(name).alias("table"), F.col("value").alias("from"), "to", "ord")


def read_pairs(spark: SparkSession, path: str, name: str = "custom") -> DataFrame:
    """``from to`` lines, the first white space parting them; blank lines and # comments are passed over; another line is an error."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    parts = lines.select(F.lit(name).alias("table"), F.regexp_extract("line", r"^(\S+)\s+(.*)$", 1).alias("from"), F.regexp_extract("line", r"^(\S+)\s+(.*)$", 2).alias("to"), F.col("ord").cast("long").alias("ord"), "line")
    bad = parts.filter(F.col("from") == "").select("line").first()
    if bad:
        raise ValueError(f"not a pair: {bad.line!r}")
    return parts.drop("line")


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord) of a file of rules."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).select(F.trim("line").alias("line"), F.col("ord").cast("long").alias("ord")).filter("line <> ''")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Conversion groups, one JSON document a file; empty files and those that can't be read are passed over."""
    return spark.read.schema(GROUP).json(path, multiLine=True, mode="PERMISSIVE").filter("name is not null or rules is not null")


def write_groups(packed: DataFrame, path: str) -> None:
    """Packed groups as one JSON object a line."""
    packed.write.mode("overwrite").json(path)


def seed_rows() -> list[tuple[str, str, str, int]]:
    """The packaged pairs. The simplified table is the traditional one's single characters in reverse."""
    rows = [tuple(line.split("\t")) for line in (Path(__file__).parent / "seed.tsv").read_text(encoding="utf-8").splitlines() if line]
    rows += [("hans", t, f) for table, f, t in rows if table == "hant" and len(f) == 1 and f != t]
    return [(table, f, t, i) for i, (table, f, t) in enumerate(rows)]


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The tables of a path, or of the environment's, or else the seed."""
    path = path or os.environ.get(PATH_VARIABLE)
    return read_arrays(spark, path) if path else spark.createDataFrame(seed_rows(), PAIRS)
