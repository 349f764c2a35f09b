"""Text jobs: ``spark-submit -m glyphspark.cli`` or ``python -m glyphspark.cli TARGET [IN OUT]``.

Without IN it converts standard input to standard output. Files are converted
whole, so that markup and line ends survive, and written below OUT under their
paths below IN, since Spark can't overwrite what it reads. A last line that
doesn't end gets its end; no other byte is added. Files that are blank or not
UTF-8 are left out; their paths are written below OUT as ``_left_out``, and
their number is told.
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions.columns import Converter
from .functions.markup import RuleError, parse_conv
from .operators import rulesets
from .variants import parse


def text_files(spark: SparkSession, path: str):
    """(path, text, good): whole files as UTF-8; good is false for others and for blank files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    return f.select("path", text.alias("text"), (F.is_valid_utf8(text) & F.regexp_like(text, F.lit(r"\S"))).alias("good"))


def convert_files(spark: SparkSession, source: str, target: str, fn: Callable[[Column], Column]) -> int:
    """Converts files below a folder into files below another; the number of those left out."""
    root = re.escape(re.sub(r"^[a-z]+:/+", "/", source).rstrip("/"))
    below = F.coalesce(F.nullif(F.regexp_extract("path", root + "/(.+)$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)$", 1))
    files = text_files(spark, source).withColumn("file", below)
    good = files.filter("good").select("file", F.regexp_replace(fn(F.col("text")), "\n$", "").alias("value"))
    good.write.partitionBy("file").text(target, lineSep="\n")
    left = files.filter("not good").select(F.col("file").alias("value"))
    n = left.count()
    if n:
        left.write.text(f"{target.rstrip('/')}/_left_out")
    return n


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphspark", description=__doc__.splitlines()[0])
    p.add_argument("target")
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--wikitext", action="store_true", help="read conversion markup")
    p.add_argument("--rule", action="append", default=[], help="a rule; one that can't be read is an error")
    p.add_argument("--rules-file", help="a file of rules; lines that can't be read are passed over")
    p.add_argument("--rulesets", help="path of the conversion tables")
    p.add_argument("--dump-table", action="store_true", help="print the pairs in use")
    a = p.parse_args(argv)
    try:
        parse(a.target)
        for rule in a.rule:
            parse_conv(rule)
    except (ValueError, RuleError) as e:
        p.error(str(e))
    spark = SparkSession.builder.appName("glyphspark").getOrCreate()
    lines = "\n".join(a.rule)
    if a.rules_file:
        lines += "\n" + "\n".join(r.value for r in spark.read.text(a.rules_file).collect())
    c = Converter(spark, path=a.rulesets)
    if a.dump_table:
        over = spark.createDataFrame(list(c.overlay(a.target, lines=lines).items()) or [("", "")], "`from` string, `to` string").selectExpr("'custom' AS `table`", "`from`", "`to`", "0L AS ord")
        for r in rulesets.dump(rulesets.mapping(rulesets.regional(c.pairs, a.target), over)).toLocalIterator():
            print(r["from"], r["to"])
        return 0
    fn = c.convert_markup if a.wikitext else c.convert
    if not a.input:
        got = spark.createDataFrame([(sys.stdin.read(),)], "text string").select(fn(F.col("text"), a.target, lines=lines)).first()[0]
        print(got)
        return 0
    left = convert_files(spark, a.input, a.output, lambda text: fn(text, a.target, lines=lines))
    if left:
        print(f"left out: {left} files that are blank or not UTF-8", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
