"""Conversion of streams: the same column functions, on streaming frames.

Conversion has no state, so a stream needs none; reports over time windows
take a watermark, which bounds what is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.columns import Converter


def read_files(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream, at most ``files`` of them in a step."""
    r = spark.readStream.format(form).schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).load(path)


def converted(stream: DataFrame, converter: Converter, text_col: str, target: str, markup: bool = False) -> DataFrame:
    """The stream with a text column converted."""
    fn = converter.convert_markup if markup else converter.convert
    return stream.withColumn(text_col, fn(F.col(text_col), target))


def requests(stream: DataFrame, converter: Converter, limit: int = 2 << 20, token: str | None = None) -> DataFrame:
    """Answers (id, status, body) to requests (id, target, wikitext, body, token), on batch or streaming frames.

    400: no body or a body beyond the limit; 401: not the token asked for; 404: no such target.
    """
    tag = F.lower(F.col("target"))
    known = tag.isin(*[t for t in converter.matchers])
    plain = converter.convert_by(F.col("body"), F.when(known, tag))
    status = F.when(F.lit(token is not None) & ~F.col("token").eqNullSafe(F.lit(token)), 401).when(~known | tag.isNull(), 404).when(F.col("body").isNull() | (F.octet_length("body") > limit), 400).otherwise(200)
    rich = converter.convert_markup_by(F.when(F.col("wikitext"), F.col("body")), F.when(known, tag))
    return stream.select("id", status.alias("status"), F.when(status == 200, F.when(F.col("wikitext"), rich).otherwise(plain)).alias("body"))


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, window: str, late: str) -> DataFrame:
    """Rows for each time window and key; rows later than ``late`` are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key_col).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key_col, "n")


def run_available(frame: DataFrame, sink_path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Writes what is there now to files, once, and stops."""
    q = frame.writeStream.format(form).option("checkpointLocation", checkpoint).option("path", sink_path).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
