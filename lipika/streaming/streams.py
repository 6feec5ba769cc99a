"""Transliteration of streams: a projection without state, so watermarks and triggers are the query's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lipika.functions.columns import transliterate


def transliterate_stream(stream: DataFrame, column: str, source: str, target: str, options: int | str = 0, into: str | None = None) -> DataFrame:
    """The stream with ``into`` (``column`` itself by default) in the target script."""
    return stream.withColumn(into or column, transliterate(column, source, target, options))


def lines(spark: SparkSession, folder: str, source: str = "itrans", target: str = "devanagari", options: int | str = 0) -> DataFrame:
    """A stream of text files' lines, transliterated (column ``value``)."""
    return transliterate_stream(spark.readStream.text(folder), "value", source, target, options)


def to_console(stream: DataFrame) -> StreamingQuery:
    return stream.writeStream.format("console").option("truncate", False).start()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what there is as Parquet, exactly once for each checkpoint, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
