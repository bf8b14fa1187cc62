"""Windows, sessions, deduplication and resumable sinks on event streams.

Every function takes a batch or a streaming DataFrame with a TIMESTAMP column
(`with_time` casts zone-less timestamps, which watermarks don't accept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def windowed(df: DataFrame, size: str, slide: str | None, *by: str, ts: str = "ts", value: str = "value", delay: str = "1 hour") -> DataFrame:
    """Events and sum of values per window; tumbling without a slide."""
    x = _late(with_time(df, ts), ts, delay).groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: events less than `gap` apart."""
    x = _late(with_time(df, ts), ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"), F.max(ts).cast("timestamp_ntz").alias("last"))
    return x.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "last", "n")


def deduplicated(df: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First event of every key; a stream forgets keys after the delay."""
    x = with_time(df, ts)
    return x.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if df.isStreaming else x.dropDuplicates([key])


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Start a query that appends to the table at path the rows whose key it lacks, batch by batch."""
    from corpuslens.sources.files import append_new

    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
