"""Structured Streaming forms of word counts and sessions.

The batch operators need no stream; these keep running figures while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.relations import word_array


def word_counts(documents: DataFrame) -> DataFrame:
    """Running counts of words of a stream of documents (output mode complete or update)."""
    return documents.select(F.explode(word_array(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events, first and last time.  A session is final once the watermark
    has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet, once for what is there."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
