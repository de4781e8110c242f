"""Streaming: arriving vectors go to fixed topic centroids (an extension; topics are static)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.operators import vectors as vx


def assign_stream(stream: DataFrame, cents: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, topic_id, similarity for a stream of (doc_id, embedding); -1 at or under the threshold.

    A stateless join of the stream with a small static table, so late data needs no watermark."""
    near = vx.nearest_centroid(stream, cents)
    return near.select("doc_id", F.when(F.col("similarity") > threshold, F.col("nearest")).otherwise(-1).cast("int").alias("topic_id"), "similarity")


def topic_counts(stream: DataFrame, at: str = "ts", topic: str = "event_type", span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of topics in tumbling windows of event time; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, span), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
