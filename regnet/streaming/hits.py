"""Streams of hits joined to a fixed set of gene windows, and counts per gene in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.network import hits_near_genes


def stream_near_genes(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """A stream-static interval join: stateless, so it runs without a watermark."""
    return hits_near_genes(hits, windows)


def stream_counts(near: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Hits per target and event-time window; rows later than the watermark are left out."""
    return near.withWatermark(time, late).groupBy(F.window(time, size), "target").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"))
