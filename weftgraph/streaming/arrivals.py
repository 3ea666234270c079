"""Extension: reference events as a stream, kept as the set of edges and counted by window.

The engine's own data is at rest; where references arrive as events, the set
is the same set with late repetitions dropped, and the counts are windowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_stream(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Edges (kind, source, target) as they first arrive; state of repetitions is dropped once the watermark has passed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["kind", "source", "target"])


def reference_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """References to each target by window."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "target")
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "target", "n")
