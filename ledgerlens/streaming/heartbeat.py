"""Job heartbeats as a stream: activity windows with a watermark. An extension; batch queries cover the same facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Runs of heartbeats without a pause of gap: a closed session is a job that went stale at its end."""
    stream = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    w = F.session_window(ts, gap)
    return stream.groupBy(key, w).agg(F.count("*").alias("beats")).select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("stale_at"), "beats")
