"""Sessions of a stream: the streaming form of gap-bounded molecule sessions, an addition of this engine.

A session of a key ends ``gap`` after its last event; late events are taken until the watermark passes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): counts of events by session; works on streams and on tables alike."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    sessions = marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
