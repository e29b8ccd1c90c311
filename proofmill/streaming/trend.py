"""The daily trend as a stream: the ledger's only computation that has a natural streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_trend(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """(day, kind, record_count) over a stream or a table; a stream drops rows later than ``late``."""
    if events.isStreaming and dict(events.dtypes)[ts] == "timestamp_ntz":  # a watermark needs an instant
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    day = F.window(ts, "1 day")
    return rows.groupBy(day, F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("record_count")).select(F.to_date("window.start").alias("day"), "kind", "record_count")
