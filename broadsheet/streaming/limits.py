"""The event stream's rate buckets and exposures as Structured Streaming queries.

Each has a batch twin among the registered queries; tests/test_streaming.py holds the two against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events later than the cut-off by more than this are refused before the watermark sees them.
SKEW = 300


def not_future(events: DataFrame, as_of: int, at: str = "ts") -> DataFrame:
    """Without events more than five minutes after the cut-off; those without a time stay."""
    return events.where(F.col(at).isNull() | (F.col(at) <= F.timestamp_seconds(F.lit(as_of + SKEW))))


def rate_buckets(events: DataFrame, width: str, limit: int, late: str, reader: str = "user_id", at: str = "ts") -> DataFrame:
    """reader, bucket, allowed, refused of tumbling windows of ``width``. State holds one count per open window and reader."""
    sums = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(reader).alias("reader")).agg(F.count("*").alias("n"))
    return sums.select("reader", F.unix_seconds("w.start").alias("bucket"), F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def first_exposures(events: DataFrame, story: Column, late: str, reader: str = "user_id", at: str = "ts", offset_hours: int = 8) -> DataFrame:
    """reader, story, day of every exposure, once. State is dropped when the watermark passes it."""
    day = F.floor((F.unix_seconds(at) + offset_hours * 3600) / 86_400).cast("long")
    rows = events.withWatermark(at, late).select(F.col(at), F.col(reader).alias("reader"), story.alias("story"), day.alias("day"))
    return rows.dropDuplicatesWithinWatermark(["reader", "story", "day"]).select("reader", "story", "day")
