"""Price snapshots as a stream: late and repeated rows out, drops per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshots(stream: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Rows without repeats of (keys, ts) that arrive within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys, ts])


def window_drops(stream: DataFrame, keys: list[str], ts: str = "ts", price: str = "price", length: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """First and last price of each key and window, and the fall in %; works on streams and on tables."""
    rows = stream.withWatermark(ts, lateness) if stream.isStreaming else stream
    out = rows.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.min_by(price, ts).alias("first"), F.max_by(price, ts).alias("last"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "first", "last", F.round(F.try_divide(F.col("first") - F.col("last"), F.col("first")) * 100, 2).alias("fall_pct"))
