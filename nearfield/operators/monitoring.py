"""Service counters: per-minute points, deltas, retention, client statistics, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less timestamps read as UTC instants (watermarks need those)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def zoneless(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def requests_per_window(events: DataFrame, width: str = "1 minute", *keys: str) -> DataFrame:
    """``(window_start, keys..., requests, clients)`` of tumbling windows.

    Requests are first counted per window and client, so distinct clients are a
    plain count of rows afterwards and a busy window is spread over its clients.
    """
    per_client = client_windows(events, width, *keys)
    return per_client.groupBy("window_start", *keys).agg(
        F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("clients")
    )


def client_windows(events: DataFrame, width: str = "1 minute", *keys: str, user: str = "user_id") -> DataFrame:
    return (
        events.groupBy(F.window("ts", width)["start"].alias("window_start"), *[F.col(k) for k in keys], F.col(user))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def cumulative(points: DataFrame, value: str, series: str, ts: str = "window_start", out: str = "total") -> DataFrame:
    """Running total per series over per-window points."""
    order = Window.partitionBy(series).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(out, F.sum(value).over(order))


def deltas(series: DataFrame, value: str, by: str = "series", ts: str = "ts", gauge: bool = False, out: str = "delta") -> DataFrame:
    """Change to the previous point; the first point of a series is 0. A gauge keeps its value instead of the change."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(ts))
    later = F.col(value) if gauge else F.col(value) - before
    return series.withColumn(out, F.when(before.isNull(), F.lit(0).cast("long")).otherwise(later))


def rolling_total(points: DataFrame, value: str, series: str, ts: str = "window_start", minutes: int = 60, out: str = "rolling") -> DataFrame:
    """Sum over the last ``minutes`` up to and including each point, over per-window points."""
    seconds = F.unix_seconds(F.col(ts))
    frame = Window.partitionBy(series).orderBy(seconds).rangeBetween(-(minutes * 60) + 1, 0)
    return points.withColumn(out, F.sum(value).over(frame))


def client_stats(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Requests in all, clients, and the least, most and average requests of a client."""
    per_client = events.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return per_client.agg(
        F.sum("n").alias("requests"),
        F.count(F.lit(1)).alias("clients"),
        F.min("n").alias("min_requests"),
        F.max("n").alias("max_requests"),
        (F.sum("n") / F.count(F.lit(1))).alias("avg_requests"),
    )


def rates(events: DataFrame, by: str, ts: str = "ts", bucket_seconds: int = 3600) -> DataFrame:
    """Requests per second per series: 1 / smallest gap and 1 / average gap between consecutive requests.

    The average gap needs only the ends and the count. For the smallest gap
    requests are ordered inside time buckets, so a series that holds most rows
    is split over its buckets, and the gaps across buckets come from one row per
    bucket. A gap of zero gives no rate.
    """
    at = F.unix_micros(F.col(ts))
    marked = events.select(F.col(by).alias("series"), at.alias("at")).withColumn(
        "bucket", F.floor(F.col("at") / F.lit(bucket_seconds * 1_000_000))
    )
    inside = Window.partitionBy("series", "bucket").orderBy("at")
    gaps = marked.withColumn("gap", F.col("at") - F.lag("at").over(inside))
    buckets = gaps.groupBy("series", "bucket").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.min("gap").alias("gap"), F.count(F.lit(1)).alias("n")
    )
    across = Window.partitionBy("series").orderBy("bucket")
    joined = buckets.withColumn("gap", F.least("gap", F.col("first") - F.lag("last").over(across)))
    per_series = joined.groupBy("series").agg(
        F.sum("n").alias("requests"), F.min("gap").alias("min_gap"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    span = F.col("last") - F.col("first")
    return per_series.select(
        "series",
        "requests",
        F.when(F.col("min_gap") > 0, 1e6 / F.col("min_gap")).alias("max_rps"),
        F.when(span > 0, (F.col("requests") - 1) * 1e6 / span).alias("avg_rps"),
    )
