"""Request counters as streams.

One stateful query counts requests per (window, client). Its state holds open
windows only and is spread over clients; each micro-batch writes the counts it
changed. Requests, distinct clients and client totals are read off that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, directory: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Events from the files of a directory, with their time. ``glob`` matches the names of files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory).withColumn("ts", F.col("ts").cast("timestamp"))


def start_client_counts(
    events: DataFrame,
    out: str,
    checkpoint: str,
    width: str = "1 minute",
    late: str = "10 minutes",
    every: str | None = "60 seconds",
) -> StreamingQuery:
    """Count requests per window and client; ``every=None`` handles what is there and ends.

    A micro-batch overwrites its own directory, so a batch that is run again after
    a failure leaves no doubles. Rows that come more than ``late`` after the newest
    one seen are not counted; ``late_rows`` says how many there were.
    """
    counts = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width)["start"].alias("window_start"), "user_id")
        .agg(F.count(F.lit(1)).alias("requests"))
    )

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows, after the counting inside each task, that came too late in the batches the query still reports on."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """Newest count of every (window, client): counts only grow, so it is the largest."""
    return spark.read.parquet(out).groupBy("window_start", "user_id").agg(F.max("requests").alias("requests"))


def per_window(counts: DataFrame) -> DataFrame:
    return counts.groupBy("window_start").agg(F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("clients"))


def per_client(counts: DataFrame) -> DataFrame:
    return counts.groupBy("user_id").agg(F.sum("requests").alias("requests"))
