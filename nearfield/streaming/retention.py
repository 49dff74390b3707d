"""Counters that are kept as state: the newest points of every series, their running totals, and totals per client.

Nothing is recomputed from history. What a stream knows is in its state, and the
views below read the state of the last finished batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

MINUTE = 60
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _keyed_state(spark: SparkSession):
    """State variables need a store that holds several of them per key; a query keeps the store it starts with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Newest(StatefulProcessor):
    """Of a series the newest ``keep`` points, and the sum of all that went before them.

    A row that comes late for a point no longer kept counts in that sum, so totals
    are right in any order of arrival, and the points kept are the newest of all.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "at long", "requests long")
        self.before = handle.getValueState("before", "total long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {at[0]: n[0] for at, n in self.points.iterator()}
        total, dropped = self.before.get() if self.before.exists() else (0, 0)
        old = set(held)
        changed = set()
        for frame in rows:
            for at, n in zip(frame["at"].tolist(), frame["requests"].tolist()):
                held[at] = held.get(at, 0) + n
                changed.add(at)
            if len(held) > 2 * self.keep:
                total, dropped = self._shed(held, total, dropped)
        total, dropped = self._shed(held, total, dropped)
        for at in old - set(held):
            self.points.removeKey((at,))
        for at in changed & set(held):
            self.points.updateValue((at,), (held[at],))
        self.before.update((total, dropped))
        yield pd.DataFrame({"series": [key[0]], "points": [len(held)], "total": [total + sum(held.values())]})

    def _shed(self, held: dict[int, int], total: int, dropped: int) -> tuple[int, int]:
        for at in sorted(held)[: max(0, len(held) - self.keep)]:
            total += held.pop(at)
            dropped += 1
        return total, dropped

    def close(self) -> None:
        pass


def minutes(events: DataFrame, series: str, ts: str = "ts", width: int = MINUTE) -> DataFrame:
    """``(series, at, requests)`` summed up inside each task, so a series with most of the events is a few rows per task.

    ``at`` is the start of the window in seconds; a series or time that is null is no point.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b.groupby(["series", "at"], as_index=False)["requests"].sum() for b in batches if len(b)]
        if parts:
            yield pd.concat(parts).groupby(["series", "at"], as_index=False)["requests"].sum()

    at = F.unix_seconds(F.col(ts))
    rows = events.select(F.col(series).cast("string").alias("series"), (at - F.pmod(at, F.lit(width))).alias("at"), F.lit(1).cast("long").alias("requests"))
    return rows.where("series IS NOT NULL AND at IS NOT NULL").mapInPandas(combine, "series string, at long, requests long")


def start_newest(events: DataFrame, series: str, checkpoint: str, keep: int = 720, ts: str = "ts", width: int = MINUTE, every: str | None = "60 seconds") -> StreamingQuery:
    """Keep the newest points per series as state in ``checkpoint``; ``every=None`` handles what is there and ends."""
    spark = events.sparkSession
    points = minutes(events, series, ts, width).groupBy("series").transformWithStateInPandas(
        Newest(keep), "series string, points long, total long", "Update", "None"
    )
    return _start(spark, points, checkpoint, every)


def start_totals(events: DataFrame, key: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Keep the number of events per key as state in ``checkpoint``."""
    return _start(events.sparkSession, events.groupBy(key).agg(F.count(F.lit(1)).alias("requests")), checkpoint, every)


def _start(spark: SparkSession, df: DataFrame, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = df.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    with _keyed_state(spark):
        return writer.start()


def newest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(series, at, requests, total, delta)`` of the points kept, as the last finished batch left them.

    ``total`` is the running total of the series up to the point, with all that was
    dropped before; ``delta`` the change since the point before, 0 for the first point
    of a series ever.
    """

    def variable(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    points = variable("points").select(F.col("key.*"), F.col("user_map_key.at").alias("at"), F.col("user_map_value.requests").alias("requests"))
    points = points.toDF("series", "at", "requests")
    before = variable("before").select(F.col("key.*"), "value.total", "value.dropped").toDF("series", "before", "dropped")
    order = Window.partitionBy("series").orderBy("at")  # at most as many rows as a series keeps
    first = (F.row_number().over(order) == 1) & (F.col("dropped") == 0)
    return points.join(before, "series").select(
        "series",
        "at",
        "requests",
        (F.col("before") + F.sum("requests").over(order)).alias("total"),
        F.when(first, F.lit(0).cast("long")).otherwise(F.col("requests")).alias("delta"),
    )


def totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(key, requests)`` of all keys, as the last finished batch left them."""
    kept = spark.read.format("statestore").load(checkpoint).select(F.col("key.*"), F.col("value.*"))
    return kept.toDF(kept.columns[0], "requests")
