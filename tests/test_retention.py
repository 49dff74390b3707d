"""Points and totals that a stream keeps as state, over several batches, late rows and restarts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearfield.streaming import retention as R

SCHEMA = "series string, user_id long, ts timestamp_ntz"


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))


def add(spark, folder, name, rows):
    made = spark.createDataFrame(rows, "series string, user_id long, at long")
    made.select("series", "user_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{folder}/{name}")


def plain(rows, keep):
    counts = {}
    for series, _, at in rows:
        if series is not None and at is not None:
            counts.setdefault(series, Counter())[at - at % 60] += 1
    out = set()
    for series, points in counts.items():
        total = 0
        for place, at in enumerate(sorted(points)):
            total += points[at]
            if place >= len(points) - keep:
                out.add((series, at, points[at], total, 0 if place == 0 else points[at]))
    return out


@pytest.mark.parametrize("keep", [5, 1000])
def test_newest_points_in_any_order_of_arrival(spark, tmp_path, keep):
    rng = random.Random(keep)
    folder, state = tmp_path / "events", str(tmp_path / "state")
    seen = []
    for batch in range(4):  # every start of the query is a restart, and takes two files one by one
        for part in range(2):
            rows = [(rng.choice(["a", "a", "a", "b", "é"]), 1, rng.randrange(0, 3000)) for _ in range(40)]  # late rows too
            rows += [("once", 1, 70), (None, 1, 5), ("a", 1, None)] if batch == 1 and part == 0 else []
            seen += rows
            add(spark, folder, f"{batch}{part}", rows)
        R.start_newest(stream(spark, folder), "series", state, keep, every=None).awaitTermination()
        assert {tuple(r) for r in R.newest(spark, state).collect()} == plain(seen, keep)
    dropped = {r["series"]: r["value"]["dropped"] for r in spark.read.format("statestore").option("stateVarName", "before").load(state).select("key.series", "value").collect()}
    assert (keep == 1000) == (dropped["a"] == 0)


def test_totals_per_client(spark, tmp_path):
    folder, state = tmp_path / "events", str(tmp_path / "state")
    rng = random.Random(1)
    seen = Counter()
    for batch in range(3):
        rows = [("a", rng.choice([1, 1, 1, 2, 3, None]), 60 * batch) for _ in range(50)]
        seen.update(r[1] for r in rows)
        add(spark, folder, str(batch), rows)
        R.start_totals(stream(spark, folder), "user_id", state, every=None).awaitTermination()
        got = R.totals(spark, state)
        assert got.columns == ["user_id", "requests"] and {r["user_id"]: r["requests"] for r in got.collect()} == seen


def test_the_store_of_other_queries_stays(spark, tmp_path):
    before = spark.conf.get(R.PROVIDER, None)
    add(spark, tmp_path / "events", "0", [("a", 1, 1)])
    R.start_totals(stream(spark, tmp_path / "events"), "user_id", str(tmp_path / "state"), every=None).awaitTermination()
    assert spark.conf.get(R.PROVIDER, None) == before


def test_events_are_summed_up_before_they_move(spark):
    events = spark.range(10_000).select(F.lit("hot").alias("series"), F.timestamp_seconds(F.col("id") % 600).alias("ts")).coalesce(4)
    assert R.minutes(events, "series").count() <= 4 * 10
