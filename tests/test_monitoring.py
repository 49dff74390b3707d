import datetime as dt

import pytest
from pyspark.sql import functions as F

from nearfield.operators import monitoring as M
from nearfield.operators.topk import last_n
from nearfield.streaming import windows as W

BASE = dt.datetime(2024, 1, 1)
EVENTS = "ts timestamp_ntz, user_id long, kind string"


def events(spark, rows):
    return M.with_event_time(spark.createDataFrame([(BASE + dt.timedelta(seconds=s), u, k) for s, u, k in rows], EVENTS))


ROWS = [(0, 1, "a"), (10, 2, "a"), (59.5, 1, "a"), (60, 1, "a"), (200, 3, "a"), (200, 3, "b")]


def test_windows_clients_and_stats(spark):
    got = {r["window_start"].minute: (r["requests"], r["clients"]) for r in M.requests_per_window(events(spark, ROWS)).collect()}
    assert got == {0: (3, 2), 1: (1, 1), 3: (2, 1)}
    row = M.client_stats(events(spark, ROWS)).first()
    assert tuple(row) == (6, 3, 1, 3, 2.0)


def test_deltas(spark):
    points = spark.createDataFrame([("s", i, v) for i, v in enumerate([5, 9, 9, 2])] + [("t", 0, 4)], "series string, ts long, value long")
    got = {(r["series"], r["ts"]): r["delta"] for r in M.deltas(points, "value").collect()}
    assert got == {("s", 0): 0, ("s", 1): 4, ("s", 2): 0, ("s", 3): -7, ("t", 0): 0}  # a reset stays negative
    gauge = {(r["series"], r["ts"]): r["delta"] for r in M.deltas(points, "value", gauge=True).collect()}
    assert gauge == {("s", 0): 0, ("s", 1): 9, ("s", 2): 9, ("s", 3): 2, ("t", 0): 0}


def test_retention(spark):
    points = spark.range(721).select(F.lit("s").alias("series"), F.col("id").alias("ts"))
    assert sorted(r["ts"] for r in last_n(points, 720).collect()) == list(range(1, 721))
    assert last_n(points, 60).count() == 60


def test_rolling_total(spark):
    rows = [(60 * m, 1, "a") for m in (0, 1, 59, 60, 61)]
    points = M.requests_per_window(events(spark, rows), "1 minute", "kind")
    got = {int((r["window_start"] - BASE).total_seconds() // 60): r["rolling"] for r in M.rolling_total(points, "requests", "kind").collect()}
    assert got == {0: 1, 1: 2, 59: 3, 60: 3, 61: 3}


@pytest.mark.parametrize("bucket", [1, 60, 3600])
def test_rates_do_not_depend_on_buckets(spark, bucket):
    got = {r["series"]: r for r in M.rates(events(spark, ROWS), "kind", bucket_seconds=bucket).collect()}
    assert got["a"]["max_rps"] == 1 / 0.5 and got["a"]["avg_rps"] == 4 / 200 and got["a"]["requests"] == 5
    assert got["b"]["max_rps"] is None and got["b"]["avg_rps"] is None
    twin = M.rates(events(spark, [(5, 1, "c"), (5, 2, "c")]), "kind", bucket_seconds=bucket).first()
    assert twin["max_rps"] is None and twin["avg_rps"] is None


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in (ROWS[:2], ROWS[2:4], ROWS[4:]):
        rows = [(BASE + dt.timedelta(seconds=s), u, k) for s, u, k in part]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = W.read_events(spark, str(source), spark.read.parquet(str(source)).schema, files_per_batch=1)
    W.start_client_counts(stream, out, str(tmp_path / "state"), every=None).awaitTermination()
    counts = W.current_counts(spark, out)
    want = sorted(M.requests_per_window(events(spark, ROWS)).collect())
    assert sorted(W.per_window(counts).collect()) == want
    assert dict(W.per_client(counts).collect()) == {1: 3, 2: 1, 3: 2}
