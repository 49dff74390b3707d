"""Registered queries: request counters in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.operators import monitoring as M
from nearfield.operators.topk import last_n
from nearfield.plans.inputs import DIGITS, streamed, table
from nearfield.session import scratch_path
from nearfield.streaming import retention as R
from nearfield.streaming import windows as W

QUERIES = {}
ORACLES = {}


def events(spark, sf_dir):
    return M.with_event_time(table(spark, sf_dir, "events"))


def shown(df, *columns):
    """Window starts as the zone-less timestamps of the input."""
    return df.withColumn("window_start", M.zoneless(F.col("window_start"))).select("window_start", *columns)


POINTS_SQL = """
points AS (SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS requests, count(DISTINCT user_id) AS clients
           FROM events GROUP BY 1, 2)"""


def _stream(spark, sf_dir):
    """All events through the streaming counter, from the files of the folder."""
    out, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-state")
    stream = streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    query = W.start_client_counts(stream, out, checkpoint, every=None)
    query.awaitTermination()
    if W.late_rows(query):
        raise RuntimeError("rows came later than the counters wait for")
    return W.current_counts(spark, out)


def requests_per_minute(spark, sf_dir):
    return shown(W.per_window(_stream(spark, sf_dir)), "requests")


QUERIES["requests_per_minute"] = requests_per_minute
ORACLES["requests_per_minute"] = "SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1"


def clients_per_minute(spark, sf_dir):
    return shown(W.per_window(_stream(spark, sf_dir)), "clients")


QUERIES["clients_per_minute"] = clients_per_minute
ORACLES["clients_per_minute"] = (
    "SELECT date_trunc('minute', ts) AS window_start, count(DISTINCT user_id) AS clients FROM events GROUP BY 1"
)


def _events(spark, sf_dir):
    return streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def client_totals(spark, sf_dir):
    """Totals per client, read off the state of a stream."""
    checkpoint = scratch_path(spark, "client-totals")
    R.start_totals(_events(spark, sf_dir), "user_id", checkpoint, every=None).awaitTermination()
    return R.totals(spark, checkpoint)


QUERIES["client_totals"] = client_totals
ORACLES["client_totals"] = "SELECT user_id, count(*) AS requests FROM events GROUP BY user_id"


def requests_batch(spark, sf_dir):
    """The same counters per hour and event type, in batch."""
    return shown(M.requests_per_window(events(spark, sf_dir), "1 hour", "event_type"), "event_type", "requests", "clients")


QUERIES["requests_per_hour"] = requests_batch
ORACLES["requests_per_hour"] = """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS requests, count(DISTINCT user_id) AS clients
FROM events GROUP BY 1, 2"""


def points(spark, sf_dir):
    return M.requests_per_window(events(spark, sf_dir), "1 minute", "event_type")


def deltas(spark, sf_dir):
    """Per-minute polls: the change of the cumulative requests, and the client gauge."""
    series = M.cumulative(points(spark, sf_dir), "requests", "event_type")
    out = M.deltas(series, "total", "event_type", "window_start", out="request_delta")
    out = M.deltas(out, "clients", "event_type", "window_start", gauge=True, out="client_gauge")
    return shown(out, "event_type", "total", "request_delta", "client_gauge")


QUERIES["deltas"] = deltas
ORACLES["deltas"] = (
    "WITH "
    + POINTS_SQL
    + """, c AS (SELECT *, sum(requests) OVER (PARTITION BY event_type ORDER BY window_start)::BIGINT AS total,
  row_number() OVER (PARTITION BY event_type ORDER BY window_start) AS n FROM points)
SELECT window_start, event_type, total, CASE WHEN n = 1 THEN 0 ELSE total - lag(total) OVER (PARTITION BY event_type ORDER BY window_start) END AS request_delta,
       CASE WHEN n = 1 THEN 0 ELSE clients END AS client_gauge FROM c"""
)


def _last(n):
    def run(spark, sf_dir):
        return shown(last_n(points(spark, sf_dir), n, "event_type", "window_start"), "event_type", "requests", "clients")

    return run


for _n in (60, 720):
    QUERIES[f"last_{_n}"] = _last(_n)
    ORACLES[f"last_{_n}"] = (
        "WITH "
        + POINTS_SQL
        + f""" SELECT window_start, event_type, requests, clients FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_start DESC) AS n FROM points) WHERE n <= {_n}"""
    )


def _newest(spark, sf_dir):
    """The newest 720 points of every event type, kept by a stream as state."""
    checkpoint = scratch_path(spark, "newest")
    R.start_newest(_events(spark, sf_dir), "event_type", checkpoint, 720, every=None).awaitTermination()
    return R.newest(spark, checkpoint).withColumn("window_start", F.timestamp_seconds("at")).withColumnRenamed("series", "event_type")


def stream_last_720(spark, sf_dir):
    return shown(_newest(spark, sf_dir), "event_type", "requests")


def stream_deltas(spark, sf_dir):
    return shown(_newest(spark, sf_dir), "event_type", "total", F.col("delta").alias("request_delta"))


QUERIES["stream_last_720"] = stream_last_720
ORACLES["stream_last_720"] = f"SELECT window_start, event_type, requests FROM ({ORACLES['last_720']})"
QUERIES["stream_deltas"] = stream_deltas
ORACLES["stream_deltas"] = f"""
SELECT window_start, event_type, total, request_delta
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_start DESC) AS n FROM ({ORACLES['deltas']})) WHERE n <= 720"""


def rolling_hour(spark, sf_dir):
    return shown(M.rolling_total(points(spark, sf_dir), "requests", "event_type"), "event_type", "requests", "rolling")


QUERIES["rolling_hour"] = rolling_hour
ORACLES["rolling_hour"] = (
    "WITH "
    + POINTS_SQL
    + """ SELECT window_start, event_type, requests, sum(requests) OVER (PARTITION BY event_type ORDER BY window_start
  RANGE BETWEEN INTERVAL 59 MINUTES PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM points"""
)


def client_stats(spark, sf_dir):
    return M.client_stats(events(spark, sf_dir)).withColumn("avg_requests", F.round("avg_requests", DIGITS))


QUERIES["client_stats"] = client_stats
ORACLES["client_stats"] = f"""
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT sum(n)::BIGINT AS requests, count(*) AS clients, min(n) AS min_requests, max(n) AS max_requests,
       round(sum(n)::DOUBLE / count(*), {DIGITS}) AS avg_requests FROM c"""


def rates(spark, sf_dir):
    got = M.rates(events(spark, sf_dir), "event_type")
    return got.select("series", "requests", F.round("max_rps", DIGITS).alias("max_rps"), F.round("avg_rps", DIGITS).alias("avg_rps"))


QUERIES["rates"] = rates
ORACLES["rates"] = f"""
WITH g AS (SELECT event_type, epoch_us(ts) AS at, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events)
SELECT event_type AS series, count(*) AS requests, round(CASE WHEN min(gap) > 0 THEN 1e6::DOUBLE / min(gap) END, {DIGITS}) AS max_rps,
       round(CASE WHEN avg(gap) > 0 THEN 1e6::DOUBLE / avg(gap) END, {DIGITS}) AS avg_rps FROM g GROUP BY event_type"""
