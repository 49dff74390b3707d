"""Grouping points by distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.hashing import shard_of
from nearfield.operators.blocks import METRICS, in_chunks, map_vectors, matrix
from nearfield.operators.corpus import dense_id
from nearfield.operators.exact import within_distance
from nearfield.operators.ivf import assign
from nearfield.operators.metric_join import choose_pivots, first_within, leaders
from nearfield.session import cut_lineage

HELD = 1000  # leaders found head by head and sent to every task; more are found in parallel rounds

_l2 = METRICS["l2"].score


def sample_distances(df: DataFrame, sample: int = 1000, id: str = "id", vec: str = "vector") -> DataFrame:
    """``(query_id, id, distance)`` of all ordered pairs among the first ``sample`` points, each with itself too."""
    first = df.select(F.col(id).alias("id"), F.col(vec).alias("vector")).orderBy("id").limit(sample)
    return within_distance(first.withColumnRenamed("id", "query_id"), first, float("inf"), query_vec="vector")


def median_distance(df: DataFrame, sample: int = 1000, **columns) -> DataFrame:
    """One row: the median distance of the sampled pairs (zero diagonal included), and how many there are."""
    return sample_distances(df, sample, **columns).agg(
        F.percentile("distance", F.lit(0.5)).alias("median_distance"), F.count(F.lit(1)).alias("pairs")
    )


def hash_shards(df: DataFrame, shards: int, id: str = "id") -> DataFrame:
    return df.withColumn("shard_id", shard_of(F.col(id), shards))


def shard_sizes(df: DataFrame, shard: str = "shard_id") -> DataFrame:
    return df.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))


def _greedy(ids: np.ndarray, vectors: np.ndarray, dist: float, room: int) -> list[int]:
    """Positions, in order, of points that no earlier chosen point covers."""
    chosen: list[int] = []
    for i in range(len(ids)):
        if len(chosen) == room:
            break
        if not chosen or (_l2(vectors[i : i + 1], vectors[chosen])[0] > dist).all():
            chosen.append(i)
    return chosen


def find_leaders(df: DataFrame, dist: float, m: int = 1000, probe: int = 512, id: str = "id", vec: str = "vector"):
    """Leader ids and vectors: the lowest uncovered id leads, everything within ``dist`` of it is covered.

    Each round looks at the ``probe`` lowest uncovered ids only, settles the rule
    among them, and drops what the new leaders cover; the outcome is that of one
    leader at a time. What stays uncovered is written before the next round.
    At most ``m`` leaders are ever held.
    """
    open_points = df.select(F.col(id).alias("id"), F.col(vec).alias("vector")).where(F.col("vector").isNotNull())
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    while len(ids) < m:
        head = open_points.orderBy("id").limit(probe).toArrow()
        if head.num_rows == 0:
            break
        head_ids = np.asarray(head.column("id").to_numpy())
        head_vectors = matrix(head.column("vector"), np.float64)
        fresh = _greedy(head_ids, head_vectors, dist, m - len(ids))
        ids += [int(i) for i in head_ids[fresh]]
        vectors += list(head_vectors[fresh])
        if head.num_rows < probe:
            break
        leaders = head_vectors[fresh]

        def covered(rows: np.ndarray, leaders=leaders) -> list[np.ndarray]:
            return [in_chunks(rows, len(leaders), lambda part: (_l2(part, leaders) <= dist).any(axis=1).astype(np.int64))]

        marked = map_vectors(open_points, "vector", covered, [T.StructField("_covered", T.LongType())])
        open_points = cut_lineage(marked.where(F.col("_covered") == 0).drop("_covered"))
    return ids, np.array(vectors)


def shard_by_distance(
    df: DataFrame, dist: float, m: int | None = HELD, probe: int = 512, id: str = "id", vec: str = "vector"
) -> DataFrame:
    """``(id, shard_id, leader, overflow)``: every point goes to the first leader within ``dist``.

    Once ``m`` leaders exist, points out of reach of all of them go to the
    nearest one with ``overflow`` set, so every point has a shard. A row without
    a vector keeps its place with nulls. Up to HELD leaders are found head by head;
    for more of them, or as many as it takes (``m=None``), see ``shard_by_leaders``.
    """
    if m is None or m > HELD:
        return shard_by_leaders(df, dist, m, id=id, vec=vec)
    ids, vectors = find_leaders(df, dist, m, probe, id, vec)
    points = df.select(F.col(id).alias("id"), F.col(vec).alias("vector"))
    fields = [T.StructField(n, T.LongType()) for n in ("shard_id", "leader", "_over")]
    leader_ids = np.array(ids, np.int64)

    def place(rows: np.ndarray) -> list[np.ndarray]:
        def best(part: np.ndarray) -> np.ndarray:
            gaps = _l2(part, vectors)
            near = gaps <= dist
            reached = near.any(axis=1)
            return np.stack([np.where(reached, near.argmax(axis=1), gaps.argmin(axis=1)), ~reached], axis=1)

        got = in_chunks(rows, len(vectors), best).astype(np.int64)
        return [got[:, 0], leader_ids[got[:, 0]], got[:, 1]]

    placed = map_vectors(points, "vector", place, fields, keep=False)
    return placed.select("id", "shard_id", "leader", (F.col("_over") == 1).alias("overflow"))


def shard_by_leaders(df: DataFrame, dist: float, m: int | None = None, id: str = "id", vec: str = "vector", **options) -> DataFrame:
    """``shard_by_distance`` for any number of leaders, which neither the driver nor a task holds.

    Leaders come from parallel rounds (``leaders``), and points look for the first
    one in reach inside pivot cells. Ids are distinct.
    """
    points = cut_lineage(df.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vector")))
    led = cut_lineage(dense_id(leaders(points, dist, m, **options), "id", out="shard_id", start=0))
    filed, pivots = choose_pivots(led, dist)
    rows = filed.select("cell", "id", F.col("vector").alias("v"))
    first = cut_lineage(first_within(points, rows, pivots, dist))
    numbers = led.select(F.col("id").alias("first"), F.col("shard_id"))
    near = points.join(first.join(numbers, "first"), "id", "left")
    placed = near.select("id", "vector", "shard_id", F.col("first").alias("leader"), F.lit(False).alias("overflow"))
    if m is None:
        return placed.select("id", "shard_id", "leader", F.when(F.col("shard_id").isNotNull(), F.col("overflow")).alias("overflow"))
    away = assign(placed.where("shard_id IS NULL").select("id", "vector"), led.select(F.col("shard_id").alias("cell"), "vector"))
    away = away.select("id", F.col("cell").alias("shard_id")).join(led.select("shard_id", F.col("id").alias("leader")), "shard_id", "left")
    away = away.select("id", "shard_id", "leader", F.when(F.col("shard_id").isNotNull(), F.lit(True)).alias("overflow"))
    return placed.where("shard_id IS NOT NULL").select("id", "shard_id", "leader", "overflow").unionByName(away)
