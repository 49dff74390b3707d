"""Joins by distance: points are filed under pivots, and the triangle inequality says which cells can hold a partner."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.hashing import md5_hex
from nearfield.operators.blocks import Metric, Within, in_chunks, matrix, metric_named
from nearfield.operators.cells import Lowest, Tally, score_cells
from nearfield.operators.ivf import as_frame, assign
from nearfield.session import cut_lineage

METRIC = ("l2", "l1")  # distances of vectors that keep the triangle inequality
PIVOTS = 2048  # pivots sent to every task at most
COPIES = 16  # cells a point is sent to on average, at most: with more, pivots are taken away
SAMPLE = 1024  # points by which that is judged
PIVOT_ROWS = 512  # rows a pivot stands for, until there are PIVOTS of them
SLACK = 1e-9  # of the distances compared, for rounding in their sums
PAIRS = 1 << 16  # pairs whose differences are computed at once
HEAD = 4096  # points among which leaders are settled first; each phase takes twice as many


@dataclass
class Pivots:
    """Pivots, and how near and far from each its rows lie."""

    cells: np.ndarray
    vectors: np.ndarray
    near: np.ndarray
    far: np.ndarray
    metric: str


def up_to(name: str, radius: float) -> Metric:
    """The metric where it is about ``radius`` at most, infinite elsewhere.

    Euclidean distances are first estimated from products, which are much cheaper,
    and only pairs that may be near enough are computed from their differences.
    """
    metric = metric_named(name)
    if name != "l2":
        return metric

    def score(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        # |q - c|^2 <= radius^2 with some slack, as one product: q c - own - other >= 0
        own = (np.einsum("ij,ij->i", q, q) * (1 - SLACK) - radius * radius - SLACK) / 2
        other = np.einsum("ij,ij->i", c, c) * (1 - SLACK) / 2
        left = np.concatenate([q, -np.ones((len(q), 1)), -own[:, None]], axis=1)
        right = np.concatenate([c, other[:, None], np.ones((len(c), 1))], axis=1)
        row, col = np.nonzero(left @ right.T >= 0)
        out = np.full((len(q), len(c)), np.inf)
        for at in range(0, len(row), PAIRS):
            i, j = row[at : at + PAIRS], col[at : at + PAIRS]
            gap = q[i] - c[j]
            out[i, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return out

    return Metric(score, ascending=True)


def _open(gap: np.ndarray, near: np.ndarray, far: np.ndarray, radius: float) -> np.ndarray:
    """Which cells can hold a row within ``radius`` of points, given their distances to the pivots."""
    most = radius + SLACK * (1 + gap + far)
    return (gap - far <= most) & (near - gap <= most) & (gap - np.nanmin(gap, axis=1, keepdims=True) <= 2 * most)


def _useful(vectors: np.ndarray, sample: np.ndarray, radius: float, metric: str) -> int:
    """How many of the pivots to take: half of them go as long as sample points would be sent to more than COPIES cells.

    Where vectors have many dimensions no pivot rules out much, and every cell more
    is a copy more of every point.
    """
    gap = metric_named(metric).score(sample, vectors)
    n = len(vectors)
    while n > COPIES:
        own = gap[:, :n].argmin(axis=1)
        near, far = np.full(n, np.inf), np.zeros(n)
        np.minimum.at(near, own, gap[np.arange(len(gap)), own])
        np.maximum.at(far, own, gap[np.arange(len(gap)), own])
        if _open(gap[:, :n], near, far, radius)[:, np.isfinite(near)].sum(axis=1).mean() <= COPIES:
            break
        n = max(COPIES, n // 2)
    return n


def choose_pivots(df: DataFrame, radius: float, metric: str = "l2", pivots: int | None = None) -> tuple[DataFrame, Pivots]:
    """``df`` ``(id, vector)`` with ``cell`` and ``cell_distance`` of its nearest pivot, and the pivots: rows with the lowest md5 of their id.

    There is one for PIVOT_ROWS rows, up to PIVOTS and as long as they rule out
    cells for joins within ``radius`` (``_useful``), unless ``pivots`` says how many.
    """
    if metric not in METRIC:
        raise ValueError(f"{metric} does not keep the triangle inequality; known: {', '.join(METRIC)}")
    rows = df.where(F.col("vector").isNotNull()).select("id", "vector")
    wanted = pivots or max(1, min(PIVOTS, -(-rows.count() // PIVOT_ROWS)))
    chosen = rows.orderBy(md5_hex(F.concat_ws(":", F.lit("pivot"), "id")), "id").limit(wanted + (0 if pivots else SAMPLE)).toArrow()
    vectors = matrix(chosen.column("vector"), np.float64)
    if pivots is None and len(vectors) > wanted:
        vectors = vectors[: _useful(vectors[:wanted], vectors[wanted:], radius, metric)]
    vectors = vectors[:wanted]
    filed = cut_lineage(assign(rows, as_frame(df.sparkSession, np.arange(len(vectors)), vectors), metric))
    spans = {r["cell"]: r for r in filed.groupBy("cell").agg(F.min("cell_distance").alias("near"), F.max("cell_distance").alias("far")).collect()}
    used = [c for c in range(len(vectors)) if c in spans and spans[c]["far"] is not None]
    near, far = (np.array([spans[c][name] for c in used], dtype=float) for name in ("near", "far"))
    return filed, Pivots(np.array(used, dtype=np.int64), vectors[used], near, far, metric)


def within_reach(df: DataFrame, pivots: Pivots, radius: float, id: str = "id", vec: str = "vector") -> DataFrame:
    """``(cell, id, v)``: every point once per cell that can hold a row within ``radius`` of it.

    A row of the cell lies between the pivot's ``near`` and ``far``, so its distance
    to the point is no less than the gap to that ring; and as no pivot is nearer to
    the row than its own, the point is at most twice the radius farther from that
    pivot than from its nearest one.
    """
    score = metric_named(pivots.metric).score
    points = df.where(F.col(vec).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("v"))
    schema = f"id long, v {dict(points.dtypes)['v']}, cells array<long>"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(pivots.cells):
                continue

            def open_cells(part: np.ndarray) -> np.ndarray:
                gap = score(part, pivots.vectors)
                return _open(gap, pivots.near, pivots.far, radius)

            found = in_chunks(matrix(batch.column("v"), np.float64), len(pivots.cells), open_cells)
            row, col = np.nonzero(found)
            offsets = np.concatenate([[0], np.cumsum(found.sum(axis=1))])
            cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pivots.cells[col], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), cells], names=["id", "v", "cells"])

    return points.mapInArrow(reach, schema).select(F.explode("cells").alias("cell"), "id", "v")


def distance_join(
    left: DataFrame, right: DataFrame, radius: float, metric: str = "l2", digits: int | None = None, only: str | None = None, pivots: int | None = None
) -> DataFrame:
    """``(query_id, id, distance)``: all pairs of ``left`` and ``right`` ``(id, vector)`` not farther apart than ``radius``.

    Rows of ``right`` lie in the cell of their nearest pivot, and points of ``left``
    are copied only to cells that the triangle inequality leaves open. Cells of any
    size are met part by part and pairs leave a task as they are found.
    ``only="earlier"`` keeps pairs whose right id is lower (a join of a table with
    itself then has each pair once), ``only="others"`` drops equal ids. ``digits``
    rounds distances before they are compared. Rows without a vector have no partner.
    """
    return _near(left, right, radius, lambda: Within(radius), metric, digits, only, pivots).withColumnRenamed("value", "distance")


def _near(left, right, radius, make_keeper, metric="l2", digits=None, only=None, pivots=None) -> DataFrame:
    margin = 0.0 if digits is None else 10.0**-digits
    filed, chosen = choose_pivots(right, radius + margin, metric, pivots)
    asked = within_reach(left, chosen, radius + margin)
    rows = filed.select("cell", "id", F.col("vector").alias("v"))
    return score_cells(asked, rows, up_to(metric, radius + margin), make_keeper, digits, only)


def count_within(left: DataFrame, right: DataFrame, radius: float, **options) -> DataFrame:
    """``(id, n_links, lowest, nearest)`` of the points of ``left`` with partners: how many, the lowest id and the least distance.

    Pairs are summed up while they are found, so no pair leaves its task and a point
    with very many partners is a row per group. Options as for ``distance_join``.
    """
    found = _near(left, right, radius, lambda: Tally(radius), **options)
    return found.groupBy(F.col("query_id").alias("id")).agg(
        F.sum("n").alias("n_links"), F.min("id").alias("lowest"), F.min("value").alias("nearest")
    )


def first_within(points: DataFrame, rows: DataFrame, pivots: Pivots, radius: float) -> DataFrame:
    """``(id, first)``: the lowest id of ``rows`` ``(cell, id, v)`` within ``radius`` of each point that has one."""
    found = score_cells(within_reach(points, pivots, radius), rows, up_to(pivots.metric, radius), lambda: Lowest(radius))
    return found.groupBy(F.col("query_id").alias("id")).agg(F.min(F.col("id")).alias("first"))


def leaders(df: DataFrame, dist: float, m: int | None = None, metric: str = "l2", head: int = HEAD, pivots: int | None = None) -> DataFrame:
    """``(id, vector)`` of the points that lead: no leader of a lower id is within ``dist`` of them; of these the first ``m``.

    That is the lexicographically first independent set, found in parallel: among
    points whose turn it is, all lead at once that have no open point of a lower id
    within ``dist``; what they cover closes, and the next round looks at the rest.
    The turn comes in phases by id, each for twice as many points as before, so
    that late points are mostly closed by then. For ids without an order in space
    the rounds of a phase grow with the logarithm of its points. Partners are
    looked for inside pivot cells only, and no pairs are listed. Ids are distinct;
    points without a vector, or with one that has no distance, do not lead.
    """
    filed, chosen = choose_pivots(df, dist, metric, pivots)
    rest = filed.select("cell", "id", F.col("vector").alias("v"))
    count = rest.count()
    shares = [head * 2**i / count for i in range(64) if head * 2**i < count] if count else []
    ends = rest.agg(F.percentile_approx("id", shares, 100_000).alias("e")).first()["e"] if shares else []
    led: DataFrame | None = None
    held = 0
    for end in [*dict.fromkeys(ends), None]:
        turn = rest if end is None else rest.where(F.col("id") <= end)
        rest_after = None if end is None else rest.where(F.col("id") > end)
        fresh: DataFrame | None = None
        while turn.limit(1).count():
            lowest = first_within(turn.select("id", F.col("v").alias("vector")), turn, chosen, dist)
            heads = cut_lineage(turn.join(lowest.where("id = first"), "id").select(*turn.columns))
            closed = first_within(turn.select("id", F.col("v").alias("vector")), heads, chosen, dist).select("id")
            undefined = turn.select("id").join(lowest.select("id"), "id", "left_anti")
            turn = cut_lineage(turn.join(closed.unionByName(undefined), "id", "left_anti"))
            fresh = heads if fresh is None else fresh.unionByName(heads)
        if fresh is not None:
            fresh = cut_lineage(fresh)
            led = fresh if led is None else led.unionByName(fresh)
            held += fresh.count()
        if rest_after is None or (m is not None and held >= m):
            break
        rest = rest_after
        if fresh is not None:
            closed = first_within(rest.select("id", F.col("v").alias("vector")), fresh, chosen, dist).select("id")
            rest = cut_lineage(rest.join(closed, "id", "left_anti"))
    if led is None:
        return filed.select("id", "vector").limit(0)
    found = led.select("id", F.col("v").alias("vector"))
    return found if m is None else found.orderBy("id").limit(m)
