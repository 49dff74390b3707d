"""Queries and rows that meet in cells: each is sent to the cells it belongs to, and nothing meets outside of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.blocks import PAIR, Block, Metric, _block, _pairs, _run, bounded_table
from nearfield.session import cut_lineage

ROWS_PART = 65_536  # rows of a cell in one group, on average
QUERIES_PART = 16_384  # queries of a cell in one group, on average: they are held while the rows pass by
TASK_ROWS = 100_000  # rows and queries a task takes
TASK_SCORES = 1 << 26  # scores a task computes
LISTED_CELLS = 4096  # sizes of so many cells are fetched at once; of more they stay a table
BROADCAST_CELLS = 500_000  # so many cells (below 30 MB) travel to the rows; more are joined

NO_ID = np.iinfo(np.int64).max

GROUP = ["cell", "part", "qpart"]


def _near(scores: np.ndarray, ids: np.ndarray, radius: float):
    """Rows with a partner, where the partners of each begin, and ids and scores of the partners, the lowest id of a row first."""
    row, col = np.nonzero(scores <= radius)
    found = ids[col]
    order = np.lexsort((found, row))
    row, found, value = row[order], found[order], scores[row, col][order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    return row[starts], starts, found, value


class Lowest:
    """Of every query the lowest id among the rows not farther than ``radius``."""

    def __init__(self, radius: float):
        self.radius = radius
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, part: int, q: Block, ids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        best, value = self.found.setdefault(part, (np.full(len(q), NO_ID), np.full(len(q), np.inf)))
        rows, starts, found, near = _near(scores, ids, self.radius)
        lower = found[starts] < best[rows]
        best[rows[lower]], value[rows[lower]] = found[starts[lower]], near[starts[lower]]
        return iter(())

    def rest(self, parts: list[Block]) -> Iterator[pa.RecordBatch]:
        for part, (best, value) in self.found.items():
            own = best < NO_ID
            yield _pairs(parts[part].ids[own], best[own], value[own])


class Tally:
    """Of every query how many rows are not farther than ``radius``, the lowest id among them and the least distance."""

    schema = T.StructType([*PAIR.fields, T.StructField("n", T.LongType())])

    def __init__(self, radius: float):
        self.radius = radius
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, part: int, q: Block, ids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        lowest, least, n = self.found.setdefault(part, (np.full(len(q), NO_ID), np.full(len(q), np.inf), np.zeros(len(q), np.int64)))
        rows, starts, found, near = _near(scores, ids, self.radius)
        if len(rows):
            lowest[rows] = np.minimum(lowest[rows], found[starts])
            least[rows] = np.minimum(least[rows], np.minimum.reduceat(near, starts))
            n[rows] += np.diff(np.concatenate([starts, [len(found)]]))
        return iter(())

    def rest(self, parts: list[Block]) -> Iterator[pa.RecordBatch]:
        for part, (lowest, least, n) in self.found.items():
            own = n > 0
            pairs = _pairs(parts[part].ids[own], lowest[own], least[own])
            yield pa.RecordBatch.from_arrays([*pairs.columns, pa.array(n[own], pa.int64())], names=[*pairs.schema.names, "n"])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of sorted batches with the same keys; a stretch ends with its batch at the latest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(new).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(c[start] for c in columns), batch.slice(start, end - start)


def score_cells(
    queries: DataFrame,
    rows: DataFrame,
    metric: Metric,
    make_keeper: Callable[[], object],
    digits: int | None = None,
    only: str | None = None,
) -> DataFrame:
    """``(query_id, id, value)``, or what else the keeper's ``schema`` says, for ``queries`` ``(cell, id, v)`` and ``rows`` ``(cell, id, v)``.

    A query meets the rows of its own cell only; for several cells it stands
    several times. Cells are counted on both sides: one that is empty on a side
    goes before the shuffle, and one that is full is cut into parts by a hash of
    the id on each side, all pairs of which meet. So a row is copied once per part
    of the queries of its own cell and a query once per part of the rows of its
    cells, whatever the number of all queries. In a task the queries of a group
    are held, its rows pass by in batches, and pairs leave as they are found.
    """
    kind = "array<bigint>" if metric.integral else "array<double>"
    queries, rows = (df.where(F.col("v").isNotNull()).select("cell", F.col("id").cast("long").alias("id"), F.col("v").cast(kind).alias("v")) for df in (queries, rows))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).join(queries.groupBy("cell").agg(F.count("*").alias("asked")), "cell")
    sizes = sizes.select("cell", "n", "asked", F.ceil(F.col("n") / ROWS_PART).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES_PART).cast("int").alias("qparts"))
    listed = bounded_table(sizes, LISTED_CELLS)
    sizes = cut_lineage(sizes) if listed is None else queries.sparkSession.createDataFrame(listed)
    total = sizes.agg(
        F.count("*").alias("cells"),
        F.sum(F.col("parts") * F.col("qparts")).alias("groups"),
        F.sum(F.col("n") * F.col("qparts") + F.col("asked") * F.col("parts")).alias("moved"),
        F.sum(F.col("n").cast("double") * F.col("asked")).alias("scores"),
    ).first()
    tasks = max(1, min(total["groups"] or 1, max(-(-(total["moved"] or 0) // TASK_ROWS), int((total["scores"] or 0) // TASK_SCORES) + 1)))
    cells = F.broadcast(sizes) if total["cells"] <= BROADCAST_CELLS else sizes

    def placed(df: DataFrame, own: str, many: str, other: str, others: str, row: bool) -> DataFrame:
        return df.join(cells, "cell").select(
            "cell",
            F.pmod(F.xxhash64("id"), F.col(many)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other),
            F.lit(row).alias("row"),
            "id",
            "v",
        )

    both = placed(queries, "qpart", "qparts", "part", "parts", False).unionByName(placed(rows, "part", "parts", "qpart", "qparts", True))
    dealt = both.repartition(tasks, *GROUP).sortWithinPartitions(*GROUP, "row")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(runs(batches, [*GROUP, "row"]), key=lambda run: run[0][:3]):
            asked = None
            for is_row, own in groupby(group, key=lambda run: run[0][3]):
                if not is_row:
                    asked = _block(pa.Table.from_batches([batch for _, batch in own]), metric.dtype)
                elif asked is not None:
                    yield from _run((_block(batch, metric.dtype) for _, batch in own), asked, metric, make_keeper(), digits, only)

    return dealt.mapInArrow(scan, getattr(make_keeper(), "schema", PAIR))
