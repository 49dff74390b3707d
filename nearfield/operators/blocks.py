"""Scoring of a query table against a corpus table, block by block in the executors.

Spark scans and shuffles; numpy scores one block at a time inside a task.
Two plans, chosen by the counted size of the query side:

* up to ``BROADCAST_ROWS`` queries: they travel to every task, the corpus is
  scanned once where it lies and never shuffled; each task sends on at most
  ``k`` rows per query;
* more queries: both sides are cut into blocks by a hash of the id and meet in
  a grid of (query block, corpus block) cells. Blocks are even whatever the
  data looks like, so no hot key can fill one task, and nothing passes through
  the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 4096  # queries sent to every task at most
QUERY_BLOCK = 4096  # queries in one grid cell
CORPUS_BLOCK = 65536  # corpus rows in one grid cell
WIDER = 8  # times as many queries in a cell, at most, where there are more cells than GRID: each row is sent to every block of queries
GRID = 256
CELLS = 1 << 22  # scores held at once in a task

PAIR = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


# --- scores: (queries x rows) matrices, NaN where undefined --------------------


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])


def _dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return q @ c.T


TILE = 2048  # rows whose differences to a query stay in the processor's cache


def _by_query(f: Callable[[np.ndarray], np.ndarray], q: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(c)))
    for start in range(0, len(c), TILE):
        tile = c[start : start + TILE]
        for i, row in enumerate(q):
            out[i, start : start + TILE] = f(tile - row)
    return out


def _l2sq(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _by_query(lambda g: np.einsum("ij,ij->i", g, g), q, c)


def _l1(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _by_query(lambda g: np.abs(g).sum(axis=1), q, c)


def _hamming(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(c)))
    for w in range(q.shape[1]):
        out += np.bitwise_count((q[:, w, None] ^ c[None, :, w]).view(np.uint64))  # of signed numbers it counts the absolute value's bits
    return out


def _matches(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(c)))
    for t in range(q.shape[1]):
        out += q[:, t, None] == c[None, :, t]
    return out


@dataclass(frozen=True)
class Metric:
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ascending: bool = False  # smaller is better
    integral: bool = False  # operands are integer codes
    euclidean: bool = False  # plain distances, which a product of the vectors estimates

    @property
    def dtype(self):
        return np.int64 if self.integral else np.float64


METRICS: dict[str, Metric] = {
    "cosine1p": Metric(lambda q, c: 1.0 + _cosine(q, c)),
    "cosine_similarity": Metric(_cosine),
    "sigmoid_dot": Metric(lambda q, c: 1.0 / (1.0 + np.exp(-_dot(q, c)))),
    "dot": Metric(_dot),
    "matches": Metric(_matches, integral=True),
    "l2": Metric(lambda q, c: np.sqrt(_l2sq(q, c)), ascending=True, euclidean=True),
    "l2sq": Metric(_l2sq, ascending=True),
    "l1": Metric(_l1, ascending=True),
    "cosine": Metric(lambda q, c: 1.0 - _cosine(q, c), ascending=True),
    "ip": Metric(lambda q, c: 1.0 - _dot(q, c), ascending=True),
    "hamming": Metric(_hamming, ascending=True, integral=True),
}


def metric_named(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[name]


# --- blocks --------------------------------------------------------------------


@dataclass
class Block:
    ids: np.ndarray
    vectors: np.ndarray
    cells: list[np.ndarray] | np.ndarray | None = None  # probed cells (queries) or own cell (rows)

    def __len__(self) -> int:
        return len(self.ids)


def matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """List column as a matrix; vectors of different length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    widths = np.diff(np.asarray(column.offsets))
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors of different dimensions in one column")
    return flat.astype(dtype, copy=False).reshape(n, -1)


ITEMS_AT_ONCE = 500_000  # items of a list column worked on at once in a task


def few_items(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ITEMS_AT_ONCE items of a list column, or of one row: rows may be of any length."""
    sizes = np.asarray(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    cuts = [0, *(1 + np.flatnonzero(np.diff(sizes.cumsum() // ITEMS_AT_ONCE))).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        if end > at:
            yield batch.slice(at, end - at)


def list_rows(lists: pa.ListArray) -> np.ndarray:
    """Row number of every item of the flattened list column; a null list has no items."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists), dtype=np.int64), sizes)


def _block(table: pa.Table | pa.RecordBatch, dtype, cell: str | None = None) -> Block:
    table = table.filter(table.column("v").is_valid())
    cells = None
    if cell == "probes":
        cells = [np.asarray(c) for c in table.column("cell").to_pylist()]
    elif cell == "own":
        cells = np.asarray(table.column("cell").to_numpy(zero_copy_only=False))
    return Block(
        np.asarray(table.column("id").to_numpy(zero_copy_only=False)).astype(np.int64),
        matrix(table.column("v"), dtype),
        cells,
    )


def _scores(metric: Metric, q: Block, c: Block, digits: int | None, only: str | None) -> np.ndarray:
    if q.vectors.shape[1] != c.vectors.shape[1]:
        raise ValueError(f"queries have {q.vectors.shape[1]} dimensions, rows {c.vectors.shape[1]}")
    if q.cells is None:
        out = metric.score(q.vectors, c.vectors)
    else:
        out = np.full((len(q), len(c)), np.nan)
        for cell in np.unique(c.cells):
            asked = np.array([i for i, probes in enumerate(q.cells) if cell in probes], int)
            if len(asked):
                here = np.flatnonzero(c.cells == cell)
                out[np.ix_(asked, here)] = metric.score(q.vectors[asked], c.vectors[here])
    if digits is not None:
        out = np.round(out, digits)
    if only == "others":
        out[q.ids[:, None] == c.ids[None, :]] = np.nan
    elif only == "earlier":
        out[c.ids[None, :] >= q.ids[:, None]] = np.nan
    return out


HUGE = 1e150  # of squared lengths: sums and differences of smaller ones are finite
ESTIMATE = 1e-11  # error of an estimated squared distance, of the squared lengths; that of the sums is far below
PAIRS_AT_ONCE = 1 << 16  # pairs whose differences are computed at once
NEAR_ROWS, NEAR_CELLS = 1 << 12, 1 << 18  # rows and estimates at once, which stay in the processor's cache


class TopK:
    """Running k best rows of every query over the blocks of one task; ties go to the lower id.

    Once a query has k rows its worst one is the bar: later blocks are compared
    with the bar only, and little of them is left to sort.
    """

    def __init__(self, k: int, metric: Metric):
        self.k, self.sign = k, (1.0 if metric.ascending else -1.0)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bars: dict[int, np.ndarray] = {}

    def add(self, part: int, q: Block, ids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.k > 0 and scores.size:
            cost = scores if self.sign > 0 else -scores
            bar = self._bar(part, cost)
            row, col = np.nonzero(cost <= bar[:, None])
            self._keep(part, len(cost), row, cost[row, col], ids[col])
        return iter(())

    def _bar(self, part: int, cost: np.ndarray) -> np.ndarray:
        """What a row may cost to be among the k best of each query, as far as is known."""
        bar = self.bars.get(part)
        if bar is None:
            bar = np.full(len(cost), np.inf)
        if self.k < cost.shape[1] and not np.isfinite(bar).all():
            own = np.partition(cost, self.k - 1, axis=1)[:, self.k - 1]  # NaN sorts last
            bar = np.fmin(bar, own)
        return bar

    def _keep(self, part: int, queries: int, row: np.ndarray, value: np.ndarray, found: np.ndarray) -> None:
        finite = value < np.inf
        if not finite.all():
            row, value, found = row[finite], value[finite], found[finite]
        if not len(row):
            return
        if part in self.kept:
            row0, value0, found0 = self.kept[part]
            row, value, found = (
                np.concatenate([row0, row]),
                np.concatenate([value0, value]),
                np.concatenate([found0, found]),
            )
        order = np.lexsort((found, value, row))
        row, value, found = row[order], value[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = place < self.k
        self.kept[part] = (row[keep], value[keep], found[keep])
        bars = np.full(queries, np.inf)
        last = place == self.k - 1
        bars[row[last]] = value[last]
        self.bars[part] = bars

    def add_near(self, part: int, q: Block, c: Block, digits: int | None, only: str | None) -> bool:
        """``add`` for Euclidean distances, all estimated by one product; only rows that may be among the k best are computed from differences.

        False, and nothing done, where numbers are too large for estimates.
        """
        if q.vectors.shape[1] != c.vectors.shape[1]:
            raise ValueError(f"queries have {q.vectors.shape[1]} dimensions, rows {c.vectors.shape[1]}")
        with np.errstate(over="ignore", invalid="ignore"):
            own, other = np.einsum("ij,ij->i", q.vectors, q.vectors), np.einsum("ij,ij->i", c.vectors, c.vectors)
        sizes = np.concatenate([own, other])
        if self.k < 1 or not (np.isnan(sizes) | (sizes < HUGE)).all():
            return False
        slack = ESTIMATE * (own + (np.nanmax(other) if np.isfinite(other).any() else 0.0))
        guess = np.concatenate([q.vectors, np.ones((len(q), 1)), own[:, None]], axis=1)
        guess = guess @ np.concatenate([-2 * c.vectors, other[:, None], np.ones((len(c), 1))], axis=1).T
        if only == "others":
            guess[q.ids[:, None] == c.ids[None, :]] = np.inf
        elif only == "earlier" and c.ids.max() >= q.ids.min():
            guess[c.ids[None, :] >= q.ids[:, None]] = np.inf
        coarse = 0.0 if digits is None else 10.0**-digits  # what is below the bar only once it is rounded counts too
        bar = self.bars.get(part)
        most = np.full(len(q), np.inf) if bar is None else np.square(bar + coarse) + slack
        if self.k < guess.shape[1] and not np.isfinite(most).all():
            kth = np.maximum(np.partition(guess, self.k - 1, axis=1)[:, self.k - 1] + slack, 0)
            most = np.fmin(most, np.square(np.sqrt(kth) + 2 * coarse) + slack)
        row, col = np.nonzero(guess <= most[:, None])
        seen = guess[row, col] < np.inf
        row, col = row[seen], col[seen]
        value = np.empty(len(row))
        for at in range(0, len(row), PAIRS_AT_ONCE):
            gap = c.vectors[col[at : at + PAIRS_AT_ONCE]] - q.vectors[row[at : at + PAIRS_AT_ONCE]]
            value[at : at + PAIRS_AT_ONCE] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        if digits is not None:
            value = np.round(value, digits)
        self._keep(part, len(q), row, value, c.ids[col])
        return True

    def rest(self, parts: list[Block]) -> Iterator[pa.RecordBatch]:
        for part, (row, value, found) in self.kept.items():
            yield _pairs(parts[part].ids[row], found, value * self.sign)


class Within:
    """All pairs whose distance does not pass ``radius``."""

    def __init__(self, radius: float):
        self.radius = radius

    def add(self, part: int, q: Block, ids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, col = np.nonzero(scores <= self.radius)
        yield _pairs(q.ids[row], ids[col], scores[row, col])

    def rest(self, parts: list[Block]) -> Iterator[pa.RecordBatch]:
        return iter(())


def _pairs(query: np.ndarray, found: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(value, pa.float64())],
        names=["query_id", "id", "value"],
    )


def _parts(q: Block, rows: int, cells: int) -> list[Block]:
    step = max(1, cells // max(rows, 1))
    return [
        Block(q.ids[i : i + step], q.vectors[i : i + step], q.cells[i : i + step] if q.cells is not None else None)
        for i in range(0, len(q), step)
    ]


def _by_id(block: Block) -> Block:
    order = np.argsort(block.ids, kind="stable")
    if isinstance(block.cells, list):
        cells = [block.cells[i] for i in order]
    else:
        cells = None if block.cells is None else block.cells[order]
    return Block(block.ids[order], block.vectors[order], cells)


def _run(
    blocks: Iterable[Block], queries: Block, metric: Metric, keeper, digits: int | None, only: str | None
) -> Iterator[pa.RecordBatch]:
    if only == "earlier":
        queries = _by_id(queries)
    estimated = metric.euclidean and isinstance(keeper, TopK) and queries.cells is None
    rows = NEAR_ROWS if estimated else 1 << 14
    parts = _parts(queries, rows, NEAR_CELLS if estimated else CELLS)
    for whole in blocks:
        if only == "earlier":
            whole = _by_id(whole)
        for start in range(0, len(whole), rows):
            end = start + rows
            c = Block(
                whole.ids[start:end],
                whole.vectors[start:end],
                whole.cells[start:end] if whole.cells is not None else None,
            )
            for p, q in enumerate(parts):
                if only == "earlier" and c.ids.min() >= q.ids.max():
                    continue  # no row is earlier than a query
                if not (estimated and keeper.add_near(p, q, c, digits, only)):
                    yield from keeper.add(p, q, c.ids, _scores(metric, q, c, digits, only))
    yield from keeper.rest(parts)


# --- plans -----------------------------------------------------------------------


def bounded_table(df: DataFrame, limit: int) -> pa.Table | None:
    """The rows of ``df`` if there are at most ``limit`` of them, else None."""
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None


def score_pairs(
    queries: DataFrame,
    corpus: DataFrame,
    metric: str,
    make_keeper: Callable[[], object],
    *,
    query_id: str = "query_id",
    query_vec: str = "q",
    id: str = "id",
    vec: str = "vector",
    probes: str | None = None,
    cell: str | None = None,
    digits: int | None = None,
    only: str | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``(query_id, id, value)`` rows that the keeper lets through."""
    m = metric_named(metric)
    kind = "array<bigint>" if m.integral else "array<double>"
    asked = [F.col(query_id).cast("long").alias("id"), F.col(query_vec).cast(kind).alias("v")]
    # Floats stay floats on the way to Python; the block turns them into doubles.
    rows = [F.col(id).cast("long").alias("id"), F.col(vec).alias("v")]
    routed = probes is not None
    if routed:
        asked.append(F.col(probes).alias("cell"))
        rows.append(F.col(cell).alias("cell"))
    q_df, c_df = queries.select(*asked), corpus.select(*rows)

    table = bounded_table(q_df, BROADCAST_ROWS if broadcast_rows is None else broadcast_rows)
    if table is not None:
        q_block = _block(table, m.dtype, "probes" if routed else None)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(q_block):
                blocks = (_block(b, m.dtype, "own" if routed else None) for b in batches)
                yield from _run((b for b in blocks if len(b)), q_block, m, make_keeper(), digits, only)

        return c_df.mapInArrow(scan, PAIR)
    return _grid(q_df, c_df, m, make_keeper, routed, digits, only)


def _grid(
    q_df: DataFrame, c_df: DataFrame, m: Metric, make_keeper, routed: bool, digits: int | None, only: str | None
) -> DataFrame:
    asked = q_df.count()
    n_q = max(1, -(-asked // QUERY_BLOCK))
    n_c = max(1, -(-c_df.count() // CORPUS_BLOCK))
    if n_q * n_c > GRID:
        n_q = max(-(-GRID // n_c), -(-asked // (QUERY_BLOCK * WIDER)))

    def spread(df: DataFrame, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select(
            F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(own_name), copies.alias(other_name), *df.columns
        )

    left = spread(q_df, n_q, n_c, "qb", "cb").groupBy("qb", "cb")
    right = spread(c_df, n_c, n_q, "cb", "qb").groupBy("qb", "cb")

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        if q.num_rows and c.num_rows:
            q_block = _block(q, m.dtype, "probes" if routed else None)
            c_block = _block(c, m.dtype, "own" if routed else None)
            if len(q_block) and len(c_block):
                out = list(_run([c_block], q_block, m, make_keeper(), digits, only))
        empty = _pairs(np.empty(0), np.empty(0), np.empty(0))
        return pa.Table.from_batches(out or [empty])

    return left.cogroup(right).applyInArrow(cell, PAIR)


def best_pairs(queries: DataFrame, corpus: DataFrame, k: int, metric: str, **options) -> DataFrame:
    """At most ``k`` candidate rows per query and task; ``top_k`` makes the final cut."""
    m = metric_named(metric)
    return score_pairs(queries, corpus, metric, lambda: TopK(k, m), **options)


def near_pairs(queries: DataFrame, corpus: DataFrame, radius: float, metric: str, **options) -> DataFrame:
    """Pairs with a distance of at most ``radius``."""
    if not metric_named(metric).ascending:
        raise ValueError(f"{metric} is not a distance")
    return score_pairs(queries, corpus, metric, lambda: Within(radius), **options)


# --- row-wise vector functions ------------------------------------------------------


def map_vectors(
    df: DataFrame, vec: str, f: Callable[[np.ndarray], list[np.ndarray]], fields: list[T.StructField], keep: bool = True
) -> DataFrame:
    """Append columns computed from the matrix of an Arrow batch; rows without a vector get nulls.

    ``f`` returns one array per new field, two-dimensional for a list column.
    Runs where the rows lie, without a shuffle.
    """
    kept = list(df.schema.fields) if keep else [x for x in df.schema.fields if x.name != vec]
    schema = T.StructType(kept + fields)
    names = [x.name for x in kept]
    out_names = [x.name for x in schema.fields]
    types = [pa.float64() if "double" in x.dataType.simpleString() else pa.int64() for x in fields]
    lists = [isinstance(x.dataType, T.ArrayType) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            valid = batch.column(vec).is_valid().to_numpy(zero_copy_only=False)
            arrays = [batch.column(name) for name in names]
            if not valid.any():
                empty = [pa.nulls(len(valid), pa.list_(kind) if is_list else kind) for kind, is_list in zip(types, lists)]
                yield pa.RecordBatch.from_arrays(arrays + empty, names=out_names)
                continue
            spread = None if valid.all() else pa.array(np.cumsum(valid) - 1, mask=~valid)
            for values, kind in zip(f(matrix(batch.column(vec).filter(pa.array(valid)), np.float64)), types):
                if values.ndim == 2:
                    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
                    out = pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))
                else:
                    out = pa.array(values, kind)
                arrays.append(out if spread is None else out.take(spread))
            yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    return df.mapInArrow(run, schema)


def counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> int | None:
    """Number of rows when it is at most ``limit``, else None."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def beside(small: DataFrame, queries: DataFrame, per_query: int, limit: int = 1_000_000) -> DataFrame:
    """``small`` holds at most ``per_query`` rows per query: broadcast it when the counted queries keep it
    under ``limit`` rows, and leave the join to the planner when they do not."""
    n = counted(queries, max(1, limit // max(per_query, 1)))
    return small if n is None else F.broadcast(small)


def in_chunks(rows: np.ndarray, width: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` over slices of rows so that (rows x width) scores stay within bounds."""
    step = max(1, CELLS // max(width, 1))
    return np.concatenate([f(rows[i : i + step]) for i in range(0, len(rows), step)])


# --- sums of vectors ------------------------------------------------------------------

OPEN_KEYS = 4096  # keys summed up at once in a task before they are sent on


def vector_means(df: DataFrame, key: str, vec: str = "vector", weight: str | None = None) -> DataFrame:
    """``(key, weight, vector)``: the (weighted) mean vector per whole-number key.

    Every task first sums its own rows per key, so a key that holds a third of
    all rows arrives as a few rows per task. The sums are then sorted by key and
    added up in passing; no group is held in memory.
    """
    rows = df.select(
        F.col(key).cast("long").alias("key"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"),
        F.col(vec).alias("v"),
    )
    sums = T.StructType.fromDDL("key long, weight double, v array<double>")

    def emit(keys, weights, totals) -> pa.RecordBatch:
        totals = np.asarray(totals)
        offsets = pa.array(np.arange(len(totals) + 1) * totals.shape[1], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(keys), pa.int64()),
                pa.array(np.asarray(weights), pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(totals.ravel(), pa.float64())),
            ],
            names=["key", "weight", "v"],
        )

    def per_batch(batch: pa.RecordBatch, scale: bool):
        batch = batch.filter(batch.column("v").is_valid())
        if not batch.num_rows:
            return np.empty(0, np.int64), np.empty(0), np.empty((0, 0))
        keys = np.asarray(batch.column("key"))
        weights = np.asarray(batch.column("weight"))
        vectors = matrix(batch.column("v"), np.float64)
        order = np.argsort(keys, kind="stable")
        keys, weights, vectors = keys[order], weights[order], vectors[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        scaled = vectors * weights[:, None] if scale else vectors
        return keys[starts], np.add.reduceat(weights, starts), np.add.reduceat(scaled, starts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for k, w, total in zip(*per_batch(batch, True)):
                before = held.get(int(k))
                held[int(k)] = (w, total) if before is None else (before[0] + w, before[1] + total)
            if len(held) > OPEN_KEYS:
                yield emit(list(held), [w for w, _ in held.values()], [t for _, t in held.values()])
                held = {}
        if held:
            yield emit(list(held), [w for w, _ in held.values()], [t for _, t in held.values()])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys, weights, totals = per_batch(batch, False)
            if not len(keys):
                continue
            if last is not None and last[0] == keys[0]:
                weights[0] += last[1]
                totals[0] += last[2]
            elif last is not None:
                yield emit([last[0]], [last[1]], [last[2] / last[1]])
            if len(keys) > 1:
                yield emit(keys[:-1], weights[:-1], totals[:-1] / weights[:-1, None])
            last = (keys[-1], weights[-1], totals[-1])
        if last is not None:
            yield emit([last[0]], [last[1]], [last[2] / last[1]])

    sorted_sums = rows.mapInArrow(partial, sums).repartition("key").sortWithinPartitions("key")
    return sorted_sums.mapInArrow(final, sums).select(F.col("key"), "weight", F.col("v").alias("vector"))
