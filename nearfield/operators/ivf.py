"""Clustered search: vectors filed under their nearest centroid, queries look into the nearest cells only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.blocks import TopK, best_pairs, bounded_table, counted, in_chunks, map_vectors, matrix, metric_named, vector_means
from nearfield.operators.cells import score_cells
from nearfield.operators.topk import top_k
from nearfield.session import cut_lineage

CENTROIDS = 65536  # centroids sent to every task at most
FILE_ROWS = 250_000  # rows of a cell in one file
LISTED_CELLS = 10_000  # probed cells written into the scan condition at most


def group_means(df: DataFrame, group: str, vec: str = "vector", digits: int | None = None) -> DataFrame:
    """``(cell, vector)``: the mean vector of every group."""
    means = vector_means(df, group, vec).select(F.col("key").alias("cell"), "vector")
    return means if digits is None else means.withColumn("vector", F.transform("vector", lambda x: F.round(x, digits)))


def kmeans_centroids(df: DataFrame, k: int, vec: str = "vector", seed: int = 57895447, iterations: int = 20) -> DataFrame:
    """``(cell, vector)`` of a distributed k-means over the frame."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(ready)
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cell long, vector array<double>")


def assign(
    df: DataFrame, centroids: DataFrame, metric: str = "l2", vec: str = "vector", id: str = "id", digits: int | None = None
) -> DataFrame:
    """Add ``cell`` and ``cell_distance`` of the nearest centroid; ties go to the lower cell, rows without a vector get nulls.

    Up to CENTROIDS centroids travel to the rows; more of them meet the rows in
    the block grid, and the result is joined back by a number that every row has
    of its own, so that rows which repeat an id keep their own cells.
    """
    m = metric_named(metric)
    table = bounded_table(centroids.select("cell", "vector").orderBy("cell"), CENTROIDS)
    if table is not None:
        cells = np.asarray(table.column("cell").to_numpy())
        centers = matrix(table.column("vector"), np.float64)

        def near(rows: np.ndarray) -> list[np.ndarray]:
            def best(part: np.ndarray) -> np.ndarray:
                d = m.score(part, centers)
                d = d if digits is None else np.round(d, digits)
                d = np.where(np.isnan(d), np.inf, d if m.ascending else -d)
                pick = d.argmin(axis=1)
                return np.stack([pick, d[np.arange(len(d)), pick]], axis=1)

            got = in_chunks(rows, len(centers), best)
            return [cells[got[:, 0].astype(int)], got[:, 1] if m.ascending else -got[:, 1]]

        return map_vectors(
            df, vec, near, [T.StructField("cell", T.LongType()), T.StructField("cell_distance", T.DoubleType())]
        )
    row = "_row"
    while row in df.columns:
        row += "_"
    kept = cut_lineage(df.withColumn(row, F.monotonically_increasing_id()))
    pairs = best_pairs(kept, centroids, 1, metric, query_id=row, query_vec=vec, id="cell", vec="vector", digits=digits)
    nearest = top_k(pairs, 1, score="value", ascending=m.ascending).select(
        F.col("query_id").alias(row), F.col("id").alias("cell"), F.col("value").alias("cell_distance")
    )
    return kept.join(nearest, row, "left").drop(row)


def nearest_cells(
    df: DataFrame, centroids: DataFrame, n: int, metric: str = "l2", vec: str = "q", id: str = "query_id", digits: int | None = None
) -> DataFrame:
    """Rows of ``df`` once per cell of its ``n`` nearest centroids, with ``cell``; ties go to the lower cell.

    Up to CENTROIDS centroids travel to the rows and nothing is shuffled; with
    more of them both sides meet in the block grid.
    """
    m = metric_named(metric)
    table = bounded_table(centroids.select("cell", "vector").orderBy("cell"), CENTROIDS)
    if table is None:
        return probes(df.withColumnRenamed(id, "query_id"), centroids, n, metric, digits).select("*", F.explode("probes").alias("cell")).drop("probes")
    cells = np.asarray(table.column("cell").to_numpy())
    centers = matrix(table.column("vector"), np.float64)
    wanted = min(n, len(cells))

    def near(rows: np.ndarray) -> list[np.ndarray]:
        def best(part: np.ndarray) -> np.ndarray:
            d = m.score(part, centers)
            d = d if digits is None else np.round(d, digits)
            d = np.where(np.isnan(d), np.inf, d if m.ascending else -d)
            order = np.argsort(d, axis=1, kind="stable")[:, :wanted]
            return np.where(np.isfinite(np.take_along_axis(d, order, axis=1)), order, -1)

        got = in_chunks(rows, len(centers), best)
        return [np.where(got < 0, -1, cells[got])]

    probed = map_vectors(df, vec, near, [T.StructField("_cells", T.ArrayType(T.LongType()))])
    return probed.withColumn("cell", F.explode(F.filter("_cells", lambda c: c >= 0))).drop("_cells")


def ivf_build(corpus: DataFrame, centroids: DataFrame, metric: str = "l2", **options) -> DataFrame:
    """The corpus with its cell. Save it partitioned by ``cell`` so that a search reads probed cells only."""
    return assign(corpus, centroids, metric, **options)


def save_ivf(index: DataFrame, centroids: DataFrame, path: str, metric: str, rows_per_file: int = FILE_ROWS) -> None:
    """Write vectors partitioned by cell, centroids, and one row that describes them.

    Cells are counted, and one with more than ``rows_per_file`` rows is spread over
    as many tasks and files as that takes, by a hash of the id.
    """
    sizes = cut_lineage(cell_sizes(index).select("cell", F.ceil(F.col("n") / rows_per_file).alias("_files")))
    n, files = sizes.agg(F.count("*"), F.sum("_files")).first()
    dealt = index.join(F.broadcast(sizes) if n <= CENTROIDS else sizes, index["cell"].eqNullSafe(sizes["cell"])).drop(sizes["cell"])
    salt = F.pmod(F.xxhash64("id"), F.col("_files"))
    dealt.repartition(max(1, files or 1), "cell", salt).drop("_files").write.partitionBy("cell").parquet(f"{path}/cells")
    centroids.write.parquet(f"{path}/centroids")
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"))
    facts.withColumn("metric", F.lit(metric)).coalesce(1).write.parquet(f"{path}/about")


def load_ivf(spark, path: str) -> tuple[DataFrame, DataFrame, dict]:
    about = spark.read.parquet(f"{path}/about").first().asDict()
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centroids"), about


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """Queries with ``probes``, the list of their nearest cells."""
    near = best_pairs(queries, centroids, nprobe, metric, id="cell", digits=digits)
    ranked = top_k(near, nprobe, score="value", ascending=metric_named(metric).ascending)
    cells = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("probes"))
    return queries.join(cells, "query_id")


def ivf_search(
    queries: DataFrame,
    index: DataFrame,
    centroids: DataFrame,
    k: int,
    nprobe: int,
    metric: str = "l2",
    score: str = "cosine1p",
    digits: int | None = None,
    expected_candidates: int | None = None,
) -> DataFrame:
    """Exact top-k among the rows of the ``nprobe`` nearest cells of each query.

    The probed cells become a condition on ``cell``, so a table partitioned by
    cell is read only where needed. A cell of any size stays spread over the
    tasks that scan it. More queries than may travel to the tasks go to their cells
    instead (``ivf_search_routed``). ``expected_candidates`` (the exploration
    factor) must exceed ``k``.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    if expected_candidates is not None and expected_candidates <= k:
        raise ValueError(f"candidates must exceed k, got {expected_candidates} for k={k}")
    if counted(queries) is None:
        return ivf_search_routed(queries, index, centroids, k, nprobe, metric, score, digits)
    routed = probes(queries, centroids, nprobe, metric, digits)
    listed = bounded_table(routed.select(F.explode("probes").alias("cell")).distinct(), LISTED_CELLS)
    rows = index if listed is None else index.where(F.col("cell").isin(listed.column("cell").to_pylist()))
    pairs = best_pairs(routed, rows, k, score, probes="probes", cell="cell", digits=digits)
    hits = top_k(pairs, k, score="value", ascending=metric_named(score).ascending)
    return hits.select("query_id", "rank", "id", F.col("value").alias("_score"))


def ivf_search_routed(
    queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "l2", score: str = "cosine1p", digits: int | None = None
) -> DataFrame:
    """What ``ivf_search`` finds, for any number of queries: each goes to its ``nprobe`` cells and meets the rows there.

    Queries are copied per probed cell and, where a cell is large, per part of it;
    rows of cells that nobody asks for don't move. See ``score_cells``.
    """
    m = metric_named(score)
    asked = nearest_cells(queries, centroids, nprobe, metric, digits=digits).select("cell", F.col("query_id").alias("id"), F.col("q").alias("v"))
    rows = index.select("cell", "id", F.col("vector").alias("v"))
    hits = top_k(score_cells(asked, rows, m, lambda: TopK(k, m), digits), k, score="value", ascending=m.ascending)
    return hits.select("query_id", "rank", "id", F.col("value").alias("_score"))


def cell_sizes(index: DataFrame, cell: str = "cell") -> DataFrame:
    return index.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))


def as_frame(spark, cells: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """A small centroid frame from arrays."""
    table = pa.table({"cell": pa.array(cells, pa.int64()), "vector": pa.array(list(vectors), pa.list_(pa.float64()))})
    return spark.createDataFrame(table)
