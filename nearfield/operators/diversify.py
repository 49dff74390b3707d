"""Reordering of hit lists. A hit list is bounded by its top-k; lists of different queries run in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.hashing import md5_hex
from nearfield.functions.vectors import cosine
from nearfield.operators.blocks import best_pairs
from nearfield.operators.topk import top_k
from nearfield.session import cut_lineage

# Fixed value: the seed of the random order.
SEED = 57895447
LIST_LIMIT = 1000  # hits per query that a reordering accepts
GAIN_FLOOR = 1e-10  # fixed value: a DPP stops below this gain


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def dpp_order(scores: np.ndarray, vectors: np.ndarray, limit: int | None = None) -> list[int]:
    """Greedy maximum of the determinant of ``s_i * cos_ij * s_j``.

    Keeps, for every item, what is left of its own kernel value after the part
    explained by the items already picked has been projected out.
    """
    unit = unit_rows(vectors)
    gain = scores * scores * np.einsum("ij,ij->i", unit, unit)
    basis = np.zeros((0, len(scores)))
    order: list[int] = []
    limit = len(scores) if limit is None else limit
    while len(order) < limit:
        best = int(np.argmax(gain))
        if order and gain[best] < GAIN_FLOOR:
            break
        order.append(best)
        if gain[best] <= 0:
            break
        kernel = scores[best] * scores * (unit @ unit[best])
        direction = (kernel - basis[:, best] @ basis) / np.sqrt(gain[best])
        basis = np.vstack([basis, direction])
        gain = gain - direction * direction
        gain[best] = -np.inf
    return order


def kmeans_labels(vectors: np.ndarray, k: int, seed: int = SEED, rounds: int = 50) -> np.ndarray:
    """Seeded Lloyd iterations on one hit list."""
    rng = np.random.default_rng(seed)
    centers = vectors[rng.choice(len(vectors), k, replace=False)]
    labels = np.zeros(len(vectors), int)
    for turn in range(rounds):
        gaps = ((vectors[:, None, :] - centers[None, :, :]) ** 2).sum(-1)
        fresh = gaps.argmin(axis=1)
        if turn and (fresh == labels).all():
            break
        labels = fresh
        for j in range(k):
            if (labels == j).any():
                centers[j] = vectors[labels == j].mean(axis=0)
    return labels


def _dpp(pdf: pd.DataFrame) -> list[int]:
    return dpp_order(pdf["_score"].to_numpy(float), np.stack(pdf["vector"].to_list()).astype(float))


def _kmeans(pdf: pd.DataFrame) -> list[int]:
    k = len(pdf) // 5
    if k == 0:
        return list(range(len(pdf)))
    return list(np.argsort(kmeans_labels(np.stack(pdf["vector"].to_list()).astype(float), k), kind="stable"))


LIST_METHODS: dict[str, Callable[[pd.DataFrame], list[int]]] = {"dpp": _dpp, "kmeans": _kmeans}


def with_old_index(hits: DataFrame) -> DataFrame:
    return hits.withColumn("old_index", F.col("rank") - 1)


def multi_hot(hits: DataFrame, categories: str, out: str = "vector") -> DataFrame:
    """Replace the vector by 0/1 over the sorted category values of the query's hits.

    A single-valued column must come as a one-element array.
    """
    values = hits.select("query_id", F.explode(categories).alias("c")).distinct()
    vocabulary = values.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("_vocabulary"))
    cell = lambda c: F.when(F.array_contains(F.col(categories), c), 1.0).otherwise(0.0)
    return (
        hits.drop(out).join(vocabulary, "query_id", "left").withColumn(out, F.transform("_vocabulary", cell)).drop("_vocabulary")
    )


def diversify(hits: DataFrame, method: str = "none", categorical: str | None = None) -> DataFrame:
    """Reorder ``(query_id, rank, id, _score, vector, ...)`` and add ``old_index``.

    random: by md5 of seed and id. dpp: greedy, may drop items. kmeans: clusters
    of about five, adjacent. Any other method keeps the order. Lists longer than
    LIST_LIMIT are an error, never cut.
    """
    rows = multi_hot(hits, categorical) if categorical else hits
    rows = with_old_index(rows)
    if method == "random":
        shuffled = Window.partitionBy("query_id").orderBy(md5_hex(F.concat_ws(":", F.lit(SEED), "id")), "id")
        return rows.withColumn("rank", F.row_number().over(shuffled).cast("long"))
    if method not in LIST_METHODS:
        return rows
    reorder = LIST_METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > LIST_LIMIT:
            raise ValueError(f"a hit list of {len(pdf)} rows; reordering takes at most {LIST_LIMIT}")
        pdf = pdf.sort_values("old_index", ignore_index=True)
        out = pdf.iloc[reorder(pdf)].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(run, rows.schema)


def similarity_matrix(hits: DataFrame) -> DataFrame:
    """``(query_id, i, j, similarity)`` for the positions of a hit list."""
    schema = "query_id long, i long, j long, similarity double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > LIST_LIMIT:
            raise ValueError(f"a hit list of {len(pdf)} rows; the matrix takes at most {LIST_LIMIT}")
        pdf = pdf.sort_values("rank", ignore_index=True)
        unit = unit_rows(np.stack(pdf["vector"].to_list()).astype(float))
        n = len(pdf)
        return pd.DataFrame(
            {
                "query_id": int(pdf["query_id"].iloc[0]),
                "i": np.repeat(np.arange(n), n),
                "j": np.tile(np.arange(n), n),
                "similarity": (unit @ unit.T).ravel(),
            }
        )

    return hits.select("query_id", "rank", "vector").groupBy("query_id").applyInPandas(run, schema)


def dpp_first_two(hits: DataFrame) -> DataFrame:
    """The first two DPP picks per query with window functions only."""
    own = F.col("_score") * F.col("_score")
    first_order = Window.partitionBy("query_id").orderBy(own.desc(), "rank")
    whole = Window.partitionBy("query_id")
    ranked = hits.withColumn("_gain", own).withColumn("_n", F.row_number().over(first_order))
    first = F.max(F.when(F.col("_n") == 1, F.struct("id", "_score", "vector", "_gain"))).over(whole)
    paired = ranked.withColumn("_first", first)
    kernel = F.col("_score") * F.col("_first._score") * cosine(F.col("vector"), F.col("_first.vector"))
    left = paired.withColumn("gain", F.col("_gain") - kernel * kernel / F.col("_first._gain"))
    second = top_k(left.where(F.col("_n") > 1), 1, score="gain", tie="_n")
    picks = ranked.where(F.col("_n") == 1).select("query_id", F.lit(1).cast("long").alias("pick"), "id", F.col("_gain").alias("gain"))
    return picks.unionByName(second.select("query_id", F.lit(2).cast("long").alias("pick"), "id", "gain"))


def cluster_order(hits: DataFrame, cell: str = "cell") -> DataFrame:
    """Stable order by cluster: members of one cluster become adjacent, all hits stay."""
    order = Window.partitionBy("query_id").orderBy(F.col(cell), F.col("old_index"))
    return with_old_index(hits).withColumn("rank", F.row_number().over(order).cast("long"))


def closest_to_centroids(df: DataFrame, centroids: DataFrame, distinct: bool = True, n_centroids: int | None = None) -> DataFrame:
    """``(cell, id, distance)``: the nearest member of every centroid.

    With ``distinct`` a member serves one centroid only, centroids choosing in
    order. As many candidates per centroid as there are centroids always
    suffice, so only that many leave each task. The choice is made in rounds:
    every centroid asks its nearest member that has not turned it down, a member
    keeps the lowest centroid that asks, and the others ask on; this ends where
    choosing one after the other would.
    """
    n = centroids.count() if n_centroids is None else n_centroids
    if n > LIST_LIMIT:
        raise ValueError(f"{n} centroids; at most {LIST_LIMIT} can choose in order")
    pairs = best_pairs(centroids, df, n if distinct else 1, "l2", query_id="cell", query_vec="vector")
    near = top_k(pairs, n if distinct else 1, score="value", ascending=True).select(
        F.col("query_id").alias("cell"), "id", F.col("value").alias("distance"), "rank"
    )
    if not distinct:
        return near.drop("rank")

    near = cut_lineage(near)
    asked = near.groupBy("cell").agg(F.lit(1).cast("long").alias("rank"))
    while True:
        asks = near.join(asked, ["cell", "rank"])
        holder = asks.groupBy("id").agg(F.min("cell").alias("holder"))
        judged = cut_lineage(asks.join(holder, "id"))
        if judged.where("cell != holder").isEmpty():
            return judged.select("cell", "id", "distance")
        asked = judged.select("cell", F.when(F.col("cell") == F.col("holder"), F.col("rank")).otherwise(F.col("rank") + 1).alias("rank"))
