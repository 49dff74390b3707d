"""Exact vector search: every matching row is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.hashing import shard_of
from nearfield.operators.blocks import best_pairs, counted, metric_named, near_pairs
from nearfield.operators.topk import top_k
from nearfield.session import cut_lineage

HITS = 1_000_000  # hits whose ids go to every task at most


def engine_score(distance: Column, metric: str) -> Column:
    """Score a search engine reports for a distance: 1/(1+d), and 1-d for negative inner-product distances."""
    if metric == "ip":
        return F.when(distance >= 0, 1.0 / (1.0 + distance)).otherwise(1.0 - distance)
    return 1.0 / (1.0 + distance)


def search_exact(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    score: str = "cosine1p",
    where: Column | None = None,
    digits: int | None = None,
    **columns,
) -> DataFrame:
    """Top-k rows per query as ``(query_id, rank, id, _score)``.

    ``where`` is a condition on the corpus; it is applied before any scoring and
    reaches the scan. A similarity ranks descending. A distance ranks ascending
    and comes as ``distance`` next to its ``_score``. ``digits`` rounds before
    ranking, which makes ties independent of the order of summation.
    """
    rows = corpus if where is None else corpus.where(where)
    pairs = best_pairs(queries, rows, k, score, digits=digits, **columns)
    ascending = metric_named(score).ascending
    hits = top_k(pairs, k, score="value", ascending=ascending)
    if ascending:
        return hits.select(
            "query_id", "rank", "id", F.col("value").alias("distance"), engine_score(F.col("value"), score).alias("_score")
        )
    return hits.select("query_id", "rank", "id", F.col("value").alias("_score"))


def search_sharded(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    size: int = 10,
    shards: int = 2,
    score: str = "cosine1p",
    query_id: str = "query_id",
    id: str = "id",
    **options,
) -> DataFrame:
    """k hits from every shard of the corpus, merged and cut to ``size``.

    One scan: a query becomes one query per shard that is routed to the rows of
    its shard only, so each shard keeps its own k.
    """
    split = queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        (F.col(query_id) * shards + F.col("_shard")).alias("_part"),
        F.array("_shard").alias("_probes"),
        F.col(options.pop("query_vec", "q")).alias("q"),
    )
    rows = corpus.withColumn("_shard", shard_of(F.col(id), shards).cast("int"))
    pairs = best_pairs(
        split, rows, k, score, query_id="_part", id=id, probes="_probes", cell="_shard", **options
    )
    per_shard = top_k(pairs, k, score="value", ascending=metric_named(score).ascending).select(
        F.floor(F.col("query_id") / shards).alias("query_id"), "id", F.col("value").alias("_score")
    )
    merged = top_k(per_shard, size, ascending=metric_named(score).ascending)
    return merged.select("query_id", "rank", "id", "_score")


def within_distance(queries: DataFrame, corpus: DataFrame, radius: float, metric: str = "l2", **options) -> DataFrame:
    """``(query_id, id, distance)`` of all rows at most ``radius`` from a seed."""
    return near_pairs(queries, corpus, radius, metric, **options).withColumnRenamed("value", "distance")


def attach(hits: DataFrame, corpus: DataFrame, columns: list[str], id: str = "id") -> DataFrame:
    """Fetch wide columns for the rows that made it into the hits only.

    The hits are written once and counted. While they are few their ids go to
    the corpus scan, which is then filtered where it lies and not shuffled.
    """
    wide = corpus.select(F.col(id).alias("id"), *[c for c in columns if c != "id"])
    kept = cut_lineage(hits)
    if counted(kept, HITS) is None:
        return kept.join(wide, "id", "left")
    found = wide.join(F.broadcast(kept.select("id").distinct()), "id", "left_semi")
    return kept.join(found, "id", "left")
