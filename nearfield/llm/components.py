"""Connected groups of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import cut_lineage


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the lowest node of its group.

    Each round hangs the higher neighbours of a node below its lowest neighbour
    and then its lower ones, until every group is a star. The lowest neighbour
    comes from a grouped minimum, combined before the shuffle, and is joined
    back: no neighbour list is ever gathered, and Spark may split a join on a
    node with very many links. Rounds grow with the logarithm of the group.
    Links with a null end and from a node to itself count for nothing; doubled
    links count once. No links, no rows.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    edges = cut_lineage(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(below.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
