"""Ranking: top-k per query, sorts, paging, previews and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    scored: DataFrame,
    k: int,
    by: str | list[str] = "query_id",
    score: str = "_score",
    tie: str = "id",
    ascending: bool = False,
) -> DataFrame:
    """The ``k`` best rows per query with ``rank`` from 1; equal scores go to the lower id.

    The rank filter turns into a group limit before the shuffle, so a query
    that matches a third of all rows still sends only ``k`` rows per task.
    """
    keys = [by] if isinstance(by, str) else by
    order = F.col(score).asc() if ascending else F.col(score).desc()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col(tie).asc()))
    return scored.where(F.col(score).isNotNull()).withColumn("rank", place).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def last_n(series: DataFrame, n: int, by: str = "series", ts: str = "ts") -> DataFrame:
    """The newest ``n`` points of every series."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(ts).desc()))
    return series.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def global_sort(df: DataFrame, score: str = "_score", tie: str = "id", limit: int | None = None) -> DataFrame:
    """Best score first over all queries; with a limit Spark keeps only that many rows per task."""
    out = df.orderBy(F.col(score).desc(), F.col(tie).asc())
    return out if limit is None else out.limit(limit)


def missing_last(column: str, descending: bool = False) -> Column:
    """Sort key that puts rows without a value at the end in both directions."""
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def page(df: DataFrame, rows: int, after: object | None = None, key: str = "id") -> DataFrame:
    """The next ``rows`` rows in key order; the cursor of the next page is the largest key returned."""
    seen = df if after is None else df.where(F.col(key) > F.lit(after))
    return seen.orderBy(F.col(key).asc()).limit(rows)


def next_cursor(page_rows: DataFrame, key: str = "id") -> DataFrame:
    return page_rows.agg(F.max(key).alias("cursor"))


def with_total(hits: DataFrame, matching: DataFrame, by: str = "query_id", cap: int | None = None) -> DataFrame:
    """Attach ``numfound``, the number of matching rows before top-k, optionally counted up to ``cap``."""
    totals = matching.groupBy(by).agg(F.count(F.lit(1)).alias("numfound"))
    if cap is not None:
        totals = totals.withColumn("numfound", F.least(F.col("numfound"), F.lit(cap).cast("long")))
    return hits.join(totals, by, "left").withColumn("numfound", F.coalesce("numfound", F.lit(0).cast("long")))


def preview(hits: DataFrame, rows: int = 10, columns: int = 5) -> DataFrame:
    """The first rows and columns of a result, in rank order."""
    keys = [c for c in ("query_id", "rank") if c in hits.columns]
    return hits.orderBy(*keys).limit(rows).select(*hits.columns[:columns])


def score_curve(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "_score")
