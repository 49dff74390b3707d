"""Bounded samples that depend on ids alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BITS = 40
SPARE = 4


def lowest_hashes(rows: DataFrame, most: int, group: str | None = None) -> DataFrame:
    """Of every ``group``, or of all rows, the ``most`` whose ``doc_id`` has the lowest hash.

    Groups are counted first, and only hashes low enough to hold SPARE times as
    many rows as are wanted are ranked, so that no task ranks a large group.
    """
    held = rows.columns
    coded = rows.withColumn("_place", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS))
    enough = float(SPARE * most * (1 << BITS))
    if group is None:
        low = coded.where(F.col("_place") < F.lit(enough / max(1, rows.count())))
        return low.orderBy("_place", "doc_id").limit(most).select(*held)
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    low = coded.join(sizes, F.col(group) == F.col("_group")).where(F.col("_place") < F.lit(enough) / F.col("_n"))
    ranked = low.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy("_place", "doc_id")))
    return ranked.where(F.col("_rank") <= most).select(*held)
