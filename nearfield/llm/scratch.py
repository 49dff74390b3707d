"""Tables written once in the shared folder, read several times, and removed."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from nearfield.session import scratch_path


@contextmanager
def written(df: DataFrame, name: str):
    """``df`` as a table in the shared folder for the length of a block; its files go when the block ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, wherever Spark's file systems find it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
