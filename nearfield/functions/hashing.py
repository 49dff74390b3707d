"""Hashes that any SQL engine can repeat: every seed, shard and sign comes from md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_hex(value: Column) -> Column:
    return F.md5(value.cast("string").cast("binary"))


def hash32(value: Column, offset: int = 1) -> Column:
    """Eight hex digits of md5(value) from ``offset`` (1-based) as an unsigned number."""
    return F.conv(F.substring(md5_hex(value), offset, 8), 16, 10).cast("long")


def shard_of(value: Column, shards: int) -> Column:
    return hash32(value) % F.lit(shards)


def plane_sign(table: Column, dim: Column) -> Column:
    """+1 or -1 for component ``dim`` of hyperplane ``table``."""
    digit = hash32(F.concat_ws(":", table.cast("string"), dim.cast("string")))
    return F.when(digit % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
