"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from nearfield.session import ship_package

MODULES = (
    "vector_search",
    "text_search",
    "ann_search",
    "diversification",
    "monitoring",
    "storage",
)

Query = Callable[[SparkSession, str], DataFrame]


def _shipping(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for _name in MODULES:
    _module = import_module(f"nearfield.plans.{_name}")
    QUERIES.update({name: _shipping(query) for name, query in _module.QUERIES.items()})
    ORACLES.update(_module.ORACLES)
