"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from nearfield.session import ship_package

MODULES = ("simhash", "decontaminate", "language", "mixing", "syncmers", "packing", "crossentropy", "toxicity", "lines", "htmltext", "merkle", "variants", "privacy")


def _shipping(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {}
ORACLES: dict[str, str] = {}

for _name in MODULES:
    _module = import_module(f"nearfield.llm.{_name}")
    QUERIES.update({name: _shipping(query) for name, query in _module.QUERIES.items()})
    ORACLES.update(getattr(_module, "ORACLES", {}))
