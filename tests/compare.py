"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def compare(spark, con, sf_dir, name, query, sql):
    started = time.time()
    frame = query(spark, sf_dir)
    got_columns, got = rows_of(frame.columns, frame.collect())
    took = time.time() - started
    if sql is None:
        return f"rows-only {len(got)}", took, None, bool(got)
    started = time.time()
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    duck_took = time.time() - started
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    odd = [
        f"{c}: {t} / {kinds.get(c)}" for c, t in frame.dtypes if KINDS.get(t, kinds.get(c)) != kinds.get(c) and c in kinds
    ]
    if got_columns != want_columns:
        return f"COLUMNS {got_columns} / {want_columns}", took, duck_took, False
    if got != want:
        only_got = sorted(set(got) - set(want), key=repr)[:3]
        only_want = sorted(set(want) - set(got), key=repr)[:3]
        return f"DIFFER {len(got)} / {len(want)} rows; spark {only_got}; sql {only_want}", took, duck_took, False
    return f"equal {len(got)}" + (f"  TYPES {odd}" if odd else ""), took, duck_took, bool(got)


def main() -> int:
    import __spark_entry__ as entry
    from nearfield.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("compare", 8)
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            text, took, duck_took, fine = compare(spark, con, sf_dir, name, query, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            text, took, duck_took, fine = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, None, False
        bad += not fine
        print(f"{'ok ' if fine else 'BAD'} {name:28s} {took:6.2f}s {'' if duck_took is None else f'{duck_took:6.2f}s'} {text}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
