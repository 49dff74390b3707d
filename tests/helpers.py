"""Small frames and brute-force answers."""

from __future__ import annotations

import numpy as np


def vectors(spark, rows, id_name="id", vec_name="vector"):
    return spark.createDataFrame(
        [(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], f"{id_name} long, {vec_name} array<double>"
    )


def random_rows(n, dim, seed, start=0):
    values = np.random.default_rng(seed).normal(size=(n, dim))
    return [(start + i, v) for i, v in enumerate(values)]


def brute_top_k(queries, rows, k, score, best_first=-1):
    """{query: [(id, value)]} by sorting everything."""
    out = {}
    for q, qv in queries:
        scored = [(i, score(np.asarray(qv, float), np.asarray(v, float))) for i, v in rows if v is not None]
        scored = [(i, s) for i, s in scored if not np.isnan(s)]
        out[q] = sorted(scored, key=lambda p: (best_first * p[1], p[0]))[:k]
    return out


def cosine(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def l2(a, b):
    return float(np.linalg.norm(a - b))


def hits_of(frame, value="_score"):
    out = {}
    for row in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(row["query_id"], []).append((row["id"], row[value]))
    return out


def same_hits(got, want, tolerance=1e-9):
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {q: [i for i, _ in hits] for q, hits in want.items() if hits}
    for q, hits in got.items():
        assert np.allclose([s for _, s in hits], [s for _, s in want[q]], atol=tolerance)
