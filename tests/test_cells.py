"""Routed search, joins by distance and leaders against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import brute_top_k, cosine, hits_of, l2, random_rows, same_hits, vectors
from nearfield.operators import cells as C
from nearfield.operators import ivf
from nearfield.operators import metric_join as J
from nearfield.operators import sharding as S


def nearest(centers, v, n):
    return [c for _, c in sorted((l2(v, x), c) for c, x in centers)[:n]]


def plain_routed(queries, rows, centers, k, nprobe):
    home = {i: nearest(centers, v, 1)[0] for i, v in rows if v is not None}
    out = {}
    for q, qv in queries:
        probed = nearest(centers, qv, nprobe)
        own = [(i, v) for i, v in rows if v is not None and home[i] in probed]
        out |= brute_top_k([(q, qv)], own, k, lambda a, b: 1 + cosine(a, b))
    return out


@pytest.fixture
def searched(spark):
    rows = [*random_rows(300, 8, 1), (1000, None)]
    centers = random_rows(7, 8, 2)
    queries = random_rows(40, 8, 3)
    frames = vectors(spark, rows), vectors(spark, centers, "cell"), vectors(spark, queries, "query_id", "q")
    return rows, centers, queries, frames


@pytest.mark.parametrize("rows_part,queries_part", [(65_536, 16_384), (20, 3)])
def test_routed_search_finds_what_the_cells_hold(searched, monkeypatch, rows_part, queries_part):
    monkeypatch.setattr(C, "ROWS_PART", rows_part)
    monkeypatch.setattr(C, "QUERIES_PART", queries_part)
    rows, centers, queries, (corpus, means, asked) = searched
    index = ivf.ivf_build(corpus, means)
    for nprobe in (1, 3, 9):
        got = hits_of(ivf.ivf_search_routed(asked, index, means, 5, nprobe))
        same_hits(got, plain_routed(queries, rows, centers, 5, nprobe))


def test_more_queries_than_may_travel_are_routed(searched, monkeypatch):
    rows, centers, queries, (corpus, means, asked) = searched
    monkeypatch.setattr(ivf, "counted", lambda df: None)
    got = ivf.ivf_search(asked, ivf.ivf_build(corpus, means), means, 5, 2)
    same_hits(hits_of(got), plain_routed(queries, rows, centers, 5, 2))


def test_rows_moved_grow_with_probes_and_not_with_queries(searched):
    """No block of rows is copied for blocks of queries: what is shuffled is each probed row once and each query once a probe."""
    _, _, _, (corpus, means, asked) = searched
    index = ivf.ivf_build(corpus, means)
    for nprobe in (1, 2):
        many = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).select((F.col("query_id") * 10 + F.col("copy")).alias("query_id"), "q")
        probed = ivf.nearest_cells(many, means, nprobe)
        assert probed.count() == 400 * nprobe
        plan = ivf.ivf_search_routed(many, index, means, 5, nprobe)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert plan.count("RoundRobinPartitioning") == 0


def test_all_rows_in_one_cell_and_nobody_asks(spark):
    rows = random_rows(50, 4, 4)
    means = vectors(spark, [(3, np.zeros(4)), (9, np.full(4, 100.0))], "cell")
    index = ivf.ivf_build(vectors(spark, rows), means)
    none = vectors(spark, [(1, np.full(4, 99.0))], "query_id", "q")
    assert ivf.ivf_search_routed(none, index, means, 5, 1).count() == 0
    assert ivf.ivf_search_routed(none.limit(0), index, means, 5, 1).count() == 0
    assert ivf.ivf_search_routed(none, index.limit(0), means, 5, 2).count() == 0


@pytest.mark.parametrize("bound", [65536, 1])
def test_assign_keeps_rows_without_vector_and_rows_that_repeat_an_id(spark, monkeypatch, bound):
    monkeypatch.setattr(ivf, "CENTROIDS", bound)
    rows = vectors(spark, [(1, [0.0, 0.0]), (2, None), (3, [9.0, 9.0]), (1, [9.0, 8.0])])
    means = vectors(spark, [(5, [0.0, 0.0]), (6, [9.0, 9.0])], "cell")
    got = sorted((r["id"], r["cell"] or 0, r["cell_distance"]) for r in ivf.assign(rows, means).collect())
    assert got == [(1, 5, 0.0), (1, 6, 1.0), (2, 0, None), (3, 6, 0.0)]


def test_saved_cells_are_cut_by_their_size(spark, tmp_path):
    rows = vectors(spark, [(i, [0.0 if i < 90 else 9.0]) for i in range(100)])
    means = vectors(spark, [(0, [0.0]), (1, [9.0])], "cell")
    ivf.save_ivf(ivf.ivf_build(rows, means), means, str(tmp_path / "ivf"), "l2", rows_per_file=10)
    files = {c: len(list((tmp_path / "ivf" / "cells" / f"cell={c}").glob("*.parquet"))) for c in (0, 1)}
    assert files[1] == 1 and files[0] > 3
    index, _, about = ivf.load_ivf(spark, str(tmp_path / "ivf"))
    assert index.count() == 100 and about["n"] == 100


@pytest.mark.parametrize("metric,radius", [("l2", 2.0), ("l1", 4.0), ("l2", 0.0), ("l2", 100.0)])
@pytest.mark.parametrize("pivots", [1, 12])
def test_distance_join_equals_all_pairs(spark, monkeypatch, metric, radius, pivots):
    monkeypatch.setattr(C, "ROWS_PART", 30)
    monkeypatch.setattr(C, "QUERIES_PART", 11)
    left, right = [*random_rows(60, 4, 5), (900, None)], [*random_rows(120, 4, 6, 1000), (2000, None)]
    right.append((3000, left[0][1]))  # an equal vector
    gap = l2 if metric == "l2" else lambda a, b: float(np.abs(np.asarray(a) - np.asarray(b)).sum())
    want = {(a, b) for a, x in left for b, y in right if x is not None and y is not None and gap(x, y) <= radius}
    got = [(r["query_id"], r["id"]) for r in J.distance_join(vectors(spark, left), vectors(spark, right), radius, metric, pivots=pivots).collect()]
    assert len(got) == len({*got}) and {*got} == want and (0, 3000) in want


def test_cells_out_of_reach_are_not_asked(spark):
    """Tight groups far apart: a point is copied to the cell of its own group only."""
    rng = np.random.default_rng(1)
    rows = [(g * 100 + i, 50 * np.eye(6)[g] + rng.normal(size=6) * 0.01) for g in range(6) for i in range(100)]
    df = vectors(spark, rows)
    _, pivots = J.choose_pivots(df, 0.5, pivots=60)
    copies = J.within_reach(df, pivots, 0.5)
    cells = {r["id"]: set(r["c"]) for r in copies.groupBy("id").agg(F.collect_set("cell").alias("c")).collect()}
    home = {int(c): int(np.argmax(v)) for c, v in zip(pivots.cells, pivots.vectors)}
    assert all({home[c] for c in own} == {i // 100} for i, own in cells.items())
    assert J.distance_join(df, df, 0.5, only="earlier").count() == 6 * 100 * 99 // 2


def test_partners_are_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PART", 30)
    left, right = random_rows(60, 4, 5), random_rows(120, 4, 6, 1000)
    want = {}
    for a, x in left:
        near = sorted((l2(x, y), b) for b, y in right if l2(x, y) <= 1.7)
        if near:
            want[a] = (len(near), min(b for _, b in near), near[0][0])
    got = {r["id"]: (r["n_links"], r["lowest"], r["nearest"]) for r in J.count_within(vectors(spark, left), vectors(spark, right), 1.7, pivots=5).collect()}
    assert got.keys() == want.keys() and all(got[a][:2] == want[a][:2] and abs(got[a][2] - want[a][2]) < 1e-9 for a in want)


def test_pivots_that_rule_nothing_out_are_taken_away():
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(1200, 64))
    assert J._useful(wide[:200], wide[200:], 9.0, "l2") == J.COPIES
    flat = rng.uniform(size=(1200, 2)) * 100
    assert J._useful(flat[:200], flat[200:], 0.5, "l2") == 200


def test_metrics_without_triangles_are_refused(spark):
    with pytest.raises(ValueError, match="triangle"):
        J.distance_join(vectors(spark, random_rows(3, 2, 1)), vectors(spark, random_rows(3, 2, 1)), 1.0, "cosine")


def plain_leaders(rows, dist):
    out = []
    for i, v in sorted(rows, key=lambda r: r[0]):
        if v is not None and all(l2(v, w) > dist for _, w in out):
            out.append((i, v))
    return out


@pytest.mark.parametrize("head", [16, 4096])
def test_leaders_are_those_of_one_point_at_a_time(spark, head):
    rows = [*random_rows(150, 3, 7), (777, None), (888, random_rows(1, 3, 7)[0][1])]
    want = [i for i, _ in plain_leaders(rows, 1.0)]
    df = vectors(spark, rows)
    assert sorted(r["id"] for r in J.leaders(df, 1.0, head=head, pivots=6).collect()) == want
    assert sorted(r["id"] for r in J.leaders(df, 1.0, 5, head=head, pivots=6).collect()) == want[:5]
    assert J.leaders(df.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("m", [None, 6])
def test_shards_by_leaders(spark, m):
    rows = [*random_rows(120, 3, 9), (777, None)]
    led = plain_leaders(rows, 1.0)[:m]
    want = set()
    for i, v in rows:
        if v is None:
            want.add((i, None, None, None))
            continue
        first = next((n for n, (_, w) in enumerate(led) if l2(v, w) <= 1.0), None)
        place = min(range(len(led)), key=lambda n: (l2(v, led[n][1]), n)) if first is None else first
        want.add((i, place, led[place][0], first is None))
    got = [tuple(r) for r in S.shard_by_leaders(vectors(spark, rows), 1.0, m, head=32, pivots=5).collect()]
    assert len(got) == len(rows) and {*got} == want
