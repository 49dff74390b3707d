import hashlib
import heapq

import numpy as np
import pytest
from helpers import brute_top_k, cosine, hits_of, l2, random_rows, same_hits, vectors
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.operators import blocks, graph, ivf, lsh, sharding
from nearfield.operators.embedding import HashEmbedder, TextEmbedder, embed, hash_embed, index_size, mean_pool, reduce_dims, unit_export
from nearfield.operators.exact import search_exact, within_distance

ROWS = random_rows(80, 6, 11)
ASKED = random_rows(7, 6, 12, start=500)


@pytest.fixture(scope="module")
def frames(spark):
    return vectors(spark, ASKED, "query_id", "q"), vectors(spark, ROWS).repartition(4)


def centers_of(spark, n):
    return vectors(spark, random_rows(n, 6, 13), "cell")


def test_assign_picks_the_nearest(spark, frames, monkeypatch):
    cells = centers_of(spark, 5)
    table = dict(random_rows(5, 6, 13))
    want = {i: min((l2(v, c), cell) for cell, c in table.items())[1] for i, v in ROWS}
    for limit in (blocks.BROADCAST_ROWS, 2):  # the second goes through the block grid
        monkeypatch.setattr(ivf, "CENTROIDS", limit)
        got = {r["id"]: r["cell"] for r in ivf.assign(frames[1], cells).collect()}
        assert got == want


def test_all_cells_probed_is_exact(spark, frames):
    queries, corpus = frames
    centers = ivf.kmeans_centroids(corpus, 4)
    index = ivf.ivf_build(corpus, centers)
    same_hits(hits_of(ivf.ivf_search(queries, index, centers, 5, nprobe=4)), hits_of(search_exact(queries, corpus, 5)))
    one_cell = hits_of(ivf.ivf_search(queries, index, centers, 5, nprobe=1))
    cell_of = {r["id"]: r["cell"] for r in index.collect()}
    for hits in one_cell.values():
        assert len({cell_of[i] for i, _ in hits}) == 1
    assert sum(r["n"] for r in ivf.cell_sizes(index).collect()) == len(ROWS)


def test_ivf_guards(spark, frames):
    queries, corpus = frames
    centers = centers_of(spark, 3)
    with pytest.raises(ValueError, match="must exceed k"):
        ivf.ivf_search(queries, ivf.ivf_build(corpus, centers), centers, 10, 1, expected_candidates=10)
    with pytest.raises(ValueError, match="nprobe"):
        ivf.ivf_search(queries, ivf.ivf_build(corpus, centers), centers, 10, 0)


def test_saved_index_prunes_partitions(spark, frames, tmp_path):
    queries, corpus = frames
    centers = centers_of(spark, 4)
    index = ivf.ivf_build(corpus, centers)
    path = str(tmp_path / "ivf")
    ivf.save_ivf(index, centers, path, "l2")
    stored, stored_centers, about = ivf.load_ivf(spark, path)
    assert about == {"n": len(ROWS), "dims": 6, "metric": "l2"}
    hits = ivf.ivf_search(queries.limit(1), stored, stored_centers, 3, nprobe=1)
    assert "PartitionFilters: [isnotnull(cell" in hits._jdf.queryExecution().executedPlan().toString()
    same_hits(hits_of(hits), hits_of(ivf.ivf_search(queries.limit(1), index, centers, 3, nprobe=1)))


def test_vector_means_with_a_heavy_key(spark, monkeypatch):
    rows = random_rows(300, 3, 3)
    key = lambda i: 0 if i < 200 else i % 40
    frame = vectors(spark, rows).withColumn("k", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 40)).repartition(6)
    for held in (4096, 3):
        monkeypatch.setattr(blocks, "OPEN_KEYS", held)
        got = {r["key"]: (r["weight"], r["vector"]) for r in blocks.vector_means(frame, "k").collect()}
        for k in {key(i) for i, _ in rows}:
            mine = [v for i, v in rows if key(i) == k]
            assert got[k][0] == len(mine) and np.allclose(got[k][1], np.mean(mine, axis=0))


def plain_code(v, tables, bits):
    signs = []
    for t in range(tables * bits):
        w = [1 if int(hashlib.md5(f"{t}:{d}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1 for d in range(len(v))]
        signs.append(int(round(float(np.dot(v, w)), 9) >= 0))
    return [int("".join(map(str, signs[t * bits : (t + 1) * bits])), 2) for t in range(tables)]


def test_lsh_codes_candidates_and_rerank(spark, frames):
    queries, corpus = frames
    coded = {r["id"]: r["codes"] for r in lsh.lsh_codes(corpus, 6, 9, 2).collect()}
    assert coded == {i: plain_code(v, 9, 2) for i, v in ROWS}
    got = hits_of(lsh.lsh_search(queries, corpus, 6, k=3, candidates=8, tables=20))
    rows = dict(ROWS)
    for q, v in ASKED:
        mine = plain_code(v, 20, 1)
        matches = {i: sum(a == b for a, b in zip(mine, plain_code(r, 20, 1))) for i, r in ROWS}
        chosen = sorted(matches, key=lambda i: (-matches[i], i))[:8]
        want = sorted(((i, 1 + cosine(v, rows[i])) for i in chosen), key=lambda p: (-p[1], p[0]))[:3]
        assert [i for i, _ in got[q]] == [i for i, _ in want]


def test_bucket_join_counts_shared_buckets(spark, frames):
    queries, corpus = frames
    got = lsh.bucket_matches(
        lsh.lsh_buckets(lsh.lsh_codes(queries, 6, 5, 3, vec="q"), id="query_id"), lsh.lsh_buckets(lsh.lsh_codes(corpus, 6, 5, 3))
    ).collect()
    want = {}
    for q, v in ASKED:
        for i, r in ROWS:
            n = sum(a == b for a, b in zip(plain_code(v, 5, 3), plain_code(r, 5, 3)))
            if n:
                want[q, i] = n
    assert {(r["query_id"], r["id"]): r["matches"] for r in got} == want


# --- distances, shards ---------------------------------------------------------------


def test_median_and_range(spark, frames):
    queries, corpus = frames
    sample = [v for _, v in sorted(ROWS)[:30]]
    every = [l2(a, b) for a in sample for b in sample]
    row = sharding.median_distance(corpus, 30).first()
    assert row["pairs"] == 900 and abs(row["median_distance"] - float(np.median(every))) < 1e-12
    assert within_distance(queries, corpus, 0.0).count() == 0


def plain_shards(rows, dist, m):
    leaders = []
    for i, v in sorted(rows):
        if len(leaders) < m and not any(l2(v, u) <= dist for _, u in leaders):
            leaders.append((i, v))
    out = {}
    for i, v in rows:
        near = [n for n, (_, u) in enumerate(leaders) if l2(v, u) <= dist]
        n = near[0] if near else min((l2(v, u), n) for n, (_, u) in enumerate(leaders))[1]
        out[i] = (n, leaders[n][0], not near)
    return out


@pytest.mark.parametrize("dist, m, probe", [(2.5, 1000, 512), (2.5, 1000, 3), (2.5, 4, 3), (0.0, 1000, 7), (99.0, 5, 512), (2.5, 1, 1)])
def test_shards_equal_one_leader_at_a_time(spark, frames, dist, m, probe):
    got = sharding.shard_by_distance(frames[1], dist, m, probe).collect()
    assert {r["id"]: (r["shard_id"], r["leader"], r["overflow"]) for r in got} == plain_shards(ROWS, dist, m)


def test_shard_boundary_is_inside(spark):
    points = vectors(spark, [(1, [0.0]), (2, [2.0]), (3, [2.0000001])])
    assert {r["id"]: r["leader"] for r in sharding.shard_by_distance(points, 2.0).collect()} == {1: 1, 2: 1, 3: 3}


# --- graph ---------------------------------------------------------------------------------


def plain_edges(rows, k):
    edges = set()
    for i, v in rows:
        for _, j in heapq.nsmallest(k, ((l2(v, u), j) for j, u in rows if j < i)):
            edges |= {(i, j), (j, i)}
    return edges


def test_graph_build_degrees_and_paths(spark, frames):
    edges = graph.knn_graph(frames[1], 2)
    want = plain_edges(ROWS, 2)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want
    degree = {}
    for a, _ in want:
        degree[a] = degree.get(a, 0) + 1
    ranks = {r["degree"]: (r["nodes"], r["rank"]) for r in graph.degree_rank(edges).collect()}
    for d, (n, rank) in ranks.items():
        assert n == sum(x == d for x in degree.values()) and rank == sum(x >= d for x in degree.values())
    centers = centers_of(spark, 3)
    assert {(r[0], r[1]) for r in graph.knn_graph(frames[1], 2, centroids=centers, nprobe=3).collect()} == want

    hops = {}
    near = {}
    for a, b in want:
        near.setdefault(a, set()).add(b)
    for s, _ in ROWS:
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [b for b in {b for a in front for b in near[a]} if b not in seen]
            seen.update({b: d for b in front})
        hops[s] = seen
    lengths = [d for seen in hops.values() for d in seen.values() if d]
    row = graph.average_path(frames[1].select("id"), edges).first()
    assert (row["pairs"], row["longest"], row["unreached"]) == (len(lengths), max(lengths), 80 * 79 - len(lengths))
    assert abs(row["average_path"] - sum(lengths) / len(lengths)) < 1e-12


def test_two_components_and_a_single_node(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    row = graph.average_path(nodes, edges).first()
    assert (row["average_path"], row["pairs"], row["unreached"]) == (1.0, 2, 4)
    assert graph.knn_graph(vectors(spark, [(1, [0.0])])).count() == 0


def test_wide_graph_search_is_exact(spark, frames):
    queries, corpus = frames
    edges = graph.knn_graph(corpus, 5).persist()
    want = brute_top_k(ASKED, ROWS, 3, l2, 1)
    got = hits_of(graph.graph_search(queries, corpus, edges, k=3, m=3, beam=80), "distance")
    same_hits(got, want)
    narrow = hits_of(graph.graph_search(queries, corpus, edges, k=3, m=3), "distance")
    found = sum(len({i for i, _ in narrow[q]} & {i for i, _ in want[q]}) for q, _ in ASKED)
    assert found / (3 * len(ASKED)) > 0.5
    edges.unpersist()


# --- embedding ---------------------------------------------------------------------------------


def plain_hash(text, dims):
    out = np.zeros(dims)
    for w in text.split():
        h = hashlib.md5(w.encode()).hexdigest()
        out[int(h[:8], 16) % dims] += 1 if int(h[8:16], 16) % 2 == 0 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


def test_hash_embedding(spark):
    texts = ["Hello, world! hello", "", "a b c", None, "..."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r["id"]: r["vector"] for r in hash_embed(df, "t", 8).collect()}
    for i, t in enumerate(["hello world hello", "", "a b c", "", ""]):
        assert np.allclose(got[i], plain_hash(t, 8))
    payload = hash_embed(df, "t", 8, target="payload").where("id = 1").first()["vector"]
    assert payload.startswith("0|0.0 1|0.0")
    with pytest.raises(ValueError, match="unknown target"):
        embed(df, "t", HashEmbedder, target="somewhere")
    lengths = embed(df.na.fill(""), "t", lambda: TextEmbedder(lambda ts: np.array([[len(t)] for t in ts])))
    assert {r["id"]: r["vector"] for r in lengths.collect()}[2] == [5.0]


def test_mean_pool(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vec array<double>")
    docs = spark.createDataFrame([(1, "A a b x"), (2, "x")], "id long, text string")
    rows = mean_pool(docs, "id", "text", table).collect()
    assert len(rows) == 1 and np.allclose(rows[0]["vector"], [2 / 3, 1 / 3])


def test_reductions_and_sizes(spark, frames):
    corpus = frames[1]
    signs = np.array([[1 if int(hashlib.md5(f"{j}:{i}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1 for j in range(3)] for i in range(6)])
    got = {r["id"]: r["reduced"] for r in reduce_dims(corpus, "vector", 3, 6).collect()}
    for i, v in ROWS:
        assert np.allclose(got[i], v @ signs / np.sqrt(3))
    assert {len(r["reduced"]) for r in reduce_dims(corpus, "vector", 2, 6, "pca").collect()} == {2}
    with pytest.raises(ValueError, match="unknown method"):
        reduce_dims(corpus, "vector", 2, 6, "tsne")
    row = index_size(corpus).first()
    assert row["vectors"] == 80 and row["dims"] == 6 and abs(row["index_bytes"] - 1.1 * (24 + 128) * 80) < 1e-6
    unit = unit_export(vectors(spark, [(7, [3.0, 4.0])])).first()
    assert unit["id"] == "7" and np.allclose(unit["vector"], [0.6, 0.8])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=30), st.integers(1, 6), st.integers(1, 5))
def test_running_best_equals_sorting(points, k, step):
    """Any cut of the rows into blocks keeps the same k best."""
    c = np.array(points, float)
    q = blocks.Block(np.array([0, 1]), np.array([[1.0, 0.5], [0.0, -1.0]]))
    best = blocks.TopK(k, blocks.METRICS["dot"])
    for start in range(0, len(c), step):
        part = c[start : start + step]
        list(best.add(0, q, np.arange(start, start + len(part)), q.vectors @ part.T))
    got = {}
    for batch in best.rest([q]):
        for row in batch.to_pylist():
            got.setdefault(row["query_id"], []).append((row["value"], row["id"]))
    for i, v in enumerate(q.vectors):
        want = sorted(((float(v @ p), j) for j, p in enumerate(c)), key=lambda x: (-x[0], x[1]))[:k]
        assert [j for _, j in sorted(got[i], key=lambda x: (-x[0], x[1]))] == [j for _, j in want]


def test_mean_pool_of_words_that_travel_and_others(spark, monkeypatch):
    from nearfield.operators import embedding

    texts = [(1, "a a b c"), (2, "b c c x"), (3, "x y"), (4, None), (5, ""), (1, "d a"), (6, "a b twice none " * 5)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    given = [("a", [1.0, 2.0]), ("b", [3.0, -1.0]), ("c", [0.5, 0.25]), ("d", [8.0, 1.0]), ("twice", [1.0, 1.0]), ("twice", [2.0, 0.0]), ("none", None)]
    table = spark.createDataFrame(given, "token string, vec array<double>")
    want = {}
    for i in {i for i, _ in texts}:
        held = [v for j, text in texts if j == i and text for w in text.split() for t, v in given if t == w and v]
        want[i] = np.mean(held, axis=0).tolist() if held else None
    for hot in (0, 1, 2, 100):
        monkeypatch.setattr(embedding, "HOT", hot)
        got = {r["id"]: r["vector"] for r in mean_pool(docs, "id", "text", table, keep=True).collect()}
        assert got.keys() == want.keys()
        assert all((got[i] is None) == (want[i] is None) and np.allclose(got[i] or [], want[i] or []) for i in want)
    assert embedding.hot_vectors(docs, "text", table).column("token").to_pylist().count("twice") == 0
    monkeypatch.setattr(embedding, "SAMPLED", 1)
    got = {r["id"]: r["vector"] for r in mean_pool(docs, "id", "text", table).collect()}
    assert {i for i in want if want[i]} == got.keys() and all(np.allclose(got[i], want[i]) for i in got)
