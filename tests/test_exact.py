import re

import numpy as np
import pytest
from helpers import brute_top_k, cosine, hits_of, l2, random_rows, same_hits, vectors
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import blocks, exact, topk
from nearfield.operators.evaluation import overlap, recall_at_k, scaling

ROWS = random_rows(60, 7, 1)
ASKED = random_rows(9, 7, 2, start=1000)


def frames(spark, rows=ROWS, asked=ASKED):
    return vectors(spark, asked, "query_id", "q"), vectors(spark, rows).repartition(5)


@pytest.mark.parametrize(
    "score, f, column",
    [
        ("cosine1p", lambda a, b: 1 + cosine(a, b), "_score"),
        ("dot", lambda a, b: float(a @ b), "_score"),
        ("sigmoid_dot", lambda a, b: 1 / (1 + np.exp(-(a @ b))), "_score"),
        ("l2", l2, "distance"),
        ("l1", lambda a, b: float(np.abs(a - b).sum()), "distance"),
        ("l2sq", lambda a, b: l2(a, b) ** 2, "distance"),
        ("cosine", lambda a, b: 1 - cosine(a, b), "distance"),
        ("ip", lambda a, b: 1 - float(a @ b), "distance"),
    ],
)
def test_every_metric_against_brute_force(spark, score, f, column):
    queries, corpus = frames(spark)
    got = hits_of(exact.search_exact(queries, corpus, 4, score), column)
    same_hits(got, brute_top_k(ASKED, ROWS, 4, f, 1 if column == "distance" else -1))


def test_grid_plan_equals_broadcast_plan(spark, monkeypatch):
    queries, corpus = frames(spark)
    want = hits_of(exact.search_exact(queries, corpus, 5))
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 4)
    monkeypatch.setattr(blocks, "CORPUS_BLOCK", 16)
    got = hits_of(exact.search_exact(queries, corpus, 5, broadcast_rows=3))
    same_hits(got, want)
    near = exact.within_distance(queries, corpus, 3.0, broadcast_rows=3).collect()
    assert {(r[0], r[1]) for r in near} == {(q, i) for q, a in ASKED for i, b in ROWS if l2(a, b) <= 3.0}


def test_small_blocks_keep_the_best(spark, monkeypatch):
    queries, corpus = frames(spark)
    want = hits_of(exact.search_exact(queries, corpus, 5))
    monkeypatch.setattr(blocks, "CELLS", 8)
    same_hits(hits_of(exact.search_exact(queries, corpus, 5)), want)


def test_edges_of_top_k(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0]), (6, [float("nan"), 1.0])]
    queries, corpus = frames(spark, rows, [(9, [2.0, 0.0])])
    got = hits_of(exact.search_exact(queries, corpus, 10))
    assert got == {9: [(1, 2.0), (5, 2.0), (2, 0.0)]}  # ties by id, k past the end, no zero, null or NaN vectors
    assert hits_of(exact.search_exact(queries, corpus, 0)) == {}
    assert hits_of(exact.search_exact(queries, corpus.where("id < 0"), 3)) == {}
    assert hits_of(exact.search_exact(queries.where("query_id < 0"), corpus, 3)) == {}


def test_many_equal_rows_keep_the_lowest_ids(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500, 0, -1)]
    queries, corpus = frames(spark, rows, [(0, [1.0, 0.5])])
    assert [i for i, _ in hits_of(exact.search_exact(queries, corpus, 7))[0]] == list(range(1, 8))


def test_wrong_dimensions_fail(spark):
    queries, corpus = frames(spark, [(1, [1.0, 2.0, 3.0])], [(0, [1.0, 2.0])])
    with pytest.raises(Exception, match="dimensions"):
        exact.search_exact(queries, corpus, 1).collect()
    with pytest.raises(ValueError, match="unknown metric"):
        exact.search_exact(queries, corpus, 1, "manhattan")


def test_filter_comes_before_scoring(spark, tmp_path):
    path = str(tmp_path / "rows")
    vectors(spark, ROWS).withColumn("kind", F.col("id") % 3).write.parquet(path)
    queries = vectors(spark, ASKED, "query_id", "q")
    out = exact.search_exact(queries, spark.read.parquet(path), 3, where=F.col("kind") == 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,1)]" in plan
    same_hits(hits_of(out), brute_top_k(ASKED, [r for r in ROWS if r[0] % 3 == 1], 3, lambda a, b: 1 + cosine(a, b)))


def test_sharded_search_with_k_per_shard(spark):
    queries, corpus = frames(spark)
    want = brute_top_k(ASKED, ROWS, 10, lambda a, b: 1 + cosine(a, b))
    same_hits(hits_of(exact.search_sharded(queries, corpus, k=10, size=10, shards=3)), want)
    few = hits_of(exact.search_sharded(queries, corpus, k=1, size=10, shards=3))
    assert all(len(hits) == 3 for hits in few.values())


def test_column_expressions(spark):
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, -3.0])], "a array<double>, z array<double>, b array<double>")
    a, z, b = F.col("a"), F.col("z"), F.col("b")
    row = one.select(
        V.l2_normalise(a), V.l2_normalise(z), V.cosine(a, b), V.cosine(a, z), V.dot(a, b), V.distance(a, b, "l1"),
        V.distance(a, b, "l2sq"), V.query_vector(F.array(F.lit(1.0), F.lit(3.0))), V.sigmoid(F.lit(0.0)),
    ).first()
    assert row[0] == [0.6, 0.8] and row[1] == [0.0, 0.0]
    assert row[2] == 0.0 and row[3] is None and row[4] == 0.0 and row[5] == 8.0 and row[6] == 50.0
    assert row[7] == [round(x / 10**0.5, 10) for x in (1.0, 3.0)] and row[8] == 0.5


def test_codecs(spark):
    texts = ["0|0.5 1|-2.0 2|1e-05", "2|1.0E-5 0|0.5 1|-2.0", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(V.from_payload(F.col("t"))).collect()
    assert [r[0] for r in rows] == [[0.5, -2.0, 1e-05], [0.5, -2.0, 1e-05], []]
    v = [1.0, -2.5e-7, 3e8]
    row = spark.createDataFrame([(v,)], "v array<double>").select(
        V.from_payload(V.to_payload(F.col("v"))), V.from_csv(V.to_csv(F.col("v"))), V.to_payload(F.col("v"))
    ).first()
    assert row[0] == v and row[1] == v and row[2].startswith("0|1.0 1|")
    m = spark.createDataFrame([("foo|1.4 bar|2",)], "t string").select(V.payload_map(F.col("t"))).first()[0]
    assert m == {"foo": 1.4, "bar": 2.0}


def test_hamming_of_signs(spark):
    a, b = np.random.default_rng(5).normal(size=(2, 70))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    got = df.select(V.distance(V.sign_bits(F.col("a"), 70), V.sign_bits(F.col("b"), 70), "hamming")).first()[0]
    assert got == int(((a > 0) != (b > 0)).sum())


def test_paging_totals_and_previews(spark):
    df = spark.range(1, 8).withColumn("query_id", F.lit(1).cast("long"))
    first = topk.page(df, 3)
    assert [r["id"] for r in first.collect()] == [1, 2, 3]
    cursor = topk.next_cursor(first).first()[0]
    assert [r["id"] for r in topk.page(df, 3, cursor).collect()] == [4, 5, 6]
    hits = df.limit(0).withColumn("rank", F.lit(1).cast("long")).withColumn("_score", F.lit(1.0))
    assert topk.with_total(hits, df).count() == 0
    some = df.where("id < 3").withColumn("rank", F.col("id")).withColumn("_score", 1.0 / F.col("id"))
    assert {r["numfound"] for r in topk.with_total(some, df).collect()} == {7}
    assert {r["numfound"] for r in topk.with_total(some, df, cap=5).collect()} == {5}
    assert topk.preview(some, rows=1, columns=2).columns == some.columns[:2]
    assert [r["id"] for r in topk.global_sort(some, limit=1).collect()] == [1]


def test_top_k_limits_before_the_shuffle(spark):
    scored = spark.range(1000).select((F.col("id") % 2).alias("query_id"), "id", (F.col("id") * 1.0).alias("_score"))
    plan = topk.top_k(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_recall_overlap_and_scaling(spark):
    hit = lambda rows: spark.createDataFrame(rows, "query_id long, rank long, id long")
    exact_hits, approx = hit([(1, 1, 5), (1, 2, 6), (2, 1, 7)]), hit([(1, 1, 6), (1, 2, 9)])
    assert dict(recall_at_k(approx, exact_hits, 2).collect()) == {1: 0.5, 2: 0.0}
    assert {r["query_id"]: (r["common"], r["either"]) for r in overlap(exact_hits, approx).collect()} == {1: (1, 3), 2: (0, 1)}
    queries, corpus = frames(spark)
    sizes = {}
    for r in scaling(queries, corpus, [10, 40], k=3).collect():
        sizes.setdefault(r["size"], {}).setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for size, got in sizes.items():
        want = brute_top_k(ASKED, ROWS[:size], 3, lambda a, b: 1 + cosine(a, b))
        assert {q: [i for _, i in sorted(h)] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}


@pytest.mark.parametrize("only", [None, "others", "earlier"])
def test_estimated_distances_give_the_same_neighbours(only, monkeypatch):
    """Ties once rounded, copies, far off vectors and such without a number, against all differences computed; hardly any are."""
    rng = np.random.default_rng(11)
    rows = np.concatenate([rng.normal(size=(400, 9)), np.round(rng.normal(size=(300, 9))), 1e4 + rng.normal(size=(300, 9))])
    rows[[5, 700]] = rows[[6, 1]]
    rows[17, 3], rows[18, 2], rows[19] = np.nan, np.inf, 0
    ids = rng.permutation(5000)[: len(rows)]
    computed = []
    plain = blocks.METRICS["l2"]

    def found(vectors, digits, estimated):
        metric = blocks.Metric(lambda q, c: computed.append(q) or plain.score(q, c), ascending=True, euclidean=estimated)
        keeper, cells = blocks.TopK(4, metric), [blocks.Block(ids[at : at + 300], vectors[at : at + 300]) for at in range(0, len(ids), 300)]
        with np.errstate(all="ignore"):
            out = list(blocks._run(cells, blocks.Block(ids[::3], vectors[::3]), metric, keeper, digits, only))
        return sorted((r["query_id"], r["id"], r["value"]) for batch in out for r in batch.to_pylist())

    for vectors, large in ((rows, True), (np.nan_to_num(rows, posinf=2.0), False)):
        for digits in (None, 1, 6):
            want = found(vectors, digits, False)
            computed.clear()
            assert found(vectors, digits, True) == want and len(want) > 1000
            assert large or not computed


def test_grid_of_many_cells_widens_its_blocks(spark, monkeypatch):
    """Rows go to fewer blocks of queries than there are QUERY_BLOCKs, with the same neighbours."""
    queries, corpus = frames(spark)
    want = hits_of(exact.search_exact(queries, corpus, 5, "l2"), "distance")
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 1)
    monkeypatch.setattr(blocks, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(blocks, "GRID", 8)
    pairs = blocks.best_pairs(queries, corpus, 60, "l2", broadcast_rows=0)
    assert pairs.count() == 9 * 60
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"pmod\(xxhash64\(id#\d+L, 42\), 2\) as int\) AS qb", plan), plan  # two blocks of queries, not nine
    same_hits(hits_of(topk.top_k(pairs, 5, score="value", ascending=True), "value"), want)
