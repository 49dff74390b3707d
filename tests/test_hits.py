import numpy as np
import pytest
from helpers import cosine, l2, random_rows, vectors
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.operators import diversify as D
from nearfield.operators import ranking as R


def hit_frame(spark, lists):
    """{query: [(id, score, vector)]} in rank order."""
    rows = [
        (q, rank, i, float(s), [float(x) for x in v]) for q, hits in lists.items() for rank, (i, s, v) in enumerate(hits, 1)
    ]
    return spark.createDataFrame(rows, "query_id long, rank long, id long, _score double, vector array<double>")


def order_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


LISTS = {
    q: [(q * 100 + i, 2 - i * 0.05, v) for i, v in random_rows(n, 4, q)] for q, n in {1: 12, 2: 1, 3: 4, 4: 5}.items()
}


def naive_dpp(hits):
    """Maximise the determinant directly, one item after another."""
    s = np.array([h[1] for h in hits])
    sim = np.array([[cosine(np.array(a[2]), np.array(b[2])) for b in hits] for a in hits])
    kernel = s[:, None] * sim * s[None, :]
    chosen, last = [], 1.0
    while len(chosen) < len(hits):
        best = max(
            ((np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])]), -i) for i in range(len(hits)) if i not in chosen)
        )
        if chosen and best[0] / last < 1e-9:
            break
        chosen.append(-best[1])
        last = best[0]
    return [hits[i][0] for i in chosen]


def test_dpp_picks_like_the_determinant(spark):
    got = order_of(D.diversify(hit_frame(spark, LISTS), "dpp"))
    for q, hits in LISTS.items():
        assert got[q] == naive_dpp(hits)[: len(got[q])]
        assert len(got[q]) == min(len(hits), 4)  # four dimensions carry at most four independent items


def test_dpp_drops_copies_and_breaks_ties_by_position(spark):
    same = {1: [(9, 1.0, [1.0, 0.0]), (8, 1.0, [1.0, 0.0]), (7, 1.0, [0.0, 1.0])]}
    assert order_of(D.diversify(hit_frame(spark, same), "dpp")) == {1: [9, 7]}
    zero = {1: [(9, 0.0, [1.0, 0.0]), (8, 0.0, [1.0, 0.0])]}
    assert order_of(D.diversify(hit_frame(spark, zero), "dpp")) == {1: [9]}


def test_dpp_first_two_agree(spark):
    picks = {}
    for r in D.dpp_first_two(hit_frame(spark, LISTS)).collect():
        picks.setdefault(r["query_id"], {})[r["pick"]] = r["id"]
    full = order_of(D.diversify(hit_frame(spark, LISTS), "dpp"))
    for q, mine in picks.items():
        assert [mine[p] for p in sorted(mine)] == full[q][:2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 3), st.lists(st.floats(-2, 2), min_size=3, max_size=3)), min_size=1, max_size=8))
def test_dpp_order_is_distinct(items):
    order = D.dpp_order(np.array([s for s, _ in items]), np.array([v for _, v in items]))
    assert len(order) == len(set(order)) and 1 <= len(order) <= len(items)


def test_shuffle_is_a_repeatable_permutation(spark):
    frame = hit_frame(spark, LISTS)
    once, twice = order_of(D.diversify(frame, "random")), order_of(D.diversify(frame.repartition(7), "random"))
    assert once == twice
    assert {q: sorted(ids) for q, ids in once.items()} == {q: sorted(h[0] for h in hits) for q, hits in LISTS.items()}
    assert once[1] != [h[0] for h in LISTS[1]]


def test_kmeans_keeps_all_hits_with_clusters_adjacent(spark):
    far = {1: [(i, 2.0, [10.0 * (i % 2), float(i) / 100]) for i in range(10)]}
    got = order_of(D.diversify(hit_frame(spark, far), "kmeans"))[1]
    assert sorted(got) == list(range(10))
    assert got in ([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], [1, 3, 5, 7, 9, 0, 2, 4, 6, 8])
    assert order_of(D.diversify(hit_frame(spark, {1: LISTS[3]}), "kmeans"))[1] == [h[0] for h in LISTS[3]]


def test_unknown_method_and_old_index(spark):
    rows = D.diversify(hit_frame(spark, LISTS), "None").collect()
    assert all(r["old_index"] == r["rank"] - 1 for r in rows)


def test_long_lists_fail_instead_of_being_cut(spark, monkeypatch):
    monkeypatch.setattr(D, "LIST_LIMIT", 3)
    with pytest.raises(ValueError, match="centroids"):
        D.closest_to_centroids(hit_frame(spark, LISTS), hit_frame(spark, LISTS), n_centroids=4)


def test_multi_hot(spark):
    frame = hit_frame(spark, {1: LISTS[3]}).withColumn("cats", F.when(F.col("rank") == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c"))))
    got = {r["rank"]: r["vector"] for r in D.multi_hot(frame, "cats").collect()}
    assert got[1] == [1.0, 1.0, 0.0] and got[2] == [0.0, 0.0, 1.0]
    assert D.diversify(frame, "dpp", categorical="cats").count() == 2


def test_similarity_matrix(spark):
    got = {(r["i"], r["j"]): r["similarity"] for r in D.similarity_matrix(hit_frame(spark, {1: LISTS[4]})).collect()}
    assert len(got) == 25
    for (i, j), s in got.items():
        assert abs(s - cosine(np.array(LISTS[4][i][2]), np.array(LISTS[4][j][2]))) < 1e-12


def test_closest_members(spark):
    members, centers = random_rows(20, 3, 4), [(0, [0.0, 0, 0]), (1, [0.01, 0, 0]), (2, [5.0, 5, 5])]
    frame, cells = vectors(spark, members), vectors(spark, centers, "cell")
    taken, want = set(), {}
    for c, v in centers:
        d, i = min((l2(np.array(v), m), i) for i, m in members if i not in taken)
        taken.add(i)
        want[c] = i
    assert {r["cell"]: r["id"] for r in D.closest_to_centroids(frame, cells).collect()} == want
    free = {r["cell"]: r["id"] for r in D.closest_to_centroids(frame, cells, distinct=False).collect()}
    assert free[0] == free[1] == want[0]


# --- learning to rank ------------------------------------------------------------------


def test_feature_sets(spark, tmp_path):
    store = R.FeatureSets(spark, str(tmp_path / "features"))
    store.reset()
    store.create("movies", ["title", "body"])
    assert store.names("movies") == ["title", "body"]
    with pytest.raises(KeyError, match="books"):
        store.names("books")
    store.reset()
    with pytest.raises(KeyError):
        store.names("movies")


def logged(spark):
    features = spark.createDataFrame(
        [(1, 100, "title", 2.0), (1, 101, "body", 5.0), (1, 101, "other", 9.0), (2, 100, "title", 7.0)],
        "query_id long, id long, feature string, value double",
    )
    return R.log_features(hit_frame(spark, {1: LISTS[1]}), features, ["title", "body"])


def test_logged_features_default_to_zero(spark):
    got = {r["id"]: r["ltr_features"] for r in logged(spark).collect()}
    assert got[100] == [2.0, 0.0] and got[101] == [0.0, 5.0] and got[102] == [0.0, 0.0]
    only = spark.createDataFrame([(101,), (5,)], "id long")
    assert [r["id"] for r in R.log_features(hit_frame(spark, {1: LISTS[1]}), spark.createDataFrame([], "query_id long, id long, feature string, value double"), ["x"], ids=only).collect()] == [101]


def test_rescore_window(spark):
    out = R.rescore(logged(spark), ["title", "body"], {"body": 1.0, "title": -10.0}, window=3)
    rows = sorted(out.collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in rows] == [101, 102, 100] + [h[0] for h in LISTS[1][3:]]
    assert abs(rows[0]["_score"] - (1.95 + 5)) < 1e-12 and rows[3]["_score"] == pytest.approx(LISTS[1][3][1])


def test_window_of_a_thousand(spark):
    hits = spark.range(1, 1002).select(
        F.lit(1).cast("long").alias("query_id"), F.col("id").alias("rank"), "id", (2000.0 - F.col("id")).alias("_score"),
        F.array(F.col("id").cast("double") * 10).alias("ltr_features"),
    )
    rows = {r["rank"]: r["id"] for r in R.rescore(hits, ["f"], {"f": 1.0}).collect()}
    assert rows[1] == 1000 and rows[1000] == 1 and rows[1001] == 1001


def test_trained_model_orders_by_label(spark):
    rows = spark.range(40).select(
        F.lit(1).cast("long").alias("query_id"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("ltr_features"),
        (F.col("id") * 0.5).alias("label"),
    )
    for kind in ("linear", "trees"):
        model = R.train_ranker(rows, "label", kind=kind)
        got = {r["id"]: r["prediction"] for r in model.transform(R.as_vectors(rows)).collect()}
        assert got[39] > got[20] > got[1]
