"""Nothing is lost: layouts that change, several batches, missing vectors, rejected documents, unfinished rounds."""

import os
from pathlib import Path

import numpy as np
import pytest
from helpers import random_rows, vectors
from pyspark.sql import functions as F

from nearfield.operators import corpus as C
from nearfield.operators import graph as G
from nearfield.operators.embedding import mean_pool, reduce_dims
from nearfield.operators.ivf import assign
from nearfield.operators.lexical import bm25, bm25_over, postings
from nearfield.operators.lsh import lsh_codes
from nearfield.operators.ranking import log_features
from nearfield.operators.sharding import shard_by_distance
from nearfield.plans.inputs import streamed
from nearfield.sources import vector_files as VF
from nearfield.sources.index_table import Index
from nearfield.streaming.ingest import ingest_stream


def test_file_order_ids_survive_another_split_of_the_input(spark, tmp_path):
    for part in range(3):
        lines = [f"{part}-{i} " + "x" * (i % 50) for i in range(3000)]
        (tmp_path / f"p{part}.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    kept = C.read_lines(spark, str(tmp_path)).where("NOT value LIKE '%7 %'")
    try:
        written, planned = C.dense_id_in_file_order(kept, written=True), C.dense_id_in_file_order(kept)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        got = [(r["id"], r["value"].split(" ")[0]) for r in written.orderBy("id").collect()]
        with pytest.raises(Exception, match="no place for a row"):
            planned.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"{p}-{i}" for p in range(3) for i in range(3000) if not str(i).endswith("7")]
    assert got == list(enumerate(want, 1))


def test_stream_keeps_the_documents_of_every_batch(spark, tmp_path):
    docs = spark.range(90).select("id", F.concat(F.lit("text "), "id").alias("text"))
    docs.repartition(5, "id").write.parquet(str(tmp_path / "docs.parquet"))
    index = Index(spark, "whole_stream", str(tmp_path / "root")).create("vector", docs.schema)
    batches = []
    stream = streamed(spark, str(tmp_path), "docs", files_per_batch=1)
    ingest_stream(stream, index, str(tmp_path / "state"), lambda b: batches.append(b.count()) or b, every=None).awaitTermination()
    assert len([b for b in batches if b]) >= 3
    assert sorted(r["id"] for r in index.scan().collect()) == list(range(90))
    single = tmp_path / "one.parquet"
    part = next(Path(tmp_path / "docs.parquet").glob("part-*"))
    single.write_bytes(part.read_bytes())
    index.drop()


def test_dropped_index_leaves_no_files(spark, tmp_path):
    index = Index(spark, "whole_drop", str(tmp_path)).create("vector", spark.range(1).select("id", F.lit("t").alias("text")).schema)
    index.upsert(spark.range(50).select("id", F.lit("t").alias("text")))
    assert any(files for _, _, files in os.walk(tmp_path))
    index.drop()
    index.drop()
    assert not any(files for _, _, files in os.walk(tmp_path)) and not index.exists()
    again = Index(spark, "whole_drop", str(tmp_path)).create("vector", spark.range(1).select("id", F.lit("t").alias("text")).schema)
    assert again.scan().count() == 0
    again.drop()


def test_upsert_returns_documents_with_a_wrong_vector(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, vector array<float>")
    index = Index(spark, "whole_check", str(tmp_path)).create("vector", rows.schema)
    rejected = index.upsert(rows, check_dims=2)
    assert [r["id"] for r in index.scan().collect()] == [1]
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {2: "dimensions", 3: "missing"}
    index.drop()


def test_upserts_write_what_they_bring_and_settle(spark, tmp_path):
    def files():
        return {f: os.path.getmtime(f) for d, _, names in os.walk(tmp_path) for n in names if n.endswith(".parquet") for f in [f"{d}/{n}"]}

    schema = spark.range(1).select("id", F.lit("t").alias("text")).schema
    index = Index(spark, "whole_commits", str(tmp_path)).create("vector", schema, buckets=2)
    index.upsert(spark.range(20_000).select("id", F.lit("x" * 50).alias("text")))
    before = files()
    want = dict.fromkeys(range(20_000), "x" * 50)
    for turn in range(12):
        ids = range(turn * 50, turn * 50 + 100)
        index.upsert(spark.createDataFrame([(i, f"v{turn}") for i in ids], schema))
        want.update(dict.fromkeys(ids, f"v{turn}"))
        if turn == 0:
            after = files()
            assert set(before) <= set(after) and sum(os.path.getsize(f) for f in set(after) - set(before)) < 0.1 * sum(map(os.path.getsize, before))
    assert {r["id"]: r["text"] for r in index.scan().collect()} == want
    assert set(before) <= set(files())  # few versions are merged among themselves
    assert [r["text"] for r in index.get(149, 19_999).orderBy("id").collect()] == ["v2", "x" * 50]
    for turn in range(10):
        index.upsert(spark.range(0, 20_000, 3).select("id", F.lit(f"w{turn}").alias("text")))
    want.update(dict.fromkeys(range(0, 20_000, 3), "w9"))
    assert {r["id"]: r["text"] for r in index.scan().collect()} == want
    assert not set(before) & set(files())  # many are merged into the documents
    index.drop()


def test_rows_without_a_vector_stay(spark):
    rows = random_rows(12, 4, 1) + [(100, None), (101, None)]
    frame = vectors(spark, rows).repartition(3)
    centers = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])], "cell long, vector array<double>")
    for got, column in (
        (reduce_dims(frame, "vector", 2, 4), "reduced"),
        (assign(frame, centers), "cell"),
        (lsh_codes(frame, 4, 5), "codes"),
        (shard_by_distance(frame, 0.5, 4), "shard_id"),
    ):
        values = {r["id"]: r[column] for r in got.collect()}
        assert len(values) == 14 and values[100] is None and values[101] is None
        assert all(values[i] is not None for i in range(12))
    only = vectors(spark, [(1, None)])
    assert reduce_dims(only, "vector", 2, 4).first()["reduced"] is None
    texts = spark.createDataFrame([(1, "a b"), (2, "zzz"), (3, None)], "id long, text string")
    table = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0])], "token string, vec array<double>")
    assert {r["id"]: r["vector"] for r in mean_pool(texts, "id", "text", table, keep=True).collect()} == {1: [2.0, 4.0], 2: None, 3: None}


def test_unfinished_rounds_are_an_error(spark):
    nodes = vectors(spark, [(i, np.array([float(i)])) for i in range(12)])
    chain = G.undirected(spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)], "src long, dst long, distance double"))
    assert G.hop_counts(nodes, chain).count() == 144 and sum(np.diff(G.reach_per_hop(nodes, chain))) == 132
    with pytest.raises(RuntimeError):
        G.hop_counts(nodes, chain, max_rounds=5)
    with pytest.raises(RuntimeError):
        G.reach_per_hop(nodes, chain, max_rounds=5)
    asked = spark.createDataFrame([(1, [0.0])], "query_id long, q array<double>")
    with pytest.raises(RuntimeError):
        G.graph_search(asked, nodes, chain, k=12, m=1, max_rounds=2)


def test_ranking_among_given_documents(spark):
    docs = spark.createDataFrame([(i, "common " * (9 - i) + f"w{i}") for i in range(9)], "id long, text string")
    asked = spark.createDataFrame([(1, "common")], "query_id long, text string")
    listed = spark.createDataFrame([(6,), (7,), (99,)], "id long")
    whole = {r["id"]: r["_score"] for r in bm25(asked, docs, 9).collect()}
    for got in (bm25(asked, docs, 2, ids=listed), bm25_over(asked, postings(docs), 2, ids=listed)):
        rows = got.orderBy("rank").collect()
        assert [(r["rank"], r["id"]) for r in rows] == [(1, 6), (2, 7)]
        assert [r["_score"] for r in rows] == pytest.approx([whole[6], whole[7]])
    hits = bm25(asked, docs, 9)
    features = hits.select("query_id", "id", F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    logged = log_features(hits, features, ["f"], ids=listed, size=2).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["ltr_features"]) for r in logged] == [(1, 6, [6.0]), (2, 7, [7.0])]


def test_files_without_a_scheme_land_where_spark_looks(spark, tmp_path):
    path = str(tmp_path / "plain")
    VF.write_vectors(vectors(spark, random_rows(30, 3, 2)), path)
    assert VF.vector_count(spark, path) == 30
    assert VF.vector_count(spark, f"file://{path}") == 30


def test_word_batches_are_worked_on_in_slices(spark, monkeypatch):
    """Vectors and word counts of a batch are the same whatever is worked on at once, and little memory beside it is taken."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from nearfield.operators import blocks
    from nearfield.operators.embedding import HashEmbedder

    lists = [None, [], ["a", "b"] * 30, ["c"], None, ["a"] * 100, []]
    tokens = pa.array(lists, pa.list_(pa.string()))
    whole = HashEmbedder(8)(tokens)
    monkeypatch.setattr(blocks, "ITEMS_AT_ONCE", 7)
    assert np.array_equal(HashEmbedder(8)(tokens), whole) and whole.shape == (7, 8)
    batch = pa.RecordBatch.from_arrays([tokens], names=["t"])
    assert pa.Table.from_batches(blocks.few_items(batch, "t")).column("t").to_pylist() == lists
    assert HashEmbedder(8)(tokens.slice(0, 0)).shape == (0, 8)
    monkeypatch.setattr(blocks, "ITEMS_AT_ONCE", 50_000)
    many = pa.array([["a", "b", "c", "d"] * 250] * 2000, pa.list_(pa.string()))
    tracemalloc.start()
    HashEmbedder(8)(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000  # a number a word of the whole batch is 16 MB
