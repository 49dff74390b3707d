import struct

import numpy as np
import pytest
from helpers import random_rows, vectors
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.sources import vector_files as VF
from nearfield.sources.index_table import Index, append_batch, index_name
from nearfield.streaming.ingest import append_stream, ingest_stream

ROWS = random_rows(101, 5, 21)


def stored(frame):
    return {r["id"]: r["vector"] for r in frame.collect()}


def raw_file(path, values, kind="<f4"):
    values = np.asarray(values)
    path.write_bytes(struct.pack("<ii", *values.shape) + values.astype(kind).tobytes())


def test_round_trip_over_several_files(spark, tmp_path):
    path = str(tmp_path / "v.fbin")
    VF.write_vectors(vectors(spark, ROWS), path, files=4)
    files = [f for f in (tmp_path / "v.fbin").iterdir() if not f.name.startswith((".", "_"))]
    assert len(files) == 4
    for f in files:  # every part is a complete file
        n, dim = struct.unpack("<ii", f.read_bytes()[:8])
        assert f.stat().st_size == 8 + n * dim * 4
    got = stored(VF.read_vectors(spark, path, rowsPerPartition="7"))
    assert sorted(got) == list(range(101))
    for i, v in ROWS:
        assert got[i] == [float(np.float32(x)) for x in v]
    assert VF.vector_count(spark, path) == 101


def test_ranges_and_pushed_conditions(spark, tmp_path):
    path = tmp_path / "a.fbin"
    raw_file(path, np.arange(60).reshape(20, 3))
    read = lambda **o: sorted(stored(VF.read_vectors(spark, str(path), **o)))
    assert read() == list(range(20))
    assert read(startIdx="15") == [15, 16, 17, 18, 19]
    assert read(startIdx="15", chunkSize="100") == [15, 16, 17, 18, 19]  # a chunk past the end is cut at the end
    assert read(startIdx="2", chunkSize="3") == [2, 3, 4]
    assert read(maxRows="4") == [0, 1, 2, 3]
    assert read(startIdx="20") == [] and read(startIdx="50") == []
    some = VF.read_vectors(spark, str(path), rowsPerPartition="5").where("id >= 13 and id < 17")
    assert some.rdd.getNumPartitions() == 1
    assert sorted(stored(some)) == [13, 14, 15, 16]
    assert stored(VF.read_vectors(spark, str(path)).where("id = 6")) == {6: [18.0, 19.0, 20.0]}


def test_other_component_types(spark, tmp_path):
    raw_file(tmp_path / "t.ibin", [[1, -2], [3, 1 << 30]], "<i4")
    assert stored(VF.read_vectors(spark, str(tmp_path / "t.ibin"), "ibin", startIdx="1")) == {1: [3, 1 << 30]}
    raw_file(tmp_path / "t.u8bin", [[0, 255], [7, 8]], "u1")
    assert stored(VF.read_vectors(spark, str(tmp_path / "t.u8bin"), "u8bin")) == {0: [0, 255], 1: [7, 8]}
    assert stored(VF.read_vectors(spark, str(tmp_path / "t.u8bin"), "fbin", dtype="uint8"))[0] == [0, 255]
    path = str(tmp_path / "out.u8bin")
    VF.write_vectors(spark.createDataFrame([(0, [1, 255])], "id long, vector array<int>"), path, "u8bin")
    assert stored(VF.read_vectors(spark, path, "u8bin")) == {0: [1, 255]}
    np.save(tmp_path / "m.npy", np.arange(12.0).reshape(4, 3))
    assert stored(VF.read_vectors(spark, str(tmp_path / "m.npy"), "npy", startIdx="3")) == {3: [9.0, 10.0, 11.0]}
    np.save(tmp_path / "bad.npy", np.arange(3))
    with pytest.raises(Exception, match="two-dimensional"):
        VF.read_vectors(spark, str(tmp_path / "bad.npy"), "npy").count()


def test_broken_input(spark, tmp_path):
    raw_file(tmp_path / "e.fbin", np.empty((0, 3)))
    assert VF.read_vectors(spark, str(tmp_path / "e.fbin")).count() == 0
    raw_file(tmp_path / "s.fbin", np.ones((4, 3)))
    data = (tmp_path / "s.fbin").read_bytes()
    (tmp_path / "s.fbin").write_bytes(data[:-5])
    with pytest.raises(Exception, match="ends early"):
        VF.read_vectors(spark, str(tmp_path / "s.fbin")).collect()
    assert stored(VF.read_vectors(spark, str(tmp_path / "s.fbin"), tolerant="true")) == {i: [1.0, 1.0, 1.0] for i in range(3)}
    (tmp_path / "s.fbin").write_bytes(data[:8])
    assert VF.read_vectors(spark, str(tmp_path / "s.fbin"), tolerant="true").count() == 0
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="dimensions"):
        VF.write_vectors(ragged, str(tmp_path / "r"), files=1)
    with pytest.raises(Exception, match="missing"):
        VF.write_vectors(spark.createDataFrame([(0, [None, 1.0])], "id long, vector array<double>"), str(tmp_path / "n"))


def test_overwrite_replaces_files(spark, tmp_path):
    path = str(tmp_path / "o")
    VF.write_vectors(vectors(spark, ROWS[:10]), path)
    VF.register(spark)
    vectors(spark, ROWS[:3]).coalesce(1).sortWithinPartitions("id").select("vector").write.format("fbin").mode("overwrite").save(path)
    assert VF.read_vectors(spark, path).count() == 3


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), min_size=2, max_size=2), min_size=1, max_size=20))
def test_any_floats_survive(spark, tmp_path_factory, values):
    path = str(tmp_path_factory.mktemp("prop") / "v")
    VF.write_vectors(vectors(spark, list(enumerate(values))), path, files=2)
    assert stored(VF.read_vectors(spark, path)) == {i: v for i, v in enumerate(values)}


def test_tsv_and_synthetic(spark, tmp_path):
    path = str(tmp_path / "t.tsv")
    VF.write_tsv(vectors(spark, ROWS), path, total=20)
    back = sorted(r["vector"] for r in VF.read_tsv(spark, path).collect())
    assert np.allclose(back, sorted(v.tolist() for _, v in ROWS[:20]), rtol=0, atol=1e-16)
    made = VF.synthetic(spark, 50, 4, seed=3)
    again = stored(VF.synthetic(spark, 50, 4, seed=3).repartition(3))
    assert stored(made) == again and len(again) == 50
    flat = np.array(list(again.values()))
    assert (flat >= 0).all() and (flat < 1).all() and abs(flat.mean() - 0.5) < 0.1


# --- index tables --------------------------------------------------------------------------

DOC = "id long, t string, v long"


@pytest.fixture
def index(spark, tmp_path):
    made = Index(spark, f"t_{tmp_path.name}", str(tmp_path)).create("vector", T.StructType.fromDDL(DOC))
    yield made
    made.drop()


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_upsert_keeps_the_last_version(spark, index):
    index.upsert(docs(spark, [(1, "a", 1), (2, "b", 1)]), seq="v")
    index.upsert(docs(spark, [(2, "c", 2), (3, "x", 1), (3, "y", 5), (3, "z", 3)]), seq="v")
    assert sorted(index.scan().collect()) == [(1, "a", 1), (2, "c", 2), (3, "y", 5)]
    index.upsert(docs(spark, []))
    assert index.scan().count() == 3
    assert [r["t"] for r in index.get(1).collect()] == ["a"]
    assert sorted(r["id"] for r in index.get(1, 3, 9).collect()) == [1, 3]
    with pytest.raises(Exception, match="needs an id"):
        index.upsert(docs(spark, [(None, "q", 1)]))
    assert index.scan().count() == 3  # a failed write leaves the index as it was


def test_many_copies_of_one_id(spark, index):
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("id"), F.col("id").cast("string").alias("t"), F.col("id").alias("v"))
    index.upsert(hot, seq="v")
    assert index.scan().collect() == [(7, "4999", 4999)]


def test_create_drop_and_append(spark, index):
    with pytest.raises(ValueError, match="exists"):
        index.create("vector")
    with pytest.raises(ValueError, match="unknown index layout"):
        Index(spark, "other").create("nosuch")
    assert index.properties()["dims"] == "768" and index_name("vector", 100) == "vector_100"
    index.append(docs(spark, [(None, "b", 20), (None, "a", 10)]), order="v")
    index.append(docs(spark, [(None, "c", 5)]), order="v")
    assert sorted(index.scan().collect()) == [(1, "a", 10), (2, "b", 20), (3, "c", 5)]
    index.drop()
    index.drop()  # a missing index is fine
    assert not index.exists()


def test_validated_upsert(spark, tmp_path):
    made = Index(spark, "t_valid", str(tmp_path)).create("vector", T.StructType.fromDDL("id long, vector array<float>"), dims=2)
    made.upsert(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0])]), check_dims=2)
    assert [r["id"] for r in made.scan().collect()] == [1]
    made.drop()


# --- streams -------------------------------------------------------------------------------------


def test_stream_of_files_ends_as_one_upsert(spark, tmp_path, index):
    source = tmp_path / "in"
    source.mkdir()
    docs(spark, [(1, "a", 1), (2, "b", 1)]).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(str(source))
        ingest_stream(stream, index, str(tmp_path / "state"), lambda b: b.withColumn("t", F.upper("t")), seq="v", every=None).awaitTermination()

    run()
    docs(spark, [(2, "late", 2), (3, "c", 1)]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert sorted(index.scan().collect()) == [(1, "A", 1), (2, "LATE", 2), (3, "C", 1)]


def test_appended_batches_number_on_and_can_be_repeated(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in (ROWS[:60], ROWS[60:]):
        vectors(spark, part, "k").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("k long, vector array<double>").option("maxFilesPerTrigger", 1).parquet(str(source))
    append_stream(stream, out, str(tmp_path / "state"), order="k", every=None).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 102)) and len({r["batch"] for r in rows}) == 2
    again = spark.read.parquet(f"{out}/batch=1").drop("id", "batch")
    append_batch(spark, out, spark.createDataFrame(again.collect(), again.schema), "k", 1)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(1, 102))


def test_documents_of_a_stream_arrive_in_as_many_files_as_they_are_read_in(spark, tmp_path, monkeypatch):
    from nearfield.plans import storage

    made = []
    docs = [(i, f"word{i} " + "word " * 30, "en", "web", 10) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(11)
    table = storage.table
    monkeypatch.setattr(storage, "table", lambda spark, sf_dir, name: frame if name == "documents" else table(spark, sf_dir, name))
    monkeypatch.setattr(storage, "scratch_path", lambda spark, name: made.append(str(tmp_path / name)) or made[-1])
    hits = storage.stream_upsert(spark, "/root/testdata/sf0.001").collect()
    assert len(list((tmp_path / "arrived" / "documents.parquet").glob("part-*"))) == 12
    assert len(list((tmp_path / "ingest-state" / "commits").glob("[0-9]*"))) == 3
    assert {r["id"] for r in hits} <= set(range(60)) and {r["rank"] for r in hits} == set(range(1, 6))
