"""Registered queries: vector files, index tables, streaming ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.corpus import dense_id, parse_corpus
from nearfield.operators.embedding import hash_embed
from nearfield.operators.exact import search_exact
from nearfield.plans.inputs import (
    DIGITS,
    DIMS,
    corpus,
    documents,
    hash_vector_sql,
    queries_sql,
    ranked_sql,
    streamed,
    table,
    vector_queries,
)
from nearfield.plans.text_search import PARSE_SQL, lines_of
from nearfield.plans.vector_search import COS
from nearfield.session import scratch_path, spread
from nearfield.sources import vector_files as VF
from nearfield.sources.index_table import Index
from nearfield.streaming.ingest import append_stream, ingest_stream, keep_stream

QUERIES = {}
ORACLES = {}


def positioned(spark, sf_dir):
    """Stored vectors with their position from 0 as id."""
    return dense_id(corpus(spark, sf_dir).select(F.col("id").alias("vec_id"), "vector"), "vec_id", out="id", start=0).select("id", "vector")


def _components(df):
    return df.select("id", F.posexplode("vector").alias("i", "x")).select(
        "id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")
    )


def fbin_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "fbin")
    VF.write_vectors(positioned(spark, sf_dir), path, "fbin", files=3)
    return _components(VF.read_vectors(spark, path, "fbin", rowsPerPartition="200"))


QUERIES["fbin_roundtrip"] = fbin_roundtrip
ORACLES["fbin_roundtrip"] = """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS i, unnest(embedding)::DOUBLE AS x
FROM embeddings"""


def ibin_roundtrip(spark, sf_dir):
    """Ground-truth ids of every query, best first, through an integer vector file."""
    hits = search_exact(vector_queries(spark, sf_dir), corpus(spark, sf_dir), 10, "cosine1p", digits=DIGITS)
    truth = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best"))
    numbered = dense_id(truth.withColumnRenamed("id", "query_id"), "query_id", out="id", start=0)
    path = scratch_path(spark, "ibin")
    VF.write_vectors(numbered.select("id", F.col("best.id").cast("array<int>").alias("vector")), path, "ibin", files=2)
    return VF.read_vectors(spark, path, "ibin").select("id", F.posexplode("vector").alias("i", "neighbour")).select(
        "id", F.col("i").cast("long").alias("i"), F.col("neighbour").cast("long").alias("neighbour")
    )


QUERIES["ibin_roundtrip"] = ibin_roundtrip
ORACLES["ibin_roundtrip"] = (
    queries_sql()
    + ","
    + ranked_sql(f"1.0 + {COS}")
    + " SELECT dense_rank() OVER (ORDER BY query_id) - 1 AS id, rank - 1 AS i, id AS neighbour FROM hits"
)


def chunk_scan(spark, sf_dir):
    """Rows from the middle of a vector file to its end, by start index and a chunk that reaches past it."""
    path = scratch_path(spark, "chunk")
    VF.write_vectors(positioned(spark, sf_dir), path, "fbin", files=2)
    return _components(VF.read_vectors(spark, path, "fbin", startIdx="250", chunkSize="1000000000"))


QUERIES["chunk_scan"] = chunk_scan
ORACLES["chunk_scan"] = """
SELECT * FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS i,
  unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE id >= 250"""


def file_headers(spark, sf_dir):
    """Vectors and dimension of a file set, from its headers."""
    path = scratch_path(spark, "headers")
    VF.write_vectors(positioned(spark, sf_dir), path, "fbin", files=4)
    return VF.read_vectors(spark, path, "fbin", headerOnly="true").agg(
        F.sum("n").alias("vectors"), F.max("dim").cast("long").alias("dim")
    )


QUERIES["file_headers"] = file_headers
ORACLES["file_headers"] = "SELECT count(*) AS vectors, max(len(embedding))::BIGINT AS dim FROM embeddings"


TSV_ROWS = 500_000


def tsv_values(spark, sf_dir):
    """The first TSV_ROWS vectors as text, parsed back."""
    path = scratch_path(spark, "tsv")
    VF.write_tsv(positioned(spark, sf_dir), path, TSV_ROWS)
    back = VF.read_tsv(spark, path)
    return back.select(F.posexplode("vector").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


QUERIES["tsv_values"] = tsv_values
ORACLES["tsv_values"] = f"""
SELECT CAST(unnest(range(len(embedding))) AS BIGINT) AS i, round(unnest(embedding)::DOUBLE, 9) AS x
FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT {TSV_ROWS})"""


# --- index tables --------------------------------------------------------------------


def _index(spark, kind: str, columns: str) -> Index:
    schema = T.StructType.fromDDL(columns)
    return Index(spark, f"nearfield_{kind}_{uuid.uuid4().hex[:12]}").create("vector", schema, dims=DIMS)


STORED = "id long, text string, lang string, version long"


def upsert_last_wins(spark, sf_dir):
    """Store all documents, then upsert new versions of the labelled ones and new ids, some of them twice."""
    docs = documents(spark, sf_dir).select("id", "text", "lang", F.lit(1).cast("long").alias("version"))
    index = _index(spark, "upsert", STORED)
    index.upsert(docs, seq="version")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    again = docs.join(labelled, "id")
    second = again.select("id", F.concat(F.lit("v2 "), "text").alias("text"), "lang", F.lit(2).cast("long").alias("version"))
    third = again.where("quality = 1").select("id", F.lit("third").alias("text"), "lang", F.lit(3).cast("long").alias("version"))
    fresh = again.select((F.col("id") + 1_000_000).alias("id"), "text", "lang", F.lit(2).cast("long").alias("version"))
    index.upsert(second.unionByName(third).unionByName(fresh), seq="version")
    return index.scan()


QUERIES["upsert_last_wins"] = upsert_last_wins
ORACLES["upsert_last_wins"] = """
WITH l AS (SELECT doc_id, quality FROM labels)
SELECT d.doc_id AS id, CASE WHEN quality = 1 THEN 'third' WHEN quality IS NULL THEN text ELSE 'v2 ' || text END AS text, lang,
       (CASE WHEN quality = 1 THEN 3 WHEN quality IS NULL THEN 1 ELSE 2 END)::BIGINT AS version
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id
UNION ALL SELECT d.doc_id + 1000000, text, lang, 2::BIGINT FROM documents d JOIN l ON d.doc_id = l.doc_id"""


def match_all(spark, sf_dir):
    """Scan of a stored index: documents per language."""
    index = _index(spark, "scan", STORED)
    index.upsert(documents(spark, sf_dir).select("id", "text", "lang", F.lit(1).cast("long").alias("version")))
    return index.scan().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


QUERIES["match_all"] = match_all
ORACLES["match_all"] = "SELECT lang, count(*) AS n, max(doc_id) AS last_id FROM documents GROUP BY lang"


def incremental_append(spark, sf_dir):
    """Vectors appended class by class in two batches; ids go on from the largest."""
    index = _index(spark, "append", "id long, vec_id long, vector array<float>")
    rows = corpus(spark, sf_dir).select(F.col("id").alias("vec_id"), "vector", "label")
    index.append(rows.where("label < 5"), order="vec_id")
    index.append(rows.where("label >= 5"), order="vec_id")
    return index.scan().select("id", "vec_id", F.col("vector")[0].cast("double").alias("x0"))


QUERIES["incremental_append"] = incremental_append
ORACLES["incremental_append"] = """
SELECT row_number() OVER (ORDER BY label >= 5, vec_id) AS id, vec_id, embedding[1]::DOUBLE AS x0 FROM embeddings"""


# --- streaming ingest ------------------------------------------------------------------------


def stream_upsert(spark, sf_dir):
    """Documents arrive in three batches of files, are cleaned, embedded and upserted under their own ids, and then searched.

    A batch is one file, and more where the table is read in more than three parts, so that no file is larger than these.
    """
    stored = "id long, url string, _text_ string, vector array<double>"
    index = _index(spark, "stream", stored)
    arrived = scratch_path(spark, "arrived")
    docs = table(spark, sf_dir, "documents")
    files = -(-docs.rdd.getNumPartitions() // 3)
    docs.repartition(3 * files, "doc_id").write.parquet(f"{arrived}/documents.parquet")
    stream = streamed(spark, arrived, "documents", files_per_batch=files)

    def prepare(batch):
        lines = spread(batch.withColumnRenamed("doc_id", "id"), "id")
        parsed = parse_corpus(lines_of(lines), order="n", own_ids=True)
        return hash_embed(parsed, "_text_", DIMS)

    ingest_stream(stream, index, scratch_path(spark, "ingest-state"), prepare, every=None).awaitTermination()
    return search_exact(vector_queries(spark, sf_dir), index.scan(), 5, "cosine1p", digits=DIGITS)


QUERIES["stream_upsert"] = stream_upsert
ORACLES["stream_upsert"] = (
    "WITH "
    + PARSE_SQL
    + ","
    + hash_vector_sql("docs", "n", "_text_", "d")
    + ","
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + ",\ncorpus AS (SELECT n AS id, q AS v FROM d),"
    + ranked_sql(f"1.0 + {COS}", k=5)
    + " SELECT query_id, rank, id, s AS _score FROM hits"
)


def stream_append(spark, sf_dir):
    """Vectors arrive as a stream of files and are appended with dense ids."""
    path = scratch_path(spark, "append")
    stream = streamed(spark, sf_dir, "embeddings")
    append_stream(stream, path, scratch_path(spark, "append-state"), order="vec_id", every=None).awaitTermination()
    return spark.read.parquet(path).select("id", "vec_id", F.col("embedding")[0].cast("double").alias("x0"))


QUERIES["stream_append"] = stream_append
ORACLES["stream_append"] = "SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, embedding[1]::DOUBLE AS x0 FROM embeddings"


def stream_fbin(spark, sf_dir):
    """Vector files that arrive one after the other, read as a stream that is started again for each."""
    arrived, kept, state = (scratch_path(spark, name) for name in ("fbin-arrived", "fbin-kept", "fbin-state"))
    rows = positioned(spark, sf_dir)
    third = -(-rows.count() // 3)
    for part in range(3):
        VF.write_vectors(rows.where(F.floor(F.col("id") / third) == part), arrived, files=2, prefix=f"{part}-")
        keep_stream(VF.stream_vectors(spark, arrived, rowsPerPartition="100"), kept, state, every=None).awaitTermination()
    return _components(spark.read.parquet(kept).select("id", "vector"))


QUERIES["stream_fbin"] = stream_fbin
ORACLES["stream_fbin"] = ORACLES["fbin_roundtrip"]
