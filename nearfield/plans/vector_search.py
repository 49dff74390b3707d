"""Registered queries: exact vector search and vector expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import exact, topk
from nearfield.operators.embedding import hash_embed, index_size, reduce_dims, unit_export
from nearfield.plans.inputs import (
    DIGITS,
    DIMS,
    corpus,
    documents,
    hash_vector_sql,
    queries_sql,
    ranked_sql,
    vector_queries,
)

COS = "list_cosine_similarity(q.q, c.v)"
DOT = "list_dot_product(q.q, c.v)"
HITS = " SELECT query_id, rank, id, s AS _score FROM hits"

QUERIES = {}
ORACLES = {}


def _search(score, k=10, **options):
    def run(spark, sf_dir):
        return exact.search_exact(
            vector_queries(spark, sf_dir), corpus(spark, sf_dir), k, score, digits=DIGITS, **options
        )

    return run


def knn_cosine(spark, sf_dir):
    return _search("cosine1p")(spark, sf_dir)


QUERIES["knn_cosine"] = knn_cosine
ORACLES["knn_cosine"] = queries_sql() + "," + ranked_sql(f"1.0 + {COS}") + HITS

QUERIES["knn_sigmoid_dot"] = _search("sigmoid_dot")
ORACLES["knn_sigmoid_dot"] = queries_sql() + "," + ranked_sql(f"1.0 / (1.0 + exp(-{DOT}))") + HITS


def knn_payload(spark, sf_dir):
    """Raw dot over vectors stored as payload text and queries sent as CSV text."""
    stored = corpus(spark, sf_dir).select("id", V.to_payload(F.col("vector")).alias("payload"))
    asked = vector_queries(spark, sf_dir).select("query_id", V.to_csv(F.col("q")).alias("csv"))
    return exact.search_exact(
        asked.select("query_id", V.from_csv(F.col("csv")).alias("q")),
        stored.select("id", V.from_payload(F.col("payload")).alias("vector")),
        10,
        "dot",
        digits=DIGITS,
    )


# The text form of a float is its shortest decimal, which is what is scored here.
QUERIES["knn_payload"] = knn_payload
ORACLES["knn_payload"] = (
    queries_sql().replace("embedding::DOUBLE[] AS v", "embedding::VARCHAR[]::DOUBLE[] AS v") + "," + ranked_sql(DOT) + HITS
)


def payload_codec(spark, sf_dir):
    """Encode every stored vector as payload text, decode it, and list the components."""
    coded = corpus(spark, sf_dir).select("id", V.to_payload(F.col("vector")).alias("payload"))
    decoded = coded.select("id", V.from_payload(F.col("payload")).cast("array<float>").alias("v"))
    return decoded.select("id", F.posexplode("v").alias("i", "x")).select(
        "id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")
    )


QUERIES["payload_codec"] = payload_codec
ORACLES["payload_codec"] = """
SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"""


def knn_filtered_label(spark, sf_dir):
    """Search among the odd classes only; the condition sits below the scoring."""
    return _search("cosine1p", where=F.col("label").isin(1, 3, 5, 7, 9))(spark, sf_dir)


QUERIES["knn_filtered_label"] = knn_filtered_label
ORACLES["knn_filtered_label"] = (
    queries_sql() + "," + ranked_sql(f"1.0 + {COS}", where="c.label IN (1, 3, 5, 7, 9)") + HITS
)


def knn_sharded(spark, sf_dir):
    return exact.search_sharded(
        vector_queries(spark, sf_dir), corpus(spark, sf_dir), k=10, size=15, shards=2, digits=DIGITS
    )


QUERIES["knn_sharded"] = knn_sharded
ORACLES["knn_sharded"] = queries_sql() + f""",
scored AS (
  SELECT q.item_id AS query_id, c.id, round(1.0 + {COS}, {DIGITS}) AS s,
         ('0x' || substr(md5(c.id::VARCHAR), 1, 8))::UBIGINT % 2 AS shard FROM q, corpus c),
per_shard AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY s DESC, id) AS r FROM scored
                 WHERE NOT isnan(s)) WHERE r <= 10)
SELECT query_id, rank, id, s AS _score FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM per_shard)
WHERE rank <= 15"""

DISTANCES = " SELECT query_id, rank, id, s AS distance, {0} AS _score FROM hits"

for _name, _sql in {
    "l1": "list_sum(list_transform(list_zip(q.q, c.v), lambda p: abs(p[1] - p[2])))",
    "l2": "list_distance(q.q, c.v)",
    "l2sq": "list_sum(list_transform(list_zip(q.q, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "cosine": f"1.0 - {COS}",
    "ip": f"1.0 - {DOT}",
}.items():
    QUERIES[f"knn_space_{_name}"] = _search(_name)
    ORACLES[f"knn_space_{_name}"] = (
        queries_sql()
        + ","
        + ranked_sql(_sql, direction="ASC")
        + DISTANCES.format("CASE WHEN s >= 0 THEN 1.0 / (1.0 + s) ELSE 1.0 - s END")
    )


def knn_space_hamming(spark, sf_dir):
    """Hamming distance of the sign patterns, 32 components to a packed long."""
    return exact.search_exact(
        vector_queries(spark, sf_dir).select("query_id", V.sign_bits(F.col("q"), DIMS).alias("q")),
        corpus(spark, sf_dir).select("id", V.sign_bits(F.col("vector"), DIMS).alias("vector")),
        10,
        "hamming",
    )


QUERIES["knn_space_hamming"] = knn_space_hamming
ORACLES["knn_space_hamming"] = (
    queries_sql()
    + ","
    + ranked_sql(
        "CAST(list_sum(list_transform(list_zip(q.q, c.v), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS DOUBLE)",
        direction="ASC",
    )
    + DISTANCES.format("1.0 / (1.0 + s)")
)


def knn_total(spark, sf_dir):
    """Hits with the number of matching rows, counted before the cut."""
    rows = corpus(spark, sf_dir)
    hits = exact.search_exact(vector_queries(spark, sf_dir), rows, 10, "cosine1p", where=F.col("label") != 0, digits=DIGITS)
    found = rows.where(F.col("label") != 0).agg(F.count(F.lit(1)).alias("numfound"))
    return hits.withColumn("numfound", found.scalar())


QUERIES["knn_total"] = knn_total
ORACLES["knn_total"] = (
    queries_sql()
    + ","
    + ranked_sql(f"1.0 + {COS}", where="c.label <> 0")
    + " SELECT query_id, rank, id, s AS _score, (SELECT count(*) FROM corpus WHERE label <> 0) AS numfound FROM hits"
)


def semantic_search(spark, sf_dir):
    """Text in, documents out: both sides are embedded, then searched by cosine."""
    docs = hash_embed(documents(spark, sf_dir).select("id", "text"), "text", DIMS).select("id", "vector")
    return exact.search_exact(vector_queries(spark, sf_dir), docs, 10, "cosine1p", digits=DIGITS)


QUERIES["semantic_search"] = semantic_search
ORACLES["semantic_search"] = (
    "WITH "
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + ","
    + hash_vector_sql("documents", "doc_id", "text", "d")
    + ",\ncorpus AS (SELECT doc_id AS id, q AS v FROM d),"
    + ranked_sql(f"1.0 + {COS}")
    + HITS
)


def scaling_sizes(spark, sf_dir):
    """The same search on growing indexes: the best hit per index size that the table reaches."""
    rows, asked = corpus(spark, sf_dir), vector_queries(spark, sf_dir)
    sizes = [100, 200, 1_000, 10_000, 100_000, 1_000_000]
    from nearfield.operators.evaluation import scaling

    return scaling(asked, rows, sizes, k=10, digits=DIGITS)


QUERIES["scaling_sizes"] = scaling_sizes
ORACLES["scaling_sizes"] = queries_sql() + f""",
sizes AS (SELECT unnest([100, 200, 1000, 10000, 100000, 1000000])::BIGINT AS size),
placed AS (SELECT id, v, row_number() OVER (ORDER BY id) AS n FROM corpus),
scored AS (SELECT size, q.item_id AS query_id, c.id, round(1.0 + {COS}, {DIGITS}) AS s
           FROM sizes, q, placed c WHERE c.n <= size),
ranked AS (SELECT *, row_number() OVER (PARTITION BY size, query_id ORDER BY s DESC, id) AS rank FROM scored WHERE NOT isnan(s))
SELECT size, query_id, rank, id, s AS _score FROM ranked WHERE rank <= 10"""


# --- vector columns ----------------------------------------------------------------


def _components(df, key):
    return df.select(key, F.posexplode("v").alias("i", "x")).select(
        key, F.col("i").cast("long").alias("i"), F.round("x", DIGITS).alias("x")
    )


def normalise(spark, sf_dir):
    """Stored vectors stretched by their label (label 0 gives zero vectors), then L2 normalised."""
    stretched = corpus(spark, sf_dir).select(
        "id", F.transform(V.as_double(F.col("vector")), lambda x: x * F.col("label")).alias("v")
    )
    return _components(stretched.select("id", V.l2_normalise(F.col("v")).alias("v")), "id")


QUERIES["normalise"] = normalise
ORACLES["normalise"] = f"""
WITH s AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS len FROM s)
SELECT id, CAST(unnest(range(len(v))) AS BIGINT) AS i,
       round(unnest(list_transform(v, lambda x: CASE WHEN len = 0 THEN x ELSE x / len END)), {DIGITS}) AS x FROM n"""


def query_vector(spark, sf_dir):
    asked = vector_queries(spark, sf_dir)
    return asked.select("query_id", F.posexplode(V.query_vector(F.col("q"))).alias("i", "x")).select(
        "query_id", F.col("i").cast("long").alias("i"), "x"
    )


QUERIES["query_vector"] = query_vector
ORACLES["query_vector"] = (
    "WITH "
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + """, n AS (SELECT item_id, q, sqrt(list_dot_product(q, q)) AS len FROM q)
SELECT item_id AS query_id, CAST(unnest(range(len(q))) AS BIGINT) AS i,
       unnest(list_transform(q, lambda x: round_even(CASE WHEN len = 0 THEN x ELSE x / len END, 10))) AS x FROM n"""
)


def hash_embed_documents(spark, sf_dir):
    docs = hash_embed(documents(spark, sf_dir).select("id", "text"), "text", DIMS).select("id", F.col("vector").alias("v"))
    return _components(docs, "id")


QUERIES["hash_embed"] = hash_embed_documents
ORACLES["hash_embed"] = (
    "WITH "
    + hash_vector_sql("documents", "doc_id", "text", "d")
    + f" SELECT doc_id AS id, CAST(unnest(range(len(q))) AS BIGINT) AS i, round(unnest(q), {DIGITS}) AS x FROM d"
)


def query_embed(spark, sf_dir):
    return _components(vector_queries(spark, sf_dir).select("query_id", F.col("q").alias("v")), "query_id")


QUERIES["query_embed"] = query_embed
ORACLES["query_embed"] = (
    "WITH "
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + f" SELECT item_id AS query_id, CAST(unnest(range(len(q))) AS BIGINT) AS i, round(unnest(q), {DIGITS}) AS x FROM q"
)


def random_projection(spark, sf_dir):
    reduced = reduce_dims(corpus(spark, sf_dir).select("id", "vector"), "vector", 32, DIMS)
    return _components(reduced.select("id", F.col("reduced").alias("v")), "id")


QUERIES["random_projection"] = random_projection
ORACLES["random_projection"] = f"""
WITH m AS (
  SELECT j, i, CASE WHEN ('0x' || substr(md5(j::VARCHAR || ':' || i::VARCHAR), 1, 8))::UBIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS w
  FROM (SELECT unnest(range(32)) AS j), (SELECT unnest(range({DIMS})) AS i)),
x AS (SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT id, CAST(j AS BIGINT) AS i, round(sum(x * w) / sqrt(32), {DIGITS}) AS x FROM x JOIN m USING (i) GROUP BY id, j"""


def pca_32(spark, sf_dir):
    return _components(
        reduce_dims(corpus(spark, sf_dir).select("id", "vector"), "vector", 32, DIMS, "pca").select(
            "id", F.col("reduced").alias("v")
        ),
        "id",
    )


QUERIES["pca_32"] = pca_32


def pca_lengths(spark, sf_dir):
    """With all components a projection only turns the vectors: their squared lengths stay."""
    whole = reduce_dims(corpus(spark, sf_dir).select("id", "vector"), "vector", DIMS, DIMS, "pca")
    squared = F.aggregate("reduced", F.lit(0.0), lambda acc, x: acc + x * x)
    return whole.select("id", F.size("reduced").cast("long").alias("dims"), F.round(squared, DIGITS).alias("squared_length"))


QUERIES["pca_lengths"] = pca_lengths
ORACLES["pca_lengths"] = f"""
SELECT vec_id AS id, len(embedding) AS dims, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), {DIGITS}) AS squared_length
FROM embeddings"""


def vector_export(spark, sf_dir):
    docs = hash_embed(documents(spark, sf_dir).select("id", "text"), "text", DIMS)
    rows = unit_export(docs).select("id", F.col("vector").alias("v"))
    return rows.select("id", F.posexplode("v").alias("i", "x")).select(
        "id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 4).alias("x")
    )


QUERIES["vector_export"] = vector_export
ORACLES["vector_export"] = (
    "WITH "
    + hash_vector_sql("documents", "doc_id", "text", "d")
    + """ SELECT doc_id::VARCHAR AS id, CAST(unnest(range(len(q))) AS BIGINT) AS i,
       round(unnest(q)::FLOAT::DOUBLE, 4) AS x FROM d"""
)


def index_size_query(spark, sf_dir):
    sized = index_size(corpus(spark, sf_dir), replicas=1)
    return sized.withColumn("index_bytes", F.round("index_bytes", 1))


QUERIES["index_size"] = index_size_query
ORACLES["index_size"] = """
SELECT count(*) AS vectors, max(len(embedding))::BIGINT AS dims,
       round(1.1::DOUBLE * (4 * max(len(embedding)) + 8 * 16) * count(*) * 2, 1) AS index_bytes,
       count(*) * 16 * 8 AS link_bytes_min, count(*) * 16 * 10 AS link_bytes_max FROM embeddings"""


# --- shaping of hits ------------------------------------------------------------------


def score_curve(spark, sf_dir):
    return topk.score_curve(knn_cosine(spark, sf_dir))


QUERIES["score_curve"] = score_curve
ORACLES["score_curve"] = queries_sql() + "," + ranked_sql(f"1.0 + {COS}") + " SELECT query_id, rank, s AS _score FROM hits"


def preview(spark, sf_dir):
    """Hits with document columns, first ten rows and five columns."""
    hits = knn_cosine(spark, sf_dir)
    wide = exact.attach(hits, documents(spark, sf_dir), ["text", "lang"])
    return topk.preview(wide.select("query_id", "rank", "id", "_score", "lang", "text"))


QUERIES["preview"] = preview
ORACLES["preview"] = (
    queries_sql()
    + ","
    + ranked_sql(f"1.0 + {COS}")
    + """ SELECT query_id, rank, id, s AS _score, lang FROM hits LEFT JOIN documents ON doc_id = id
ORDER BY query_id, rank LIMIT 10"""
)


def source_projection(spark, sf_dir):
    """Hits with the stored fields a result page shows."""
    hits = knn_cosine(spark, sf_dir)
    docs = documents(spark, sf_dir).select("id", F.col("text").alias("_text_"), F.concat(F.lit("doc/"), "id").alias("url"))
    return exact.attach(hits, docs, ["_text_", "url"]).select("query_id", "rank", "id", "_text_", "url", "_score")


QUERIES["source_projection"] = source_projection
ORACLES["source_projection"] = (
    queries_sql()
    + ","
    + ranked_sql(f"1.0 + {COS}")
    + """ SELECT query_id, rank, id, text AS _text_,
CASE WHEN doc_id IS NULL THEN NULL ELSE 'doc/' || doc_id END AS url, s AS _score FROM hits LEFT JOIN documents ON doc_id = id"""
)


def best_overall(spark, sf_dir):
    """Every corpus row with its best score over all queries, globally sorted."""
    hits = exact.search_exact(vector_queries(spark, sf_dir), corpus(spark, sf_dir), 50, "cosine1p", digits=DIGITS)
    best = hits.groupBy("id").agg(F.max("_score").alias("_score"), F.count(F.lit(1)).alias("n"))
    return topk.global_sort(best)


QUERIES["global_sort"] = best_overall
ORACLES["global_sort"] = (
    queries_sql()
    + ","
    + ranked_sql(f"1.0 + {COS}", k=50)
    + " SELECT id, max(s) AS _score, count(*) AS n FROM hits GROUP BY id ORDER BY _score DESC, id"
)
