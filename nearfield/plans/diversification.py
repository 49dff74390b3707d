"""Registered queries: reordering of hit lists, rescoring, feature logging, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.operators import diversify as D
from nearfield.operators import ranking as R
from nearfield.functions.vectors import cosine
from nearfield.operators.blocks import beside
from nearfield.operators.exact import attach, search_exact
from nearfield.operators.ivf import assign
from nearfield.operators.lexical import bm25
from nearfield.operators.embedding import hash_embed
from nearfield.plans.ann_search import CELLS_SQL, MEANS_SQL, class_means
from nearfield.plans.inputs import DIGITS, DIMS, corpus, documents, hash_vector_sql, queries_sql, ranked_sql, table, text_queries, vector_queries
from nearfield.plans.text_search import bm25_sql
from nearfield.plans.vector_search import COS
from nearfield.session import cut_lineage, scratch_path

QUERIES = {}
ORACLES = {}

DEPTH = 20


def hit_vectors(spark, sf_dir):
    """The 20 best hits of every query with their vectors."""
    rows = corpus(spark, sf_dir)
    hits = search_exact(vector_queries(spark, sf_dir), rows, DEPTH, "cosine1p", digits=DIGITS)
    return attach(hits, rows, ["vector", "label"])


HITS_SQL = queries_sql() + "," + ranked_sql(f"1.0 + {COS}", k=DEPTH)


def old_index(spark, sf_dir):
    """An unknown method keeps the order."""
    return D.diversify(hit_vectors(spark, sf_dir), "none").select("query_id", "rank", "id", "old_index")


QUERIES["old_index"] = old_index
ORACLES["old_index"] = HITS_SQL + " SELECT query_id, rank, id, rank - 1 AS old_index FROM hits"


def shuffle(spark, sf_dir):
    return D.diversify(hit_vectors(spark, sf_dir), "random").select("query_id", "rank", "id", "old_index")


QUERIES["shuffle"] = shuffle
ORACLES["shuffle"] = (
    HITS_SQL
    + f""" SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('{D.SEED}:' || id), id) AS rank, id, rank - 1 AS old_index FROM hits"""
)


def dpp(spark, sf_dir):
    return D.diversify(hit_vectors(spark, sf_dir), "dpp").select("query_id", "rank", "id", "old_index", "_score")


QUERIES["dpp"] = dpp
ORACLES["dpp"] = (
    HITS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
l AS (SELECT query_id, count(*) AS n, list(id ORDER BY rank) AS ids, list(s ORDER BY rank) AS s, list(v ORDER BY rank) AS vs
      FROM hits JOIN corpus USING (id) GROUP BY query_id),
kern AS (SELECT query_id, n, ids, s, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1),
           lambda j: s[i] * s[j] * list_cosine_similarity(vs[i], vs[j]))) AS kern FROM l),
pick(query_id, step, best, gain, basis) AS (
  SELECT query_id, 0, NULL::BIGINT, list_transform(range(1, n + 1), lambda i: kern[i][i]), []::DOUBLE[][] FROM kern
  UNION ALL
  SELECT query_id, step + 1, best,
         list_transform(range(1, n + 1), lambda j: CASE WHEN j = best THEN '-inf'::DOUBLE ELSE gain[j] - dir[j] * dir[j] END),
         list_append(basis, dir)
  FROM (SELECT *, list_transform(range(1, n + 1), lambda j:
                 (kern[best][j] - coalesce(list_sum(list_transform(basis, lambda b: b[best] * b[j])), 0.0)) / sqrt(gain[best])) AS dir
        FROM (SELECT p.query_id, p.step, p.gain, p.basis, k.n, k.kern, list_position(p.gain, list_max(p.gain)) AS best
              FROM pick p JOIN kern k USING (query_id)
              WHERE p.step < k.n AND list_max(p.gain) >= {D.GAIN_FLOOR})))
SELECT query_id, step::BIGINT AS rank, ids[best] AS id, best - 1 AS old_index, s[best] AS _score FROM pick JOIN kern USING (query_id) WHERE step > 0"""
)


def dpp_first_two(spark, sf_dir):
    return D.dpp_first_two(hit_vectors(spark, sf_dir)).withColumn("gain", F.round("gain", 5))


QUERIES["dpp_first_two"] = dpp_first_two
ORACLES["dpp_first_two"] = (
    HITS_SQL
    + """,
h AS (SELECT query_id, rank, id, s, v, s * s AS gain FROM hits JOIN corpus USING (id)),
f AS (SELECT * FROM h WHERE rank = 1),
g AS (SELECT h.query_id, h.id, h.rank, h.gain - (h.s * f.s * list_cosine_similarity(h.v, f.v)) ** 2 / f.gain AS gain
      FROM h JOIN f USING (query_id) WHERE h.rank > 1),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS r FROM g)
SELECT query_id, 1::BIGINT AS pick, id, round(gain, 5) AS gain FROM f UNION ALL
SELECT query_id, 2::BIGINT AS pick, id, round(gain, 5) AS gain FROM w WHERE r = 1"""
)


def kmeans_reorder(spark, sf_dir):
    return D.diversify(hit_vectors(spark, sf_dir), "kmeans").select("query_id", "rank", "id", "old_index", "_score")


QUERIES["kmeans_reorder"] = kmeans_reorder


def cluster_reorder_fixed(spark, sf_dir):
    """Hits grouped by the nearest class mean, otherwise in their old order."""
    filed = assign(hit_vectors(spark, sf_dir), class_means(spark, sf_dir), digits=DIGITS)
    return D.cluster_order(filed).select("query_id", "rank", "id", "old_index", "cell")


QUERIES["cluster_reorder_fixed"] = cluster_reorder_fixed
ORACLES["cluster_reorder_fixed"] = (
    HITS_SQL
    + ","
    + CELLS_SQL
    + """ SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cell, rank) AS rank, id, rank - 1 AS old_index, cell
FROM hits JOIN cells USING (id)"""
)


def closest_member(spark, sf_dir):
    """The nearest vector of every class mean, no vector used twice."""
    got = D.closest_to_centroids(corpus(spark, sf_dir), class_means(spark, sf_dir))
    return got.withColumn("distance", F.round("distance", DIGITS))


QUERIES["closest_member"] = closest_member
ORACLES["closest_member"] = (
    "WITH RECURSIVE "
    + MEANS_SQL
    + f""",
gap AS (SELECT cell, vec_id AS id, list_distance(embedding::DOUBLE[], c) AS d FROM embeddings, cents),
ord AS (SELECT cell, row_number() OVER (ORDER BY cell) AS n FROM cents),
pick(n, cell, id, d, used) AS (
  SELECT * FROM (SELECT n, cell, id, d, [id] FROM ord JOIN gap USING (cell) WHERE n = 1 ORDER BY d, id LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT o.n, o.cell, g.id, g.d, list_append(p.used, g.id) FROM pick p JOIN ord o ON o.n = p.n + 1 JOIN gap g ON g.cell = o.cell
                 WHERE NOT list_contains(p.used, g.id) ORDER BY g.d, g.id LIMIT 1))
SELECT cell, id, round(d, {DIGITS}) AS distance FROM pick"""
)


def similarity_matrix(spark, sf_dir):
    return D.similarity_matrix(hit_vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", DIGITS))


QUERIES["similarity_matrix"] = similarity_matrix
ORACLES["similarity_matrix"] = (
    HITS_SQL
    + f""", h AS (SELECT query_id, rank - 1 AS i, v FROM hits JOIN corpus USING (id))
SELECT a.query_id, a.i, b.i AS j, round(list_cosine_similarity(a.v, b.v), {DIGITS}) AS similarity FROM h a JOIN h b USING (query_id)"""
)


def categories_multihot(spark, sf_dir):
    """Hits on documents with 0/1 vectors over the languages and sources of the hit list."""
    docs = documents(spark, sf_dir)
    vectors = hash_embed(docs.select("id", "text"), "text", DIMS).select("id", "vector")
    hits = search_exact(vector_queries(spark, sf_dir), vectors, DEPTH, "cosine1p", digits=DIGITS)
    tagged = attach(hits, docs.select("id", F.array("lang", F.coalesce("source", F.lit("?"))).alias("cats")), ["cats"])
    return D.multi_hot(tagged, "cats").select(
        "query_id", "rank", "id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), "").alias("bits")
    )


QUERIES["categories_multihot"] = categories_multihot
ORACLES["categories_multihot"] = (
    "WITH "
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + ","
    + hash_vector_sql("documents", "doc_id", "text", "d")
    + ",\ncorpus AS (SELECT doc_id AS id, q AS v FROM d),"
    + ranked_sql(f"1.0 + {COS}", k=DEPTH)
    + """,
t AS (SELECT query_id, rank, hits.id, [lang, coalesce(source, '?')] AS cats FROM hits JOIN documents ON doc_id = hits.id),
voc AS (SELECT query_id, list_sort(list(DISTINCT c)) AS words FROM (SELECT query_id, unnest(cats) AS c FROM t) GROUP BY query_id)
SELECT query_id, rank, id, array_to_string(list_transform(words, lambda c: CASE WHEN list_contains(cats, c) THEN '1' ELSE '0' END), '') AS bits
FROM t JOIN voc USING (query_id)"""
)

# --- learning to rank ------------------------------------------------------------------------------

NAMES = ["bm25", "cosine", "length", "absent"]


def logged(spark, sf_dir):
    """BM25 hits on documents with their features, each computed for every hit; one feature is never there.

    The hits' texts are fetched by one filtered scan, and only they are embedded.
    """
    docs = documents(spark, sf_dir)
    hits = attach(bm25(text_queries(spark, sf_dir), docs, 50, digits=DIGITS), docs, ["text", "n_chars"])
    asked = vector_queries(spark, sf_dir)
    rows = hash_embed(hits, "text", DIMS).join(beside(asked, asked, 1), "query_id")
    values = {
        "bm25": F.col("_score"),
        "cosine": F.round(cosine(F.col("q"), F.col("vector")), DIGITS),
        "length": F.round(F.log(F.col("n_chars") + 1), DIGITS),
    }
    return R.log_columns(rows, values, NAMES).select("query_id", "rank", "id", "_score", "ltr_features")


LTR_SQL = (
    "WITH "
    + bm25_sql("documents", "doc_id", "text", " * 2.2::DOUBLE", k=50)
    + ","
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + ","
    + hash_vector_sql("documents", "doc_id", "text", "d")
    + f""",
ltr AS (SELECT b.query_id, b.rank, b.id, b.s, b.s AS f1, coalesce(round(list_cosine_similarity(q.q, d.q), {DIGITS}), 0.0) AS f2,
               round(ln(n_chars + 1), {DIGITS}) AS f3, 0.0 AS f4
        FROM b_hits b JOIN documents ON documents.doc_id = b.id JOIN d ON d.doc_id = b.id JOIN q ON q.item_id = b.query_id)"""
)


def feature_log(spark, sf_dir):
    rows = logged(spark, sf_dir)
    return rows.select(
        "query_id", "rank", "id", *[F.round(F.col("ltr_features")[i], DIGITS).alias(f"f{i + 1}") for i in range(4)]
    )


QUERIES["feature_log"] = feature_log
ORACLES["feature_log"] = LTR_SQL + " SELECT query_id, rank, id, f1, f2, f3, f4::DOUBLE AS f4 FROM ltr"

WEIGHTS = {"cosine": 25.0, "length": -0.4}


def linear_rescore(spark, sf_dir):
    """The first 30 hits get a linear model on top, the other 20 follow."""
    out = R.rescore(logged(spark, sf_dir), NAMES, WEIGHTS, window=30, digits=DIGITS)
    return out.select("query_id", "rank", "first_rank", "id", "_score")


QUERIES["linear_rescore"] = linear_rescore
ORACLES["linear_rescore"] = (
    LTR_SQL
    + f""",
r AS (SELECT query_id, rank AS first_rank, id, round(CASE WHEN rank <= 30 THEN s + 25.0::DOUBLE * f2 - 0.4::DOUBLE * f3 ELSE s END, {DIGITS}) AS t FROM ltr)
SELECT query_id, first_rank, id, t AS _score, row_number() OVER (PARTITION BY query_id
  ORDER BY first_rank <= 30 DESC, CASE WHEN first_rank <= 30 THEN t END DESC, CASE WHEN first_rank > 30 THEN first_rank END, id) AS rank FROM r"""
)


def train_ranker(spark, sf_dir):
    """A linear model of document quality from logged features, applied to all hits."""
    rows = cut_lineage(logged(spark, sf_dir))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    model = R.train_ranker(rows.join(labels, "id"), "label")
    return model.transform(R.as_vectors(rows)).select("query_id", "rank", "id", F.round("prediction", DIGITS).alias("prediction"))


QUERIES["train_ranker"] = train_ranker

STEPS, RATE = 20, 0.01


def train_pairwise(spark, sf_dir):
    """A model of which hit is of better quality, from pairs of hits, stored under its name and read back."""
    rows = logged(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    weights = R.train_pairwise(rows.join(labels, "id"), steps=STEPS, rate=RATE)
    models = R.Models(spark, scratch_path(spark, "models"))
    models.put("quality", NAMES, weights)
    return models.get("quality").select("feature", F.round("weight", DIGITS).alias("weight"))


_STEP = ", ".join(f"any_value(w{i}) + {RATE}::DOUBLE * avg((a.f{i} - b.f{i}) / (1.0 + exp({' + '.join(f'w{j} * (a.f{j} - b.f{j})' for j in range(1, 5))})))" for i in range(1, 5))
QUERIES["train_pairwise"] = train_pairwise
ORACLES["train_pairwise"] = (
    LTR_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
j AS (SELECT ltr.query_id, f1::DOUBLE AS f1, f2::DOUBLE AS f2, f3::DOUBLE AS f3, f4::DOUBLE AS f4, quality FROM ltr JOIN labels ON labels.doc_id = ltr.id),
w(step, w1, w2, w3, w4) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT step + 1, {_STEP} FROM w, j a JOIN j b ON a.query_id = b.query_id AND a.quality > b.quality WHERE step < {STEPS} GROUP BY step)
SELECT unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS feature, unnest([round(w1, {DIGITS}), round(w2, {DIGITS}), round(w3, {DIGITS}), round(w4, {DIGITS})]) AS weight
FROM w WHERE step = {STEPS}"""
)
