"""Registered queries: clustered and hashed search, recall, sharding, graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nearfield.operators import descent
from nearfield.operators import graph as G
from nearfield.operators import ivf, lsh
from nearfield.operators import metric_join as J
from nearfield.operators import sharding as S
from nearfield.operators.blocks import best_pairs
from nearfield.operators.evaluation import recall_at_k
from nearfield.operators.exact import within_distance
from nearfield.operators.topk import top_k
from nearfield.plans.inputs import DIGITS, DIMS, corpus, queries_sql, ranked_sql, vector_queries
from nearfield.plans.vector_search import COS, knn_cosine
from nearfield.session import scratch_path

QUERIES = {}
ORACLES = {}

FIRST = 64  # nodes compared all with all before the others descend, few enough that small tables descend too

# --- clustered search --------------------------------------------------------------

NPROBE = 3
MEAN_DIGITS = 9


def class_means(spark, sf_dir):
    return ivf.group_means(corpus(spark, sf_dir), "label", digits=MEAN_DIGITS)


MEANS_SQL = f"""
comp AS (SELECT label::BIGINT AS cell, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT cell, i, round(avg(x), {MEAN_DIGITS}) AS x FROM comp GROUP BY cell, i),
cents AS (SELECT cell, list(x ORDER BY i) AS c FROM mean GROUP BY cell)"""

CELLS_SQL = f"""
{MEANS_SQL},
near AS (SELECT e.vec_id AS id, cell, round(list_distance(e.embedding::DOUBLE[], c), {DIGITS}) AS d FROM embeddings e, cents),
cells AS (SELECT id, cell, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cell) AS r FROM near) WHERE r = 1)"""


def ivf_assign(spark, sf_dir):
    filed = ivf.ivf_build(corpus(spark, sf_dir), class_means(spark, sf_dir), digits=DIGITS)
    return filed.select("id", "cell", "cell_distance")


QUERIES["ivf_assign"] = ivf_assign
ORACLES["ivf_assign"] = "WITH " + CELLS_SQL + " SELECT id, cell, d AS cell_distance FROM cells"


def ivf_search(spark, sf_dir):
    """Search of a stored index, of which only the probed cells are read."""
    means = class_means(spark, sf_dir)
    path = scratch_path(spark, "ivf")
    ivf.save_ivf(ivf.ivf_build(corpus(spark, sf_dir), means, digits=DIGITS), means, path, "l2")
    index, means, _ = ivf.load_ivf(spark, path)
    return ivf.ivf_search(vector_queries(spark, sf_dir), index, means, 10, NPROBE, digits=DIGITS)


IVF_HITS_SQL = f"""
pr AS (SELECT query_id, cell FROM (
  SELECT q.item_id AS query_id, cell, row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_distance(q.q, c), {DIGITS}), cell) AS r
  FROM q, cents) WHERE r <= {NPROBE}),
ivf AS (SELECT query_id, id, s, rank FROM (
  SELECT pr.query_id, c.id, round(1.0 + {COS}, {DIGITS}) AS s,
         row_number() OVER (PARTITION BY pr.query_id ORDER BY round(1.0 + {COS}, {DIGITS}) DESC, c.id) AS rank
  FROM pr JOIN cells USING (cell) JOIN corpus c USING (id) JOIN q ON q.item_id = pr.query_id WHERE NOT isnan({COS})) WHERE rank <= 10)"""

QUERIES["ivf_search"] = ivf_search
ORACLES["ivf_search"] = (
    queries_sql() + "," + CELLS_SQL + "," + IVF_HITS_SQL + " SELECT query_id, rank, id, s AS _score FROM ivf"
)


def ivf_search_routed(spark, sf_dir):
    """The same search with queries sent to the cells they probe, as it is done for any number of queries."""
    means = class_means(spark, sf_dir)
    index = ivf.ivf_build(corpus(spark, sf_dir), means, digits=DIGITS)
    return ivf.ivf_search_routed(vector_queries(spark, sf_dir), index, means, 10, NPROBE, digits=DIGITS)


QUERIES["ivf_search_routed"] = ivf_search_routed
ORACLES["ivf_search_routed"] = ORACLES["ivf_search"]


def recall_at_10(spark, sf_dir):
    return recall_at_k(ivf_search(spark, sf_dir), knn_cosine(spark, sf_dir), 10)


QUERIES["recall_at_10"] = recall_at_10
ORACLES["recall_at_10"] = (
    queries_sql()
    + ","
    + CELLS_SQL
    + ","
    + IVF_HITS_SQL
    + ","
    + ranked_sql(f"1.0 + {COS}")
    + " SELECT query_id, count(ivf.id)::DOUBLE / count(*) AS recall FROM hits LEFT JOIN ivf USING (query_id, id) GROUP BY query_id"
)


def ivf_kmeans_recall(spark, sf_dir):
    """Recall of a search over trained centroids, half of the cells probed."""
    rows = corpus(spark, sf_dir)
    centers = ivf.kmeans_centroids(rows, 8)
    hits = ivf.ivf_search(vector_queries(spark, sf_dir), ivf.ivf_build(rows, centers), centers, 10, 4, digits=DIGITS)
    return recall_at_k(hits, knn_cosine(spark, sf_dir), 10)


QUERIES["ivf_kmeans_recall"] = ivf_kmeans_recall


def ivf_kmeans_whole(spark, sf_dir):
    """A search over trained centroids that probes every cell finds what exact search finds."""
    rows = corpus(spark, sf_dir)
    centers = ivf.kmeans_centroids(rows, 8)
    return ivf.ivf_search(vector_queries(spark, sf_dir), ivf.ivf_build(rows, centers), centers, 10, 8, digits=DIGITS)


QUERIES["ivf_kmeans_whole"] = ivf_kmeans_whole
ORACLES["ivf_kmeans_whole"] = queries_sql() + "," + ranked_sql(f"1.0 + {COS}") + " SELECT query_id, rank, id, s AS _score FROM hits"

# --- hashed search --------------------------------------------------------------------


def lsh_buckets(spark, sf_dir):
    coded = lsh.lsh_codes(corpus(spark, sf_dir), DIMS)
    return lsh.lsh_buckets(coded)


def planes_sql(tables: int) -> str:
    return f"""
planes AS (SELECT t, d, CASE WHEN ('0x' || substr(md5(t::VARCHAR || ':' || d::VARCHAR), 1, 8))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS w
  FROM (SELECT unnest(range({tables})) AS t), (SELECT unnest(range({DIMS})) AS d))"""


def codes_sql(name: str, key: str, vec: str, source: str) -> str:
    return f"""
{name}_x AS (SELECT {key} AS id, unnest(range(len({vec}))) AS d, unnest({vec})::DOUBLE AS x FROM {source}),
{name} AS (SELECT id, t, CAST(round(sum(x * w), 9) >= 0 AS BIGINT) AS code FROM {name}_x JOIN planes USING (d) GROUP BY id, t)"""


QUERIES["lsh_buckets"] = lsh_buckets
ORACLES["lsh_buckets"] = (
    "WITH " + planes_sql(99) + "," + codes_sql("rc", "vec_id", "embedding", "embeddings") + " SELECT id, t AS table_id, code AS bucket FROM rc"
)


def lsh_search(spark, sf_dir):
    """Search of a stored table of packed signs."""
    path = scratch_path(spark, "lsh")
    lsh.save_lsh(corpus(spark, sf_dir), DIMS, path)
    return lsh.lsh_search(vector_queries(spark, sf_dir), spark.read.parquet(path), DIMS, digits=DIGITS)


QUERIES["lsh_search"] = lsh_search
ORACLES["lsh_search"] = (
    queries_sql()
    + ","
    + planes_sql(99)
    + ","
    + codes_sql("rc", "vec_id", "embedding", "embeddings")
    + ","
    + codes_sql("qc", "item_id", "q", "q")
    + f""",
m AS (SELECT qc.id AS query_id, rc.id, count(*) AS matches FROM qc JOIN rc USING (t, code) GROUP BY 1, 2),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, id) AS r FROM m) WHERE r <= 10),
sc AS (SELECT query_id, c.id, matches, round(1.0 + {COS}, {DIGITS}) AS s FROM cand JOIN corpus c USING (id) JOIN q ON q.item_id = query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, s AS _score, matches FROM sc WHERE NOT isnan(s)"""
)

TABLES, BITS = 12, 6


def lsh_bucket_join(spark, sf_dir):
    """Candidates by an equi-join on selective buckets: 12 tables of 6 bits."""
    rows = lsh.lsh_buckets(lsh.lsh_codes(corpus(spark, sf_dir), DIMS, TABLES, BITS))
    asked = lsh.lsh_buckets(lsh.lsh_codes(vector_queries(spark, sf_dir), DIMS, TABLES, BITS, vec="q"), id="query_id")
    return lsh.bucket_matches(asked, rows)


QUERIES["lsh_bucket_join"] = lsh_bucket_join
ORACLES["lsh_bucket_join"] = (
    queries_sql()
    + ","
    + planes_sql(TABLES * BITS)
    + ","
    + codes_sql("rc", "vec_id", "embedding", "embeddings")
    + ","
    + codes_sql("qc", "item_id", "q", "q")
    + f""",
rb AS (SELECT id, t // {BITS} AS tb, sum(code << ({BITS} - 1 - t % {BITS})) AS b FROM rc GROUP BY 1, 2),
qb AS (SELECT id AS query_id, t // {BITS} AS tb, sum(code << ({BITS} - 1 - t % {BITS})) AS b FROM qc GROUP BY 1, 2)
SELECT query_id, id, count(*) AS matches FROM qb JOIN rb USING (tb, b) GROUP BY 1, 2"""
)

# --- distances and shards ---------------------------------------------------------------------


def pairwise_median(spark, sf_dir):
    got = S.median_distance(corpus(spark, sf_dir))
    return got.withColumn("median_distance", F.round("median_distance", DIGITS))


PAIRS_SQL = """
p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1000),
d AS (SELECT list_distance(a.v, b.v) AS d FROM p a, p b)"""

QUERIES["pairwise_median"] = pairwise_median
ORACLES["pairwise_median"] = (
    "WITH " + PAIRS_SQL + f" SELECT round(median(d), {DIGITS}) AS median_distance, count(*) AS pairs FROM d"
)

RADIUS = 1.25


def distance_range(spark, sf_dir):
    """All vectors within a radius of the class means."""
    seeds = class_means(spark, sf_dir).select(F.col("cell").alias("query_id"), F.col("vector").alias("q"))
    got = within_distance(seeds, corpus(spark, sf_dir), 1.05, "l2", digits=DIGITS)
    return got


QUERIES["distance_range"] = distance_range
ORACLES["distance_range"] = (
    "WITH "
    + MEANS_SQL
    + f""", d AS (SELECT cell AS query_id, vec_id AS id, round(list_distance(embedding::DOUBLE[], c), {DIGITS}) AS distance FROM embeddings, cents)
SELECT * FROM d WHERE distance <= 1.05"""
)


def _shards(spark, sf_dir):
    return S.shard_by_distance(corpus(spark, sf_dir), RADIUS, m=40)


def shard_by_distance(spark, sf_dir):
    """At most 40 leaders; whatever they do not reach overflows to the nearest."""
    return _shards(spark, sf_dir)


def shards_sql(m: int) -> str:
    return f"""
p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
gap AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM p a, p b),
reach AS (SELECT a, list(b) AS bs FROM gap WHERE d <= {RADIUS} GROUP BY a),
rec(n, leader, covered) AS (
  SELECT 1, a, bs FROM reach WHERE a = (SELECT min(id) FROM p)
  UNION ALL
  SELECT n + 1, r.a, list_distinct(list_concat(covered, r.bs))
  FROM rec, reach r
  WHERE n < {m} AND r.a = (SELECT min(x) FROM (SELECT unnest(list_filter((SELECT list(id) FROM p), lambda i: NOT list_contains(covered, i))) AS x))),
led AS (SELECT n - 1 AS shard, leader FROM rec),
opt AS (SELECT b AS id, shard, leader, d, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN d <= {RADIUS} THEN 0 ELSE 1 END,
          CASE WHEN d <= {RADIUS} THEN shard END, d, shard) AS r FROM led JOIN gap ON gap.a = leader),
shards AS (SELECT id, shard::BIGINT AS shard_id, leader, d > {RADIUS} AS overflow FROM opt WHERE r = 1)"""

QUERIES["shard_by_distance"] = shard_by_distance
ORACLES["shard_by_distance"] = "WITH RECURSIVE " + shards_sql(40) + " SELECT id, shard_id, leader, overflow FROM shards"


def shard_by_leaders(spark, sf_dir):
    """As many leaders as it takes, found in parallel rounds."""
    return S.shard_by_leaders(corpus(spark, sf_dir), RADIUS)


QUERIES["shard_by_leaders"] = shard_by_leaders
ORACLES["shard_by_leaders"] = "WITH RECURSIVE " + shards_sql(1_000_000) + " SELECT id, shard_id, leader, overflow FROM shards"


def shard_counts(spark, sf_dir):
    return S.shard_sizes(_shards(spark, sf_dir))


QUERIES["shard_counts"] = shard_counts
ORACLES["shard_counts"] = "WITH RECURSIVE " + shards_sql(40) + " SELECT shard_id, count(*) AS n FROM shards GROUP BY shard_id"


def hash_shards(spark, sf_dir):
    return S.shard_sizes(S.hash_shards(corpus(spark, sf_dir), 2))


QUERIES["hash_shards"] = hash_shards
ORACLES["hash_shards"] = """
SELECT CAST(('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::UBIGINT % 2 AS BIGINT) AS shard_id, count(*) AS n FROM embeddings GROUP BY 1"""

# --- graph ------------------------------------------------------------------------------------------


def knn_graph(spark, sf_dir):
    return G.knn_graph(corpus(spark, sf_dir), 5, digits=DIGITS)


GRAPH_SQL = f"""
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), {DIGITS}), b.id) AS r
         FROM e a JOIN e b ON b.id < a.id),
edges AS (SELECT src, dst FROM near WHERE r <= 5 UNION SELECT dst, src FROM near WHERE r <= 5)"""

QUERIES["knn_graph"] = knn_graph
ORACLES["knn_graph"] = "WITH " + GRAPH_SQL + " SELECT src, dst FROM edges"


def knn_graph_descent(spark, sf_dir):
    """The same graph, found at a cost linear in the nodes."""
    return descent.knn_graph_descent(corpus(spark, sf_dir), 5, digits=DIGITS, first=FIRST)


QUERIES["knn_graph_descent"] = knn_graph_descent


def knn_graph_recall(spark, sf_dir):
    """How much of the exact neighbours descent finds, for every node whose id is divisible by 100."""
    rows = corpus(spark, sf_dir)
    asked = F.col("query_id") % 100 == 0
    found = descent.knn_edges_descent(rows, 5, digits=DIGITS, first=FIRST).select(F.col("src").alias("query_id"), F.col("dst").alias("id"))
    some = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    exact = top_k(best_pairs(some, rows, 5, "l2", digits=DIGITS, only="earlier"), 5, score="value", ascending=True)
    ranked = found.where(asked).withColumn("rank", F.lit(1).cast("long"))
    return recall_at_k(ranked, exact.select("query_id", "rank", "id"), 5)


QUERIES["knn_graph_recall"] = knn_graph_recall


def degree_rank(spark, sf_dir):
    return G.degree_rank(knn_graph(spark, sf_dir))


QUERIES["degree_rank"] = degree_rank
ORACLES["degree_rank"] = (
    "WITH "
    + GRAPH_SQL
    + """, deg AS (SELECT src, count(*) AS degree FROM edges GROUP BY src)
SELECT degree, count(*) AS nodes, sum(count(*)) OVER (ORDER BY degree DESC)::BIGINT AS rank FROM deg GROUP BY degree"""
)


def avg_path(spark, sf_dir):
    from nearfield.session import cut_lineage

    edges = cut_lineage(knn_graph(spark, sf_dir))
    return G.average_path(corpus(spark, sf_dir).select("id"), edges).withColumn("average_path", F.round("average_path", DIGITS))


QUERIES["avg_path"] = avg_path
ORACLES["avg_path"] = (
    "WITH RECURSIVE "
    + GRAPH_SQL
    + f""",
walk(source, id, hops) AS (
  SELECT id, id, 0 FROM e UNION SELECT source, dst, hops + 1 FROM walk JOIN edges ON src = id WHERE hops < 12),
best AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2)
SELECT round(sum(hops)::DOUBLE / count(*), {DIGITS}) AS average_path, count(*) AS pairs, max(hops)::BIGINT AS longest,
       (SELECT count(*) * (count(*) - 1) FROM e) - count(*) AS unreached FROM best WHERE hops > 0"""
)


def avg_path_sketch(spark, sf_dir):
    """The mean path of the whole graph, estimated with one sketch per node."""
    from nearfield.session import cut_lineage

    edges = cut_lineage(knn_graph_descent(spark, sf_dir))
    return G.average_path_sketch(corpus(spark, sf_dir).select("id"), edges)


QUERIES["avg_path_sketch"] = avg_path_sketch


def graph_search(spark, sf_dir):
    from nearfield.session import cut_lineage

    edges = cut_lineage(knn_graph(spark, sf_dir))
    return G.graph_search(vector_queries(spark, sf_dir), corpus(spark, sf_dir), edges, k=5, m=5, beam=20)


QUERIES["graph_search"] = graph_search


def graph_search_whole(spark, sf_dir):
    """A beam as wide as the graph, which is connected, finds what exact search finds."""
    from nearfield.session import cut_lineage

    rows = corpus(spark, sf_dir)
    edges = cut_lineage(knn_graph(spark, sf_dir))
    hits = G.graph_search(vector_queries(spark, sf_dir), rows, edges, k=5, m=5, beam=rows.count())
    return hits.withColumn("distance", F.round("distance", DIGITS))


QUERIES["graph_search_whole"] = graph_search_whole
ORACLES["graph_search_whole"] = (
    queries_sql()
    + ","
    + ranked_sql("list_distance(q.q, c.v)", k=5, direction="ASC")
    + " SELECT query_id, rank, id, s AS distance FROM hits"
)

# --- joins by distance ---------------------------------------------------------------------------------


def distance_join(spark, sf_dir):
    """All vectors joined with themselves by distance: partners of each, how many there are and the nearest."""
    rows = corpus(spark, sf_dir).select("id", "vector")
    links = J.count_within(rows, rows, 1.05, digits=DIGITS, only="others")
    return rows.select("id").join(links, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


QUERIES["distance_join"] = distance_join
ORACLES["distance_join"] = f"""
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.id, b.id AS other, round(list_distance(a.v, b.v), {DIGITS}) AS distance FROM e a JOIN e b ON b.id <> a.id),
near AS (SELECT id, count(*) AS n_links, min(other) AS lowest, min(distance) AS nearest FROM d WHERE distance <= 1.05 GROUP BY id)
SELECT e.id, coalesce(n_links, 0) AS n_links, lowest, nearest FROM e LEFT JOIN near USING (id)"""


def graph_search_stored(spark, sf_dir):
    """A whole search over the graph as a stored table of neighbours."""
    rows = corpus(spark, sf_dir)
    name = f"graph_{uuid.uuid4().hex}"
    graph = G.StoredGraph(spark, name).save(rows, knn_graph(spark, sf_dir), scratch_path(spark, name))
    hits = graph.search(vector_queries(spark, sf_dir), k=5, m=5, beam=rows.count())
    return hits.withColumn("distance", F.round("distance", DIGITS))


QUERIES["graph_search_stored"] = graph_search_stored
ORACLES["graph_search_stored"] = ORACLES["graph_search_whole"]
