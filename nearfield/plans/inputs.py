"""Input tables of the registered queries, and the SQL that derives the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.embedding import hash_embed
from nearfield.session import spread

DIMS = 64
DIGITS = 6  # scores are rounded before ranking, so both engines break ties alike


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a directory of part files: the path of either is a pattern."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored vectors as ``(id, vector, label)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts with a unit-length hashed vector ``q``."""
    return hash_embed(text_queries(spark, sf_dir), "text", DIMS, out_col="q").select("query_id", "q")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "id")


# --- the same in SQL ------------------------------------------------------------

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def words_sql(column: str) -> str:
    return WORDS.format(column)


def hash_vector_sql(source: str, key: str, text: str, name: str, dims: int = DIMS) -> str:
    """CTEs ending in ``name(key, q)``: unit-length hashed vectors of a text column."""
    return f"""
{name}_tok AS (SELECT {key} AS k, unnest({words_sql(text)}) AS token FROM {source}),
{name}_cnt AS (SELECT k, token, count(*) AS n FROM {name}_tok GROUP BY k, token),
{name}_dim AS (
  SELECT k, CAST(('0x' || substr(md5(token), 1, 8))::UBIGINT % {dims} AS BIGINT) AS d,
         CAST(sum(CASE WHEN ('0x' || substr(md5(token), 9, 8))::UBIGINT % 2 = 0 THEN n ELSE -n END) AS DOUBLE) AS x
  FROM {name}_cnt GROUP BY 1, 2),
{name}_len AS (SELECT k, sqrt(sum(x * x)) AS len FROM {name}_dim GROUP BY k),
{name}_grid AS (SELECT s.{key} AS k, g.i AS d FROM {source} s, (SELECT unnest(range({dims})) AS i) g),
{name} AS (
  SELECT g.k AS {key}, list(CASE WHEN coalesce(l.len, 0) = 0 THEN 0.0 ELSE coalesce(c.x, 0.0) / l.len END ORDER BY g.d) AS q
  FROM {name}_grid g LEFT JOIN {name}_dim c ON c.k = g.k AND c.d = g.d LEFT JOIN {name}_len l ON l.k = g.k
  GROUP BY g.k)"""


def queries_sql() -> str:
    """``q(item_id, q)`` and ``corpus(id, v, label)``."""
    return (
        "WITH "
        + hash_vector_sql("benchmark", "item_id", "text", "q")
        + ",\ncorpus AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
    )


def ranked_sql(score: str, k: int = 10, where: str = "TRUE", direction: str = "DESC") -> str:
    """CTE ``hits(query_id, rank, id, score)``: top k by a score over (q.q, c.v)."""
    return f"""
scored AS (SELECT q.item_id AS query_id, c.id, round({score}, {DIGITS}) AS s FROM q, corpus c WHERE {where}),
hits AS (
  SELECT query_id, rank, id, s FROM (
    SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s {direction}, id) AS rank
    FROM scored WHERE s IS NOT NULL AND NOT isnan(s)) WHERE rank <= {k})"""
