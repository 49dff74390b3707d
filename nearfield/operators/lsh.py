"""Hashed search: sign patterns of random hyperplanes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import cosine
from nearfield.operators.blocks import best_pairs, beside, map_vectors
from nearfield.operators.topk import top_k


ZERO_DIGITS = 9  # a dot product this close to zero counts as zero, whatever the order of summation


def planes(dims: int, tables: int, bits: int = 1) -> np.ndarray:
    """Fixed +-1 hyperplanes, (dims x tables*bits), drawn from md5."""
    out = np.empty((dims, tables * bits))
    for t in range(tables * bits):
        for d in range(dims):
            digest = hashlib.md5(f"{t}:{d}".encode()).hexdigest()
            out[d, t] = 1.0 if int(digest[:8], 16) % 2 == 0 else -1.0
    return out


def signs_packed(df: DataFrame, dims: int, tables: int = 99, vec: str = "vector", out: str = "packed") -> DataFrame:
    """Add the signs of one-bit tables, 64 to a number: 99 of them are two numbers."""
    normals = planes(dims, tables)

    def code(rows: np.ndarray) -> list[np.ndarray]:
        signs = np.round(rows @ normals, ZERO_DIGITS) >= 0
        wide = np.zeros((len(rows), -(-tables // 64) * 64), dtype=bool)
        wide[:, :tables] = signs
        return [np.packbits(wide, axis=1).view(np.int64)]

    return map_vectors(df, vec, code, [T.StructField(out, T.ArrayType(T.LongType()))])


def save_lsh(df: DataFrame, dims: int, path: str, tables: int = 99) -> None:
    """Write ``(id, packed, vector)``; a search reads ids and packed signs, and vectors of candidates only."""
    signs_packed(df.select("id", "vector"), dims, tables).select("id", "packed", "vector").write.parquet(path)


def lsh_codes(df: DataFrame, dims: int, tables: int = 99, bits: int = 1, vec: str = "vector", out: str = "codes") -> DataFrame:
    """Add the bucket number of every table: ``bits`` signs read as a binary number."""
    normals = planes(dims, tables, bits)
    weights = 1 << np.arange(bits - 1, -1, -1)

    def code(rows: np.ndarray) -> list[np.ndarray]:
        signs = (np.round(rows @ normals, ZERO_DIGITS) >= 0).astype(np.int64).reshape(len(rows), tables, bits)
        return [signs @ weights]

    return map_vectors(df, vec, code, [T.StructField(out, T.ArrayType(T.LongType()))])


def lsh_buckets(codes: DataFrame, id: str = "id", column: str = "codes") -> DataFrame:
    """``(id, table_id, bucket)`` rows."""
    return codes.select(F.col(id), F.posexplode(column).alias("table_id", "bucket")).withColumn(
        "table_id", F.col("table_id").cast("long")
    )


def bucket_matches(query_buckets: DataFrame, corpus_buckets: DataFrame, salt: int = 8) -> DataFrame:
    """``(query_id, id, matches)``: number of tables in which a query and a row share the bucket.

    For selective buckets (several bits). A crowded bucket is spread over ``salt``
    tasks by row id; matches are counted per task before the shuffle.
    """
    rows = corpus_buckets.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
    asked = query_buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return (
        rows.join(asked, ["table_id", "bucket", "salt"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("matches"))
    )


def lsh_candidates(queries: DataFrame, corpus: DataFrame, candidates: int) -> DataFrame:
    """The rows with most matching tables per query, by comparing codes directly.

    With few bits a bucket holds a large part of all rows, and joining on
    buckets would pair almost everything once per table. Comparing the compact
    codes gives the same counts in one scan without a shuffle.
    """
    pairs = best_pairs(queries, corpus, candidates, "matches", query_vec="codes", vec="codes")
    return top_k(pairs.where("value > 0"), candidates, score="value").select("query_id", "id", F.col("value").alias("matches"))


def packed_candidates(queries: DataFrame, corpus: DataFrame, candidates: int, tables: int) -> DataFrame:
    """The same from packed signs: tables that match are those without a differing bit."""
    pairs = best_pairs(queries, corpus, candidates, "hamming", query_vec="packed", vec="packed")
    matches = (F.lit(tables) - F.col("value")).alias("matches")
    return top_k(pairs.where(F.col("value") < tables), candidates, score="value", ascending=True).select("query_id", "id", matches)


def lsh_search(
    queries: DataFrame,
    corpus: DataFrame,
    dims: int,
    k: int = 10,
    candidates: int = 10,
    tables: int = 99,
    bits: int = 1,
    digits: int | None = None,
) -> DataFrame:
    """Candidates by matching hashes, reranked by exact ``1 + cosine``.

    A corpus read from ``save_lsh``, or with ``codes``, is not coded again. Tables
    of one bit are compared packed.
    """
    if "codes" not in corpus.columns and bits == 1:
        coded = corpus if "packed" in corpus.columns else signs_packed(corpus, dims, tables)
        found = packed_candidates(signs_packed(queries, dims, tables, vec="q"), coded, candidates, tables)
    else:
        coded = corpus if "codes" in corpus.columns else lsh_codes(corpus, dims, tables, bits)
        found = lsh_candidates(lsh_codes(queries, dims, tables, bits, vec="q"), coded, candidates)
    vectors = corpus.select("id", "vector").join(beside(found, queries, candidates), "id")
    score = 1.0 + cosine(F.col("q"), F.col("vector"))
    scored = vectors.join(queries.select("query_id", "q"), "query_id").withColumn(
        "_score", score if digits is None else F.round(score, digits)
    )
    return top_k(scored, k).select("query_id", "rank", "id", "_score", F.col("matches").cast("long").alias("matches"))
