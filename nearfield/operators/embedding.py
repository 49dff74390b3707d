"""Vectors for texts: a pluggable batch embedder, mean pooling, projections, size estimates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.text import words
from nearfield.functions.vectors import l2_normalise, to_payload
from nearfield.operators.blocks import few_items, list_rows, map_vectors, matrix, vector_means
from nearfield.session import cut_lineage

SEEN_WORDS = 200_000  # words whose place a task remembers; it is computed again for others

# An embedder turns an Arrow array of prepared texts into a matrix, one row per
# text. It is made once per task by calling the factory, so a model loads once.
Embedder = Callable[[pa.Array], np.ndarray]


class HashEmbedder:
    """Signed feature hashing of words into ``dims`` components, L2 normalised.

    Needs no model file: component and sign of a word come from its md5. Works
    on the flat word column of a batch; only distinct words are hashed.
    """

    def __init__(self, dims: int = 64):
        self.dims = dims
        self.seen: dict[str, tuple[int, int]] = {}

    @staticmethod
    def prepare(text: Column) -> Column:
        return words(text)

    def place(self, word: str) -> tuple[int, int]:
        got = self.seen.get(word)
        if got is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            got = (int(digest[:8], 16) % self.dims, 1 if int(digest[8:16], 16) % 2 == 0 else -1)
            if len(self.seen) < SEEN_WORDS:
                self.seen[word] = got
        return got

    def __call__(self, tokens: pa.ListArray) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([tokens], names=["tokens"])
        return np.concatenate([np.empty((0, self.dims)), *(self._vectors(some.column("tokens")) for some in few_items(batch, "tokens"))])

    def _vectors(self, tokens: pa.ListArray) -> np.ndarray:
        rows = len(tokens)
        row = list_rows(tokens)
        coded = tokens.flatten().dictionary_encode()
        if not len(row):
            return np.zeros((rows, self.dims))
        placed = np.array([self.place(w) for w in coded.dictionary.to_pylist()], np.int64)
        word = coded.indices.to_numpy()
        cell = row * self.dims + placed[word, 0]
        out = np.bincount(cell, placed[word, 1].astype(float), rows * self.dims).reshape(rows, self.dims)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


class TextEmbedder:
    """Any function from a list of strings to a matrix, such as the encode method of a model."""

    def __init__(self, encode: Callable[[list[str]], np.ndarray]):
        self.encode = encode

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.asarray(self.encode(texts.to_pylist()), float)


def embed(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], Embedder],
    out_col: str = "vector",
    target: str = "array",
    prepare: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Attach a vector per row. The prepared text goes to Python in Arrow batches; no shuffle.

    ``target`` is ``array`` or ``payload`` (index|value text); anything else is an error.
    """
    if target not in ("array", "payload"):
        raise ValueError(f"unknown target: {target}")
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    prepare = prepare or getattr(factory, "prepare", None) or (lambda c: c)
    fed = df.withColumn("_fed", prepare(F.col(text_col)))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            rows = model(batch.column("_fed"))
            offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
            vectors = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()))
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, vectors], names=[*names, out_col])

    out = fed.mapInArrow(run, schema)
    if target == "payload":
        return out.withColumn(out_col, to_payload(F.col(out_col)))
    return out


def hash_embed(df: DataFrame, text_col: str, dims: int = 64, out_col: str = "vector", target: str = "array") -> DataFrame:
    return embed(df, text_col, lambda: HashEmbedder(dims), out_col, target, HashEmbedder.prepare)


def mean_pool(df: DataFrame, id_col: str, text_col: str, table: DataFrame, keep: bool = False) -> DataFrame:
    """Average of the token vectors of a text, repeated tokens counted each time.

    ``table`` is ``(token, vec)``; tokens without a vector are left out. A text
    without any known token has no row, or with ``keep`` a null vector.

    The vectors of the HOT words that a sample of SAMPLED texts holds most often
    travel to the texts and are summed up there; only other words are counted per
    text and joined. Which words travel does not change the means.
    """
    known = hot_vectors(df, text_col, table)
    width = len(known.column("vec")[0]) if known.num_rows else 0
    rows = df.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("tokens")).mapInArrow(
        _sums_and_rest(known.column("token").combine_chunks(), matrix(known.column("vec"), np.float64) if width else np.empty((0, 0))),
        "id long, n long, vec array<double>, token string",
    )
    parts = cut_lineage(rows)
    rest = parts.where("token IS NOT NULL").select("id", "n", "token").join(table.select("token", F.col("vec").cast("array<double>").alias("vec")), "token")
    all_rows = parts.where("token IS NULL").select("id", "n", "vec").unionByName(rest.select("id", "n", "vec"))
    means = vector_means(all_rows, "id", "vec", weight="n").select(F.col("key").alias("id"), "vector")
    return df.select(F.col(id_col).alias("id")).distinct().join(means, "id", "left") if keep else means


HOT, HOT_CELLS = 200_000, 8_000_000  # words, and components of their vectors (64 MB), that travel to the texts at most
SAMPLED = 20_000  # texts about that choose them


def hot_vectors(df: DataFrame, text_col: str, table: DataFrame) -> pa.Table:
    """``(token, vec)`` of common words of ``df`` that ``table`` knows once."""
    first = table.select(F.size("vec").alias("n")).where("n > 0").first()
    most = 0 if first is None else min(HOT, HOT_CELLS // first["n"])
    texts = df.select(F.col(text_col).alias("text"))
    count = texts.count()
    texts = texts if count <= SAMPLED else texts.sample(SAMPLED / count, seed=1)
    common = texts.select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common = common.orderBy(F.col("n").desc(), "token").limit(most)
    vectors = table.select("token", F.col("vec").cast("array<double>").alias("vec"))
    found = vectors.where(F.col("vec").isNotNull()).join(F.broadcast(common.select("token")), "token", "left_semi").toArrow()
    times = pc.value_counts(found.column("token"))
    once = times.field("values").filter(pc.equal(times.field("counts"), 1))
    return found.filter(pc.is_in(found.column("token"), value_set=once))


def _sums_and_rest(known: pa.Array, vectors: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text its number of ``known`` words and their mean vector, without a token, and a row with its count for every other word."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in few_items(whole, "tokens")):
            coded = pc.dictionary_encode(batch.column("tokens").flatten())
            place = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = coded.indices.to_numpy()
            row, word = list_rows(batch.column("tokens")), place[code]
            hot = word >= 0
            n = np.bincount(row[hot], minlength=batch.num_rows)
            own = np.flatnonzero(n)
            at, words_at = row[hot], word[hot]
            sums = np.stack([np.bincount(at, vectors[words_at, d], batch.num_rows)[own] for d in range(vectors.shape[1])], axis=1) if len(own) else vectors[:0]
            size = max(1, len(coded.dictionary))
            cells, counts = np.unique(row[~hot] * size + code[~hot], return_counts=True)
            offsets = np.concatenate([np.arange(len(own) + 1) * vectors.shape[1], np.full(len(cells), sums.size)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.concatenate([own, cells // size]))),
                    pa.array(np.concatenate([n[own], counts]), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((sums / n[own, None]).ravel(), pa.float64())),
                    pa.concat_arrays([pa.nulls(len(own), pa.string()), coded.dictionary.take(pa.array(cells % size))]),
                ],
                names=["id", "n", "vec", "token"],
            )

    return look


def projection_matrix(dims: int, k: int) -> np.ndarray:
    """Fixed +-1 matrix (dims x k) drawn from md5."""
    out = np.empty((dims, k))
    for j in range(k):
        for i in range(dims):
            digest = hashlib.md5(f"{j}:{i}".encode()).hexdigest()
            out[i, j] = 1.0 if int(digest[:8], 16) % 2 == 0 else -1.0
    return out


def project(df: DataFrame, vec: str, weights: np.ndarray, out_col: str) -> DataFrame:
    """Multiply every vector by a fixed (dims x k) matrix."""
    return map_vectors(df, vec, lambda rows: [rows @ weights], [T.StructField(out_col, T.ArrayType(T.DoubleType()))])


def reduce_dims(df: DataFrame, vec: str, k: int, dims: int, method: str = "projection", out_col: str = "reduced") -> DataFrame:
    """``projection``: seeded +-1 random projection over sqrt(k). ``pca``: fitted on the frame."""
    if method == "projection":
        return project(df, vec, projection_matrix(dims, k) / np.sqrt(k), out_col)
    if method == "pca":
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        known = df.where(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("_dense"))
        return project(df, vec, PCA(k=k, inputCol="_dense", outputCol="_reduced").fit(known).pc.toArray(), out_col)
    raise ValueError(f"unknown method: {method}")


def unit_export(df: DataFrame, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """Rows as stored for other engines: id as text, unit-length float vector."""
    return df.select(F.col(id_col).cast("string").alias("id"), l2_normalise(F.col(vec)).cast("array<float>").alias("vector"))


def index_size(df: DataFrame, vec: str = "vector", m: int = 16, replicas: int = 0) -> DataFrame:
    """Memory a graph index would take: 1.1 * (4 * dims + 8 * m) bytes per vector and copy."""
    facts = df.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size(vec)).cast("long").alias("dims"))
    per_vector = 1.1 * (4 * F.col("dims") + 8 * m)
    return facts.select(
        "vectors",
        "dims",
        (per_vector * F.col("vectors") * (1 + replicas)).alias("index_bytes"),
        (F.col("vectors") * m * 8).alias("link_bytes_min"),
        (F.col("vectors") * m * 10).alias("link_bytes_max"),
    )
