"""Language of whole texts by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.frames import free_name
from nearfield.llm.sampling import lowest_hashes

DIMS = 4096  # hashed letter n-grams, a power of two
GRAMS = 3  # n-grams of 1 to 3 letters
SAMPLE = 1000  # labelled texts a language is learned from, at most
CENTROIDS = 4  # per language
ROUNDS = 8
CLEARLY = 3.0  # times as near as its n-grams would be if scattered at random: what is less near is rejected,
NEAR = 0.5  # unless its cosine is this much: a very long text, in several languages, has nearly all n-grams
PIECE = 1_000_000  # letters handled at once; no n-gram spans two pieces
UNKNOWN = "und"

_FOLDED: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Lower case of every letter, and a blank for every other code point."""
    if not _FOLDED:
        chars = map(chr, range(0x110000))
        _FOLDED.append(np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in chars), dtype=np.uint32, count=0x110000))
    return _FOLDED[0]


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams of 1 to GRAMS letters of a text's words. Anything but a letter is a word's end."""
    shift = np.uint32(33 - DIMS.bit_length())
    keys = [np.empty(0, dtype=np.uint32)]
    for at in range(0, len(text or ""), PIECE):
        codes = np.frombuffer(f" {text[at : at + PIECE]} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = fold_table()[codes]
        word = codes != 32
        codes = codes[np.concatenate((word[:1], word[1:] | word[:-1])) | (np.arange(len(codes)) == 0)]
        mixed = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, GRAMS + 1):
            mixed = (mixed[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            hashed = (mixed * np.uint32(0x85EBCA77)) >> shift
            keys.append(hashed[codes != 32] if n == 1 else hashed if len(codes) > 2 else hashed[:0])
    return np.bincount(np.concatenate(keys), minlength=DIMS)


def weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams a text has, and their unit-length TF-IDF weights."""
    used = np.flatnonzero(counts)
    values = np.log1p(counts[used]) * idf[used]
    return used, values / max(1e-12, float(np.linalg.norm(values)))


def document_counts(docs: DataFrame, text: str) -> np.ndarray:
    """In how many texts each hashed n-gram occurs, and how many texts have letters (last)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(DIMS + 1, dtype=np.int64)
        for batch in batches:
            for one in batch["text"]:
                used = np.flatnonzero(gram_counts(one))
                seen[used] += 1
                seen[DIMS] += len(used) > 0
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": used, "n": seen[used]})

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "bucket long, n long")
    seen = np.zeros(DIMS + 1, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        seen[row["bucket"]] = row["n"]
    return seen


def clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starts: unit centroids."""
    start = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(start) < min(k, len(rows)):
        near = (rows @ rows[start].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        start.append(int(np.argmin(near)))
    centers = rows[start]
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ centers.T, axis=1)
        sums = np.stack([rows[nearest == c].sum(axis=0) if (nearest == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centers


class Centroids:
    """The learned model: unit ``centers`` and their languages.

    A text whose weights fell on n-grams at random would have the cosine
    sum(weights) * mean(center) to a center, however long it is. A text that is
    not CLEARLY nearer than this to its nearest center, nor NEAR it, is rejected.
    """

    def __init__(self, idf: np.ndarray, names: list[str], centers: np.ndarray):
        self.idf, self.names, self.centers = idf, names, centers
        self.columns = np.ascontiguousarray(centers.T)
        self.chance = CLEARLY * centers.mean(axis=1)

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is rejected."""
        used, values = weights(gram_counts(text), self.idf)
        if not len(used) or not self.names:
            return UNKNOWN, 0.0, True
        cosine = values @ self.columns[used]
        best = int(np.argmax(cosine))
        return self.names[best], float(min(max(cosine[best], 0), 1)), bool(cosine[best] < min(NEAR, values.sum() * self.chance[best]))


def learn(known: DataFrame, text: str = "text") -> Centroids:
    """Centroids and n-gram statistics from ``known`` rows (``doc_id``, ``lang``, text), and from no others.

    Of the rows with a language all count in how many texts an n-gram occurs. A language is learned from its SAMPLE rows with the lowest hash of
    ``doc_id``; the sample is chosen by id and language alone and only then
    joined to the texts. Rows without language, ``doc_id`` or letters teach
    nothing. Grouped tasks and the model are bounded by the number of languages.
    """
    known = known.where("lang IS NOT NULL")
    seen = document_counts(known, text)
    idf = (np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1).astype(np.float32)
    chosen = lowest_hashes(known.where("doc_id IS NOT NULL").select("lang", "doc_id").distinct(), SAMPLE, "lang")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros((len(frame), DIMS), dtype=np.float32)
        for row, text in zip(rows, frame.sort_values("doc_id", kind="stable")["text"]):
            used, values = weights(gram_counts(text), idf)
            row[used] = values
        rows = rows[rows.any(axis=1)]
        if not len(rows):
            return pd.DataFrame({"lang": [], "center": []})
        centers = clustered(rows, CENTROIDS)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "center": [c.astype("<f4").tobytes() for c in centers]})

    found = (
        known.select("lang", "doc_id", F.col(text).cast("string").alias("text"))
        .join(F.broadcast(chosen), ["lang", "doc_id"])
        .groupBy("lang", "doc_id")
        .agg(F.min("text").alias("text"))
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, center binary")
        .collect()
    )
    found.sort(key=lambda r: (r["lang"], bytes(r["center"])))
    centers = np.stack([np.frombuffer(r["center"], dtype="<f4") for r in found]) if found else np.zeros((0, DIMS), np.float32)
    return Centroids(idf, [r["lang"] for r in found], centers)


def identify(docs: DataFrame, model: Centroids, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with one more column ``name``: ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Where ``docs`` has a column of that name, underscores are added to the new one.
    ``und`` with score 0, and rejected, are null texts, texts without a letter,
    and all texts if nothing was learned. Ties go to the language first in
    alphabet. No row is moved or dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def look(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.nearest(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(free_name(docs, name), look(F.col(text).cast("string")))


def held_out(part: int, parts: int = 4):
    """Rows kept from learning: by crc32 of ``doc_id`` as text; rows without ``doc_id`` among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(True))


def learned_model(docs: DataFrame) -> Centroids:
    """The production model: learned from rows whose crc32(doc_id) mod 4 is not 2."""
    return learn(docs.where(~held_out(2)))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that have no letter or lie too far from every learned language."""
    name = free_name(docs, "language")
    return identify(docs, learned_model(docs), name=name).where(~F.col(name)["rejected"]).drop(name)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, learned_model(docs)).select(
        "doc_id", held_out(2).alias("held_out"), "language.lang_pred", "language.score", "language.rejected"
    )


QUERIES = {"op8_language_id": op8_language_id}
