"""Toxicity of texts whose disguised words a noisy-channel decoder has restored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.language import fold_table
from nearfield.llm.sampling import lowest_hashes
from nearfield.session import cut_lineage

# fixed values: what a sign may stand for, and what it costs (negative log probability)
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SIGN_COST = 1.0
FILLERS = " .,-_*~'/\\|+"
DROP_COST = 0.5  # of a filler between letters
KEEP_COST = 6.0  # of a sign left as it is, which ends a word
REPEAT_COST = 0.3  # of each letter of a run of three or more that only repeats the one before

CLASSES = 64  # of the character model: end of a word, a to z, and 37 classes of other letters
LABELLED = 15_000  # labelled rows that the classifier is learned from, at most
LEARN_PARTS = 8
PREFIXES = (4, 5, 6)
LEAST_DOCS = 5  # toxic documents with a feature that may weigh
LEAST_G = 24.0  # log-likelihood ratio (G2) by which a feature must lean to toxic texts
CACHE = 200_000
PIECE = 100_000  # code points counted at once

# four single characters or more with fillers between them
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .,\-_*~/]{1,2}[^\W_\s]){3,}(?![^\W_])")
SIGN_RUN = re.compile(r"[0-9@$!|+(<€£¡*_~.\-]+")
SPACE = re.compile(r"\s")
EDGE = re.compile(r"^[^\w@$!|+(<€£¡]+|[^\w@$]+$")
WORD = re.compile(r"[^\W\d_]+")


def classes() -> np.ndarray:
    """Class of every code point: 0 for anything but a letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    codes = np.flatnonzero(fold_table() != 32)
    out[codes] = 27 + codes % (CLASSES - 27)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    return out


_CLASSES: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(classes())
    return _CLASSES[0]


def trigrams(texts: list[str | None]) -> np.ndarray:
    """Counts of class triples of the words of texts, as positions in a cube of CLASSES."""
    total = np.zeros(CLASSES**3, dtype=np.int64)
    table = class_table()
    for at in range(0, len(texts), 256):
        joined = "  ".join(["", *(t.lower() for t in texts[at : at + 256] if t), ""])
        for low in range(0, len(joined), PIECE):
            codes = np.frombuffer(joined[max(0, low - 2) : low + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            c = table[codes].astype(np.int64)
            keys = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            total += np.bincount(keys[(c[1:-1] > 0) | (c[2:] > 0)], minlength=len(total))
    return total


class CharacterModel:
    """Trigram model over letter classes, interpolated with bigrams and single classes."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        one = cube.sum(axis=(0, 1)) + 1
        two = cube.sum(axis=0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (cube + 5 * p2[None]) / (cube.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(p3).astype(np.float32)

    def restore(self, text: str) -> str:
        """The cheapest reading of a disguised stretch: Viterbi over its character lattice.

        Each sign may be a letter it stands for, or itself; each filler between
        letters may be nothing or the end of a word; each letter may be itself
        or, in a run of three or more, only repeat the one before it.
        """
        table, cost = class_table(), self.cost
        # what is written so far is a chain of (letter, chain before), so that a step costs the same at any length
        paths: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        text = text.lower()
        for at, c in enumerate(text):
            run = c * 3 in text[max(0, at - 2) : at + 3]
            options = []  # (written letter or blank, extra cost)
            if table[ord(c)]:
                options.append((c, 0.0))
            else:
                options += [(x, SIGN_COST) for x in SIGNS.get(c, "")]
                if c in FILLERS:
                    options += [("", DROP_COST), (" ", 0.0)]
                else:
                    options.append((" ", KEEP_COST if c in SIGNS else 0.0))
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (so_far, out) in paths.items():
                for x, extra in options:
                    if x == "":
                        key, value, word = (a, b, last), so_far + extra, out
                    elif x == " ":
                        if b == 0:
                            key, value, word = (0, 0, ""), so_far + extra, out
                        else:
                            key, value, word = (0, 0, ""), so_far + extra + float(cost[a, b, 0]), (" ", out)
                    else:
                        k = int(table[ord(x)])
                        key, value, word = (b, k, x), so_far + extra + float(cost[a, b, k]), (x, out)
                        if x == last and run:
                            again = (a, b, last)
                            if again not in after or so_far + extra + REPEAT_COST < after[again][0]:
                                after[again] = (so_far + extra + REPEAT_COST, out)
                    if key not in after or value < after[key][0]:
                        after[key] = (value, word)
            paths = after
        ends = [(so_far + (float(cost[a, b, 0]) if b else 0.0), out) for (a, b, _), (so_far, out) in paths.items()]
        least = min(e for e, _ in ends)
        return min(_written(out) for e, out in ends if e == least).strip()


def _written(chain: tuple | None) -> str:
    letters = []
    while chain is not None:
        letter, chain = chain
        letters.append(letter)
    return "".join(reversed(letters))


_MODELS: dict = {}


def _restorer(key: str, counts) -> callable:
    if key not in _MODELS:
        _MODELS.clear()
        model = CharacterModel(counts.value)
        short = lru_cache(maxsize=CACHE)(model.restore)
        _MODELS[key] = lambda part: short(part) if len(part) <= REMEMBERED else model.restore(part)
    return _MODELS[key]


REMEMBERED = 200  # readings of longer stretches are not kept for the next text


def disguised(lower: str) -> list[tuple[int, int]]:
    """Stretches that may hide a word: spaced letters, and tokens with a sign beside a letter or a letter three times.

    A run of signs counts between two letters and, of one or two signs, at
    either end of them; full stops, hyphens and the like only between letters.
    A stretch may have any length, and stretches that overlap are one.
    """
    found = [m.span() for m in SPACED.finditer(lower)]
    marks = []
    for m in SIGN_RUN.finditer(lower):
        low, high = m.span()
        before = low > 0 and lower[low - 1].isalpha()
        after = high < len(lower) and lower[high].isalpha()
        if before and after or (before or after) and high - low < 3 and any(c in SIGNS and c not in "!|+" for c in m.group()):
            marks.append(low)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    marks += [int(i) for i in np.flatnonzero((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])) if lower[i].isalpha()]
    end = 0
    for mark in sorted(marks):
        if mark < end:
            continue
        low = mark
        while low > end and not lower[low - 1].isspace():
            low -= 1
        after = SPACE.search(lower, mark)
        end = after.start() if after else len(lower)
        found.append((low, end))
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def restored_words(text: str | None, restore) -> list[str]:
    """Words of a text in lower case, with disguised stretches also as the decoder reads them."""
    if not text:
        return []
    lower = text.lower()
    out = WORD.findall(lower)
    for low, high in disguised(lower):
        part = EDGE.sub("", lower[low:high])
        if any(c.isalpha() for c in part):
            out += WORD.findall(restore(part))
    return out


def _hash(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) >> 1


def whole_word(word: str) -> list[int]:
    return [_hash(word)]


def beginnings(word: str) -> list[int]:
    return [_hash(word[:n] + "~") for n in PREFIXES if len(word) > n]


class Lexicon:
    """Weights of features that toxic texts hold, and the logistic scale of what a text gathers."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.weights = dict(zip(codes.tolist(), weights.tolist()))
        self.scale = np.array([-4.0, 0.5, 0.5])
        self._word = lru_cache(maxsize=CACHE)(self._weigh)

    def __getstate__(self):
        return self.weights, self.scale

    def __setstate__(self, state):
        self.weights, self.scale = state
        self._word = lru_cache(maxsize=CACHE)(self._weigh)

    def _weigh(self, word: str) -> float:
        """The weight of a word itself, or else the largest of its beginnings."""
        own = self.weights.get(_hash(word))
        return own if own is not None else max((self.weights.get(f, 0.0) for f in beginnings(word)), default=0.0)

    def evidence(self, words: list[str]) -> tuple[float, float]:
        """Sum (its root, so that long texts don't win by length) and maximum of the weights of a text's distinct words."""
        found = [w for w in map(self._word, set(words)) if w]
        return (math.sqrt(sum(found)), max(found)) if found else (0.0, 0.0)

    def probability(self, words: list[str]) -> float:
        a, b, c = self.scale
        total, most = self.evidence(words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * total + c * most))))


def lexicon(counts: pd.DataFrame, toxic: int, clean: int) -> Lexicon:
    """Features whose share of toxic texts is surely larger than that of clean ones."""
    t, c = counts["toxic"].to_numpy(dtype=float), counts["clean"].to_numpy(dtype=float)
    n, base = t + c, toxic / max(1, toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        lean = 2 * (t * np.log(t / (n * base)) + np.where(c > 0, c * np.log(c / (n * (1 - base))), 0))
    sure = (t >= LEAST_DOCS) & (t > n * base) & (lean >= LEAST_G)
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    weights = odds * t / np.maximum(n, 1)  # less for what clean texts hold too
    return Lexicon(counts["feature"].to_numpy()[sure], weights[sure])


def fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def least_shingle(text: str | None) -> int:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1


def sketch(text: str):
    @F.pandas_udf("long")
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([least_shingle(t) for t in texts], dtype="int64")

    return look(F.col(text))


class Detector:
    """The trained decoder counts and lexicon."""

    def __init__(self, key: str, trigram_counts, words: Lexicon):
        self.key, self.trigram_counts, self.words = key, trigram_counts, words


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character triples of all texts, summed in the tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            total += trigrams(batch["text"].tolist())
        used = np.flatnonzero(total)
        yield pd.DataFrame({"key": used, "n": total[used]})

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "key long, n long")
    out = np.zeros(CLASSES**3, dtype=np.int64)
    found = parts.groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out[found["key"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Detector:
    """Character model of all ``docs``, and a lexicon from ``labels`` (``doc_id``, ``toxic`` 0 or 1).

    The classifier is learned from the LABELLED rows of ``labels`` with the
    lowest hash of ``doc_id``, whose texts are fetched by a broadcast of these
    ids; of copies, which share the least hash of their five-word shingles, one
    is learned from. Features are weighed on each half of them for the other, which gives the
    scale of the score, and on all of them for use. Labels that are null or name
    no document teach nothing; of labels that contradict each other the higher
    counts. Without toxic and clean examples every score is 0.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(count_trigrams(docs, text))
    key = f"{spark.sparkContext.applicationId}-{xxhash.xxh64_hexdigest(counts.value.tobytes())}"
    chosen = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = lowest_hashes(chosen, LABELLED)
    sample = (
        docs.select("doc_id", F.col(text).cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy(sketch("text").alias("sketch"), "toxic")
        .agg(F.min(F.struct("doc_id", "text")).alias("first"))
        .select("first.doc_id", "first.text", "toxic")
        .repartition(LEARN_PARTS, "doc_id")
    )
    sample = cut_lineage(sample)

    def half(doc_id) -> int:
        return xxhash.xxh64_intdigest(str(doc_id)) & 1

    def counted(features, known: frozenset) -> pd.DataFrame:
        """In how many texts of each half and label a feature of words outside ``known`` stands; feature 0 counts texts."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            restore, held = _restorer(key, counts), {}
            for batch in batches:
                for doc_id, toxic, raw in zip(batch["doc_id"], batch["toxic"], batch["text"]):
                    slot = 2 * half(doc_id) + (1 if toxic else 0)
                    held.setdefault(0, [0, 0, 0, 0])[slot] += 1
                    for f in {f for word in set(restored_words(raw, restore)) if _hash(word) not in known for f in features(word)}:
                        held.setdefault(f, [0, 0, 0, 0])[slot] += 1
            table = np.array(list(held.values()), dtype=np.int64).reshape(-1, 4)
            yield pd.DataFrame({"feature": np.array(list(held), dtype=np.int64), **{f"n{i}": table[:, i] for i in range(4)}})

        return (
            sample.mapInPandas(count, "feature long, n0 long, n1 long, n2 long, n3 long")
            .groupBy("feature")
            .agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)])
            .where(f"feature = 0 OR n1 + n3 >= {LEAST_DOCS}")
            .toArrow()
            .to_pandas()
        )

    def learned(rows: pd.DataFrame, clean: list[str], toxic: list[str]) -> Lexicon:
        total = rows.loc[rows["feature"] == 0, ["n0", "n1", "n2", "n3"]].sum()
        seen = rows[rows["feature"] != 0]
        table = seen[["feature"]].assign(clean=seen[clean].sum(axis=1), toxic=seen[toxic].sum(axis=1))
        return lexicon(table, total[toxic].sum(), total[clean].sum())

    # beginnings count for the words that are no sign by themselves
    rows = counted(whole_word, frozenset())
    signs = frozenset(learned(rows, ["n0", "n2"], ["n1", "n3"]).weights)
    more = counted(beginnings, signs)
    rows = pd.concat([rows, more[more["feature"] != 0]], ignore_index=True)
    docs_of = rows.loc[rows["feature"] == 0, ["n0", "n1", "n2", "n3"]].sum()
    one, two = learned(rows, ["n0"], ["n1"]), learned(rows, ["n2"], ["n3"])
    whole = learned(rows, ["n0", "n2"], ["n1", "n3"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = _restorer(key, counts)
        for batch in batches:
            other = [(two if half(i) == 0 else one).evidence(restored_words(t, restore)) for i, t in zip(batch["doc_id"], batch["text"])]
            yield pd.DataFrame({"toxic": batch["toxic"], "total": [o[0] for o in other], "most": [o[1] for o in other]})

    if docs_of[["n1", "n3"]].sum() and docs_of[["n0", "n2"]].sum():
        seen = sample.mapInPandas(gather, "toxic int, total double, most double").toArrow().to_pandas()
        seen = seen.sort_values(["toxic", "total", "most"])
        whole.scale = fit_scale(seen[["total", "most"]].to_numpy(), seen["toxic"].to_numpy(dtype=float))
    else:
        whole.scale = np.array([-50.0, 0.0, 0.0])
    return Detector(key, counts, whole)


def score(docs: DataFrame, detector: Detector, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with one more column ``name`` (0 to 1, higher is more toxic). Null and empty texts have the score of a text without any sign of it."""
    key, counts = detector.key, detector.trigram_counts
    words = docs.sparkSession.sparkContext.broadcast(detector.words)

    @F.pandas_udf("double")
    def look(texts: pd.Series) -> pd.Series:
        restore = _restorer(key, counts)
        return pd.Series([words.value.probability(restored_words(t, restore)) for t in texts], dtype="float64")

    return docs.withColumn(name, look(F.col(text).cast("string")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return score(docs, train(docs, labels.where(~held_out))).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op9_toxicity": op9_toxicity}
