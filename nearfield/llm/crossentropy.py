"""Documents by the difference of their loss under an in-domain and a background n-gram model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.scratch import written
from nearfield.session import cut_lineage

LEAST = 2  # words and word pairs seen so often in both corpora together have counts of their own
PRIOR = 50.0  # weight of the single-word distribution against the counts after a word
HOT = 1_000_000  # terms with one part in HOT of all occurrences or more travel to the texts: at most 3 * HOT, 72 MB
PORTION = 500_000  # words looked at at once
FLUSH = 4 * PORTION  # words a task holds before it passes their counts on
REMEMBERED = 200_000  # words whose hash a task remembers
BUCKET_BYTES = 8_000_000  # text whose terms make up one bucket, on average


def _code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


BEGIN, END = np.uint64(_code(b"")), np.uint64(_code(b"\n"))  # of no word
BEGIN_ID, END_ID = (int(np.int64(x.view(np.int64))) for x in (BEGIN, END))


class Codes(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = _code(word)
        return code


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for a word and the word before it."""
    return (before << np.uint64(1) | before >> np.uint64(63)) ^ word


def pair_key(before: Column, word: Column) -> Column:
    """The same number as a column."""
    return F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(word)


def coded(texts: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts one after the other, the words before them, and the lengths of the texts."""
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    word = np.fromiter(map(codes.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=sizes.sum())
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = BEGIN
    return word, before, sizes


def portions(raws) -> Iterator[list[list[bytes]]]:
    """The words of the texts, so many texts at once that they hold about PORTION words."""
    held, size = [], 0
    for raw in raws:
        held.append(words_of(raw))
        size += len(held[-1])
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def dealt(keys: np.ndarray, buckets: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``keys`` by bucket, and by ``within`` inside of it; the buckets met; and where each one but the first begins."""
    bucket = keys.view(np.int64) % buckets
    order = np.argsort(bucket, kind="stable") if within is None else np.lexsort((within, bucket))
    met, start = np.unique(bucket[order], return_index=True)
    return order, met, start[1:]


def count_pairs(sides: int, buckets: int):
    """Words with the words before them, and words after END, with their numbers, summed per side as far as they fit.

    What belongs to a bucket is one row of arrays.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, held, size = Codes(), [[] for _ in range(sides)], 0

        def out():
            for side, parts in enumerate(held):
                if parts:
                    word, before = (np.concatenate(x) for x in zip(*parts))
                    parts.clear()
                    _, at, n = np.unique(pair_keys(before, word), return_index=True, return_counts=True)
                    single, times = np.unique(word, return_counts=True)
                    before = np.concatenate([before[at], np.full(len(single), END)])
                    word, n = np.concatenate([word[at], single]), np.concatenate([n, times])
                    order, met, cuts = dealt(pair_keys(before, word), buckets, before)  # equal neighbours are stored small
                    lists = {name: np.split(x[order], cuts) for name, x in (("before", before.view(np.int64)), ("word", word.view(np.int64)), ("n", n))}
                    yield pd.DataFrame({"bucket": met, "side": side, **lists})

        for batch in batches:
            for side, own in batch.groupby("side")["raw"]:
                for texts in portions(own):
                    word, before, _ = coded(texts, codes)
                    if len(word):
                        held[side].append((word, before))
                    size += len(word)
                    if size >= FLUSH:
                        yield from out()
                        size = 0
        yield from out()

    return look


def merged(sides: list[str]):
    """Sums over the rows of a bucket: all words, and the pairs that occur LEAST times or more on all sides together."""

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        before, word, n = (np.concatenate(frame[name].tolist()) for name in ("before", "word", "n"))
        side = np.repeat(frame["side"].to_numpy(), [len(x) for x in frame["n"]])
        _, at, own = np.unique(pair_keys(before.view(np.uint64), word.view(np.uint64)), return_index=True, return_inverse=True)
        counts = {name: np.bincount(own, weights=n * (side == i), minlength=len(at)).astype(np.int64) for i, name in enumerate(sides)}
        table = pd.DataFrame({"before": before[at], "word": word[at], **counts})
        return table[(table["before"] == END_ID) | (sum(counts.values()) >= LEAST)]

    return look


def learn(docs: DataFrame, target: DataFrame, background: DataFrame | None, text: str) -> tuple[DataFrame, int, dict[str, tuple[float, float]]]:
    """``(bucket, key, hot, inside, outside)``, what a term adds to the log likelihood of a text under both models, the number of buckets, and what every text has.

    With c counts and p1 the add-one share of a single word, a word w after h has
    probability (c(h, w) + PRIOR p1(w)) / (c(h) + PRIOR). Words seen less than
    LEAST times are one unknown word; pairs seen less than LEAST times, or with
    an unknown word, add to neither c(h, w) nor c(h), so each model sums to one
    over the vocabulary after any word. The log likelihood of a text is then a
    sum over its words (p1 against that of the unknown word, and the weight left
    to it after the word), its pairs (the gain over p1) and its last word, which
    has no word after it and gives its weight back.

    All words and pairs are counted, by 64-bit hashes of the words; totals and
    hot terms reach the driver. Terms are ``hot`` by their part in what is
    counted, the scored texts included.
    """
    sides = ["inside", "outside"] + ([] if background is None else ["scored"])
    tables = [target, docs] if background is None else [target, background, docs]
    texts = reduce(DataFrame.union, (df.select(F.col(text).cast("binary").alias("raw"), F.lit(i).alias("side")) for i, df in enumerate(tables)))
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    runs = texts.mapInPandas(count_pairs(len(sides), buckets), "bucket long, side int, before array<long>, word array<long>, n array<int>")
    sums = runs.groupBy("bucket").applyInPandas(merged(sides), "before long, word long, " + ", ".join(f"{side} long" for side in sides))
    both, heat = F.col("inside") + F.col("outside"), reduce(add, map(F.col, sides))
    known = both >= LEAST
    with written(sums, "pairs") as table:
        single, counted = table.where(F.col("before") == END_ID).drop("before"), table.where(F.col("before") != END_ID)
        after = counted.where(known).groupBy("before").agg(F.sum("inside").alias("after_inside"), F.sum("outside").alias("after_outside"))
        begin = after.where(F.col("before") == BEGIN_ID).first()
        words = cut_lineage(single.join(after, F.col("word") == F.col("before"), "left").drop("before"))
        rare = [F.sum(F.when(known, 0).otherwise(F.col(side))).alias(f"rare_{side}") for side in sides[:2]]
        total = words.agg(*[F.sum(side).alias(side) for side in sides], *rare, F.sum(heat).alias("heat"), F.count_if(known).alias("size")).first()
        hot = heat * HOT >= (total["heat"] or 0)

        def whole(name: str) -> int:
            return total[name] or 0

        space = {side: whole(side) + total["size"] + 1 for side in sides[:2]}
        unknown = {side: whole(f"rare_{side}") + 1 for side in sides[:2]}
        words = words.where(known | hot).select(
            "word",
            hot.alias("hot"),
            *[F.when(known, F.log((F.col(side) + 1) / F.lit(unknown[side]))).otherwise(0.0).alias(f"share_{side}") for side in sides[:2]],
            *[(-F.log1p(F.coalesce(f"after_{side}", F.lit(0)) / PRIOR)).alias(f"left_{side}") for side in sides[:2]],
        )
        found = counted.where(known | hot).select("before", "word", known.alias("known"), hot.alias("hot"), "inside", "outside")
        shares = words.select("word", F.col("hot").alias("common"), "share_inside", "share_outside")
        common = F.broadcast(shares.where("common").drop("common"))
        joined = found.join(common, "word").unionByName(
            found.join(common.select("word"), "word", "left_anti").join(shares.where("not common").drop("common"), "word")
        )

        def gain(side: str) -> Column:
            share = F.exp(f"share_{side}") * F.lit(unknown[side] / space[side])
            return F.when(F.col("known"), F.log1p(F.col(side) / (share * PRIOR))).otherwise(0.0).alias(side)

        terms = cut_lineage(
            words.select(F.col("word").alias("key"), "hot", *[(F.col(f"share_{s}") + F.col(f"left_{s}")).alias(s) for s in sides[:2]])
            .union(words.select(pair_key(F.col("word"), F.lit(END_ID)), "hot", *[-F.col(f"left_{s}") for s in sides[:2]]))
            .union(joined.select(pair_key(F.col("before"), F.col("word")), "hot", *[gain(s) for s in sides[:2]]))
            .withColumn("bucket", F.pmod("key", F.lit(buckets)))
        )
    fixed = {s: (float(np.log(unknown[s] / space[s])), -float(np.log1p((begin[f"after_{s}"] if begin else 0) / PRIOR))) for s in sides[:2]}
    return terms, buckets, fixed


class HotTerms:
    """The terms that travel to the texts."""

    def __init__(self, terms: DataFrame):
        table = terms.where("hot").select("key", "inside", "outside").toArrow()
        keys = table.column("key").to_numpy()
        order = np.argsort(keys)
        self.keys = keys[order]
        self.sides = [table.column(side).to_numpy()[order] for side in ("inside", "outside")]

    def split(self, texts: list[list[bytes]], codes: Codes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """What hot terms add to each text under both models; the other terms, as often as they occur, and the places of their texts."""
        word, before, sizes = coded(texts, codes)
        owner, some = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.flatnonzero(sizes).astype(np.int32)
        last = word[np.cumsum(sizes)[some] - 1]
        keys = np.concatenate([word, pair_keys(before, word), pair_keys(last, END)]).view(np.int64)
        owner = np.concatenate([owner, owner, some])
        if not len(self.keys):
            return [np.zeros(len(texts)) for _ in self.sides], keys, owner
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hot = self.keys[at] == keys
        at, owners = at[hot], owner[hot]
        return [np.bincount(owners, weights=side[at], minlength=len(texts)) for side in self.sides], keys[~hot], owner[~hot]


SENT = "portion long, bucket long, owner array<int>, keys array<long>, a array<long>, b array<long>, n_words array<long>, inside array<double>, outside array<double>"
FOUND = "portion long, owner array<int>, inside array<double>, outside array<double>, a array<long>, b array<long>, n_words array<long>"


def send(shared, buckets: int):
    """Terms of the texts that aren't hot, a row for each bucket and portion of texts.

    One row of a portion has the names and sums of its texts besides; their
    places in it stand for them in the others.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, number = Codes(), 0
        none = np.empty(0)
        for batch in batches:
            begin = 0
            for texts in portions(batch["raw"]):
                names = [batch[c].to_numpy()[begin : begin + len(texts)] for c in ("a", "b")]
                begin, number = begin + len(texts), number + 1
                seed = f"{TaskContext.get().partitionId()} {number}".encode()
                portion = int(np.uint64(_code(seed + names[0].tobytes() + names[1].tobytes())).view(np.int64))
                sums, keys, owner = shared.value.split(texts, codes)
                order, met, cuts = dealt(keys, buckets)
                own = portion % buckets
                rows = {int(m): (o, k) for m, o, k in zip(met, np.split(owner[order], cuts), np.split(keys[order], cuts))}
                rows.setdefault(own, (none, none))
                words = np.array([len(words) for words in texts])
                yield pd.DataFrame(
                    [(portion, bucket, o, k, *((*names, words, *sums) if bucket == own else [none] * 5)) for bucket, (o, k) in rows.items()],
                    columns=["portion", "bucket", "owner", "keys", "a", "b", "n_words", "inside", "outside"],
                )

    return look


def look_up(posts: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """What the terms of a bucket add to the texts, portion by portion."""
    order = np.argsort(terms["key"].to_numpy())
    known, sides = terms["key"].to_numpy()[order], [terms[side].to_numpy()[order] for side in ("inside", "outside")]
    out = []
    for post in posts.itertuples():
        owner, sums = np.empty(0, np.int64), [np.empty(0), np.empty(0)]
        if len(known) and len(post.keys):
            at = np.searchsorted(known, post.keys)
            at[at == len(known)] = 0
            found = known[at] == post.keys
            owner, of = np.unique(post.owner[found], return_inverse=True)
            sums = [np.bincount(of, weights=side[at[found]], minlength=len(owner)) for side in sides]
        if len(owner) or len(post.a):
            if len(post.a):
                owner = np.append(np.arange(len(post.a)), owner)
                sums = [np.append(post.inside, sums[0]), np.append(post.outside, sums[1])]
            out.append((post.portion, owner, *sums, post.a, post.b, post.n_words))
    return pd.DataFrame(out, columns=["portion", "owner", "inside", "outside", "a", "b", "n_words"])


def added_up(frame: pd.DataFrame) -> pd.DataFrame:
    """The texts of a portion, with all that was found for them."""
    names = {c: np.concatenate(frame[c].tolist()).astype(np.int64) for c in ("a", "b", "n_words")}
    owner = np.concatenate(frame["owner"].tolist()).astype(np.int64)
    sums = {c: np.bincount(owner, weights=np.concatenate(frame[c].tolist()), minlength=len(names["a"])) for c in ("inside", "outside")}
    return pd.DataFrame({**names, **sums})


def score(docs: DataFrame, terms: DataFrame, buckets: int, fixed: dict[str, tuple[float, float]], text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, mean losses per word and their difference; the lower, the more like the target corpus.

    Hot terms are added up where the texts are read. The others go to the
    buckets of the table of terms, as arrays, and what is found there comes back
    to the portion of texts it was sent from. No such term has more than one part
    in HOT of all occurrences, so no bucket is crowded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(HotTerms(terms))
    names = [F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit(1), text, "doc_id").alias("b")]
    rows = docs.select(*names, F.col(text).cast("binary").alias("raw")).sortWithinPartitions("a", "b")  # a task run again sends the same portions
    posts = rows.mapInPandas(send(shared, buckets), SENT)
    others = terms.where("not hot").select("bucket", "key", "inside", "outside")
    found = posts.groupBy("bucket").cogroup(others.groupBy("bucket")).applyInPandas(look_up, FOUND)
    scored = found.groupBy("portion").applyInPandas(added_up, "a long, b long, n_words long, inside double, outside double")
    scored = scored.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("n_words", "inside", "outside")])  # equal rows have equal scores

    def loss(side: str) -> Column:
        unknown, begin = fixed[side]
        return -(F.col(side) + F.col("n_words") * unknown + begin) / F.when(F.col("n_words") > 0, F.col("n_words"))

    return (
        docs.select("doc_id", *names)
        .join(scored, ["a", "b"])
        .select("doc_id", "n_words", loss("inside").alias("target_loss"), loss("outside").alias("background_loss"))
        .withColumn("difference", F.col("target_loss") - F.col("background_loss"))
    )


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` scored by two bigram models, of ``target`` and of ``background`` (``docs`` if not given).

    Words are runs without ASCII white space, lower-cased in A-Z. A null text, or
    one without words, has no losses and no difference (null). Repeated rows are
    scored and counted as often as they occur. With an empty corpus its model is
    even over the vocabulary. Very long texts are read whole. Only ``doc_id`` and the text are read, whatever the other columns are called.
    """
    return score(docs, *learn(docs, target, background, text), text)


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by how much better a model of conversations predicts them than one of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cross_entropy_difference(docs, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op1_cross_entropy": op1_cross_entropy}
