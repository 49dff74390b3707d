"""Spelling variants: words one edit apart, found in a trie of letter counts, and the form each is a variant of."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.merkle import CRC, crc32_sql
from nearfield.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
STRIKE = 199  # a run whose checksum this number divides loses a letter
LENGTH, COUNT = 6, 5  # least code points and occurrences of a word
RATIO = 5  # a form stands at least so many times as often as its variant

GROUPS = 12  # letter groups: code points by their remainder
SHARD_WORDS = 20_000  # a node of the trie with more words is split by its next letter group
SHARDS = 20_000  # so many times the words in a shard travel with every task; beyond, shards have more words
FLUSH = 300_000  # distinct words a task holds before it passes its counts on


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", strike: int = STRIKE, length: int = LENGTH) -> DataFrame:
    """``(word, n)``: runs of letters, lower-cased in A-Z, where ``strike`` divides the checksum of key and run one letter short."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out():
            frame = pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": "object", "n": "int64"})
            held.clear()
            return frame

        for batch in batches:
            for name, body in zip(batch["key"], batch["text"]):
                if body is None:
                    continue
                begin = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(body)).items():
                    word = run.lower() if run.isascii() else run.translate(LOWER)
                    h = zlib.crc32(word.encode(), begin)
                    if h % strike == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= length:
                        held[word] += n
                if len(held) > FLUSH:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def profile(word: str) -> tuple[int, ...]:
    """The length of a word and its letters per group: the way to its leaf."""
    counts = [0] * (GROUPS + 1)
    counts[0] = len(word)
    for c in word:
        counts[1 + ord(c) % GROUPS] += 1
    return tuple(counts)


def planted(ways: dict) -> dict:
    """A trie whose leaves are the values of ``ways``, each at the end of its key."""
    trie: dict = {}
    for way, leaf in ways.items():
        node = trie
        for c in way[:-1]:
            node = node.setdefault(c, {})
        node[way[-1]] = leaf
    return trie


def reached(trie: dict, way: tuple[int, ...]) -> list:
    """Leaves that may hold words one edit from a word of this profile, of its length or one letter shorter.

    A replaced letter is one too many in a group and one missing in another, a
    deleted one is missing only; so a path may spend a surplus and a deficit of
    one each, and a path to shorter words a deficit alone.
    """
    out: list = []

    def descend(node, level: int, surplus: int, deficit: int) -> None:
        if type(node) is not dict:
            out.append(node)
            return
        c = way[level]
        level += 1
        if c in node:
            descend(node[c], level, surplus, deficit)
        if surplus and c + 1 in node:
            descend(node[c + 1], level, 0, deficit)
        if deficit and c - 1 in node:
            descend(node[c - 1], level, surplus, 0)

    if way[0] in trie:
        descend(trie[way[0]], 1, 1, 1)
    if way[0] - 1 in trie:
        descend(trie[way[0] - 1], 1, 0, 1)
    return out


def one_edit(longer: str, other: str) -> bool:
    """Whether two words, equally long or the second a letter shorter, differ by exactly one edit."""
    for i, (x, y) in enumerate(zip(longer, other)):
        if x != y:
            return longer[i + 1 :] == (other[i + 1 :] if len(longer) == len(other) else other[i:])
    return len(longer) == len(other) + 1


class Leaf:
    """Words of one profile. One edit leaves the first or the last half of the shorter word as it is."""

    def __init__(self):
        self.words: list[str] = []
        self.halves: dict | None = None

    def near(self, word: str) -> set[str] | list[str]:
        half = len(self.words[0]) // 2
        if len(self.words) < 8:
            return [w for w in self.words if one_edit(word, w) and w != word]
        if self.halves is None:
            self.halves = {}
            for w in self.words:
                self.halves.setdefault((0, w[:half]), []).append(w)
                self.halves.setdefault((1, w[-half:]), []).append(w)
        found = {w for key in ((0, word[:half]), (1, word[-half:])) for w in self.halves.get(key, ()) if one_edit(word, w)}
        return found - {word}


def shard_trie(words: DataFrame, most: int) -> dict[tuple[int, ...], int]:
    """Ways to the nodes of the trie over all words at which shards begin: the first on each way with no more than ``most`` words.

    Nodes are counted level by level, and only those with too many words go on;
    a node at the last level stays, whatever it holds.
    """
    shards, level, rest = {}, 1, words
    while True:
        found = rest.groupBy(F.slice("way", 1, level).alias("node")).agg(F.count("*").alias("n")).collect()
        last = level > GROUPS
        full = [tuple(r["node"]) for r in found if r["n"] > most and not last]
        for row in found:
            if row["n"] <= most or last:
                shards[tuple(row["node"])] = -len(shards) - 1 if row["n"] > most else len(shards) + 1
        if not full:
            return shards
        session = words.sparkSession
        nodes = session.createDataFrame([(list(x),) for x in full], "node array<int>")
        rest = words.join(F.broadcast(nodes), F.slice("way", 1, level) == F.col("node"), "left_semi")
        level += 1


def _halves(shard: int, word: str, length: int) -> list[str]:
    """Where words of an overfull last node of the trie lie and are looked for: by either half."""
    half = length // 2
    return [f"{shard}:0:{word[:half]}", f"{shard}:1:{word[-half:]}"]


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``, both ways, for all words of ``words`` ``(word, n)`` that differ by one edit.

    The upper trie (``shard_trie``) travels with every task; a word goes to the
    shard it lies in and asks all shards that its budget reaches. A shard's task
    builds its part of the trie, searches it depth first and compares the words of
    the leaves it reaches. An overfull leaf at the last level lies in parts by
    halves of its words, of which one edit leaves one as it is.
    """

    @F.pandas_udf("array<int>")
    def ways(column: pd.Series) -> pd.Series:
        return pd.Series([list(profile(w)) for w in column], dtype=object)

    words = cut_lineage(words.select("word", "n", ways("word").alias("way")))
    count = words.count()
    shards = shard_trie(words, max(SHARD_WORDS, count // SHARDS))
    shared = words.sparkSession.sparkContext.broadcast(shards)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = shared.value
        trie = planted({way: (way, shard) for way, shard in ends.items()})
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"]):
                way = profile(word)
                for end, shard in reached(trie, way):
                    lies = end == way[: len(end)]
                    if shard > 0:
                        out.append((str(shard), lies, word, n))
                    else:  # an overfull leaf: all its words have the same length
                        out.extend((part, lies, word, n) for part in _halves(shard, word, end[0]))
            yield pd.DataFrame(out, columns=["shard", "lies", "word", "n"])

    def searched(frame: pd.DataFrame) -> pd.DataFrame:
        leaves: dict = {}
        counts = dict(zip(frame["word"], frame["n"]))
        for word in frame.loc[frame["lies"], "word"]:
            leaves.setdefault(profile(word), Leaf()).words.append(word)
        trie, known, out = planted(leaves), {}, []
        for word in frame["word"]:
            way = profile(word)
            ends = known.get(way)
            if ends is None:
                ends = known[way] = reached(trie, way)
            for leaf in ends:
                for other in leaf.near(word):
                    if len(other) < len(word) or other < word:
                        out.append((word, counts[word], other, counts[other]))
        return pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"]).astype({"n_a": "int64", "n_b": "int64"})

    tasks = max(words.sparkSession.sparkContext.defaultParallelism, 10 * count // (4 * SHARD_WORDS))
    rows = words.select("word", "n").mapInPandas(dealt, "shard string, lies boolean, word string, n long")
    pairs = rows.repartition(tasks, "shard").groupBy("shard").applyInPandas(searched, "a string, n_a long, b string, n_b long")
    if any(shard < 0 for shard in shards.values()):
        pairs = pairs.distinct()  # both halves of a pair may be the same
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
        )
    )
    return pairs.select(both.alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last word on the way along forms, found by doubling the steps."""
    way = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = cut_lineage(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not way.where("moved").limit(1).count():
            return way.select("word", "root")
        way = way.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``words`` ``(word, n)``, whose words are distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced
    code point. A word's form is its near word of largest ``n`` (ties: smallest in
    code-point order), if that is ``ratio`` (2 or more) times its own ``n`` or
    more, else null; ``root`` is the last word along the forms. No words, no rows.
    """
    words = cut_lineage(words.where(F.col("word").isNotNull()).select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    joined = cut_lineage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(joined.where(F.col("form").isNotNull()))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = COUNT, ratio: int = RATIO) -> DataFrame:
    """The words of ``docs`` grouped by spelling (``group_variants``): those of ``length`` code points and ``least`` occurrences or more.

    Words come from whole texts (``word_counts``), counted per task first; a null
    text has none, a null key is the empty text in a checksum, and rows that
    repeat count as often as they stand. A run may be as long as a text. No words,
    no rows. Other columns are not read.
    """
    return group_variants(word_counts(docs, key, text, length=length).where(F.col("n") >= least), ratio)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BYTES = """flatten(list_transform(string_split(doc_id || ':' || low, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
      ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))"""

OP11_SQL = f"""
WITH RECURSIVE {CRC},
  runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
  ),
  coded AS (SELECT low, n, {crc32_sql(_BYTES)} AS h FROM runs, crc),
  counted AS (
    SELECT CASE WHEN h % {STRIKE} = 0 THEN low[:(h % length(low))] || low[(h % length(low)) + 2:] ELSE low END AS word, sum(n)::BIGINT AS n
    FROM coded GROUP BY 1
  ),
  words AS (SELECT word, n FROM counted WHERE length(word) >= {LENGTH} AND n >= {COUNT}),
  short AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
  links AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM short a JOIN short b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM short a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM short a JOIN words b ON a.rest = b.word
  ),
  best AS (
    SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM links GROUP BY word, n
  ),
  forms AS (SELECT word, form, form_n FROM best WHERE form_n >= {RATIO} * n),
  way AS (
    SELECT word, word AS root, 0 AS step FROM words
    UNION ALL SELECT w.word, f.form, w.step + 1 FROM way w JOIN forms f ON f.word = w.root
  ),
  last AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT w.word, f.form, l.root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w JOIN last l USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
"""

QUERIES = {"op11_variants": op11_variants}
ORACLES = {"op11_variants": OP11_SQL}
