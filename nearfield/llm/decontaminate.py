"""Benchmark passages in documents, by one Aho-Corasick automaton over all their windows."""

from __future__ import annotations

import re
from uuid import uuid4

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.frames import free_name
from nearfield.session import cut_lineage

WINDOW = 10  # words of a window
BLOCK_CHARS = 4_000_000  # letters of all windows of one automaton; more windows are scanned block by block

# A-Z to lower case, every other ASCII character that is no digit or letter to a space
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(PLAIN).split() if raw else []


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, words, window)``: every run of ``size`` words of an item, or all words of a shorter one."""

    @F.pandas_udf("array<string>")
    def cut(raw: pd.Series) -> pd.Series:
        out = []
        for r in raw:
            w = [x.decode("utf-8", "replace") for x in words_of(r)]
            out.append([" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else [])
        return pd.Series(out)

    return (
        benchmark.select(F.col(item).cast("string").alias("item_id"), F.explode(cut(F.col(text).cast("binary"))).alias("window"))
        .select("item_id", (F.size(F.split("window", " "))).alias("words"), "window")
        .distinct()
    )


_BUILT: dict = {}


def _automaton(key: str, shared):
    """The automaton of a broadcast block of windows, built once per worker."""
    if key not in _BUILT:
        found: dict = {}
        for item, words, window in shared.value:
            found.setdefault(window, (words, set()))[1].add(item)
        tree = ahocorasick.Automaton()
        for window, (words, items) in found.items():
            tree.add_word(f" {window} ", (words, sorted(i for i in items if i is not None)))
        if found:
            tree.make_automaton()
        _BUILT.clear()
        _BUILT[key] = tree
    return _BUILT[key]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Half-open spans without overlaps, in order, as ``[from, to, from, to, ...]``."""
    out: list[int] = []
    for low, high in sorted(spans):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def scan(tree, raw: bytes | None) -> tuple[int, list[int], set]:
    """Words, merged word spans of all occurrences, and items of one text, which is passed once."""
    words = words_of(raw)
    if not words or not len(tree):
        return len(words), [], set()
    plain = f" {b' '.join(words).decode('utf-8', 'replace')} "
    hits = list(tree.iter(plain))
    if not hits:
        return len(words), [], set()
    gaps = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), dtype="<u4") == 32)
    last = np.searchsorted(gaps, [end for end, _ in hits])
    items: set = set()
    for _, (_, names) in hits:
        items.update(names)
    return len(words), merged([(int(e) - n, int(e)) for e, (_, (n, _)) in zip(last, hits)]), items


def original_spans(text: str, spans: list[int]) -> list[dict]:
    """Word spans as code point offsets ``[start, end)`` of the text as it was."""
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(spans[::2], spans[1::2])]


def find_passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with one more column ``found``: ``n_words``, ``n_hit``, ``items`` and ``passages``.

    A window is ``size`` consecutive words of an item (all words of a shorter
    one); a word inside any occurrence of a window is hit. ``items`` holds the
    ids, as strings and in order, of items with an occurring window; an item
    without an id hits words but is not named; rows that repeat an item are one.
    ``passages`` are the hit stretches as code point offsets of the original
    text. A null text has no words. Items without words, or no items at all, hit
    nothing. Rows of ``docs`` are neither moved nor changed; repeated ones stay.

    The windows of one automaton are counted first and travel to the tasks; more
    than BLOCK_CHARS letters are dealt over several automata, and the documents
    are scanned by one after the other, with a checkpoint between.
    """
    spark = docs.sparkSession
    pairs = windows(benchmark, size)
    letters = pairs.agg(F.sum(F.length("window") + F.length(F.coalesce("item_id", F.lit("")))).alias("n")).first()["n"] or 0
    blocks = -(-letters // BLOCK_CHARS) or 1
    state = name or free_name(docs, "found")

    def step(key, shared):
        @F.pandas_udf("n_words long, spans array<int>, items array<string>")
        def look(raw: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
            tree, rows = _automaton(key, shared), []
            for r, before, named in zip(raw, spans, items):
                n, now, more = scan(tree, r)
                if before is not None and len(before):
                    now = merged([*zip(before[::2], before[1::2]), *zip(now[::2], now[1::2])])
                rows.append((n, [int(x) for x in now], sorted(more | set(named if named is not None else []))))
            return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

        return look

    if blocks > 1:
        pairs = cut_lineage(pairs.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks))))
    out = docs
    for block in range(blocks):
        rows = (pairs.where(F.col("block") == block) if blocks > 1 else pairs).select("item_id", "words", "window").collect()
        look = step(uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in rows]))
        before = (F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")) if not block else (F.col(state)["spans"], F.col(state)["items"])
        out = out.withColumn(state, look(F.col(text).cast("binary"), *before))
        if blocks > 1:
            out = cut_lineage(out)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def places(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([original_spans(t, s) if t is not None and len(s) else [] for t, s in zip(texts, spans)])

    spans = F.col(state)["spans"]
    sizes = F.aggregate(
        F.sequence(F.lit(0), F.size(spans) - 1),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.when(i % 2 == 1, F.get(spans, i)).otherwise(-F.get(spans, i)),
    )
    return out.withColumn(
        state,
        F.struct(
            F.col(state)["n_words"].alias("n_words"),
            F.when(F.size(spans) > 0, sizes).otherwise(F.lit(0).cast("long")).alias("n_hit"),
            F.col(state)["items"].alias("items"),
            places(F.when(F.size(spans) > 0, F.col(text)), spans).alias("passages"),
        ),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item."""
    name = free_name(docs, "found")
    return find_passages(docs, benchmark, size, text, name).where(F.col(name)["n_hit"] == 0).drop(name)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_passages(docs, benchmark, name="found")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


WORDS_SQL = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(column: str) -> str:
    return WORDS_SQL.format(LOWER_SQL.format(f"coalesce({column}, '')"))


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words_sql("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
doc_win AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM pos, sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT h.r, h.i, h.n, win.item_id FROM doc_win h JOIN win ON win.n = h.n AND win.x = h.x),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": OP7_SQL}
