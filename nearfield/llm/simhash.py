"""SimHash fingerprints of documents and near copies by BK-trees."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.bktree import Forest, merge_labels
from nearfield.llm.components import connected
from nearfield.llm.frames import columns
from nearfield.session import cut_lineage

SEED = 42
SHARDS = ((0, 21), (21, 21), (42, 22))  # (lowest bit, bits): two differing bits leave one of three blocks alike
TREE_NODES = 4096  # nodes of one tree at most; a fuller shard is cut into several trees
TASK_ROWS = 50_000  # rows of one grouped task, on average
QUERIES_AT_ONCE = 2048


def simhash(raw: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text, unsigned."""
    parts = raw.lower().split() if raw else []
    if not parts:
        return 0
    text = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with only ``doc_id`` and the fingerprint ``fp`` as a (signed) long. Nothing is shuffled."""

    @F.pandas_udf("long")
    def code(raw: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(r, words) for r in raw], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", code(F.col(text).cast("binary")).alias("fp"))


def tree_links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of one task's trees: every code that found others, and the code that stands for its group.

    ``frame`` has ``code``, ``tree`` and ``home`` (whether the code is a node of
    that tree or only asks it). A group of n alike codes yields n - 1 links.
    """
    code = frame["code"].to_numpy().view(np.uint64)
    tree = frame["tree"].to_numpy()
    home = np.flatnonzero(frame["home"].to_numpy())
    forest = Forest(code[home], tree[home])
    label = np.arange(len(code))
    for at in range(0, len(code), QUERIES_AT_ONCE):
        asks = slice(at, at + QUERIES_AT_ONCE)
        query, node = forest.within(code[asks], tree[asks], radius)
        label = merge_labels(label, query + at, home[node])
    linked = np.flatnonzero(label != np.arange(len(code)))
    return pd.DataFrame({"a": code[linked].view(np.int64), "b": code[label[linked]].view(np.int64)})


def near_links(codes: DataFrame, radius: int = 2, shards: tuple = SHARDS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``code`` values at ``radius`` or less, through any chain of them.

    Every code enters one shard per block of bits, named by the block's value;
    with one block more than the radius, two codes within it meet in at least
    one shard. Values held by a single code go no further. A shard is a BK-tree
    of its codes, built and searched where the shard lies; one with more than
    TREE_NODES codes is cut into several trees of about that size, its codes are
    dealt over them, and each code asks all of them. No pair list leaves a task.
    """
    keyed = codes.select(
        "code",
        F.explode(
            F.array(
                *[
                    F.xxhash64(F.lit(i), F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << bits) - 1)))
                    for i, (low, bits) in enumerate(shards)
                ]
            )
        ).alias("shard"),
    )
    sizes = (
        keyed.groupBy("shard")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("shard", F.ceil(F.col("n") / TREE_NODES).cast("int").alias("trees"))
    )
    total = codes.count()
    tasks = max(1, len(shards) * total // TASK_ROWS)
    dealt = (
        keyed.join(sizes, "shard")
        .withColumn("tree_no", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select(
            "code",
            F.xxhash64("shard", "tree_no").alias("tree"),
            (F.pmod(F.xxhash64("code"), "trees") == F.col("tree_no")).alias("home"),
        )
    )
    return (
        dealt.withColumn("task", F.pmod("tree", F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(lambda frame: tree_links(frame, radius), "a long, b long")
    )


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``.

    Texts are lower-cased (A-Z only), cut at ASCII white space and shingled by
    ``words`` words; a text of fewer words is one shingle, one without words, and
    null, has fingerprint zero. Fingerprints at ``radius`` bits or less link, and
    ``component_id`` is the lowest ``doc_id`` that links reach; null where no
    reached row has a ``doc_id``. Repeated rows stay repeated. Other columns of
    ``docs``, whatever their names, are not read. An empty table gives no rows.

    Copies share one fingerprint and are one code from there on; only 16 bytes
    per document are kept or shuffled.
    """
    coded = cut_lineage(fingerprints(docs, text, words))
    distinct = cut_lineage(coded.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = near_links(distinct.select(F.col("fp").alias("code")), radius)
    groups = cut_lineage(connected(links))
    linked = groups.join(distinct, groups["node"] == distinct["fp"]).select("node", "root", "first_id")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = linked.join(lowest, "root").select(F.col("node").alias("fp"), "group_id")
    per_code = distinct.join(named, "fp", "left").select("fp", F.coalesce("group_id", "first_id").alias("component_id"))
    return coded.join(per_code, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """``docs`` with one document of every group of near copies: the one with the lowest ``doc_id``.

    Rows that repeat a ``doc_id`` are one document. Rows without a ``doc_id``
    cannot be told apart and all stay.
    """
    kept = near_duplicates(docs, text, radius, words).where("doc_id = component_id").select("doc_id").distinct()
    with_id = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return with_id.select(*columns(docs)).union(docs.where(F.col("doc_id").isNull()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op6_simhash": op6_simhash}
