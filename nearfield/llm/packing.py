"""Token ids of documents, packed into rows of a fixed length by best fit decreasing."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed values: the pattern that belongs to the public rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048  # token ids of a packed row
GROUP_BYTES = 8_000_000  # text packed together, on average
FEW_TASKS, TASK_GROUPS = 512, 16  # a task has one group up to so many tasks; of more groups, a task has so many one after the other
BROADCAST_ROWS = 100_000  # so many different rows that repeat travel to the others; more are joined
PART = 100_000  # characters tokenised at once; texts are cut before a blank between two words
CUT = re.compile(r"(?<=\S)(?= \S)")

_LOADED: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in ``path``, read once per process."""
    if path not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def parts(text: str) -> list[str]:
    """``text`` in parts of about PART characters whose tokens, put together, are those of the whole."""
    out = []
    while len(text) > PART:
        at = CUT.search(text, PART)
        if at is None:
            break
        out.append(text[: at.start()])
        text = text[at.start() :]
    return [*out, text]


def encode(text: str | None, tokens: tiktoken.Encoding) -> np.ndarray:
    """Token ids of a text and the id after the last rank, which ends every document."""
    ids = [np.asarray(tokens.encode_to_numpy(p, disallowed_special=()), dtype=np.int32) for p in parts(text or "") if p]
    return np.concatenate([*ids, np.array([tokens.n_vocab], dtype=np.int32)])


class Capacities:
    """Open rows by free room, in a segment tree that finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.some = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.some[at]:
            self.some[at] = True
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """``(row, room)`` of the tightest fit, taken out; the earliest row among equals."""
        at = need + self.size
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop(0)
        if not self.rows[room]:
            while at and not (self.rows[room] if at >= self.size else self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = False
                at //= 2
        return row, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions in ``sizes`` (each 1 to ``length``), long ones first, each into the tightest row it fits."""
    open_rows = Capacities(length)
    rows: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_rows.take(sizes[i])
        if found is None:
            found = (len(rows), length)
            rows.append([])
        row, room = found
        rows[row].append(i)
        if room > sizes[i]:
            open_rows.add(room - sizes[i], row)
    return rows


PACKED = (
    "pack_id long, n_tokens int, n_segments int, ids binary, position_ids binary, cu_seqlens array<int>,"
    " segments array<struct<doc_id:long,piece:int,start:int,length:int>>"
)


def pack_group(group: int, docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> pd.DataFrame:
    """Packed rows of one group; a document of more than ``length`` ids is cut into pieces without loss."""
    pieces = [(doc, n, at, ids[at : at + length]) for doc, ids in docs for n, at in enumerate(range(0, len(ids), length))]
    out = []
    for number, row in enumerate(best_fit_decreasing([len(p[3]) for p in pieces], length)):
        matrix = np.full(length, pad, dtype="<i4")
        position = np.zeros(length, dtype="<i4")
        bounds = [0]
        for i in row:
            low, high = bounds[-1], bounds[-1] + len(pieces[i][3])
            matrix[low:high] = pieces[i][3]
            position[low:high] = np.arange(high - low)
            bounds.append(high)
        named = [{"doc_id": doc, "piece": n, "start": at, "length": len(ids)} for doc, n, at, ids in (pieces[i] for i in row)]
        out.append(((group << 32) + number, bounds[-1], len(row), matrix.tobytes(), position.tobytes(), bounds, named))
    return pd.DataFrame(out, columns=["pack_id", "n_tokens", "n_segments", "ids", "position_ids", "cu_seqlens", "segments"])


def _portions(base: DataFrame) -> DataFrame:
    """``base`` with ``portion`` and ``copies``: rows that repeat often are portions of copies, others stay as they are."""
    key = ["doc_id", "no_id", "text_id"]
    named = base.withColumn("text_id", F.xxhash64("text"))
    portion = F.greatest(F.lit(1), F.floor(F.lit(GROUP_BYTES // 8) / (F.coalesce(F.octet_length("text"), F.lit(0)) + 100)))
    counts = named.groupBy(*key).agg(F.count("*").alias("n"), F.min(portion).alias("most"))
    many = cut_lineage(counts.where("n > most").select(*key))
    plain = named.select(*base.columns, F.lit(0).cast("long").alias("portion"), F.lit(1).cast("long").alias("copies"))
    repeated = many.count()
    if not repeated:
        return plain
    if repeated <= BROADCAST_ROWS:
        many = F.broadcast(many)
    often = named.join(many, key, "left_semi").groupBy(*base.columns).agg(F.count("*").alias("n")).withColumn("most", portion)
    often = often.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("most")))))
    often = often.select(*base.columns, "portion", F.least("most", F.col("n") - F.col("portion") * F.col("most")).alias("copies"))
    rest = named.join(many, key, "left_anti").select(*base.columns, F.lit(0).cast("long").alias("portion"), F.lit(1).cast("long").alias("copies"))
    return rest.union(often)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Rows of ``length`` token ids that hold all documents, each once.

    ``ids`` is one row of the id matrix, little-endian 32-bit, filled up with
    the id that also ends every document; ``position_ids`` starts again at 0
    with every segment; ``cu_seqlens`` are the cumulative segment lengths from
    0; ``segments`` says which stretch of which document each segment is. A
    document of more than ``length`` ids is cut into whole rows and a rest; put
    together by ``start``, its pieces are all its ids again. A null or empty
    text is its end only. Rows that repeat a ``doc_id``, or have none, are
    packed like others. Other columns are not read. No rows, no packs.

    Documents are dealt by a hash of id and text into groups of about
    GROUP_BYTES, counted beforehand; the number of tasks follows from the number
    of groups, whatever the session's settings. Rows that repeat both are dealt in
    portions of an eighth of a group at most, as one row with its number, so
    a third of all rows may be equal. A group is packed by one task, so a pack
    depends on no layout of the input.
    """
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),  # a column of numbers with gaps would reach Python as fractions
        F.col(text).cast("string").alias("text"),
    )
    size = base.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("docs")).first()
    groups = max(1, -(-((size["n"] or 0) + 100 * size["docs"]) // GROUP_BYTES))
    tasks = max(min(groups, FEW_TASKS), groups // TASK_GROUPS)

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tokens = tokenizer(vocabulary)
        frame = frame.sort_values(["no_id", "doc_id", "text"], kind="stable", na_position="first")
        named = []
        for i, no, t, copies in zip(frame["doc_id"], frame["no_id"], frame["text"], frame["copies"]):
            named += [(None if no else int(i), encode(t, tokens))] * copies
        return pack_group(int(key[0]), named, length, tokens.n_vocab)

    return (
        _portions(base)
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "text", "portion"), F.lit(groups)))
        .repartition(tasks, "group")
        .groupBy("group")
        .applyInPandas(packed, PACKED)
    )


def write_packs(packs: DataFrame, path: str) -> None:
    """Packed rows as Parquet files that a loader can map: one id matrix row, its positions and lengths per row."""
    packs.write.mode("errorifexists").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_packing": op5_packing}
