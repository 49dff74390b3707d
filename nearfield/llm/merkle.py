"""Merkle trees over documents, and versions of them that share every node an edit leaves alone."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nearfield.session import cut_lineage

FAN = 3  # nodes of a run, which become one node above
LEVELS = 6  # levels of a block: one task builds the tree over FAN ** LEVELS neighbouring nodes
TASK_ROWS = 50_000
BROADCAST_SPANS = 500_000  # so many stretches of a tree (below 50 MB) travel to the nodes; more are joined
VALUES = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes of the value in UTF-8, their number before them."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def tree_over(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([hashed(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def beside(tree: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the nodes over leaf ``at`` in their runs, level by level."""
    left, right = [], []
    for nodes in tree[:-1]:
        run = at - at % FAN
        left.append("".join(nodes[run:at]))
        right.append("".join(nodes[at + 1 : run + FAN]))
        at //= FAN
    return left, right


def copied(leaf: str, left: list[str], right: list[str]) -> list[str]:
    """The path of a version: its leaf and the ancestors that it cannot share."""
    out = [leaf]
    for before, after in zip(left, right):
        out.append(hashed([before, out[-1], after]))
    return out


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def numbered(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` with ``at``, the place of a row in its ``tree`` from 0 by ``order``, and ``size``, the rows of the tree.

    Rows are dealt out by ranges of tree and order, and stretches of a tree are
    counted range by range; no window holds a tree. ``order`` should settle ties:
    equal rows are cut into ranges only by what differs.
    """
    keys = ["tree", *order]
    placed = cut_lineage(
        df.repartitionByRange(_tasks(df, rows), *keys)
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    )
    spans = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = cut_lineage(
        spans.select(
            "tree",
            "part",
            (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(W.partitionBy("tree")).alias("size"),
        )
    )
    few = spans.count() <= BROADCAST_SPANS
    return placed.join(F.broadcast(spans) if few else spans, ["tree", "part"]).select(
        *df.columns, (F.col("seq") + F.col("shift")).alias("at"), "size"
    )


def _blocks(nodes: DataFrame, rows: int, levels: int) -> DataFrame:
    """Nodes with the number of their block, each block in one place."""
    block = F.floor(F.col("at") / FAN**levels).cast("long")
    return nodes.withColumn("block", block).repartition(_tasks(nodes, rows), "tree", "block")


def _built(frame: pd.DataFrame, levels: int) -> list[list[str]]:
    """The tree over the leaves of a block, which are sorted."""
    return tree_over(frame["digest"].tolist(), min(levels, height(int(frame["size"].iloc[0]))))


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(tree, at, top, lefts, rights)`` for ``nodes`` ``(tree, at, digest, size)``.

    ``top`` is the node that remains of a tree and ``lefts``, ``rights`` what stands
    beside the nodes on the way there, level by level. Blocks of FAN ** levels
    neighbours are built each in one task, and their tops are the nodes of the
    next round, so that no task sees a tree, however many leaves it has.
    """
    nodes = cut_lineage(nodes)
    counted = nodes.agg(F.max("size").alias("size"), F.count("*").alias("rows")).first()
    if (counted["size"] or 0) <= 1:
        none = F.array().cast("array<string>")
        return nodes.select("tree", "at", F.col("digest").alias("top"), none.alias("lefts"), none.alias("rights"))
    upper = climb(tops(nodes, counted["rows"], levels), levels)

    def path(key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        tree, over = _built(own, levels), above.iloc[0]
        rows = [beside(tree, i) for i in range(len(own))]
        return pd.DataFrame(
            {
                "tree": own["tree"].tolist(),
                "at": own["at"].tolist(),
                "top": over["top"],
                "lefts": [left + list(over["lefts"]) for left, _ in rows],
                "rights": [right + list(over["rights"]) for _, right in rows],
            }
        )

    return _with_upper(nodes, upper, counted["rows"], levels).applyInPandas(
        path, "tree string, at long, top string, lefts array<string>, rights array<string>"
    )


def tops(nodes: DataFrame, rows: int, levels: int) -> DataFrame:
    """The nodes above the blocks of ``nodes``."""

    def top(frame: pd.DataFrame) -> pd.DataFrame:
        frame, block = frame.sort_values("at"), frame["block"].iloc[0]
        size = -(-int(frame["size"].iloc[0]) // FAN**levels)
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "at": block, "digest": _built(frame, levels)[-1], "size": size})

    blocks = _blocks(nodes.select("tree", "at", "digest", "size"), rows, levels)
    return blocks.groupBy("tree", "block").applyInPandas(top, "tree string, at long, digest string, size long")


def _with_upper(nodes: DataFrame, upper: DataFrame, rows: int, levels: int):
    """Blocks of nodes, each beside the one row that ``upper`` has of it."""
    return _blocks(nodes, rows, levels).groupBy("tree", "block").cogroup(upper.withColumnRenamed("at", "block").groupBy("tree", "block"))


def manifest(
    docs: DataFrame, edited: Column | None = None, key: str = "doc_id", tree: str = "source", values: tuple[str, ...] = VALUES, levels: int = LEVELS
) -> DataFrame:
    """``(key, leaf, subroot, root, proof, folded_root, copies)`` for every row of ``docs``.

    A row's ``leaf`` is the SHA-256 of ``values``. Rows with the same ``tree``
    column, in the order of ``key``, are the leaves of a tree with ``subroot`` on
    top; subroots in the order of ``tree`` are the leaves of the tree of ``root``.
    ``proof`` holds the siblings on the way up, level by level, as one string of
    digests, and ``folded_root`` follows from them and the leaf as it is found later,
    with ``edited`` for its text. Where that is another leaf, the row has a version
    of its own: ``copies`` are the nodes it cannot share with the tree, from its leaf
    to its root; elsewhere it is null. All other nodes of a version are the tree's.

    Inside a block of FAN ** levels leaves the task that builds the block copies
    the path of every version; above, the version goes on along the path that the
    rounds over block tops have found for its block (``climb``).

    Nulls: a null value is ``-`` in the leaf; a null tree is a tree of its own, the
    first; null keys come first. Rows that repeat a key are leaves of their own,
    ordered by leaf; equal rows stand side by side. No rows, no rows. Other columns
    are not read.
    """
    text = F.col("text")
    later = [F.col(v) if v != "text" or edited is None else edited for v in values]
    leaves = docs.select(
        F.col(key).alias("key"),
        F.col(tree).cast("string").alias("branch"),
        encoded(F.col(tree)).alias("tree"),
        digest(*(encoded(text if v == "text" else F.col(v)) for v in values)).alias("digest"),
        digest(*map(encoded, later)).alias("later"),
    )
    leaves = leaves.withColumn("later", F.when(F.col("later") != F.col("digest"), F.col("later")))
    leaves = cut_lineage(leaves.withColumn("salt", F.monotonically_increasing_id()))
    rows = leaves.count()
    placed = numbered(leaves, ["key", "digest", "salt"], rows)
    upper = cut_lineage(climb(tops(placed, rows, levels), levels))

    # the tree over the trees
    branches = cut_lineage(leaves.select("branch", "tree").distinct())
    crowns = upper.select("tree", F.col("top").alias("digest")).dropDuplicates(["tree"]).join(branches, "tree")
    crowns = crowns.select(F.lit("").alias("tree"), "branch", F.col("tree").alias("own"), "digest")
    crowns = cut_lineage(numbered(crowns, ["branch"], branches.count()))
    forest = climb(crowns.select("tree", "at", "digest", "size"), levels).select(
        "at", F.col("top").alias("root"), F.col("lefts").alias("root_lefts"), F.col("rights").alias("root_rights")
    )
    forest = cut_lineage(crowns.select("at", F.col("own").alias("tree")).join(forest, "at").drop("at"))
    upper = upper.join(forest, "tree").select(
        "tree", "at", "top", "root", F.concat("lefts", "root_lefts").alias("lefts"), F.concat("rights", "root_rights").alias("rights")
    )

    def path(key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        built, over = _built(own, levels), above.iloc[0]
        proofs, folds, versions = [], [], []
        for i, (leaf, later) in enumerate(zip(own["digest"], own["later"])):
            left, right = beside(built, i)
            left, right = left + list(over["lefts"]), right + list(over["rights"])
            proofs.append("".join(a + b for a, b in zip(left, right)))
            folds.append(copied(later or leaf, left, right))
            versions.append(folds[-1] if later else None)
        return pd.DataFrame(
            {
                "key": own["key"].tolist(),
                "leaf": own["digest"].tolist(),
                "subroot": over["top"],
                "root": over["root"],
                "proof": proofs,
                "folded_root": [path[-1] for path in folds],
                "copies": versions,
            }
        )

    kind = leaves.schema["key"].dataType
    rows_of = placed.select("tree", "at", F.col("key").cast("string").alias("key"), "digest", "later", "size")
    done = _with_upper(rows_of, upper, rows, levels).applyInPandas(
        path, "key string, leaf string, subroot string, root string, proof string, folded_root string, copies array<string>"
    )
    return done.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves; of every second one (by crc32 of its id) the lines are joined, which its version shows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    edited = F.when(struck, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, edited).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


CRC = """
  crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
  )"""


def crc32_sql(codes: str) -> str:
    """CRC-32 of a list of byte values, beside the table of CRC."""
    steps = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))"
    return f"xor({steps}, 4294967295)"


def _encoded_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


OP13_SQL = f"""
WITH RECURSIVE {CRC},
  docs AS (
    SELECT doc_id, source, {" || ".join(_encoded_sql(v) for v in VALUES)} AS whole,
      CASE WHEN {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 2 = 0
        THEN {" || ".join(_encoded_sql("replace(text, chr(10), '')" if v == "text" else v) for v in VALUES)} END AS struck
    FROM documents, crc
  ),
  leaves AS (
    SELECT *, sha256(whole) AS leaf, sha256(coalesce(struck, whole)) AS later,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(whole)) - 1 AS pos,
      count(*) OVER (PARTITION BY source) AS size
    FROM docs
  ),
  low AS (
    SELECT 0 AS level, source, pos, leaf AS d, size FROM leaves
    UNION ALL
    SELECT level + 1, source, pos // {FAN}, sha256(string_agg(d, '' ORDER BY pos)), (any_value(size) + {FAN - 1}) // {FAN}
    FROM low WHERE size > 1 GROUP BY level, source, pos // {FAN}
  ),
  subroots AS (
    SELECT source, d AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1
  ),
  high AS (
    SELECT 0 AS level, pos, subroot AS d, size FROM subroots
    UNION ALL
    SELECT level + 1, pos // {FAN}, sha256(string_agg(d, '' ORDER BY pos)), (any_value(size) + {FAN - 1}) // {FAN}
    FROM high WHERE size > 1 GROUP BY level, pos // {FAN}
  ),
  beside AS (
    SELECT source, pos, level, string_agg(d, '' ORDER BY n) FILTER (n < own) AS l, string_agg(d, '' ORDER BY n) FILTER (n > own) AS r
    FROM (
      SELECT v.source, v.pos, n.level, v.pos // ({FAN} ** n.level)::BIGINT AS own, n.pos AS n, n.d
      FROM leaves v JOIN low n ON n.source IS NOT DISTINCT FROM v.source AND n.size > 1 AND n.pos // {FAN} = (v.pos // ({FAN} ** n.level)::BIGINT) // {FAN}
    ) GROUP BY source, pos, level
    UNION ALL
    SELECT source, pos, level, string_agg(d, '' ORDER BY n) FILTER (n < own), string_agg(d, '' ORDER BY n) FILTER (n > own)
    FROM (
      SELECT v.source, v.pos, s.height + n.level AS level, s.pos // ({FAN} ** n.level)::BIGINT AS own, n.pos AS n, n.d
      FROM leaves v JOIN subroots s ON s.source IS NOT DISTINCT FROM v.source
      JOIN high n ON n.size > 1 AND n.pos // {FAN} = (s.pos // ({FAN} ** n.level)::BIGINT) // {FAN}
    ) GROUP BY source, pos, level
  ),
  proofs AS (
    SELECT source, pos, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level)) AS proof FROM beside GROUP BY source, pos
  ),
  folds AS (
    SELECT source, pos, 0 AS level, later AS d FROM leaves
    UNION ALL
    SELECT f.source, f.pos, f.level + 1, sha256(coalesce(b.l, '') || f.d || coalesce(b.r, ''))
    FROM folds f JOIN beside b ON b.source IS NOT DISTINCT FROM f.source AND b.pos = f.pos AND b.level = f.level
  ),
  folded AS (SELECT source, pos, arg_max(d, level) AS folded_root FROM folds GROUP BY source, pos)
SELECT v.doc_id, v.leaf, s.subroot, h.d AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = h.d AS verified
FROM leaves v
JOIN subroots s ON s.source IS NOT DISTINCT FROM v.source
JOIN folded f ON f.source IS NOT DISTINCT FROM v.source AND f.pos = v.pos
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM v.source AND p.pos = v.pos
JOIN high h ON h.size = 1
"""

QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {"op13_merkle": OP13_SQL}
