"""Merkle trees and their versions against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from nearfield.llm import merkle as op

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def walk(tree, at):
    for nodes in tree[:-1]:
        run = at - at % 3
        yield nodes[run:at], nodes[at + 1 : run + 3]
        at //= 3


def plain(rows, edit):
    """{row number: (leaf, subroot, root, proof, folded root)} of (doc_id, source, lang, n_chars, text)."""
    leaf = {i: h(*map(enc, r)) for i, r in enumerate(rows)}
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i])) for s in sources}
    trees = {s: plain_tree([leaf[i] for i in own]) for s, own in order.items()}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out = {}
    for place, s in enumerate(sources):
        for at, i in enumerate(order[s]):
            later = fold = h(*map(enc, (*rows[i][:4], edit(rows[i]))))
            proof, copies = "", [later]
            for left, right in (*walk(trees[s], at), *walk(top, place)):
                proof += "".join(left + right)
                fold = h(*left, fold, *right)
                copies.append(fold)
            out[i] = (leaf[i], trees[s][-1][0], top[-1][0], proof, fold, copies if later != leaf[i] else None)
    return out


def check(spark, rows, **more):
    def edit(row):
        struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        return row[4].replace("\n", "") if struck and row[4] is not None else row[4]

    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    edited = F.when(struck, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["copies"]) for r in op.manifest(
        spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), edited, **more).collect()), key=key)
    want = sorted(((rows[i][0], *v) for i, v in plain(rows, edit).items()), key=key)
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want] if len({r for r in rows}) == len(rows) else True
    assert sorted(g[4] for g in got) == sorted(w[4] for w in want)
    assert {(g[0], g[5] == g[3]) for g in got} == {(w[0], w[5] == w[3]) for w in want}


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_a_plain_tree_whatever_the_size_of_blocks(spark, levels):
    rows = [(i, f"s{i % 2}" if i % 7 else "one", "en", i, f"text {i}\nmore é" if i % 5 else None) for i in range(60)]
    rows += [(None, None, None, None, None), (2**60 + 1, None, "de", 3, "\n" * 5), (7, "z", None, 0, ""), (8, "ö", "x" * 300, -1, "long " * 30_000)]
    rows += [(9, f"many{i}", "en", i, "a\nb") for i in range(11)]
    check(spark, rows, levels=levels)


def test_rows_that_repeat_are_leaves_of_their_own(spark):
    check(spark, [(5, "s", "en", 1, "a\nb")] * 7 + [(5, "s", "en", 2, "c\nd")] * 2 + [(None, "s", None, None, "x\n")] * 3)


def test_a_version_shares_all_but_its_path(spark):
    rows = [(i, "s", "en", 1, f"a\nb{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("clash")).withColumn("at", F.lit(1))
    got = {r["doc_id"]: r for r in op.manifest(docs, F.when(F.col("doc_id") == 13, "other").otherwise(F.col("text"))).collect()}
    nodes = {d for level in plain_tree([got[i]["leaf"] for i in range(30)]) for d in level}
    assert [i for i, r in got.items() if r["copies"]] == [13]
    assert len(got[13]["copies"]) == 1 + 4 and not nodes & {*got[13]["copies"]}
    assert got[13]["folded_root"] != got[13]["root"] and all(r["folded_root"] == r["root"] for i, r in got.items() if i != 13)
    beside = {got[13]["proof"][i : i + 64] for i in range(0, len(got[13]["proof"]), 64)}
    assert beside <= nodes


def test_no_rows(spark):
    assert op.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_equal_rows_are_dealt_over_tasks(spark):
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text"))
    leaves = docs.select(F.lit("t").alias("tree"), F.lit(1).alias("key"), F.monotonically_increasing_id().alias("salt"))
    placed = op.numbered(leaves, ["key", "salt"], 40_000)
    assert sorted(r["at"] for r in placed.select("at").collect()) == list(range(40_000))
    assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000


def test_whole_query(spark):
    text, _, _, fine = compare(spark, duck(SF), SF, "op13_merkle", op.op13_merkle, op.OP13_SQL)
    assert fine, text
