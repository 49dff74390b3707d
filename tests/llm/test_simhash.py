"""SimHash, BK-trees and groups of near copies against plain answers."""

import itertools
import random

import numpy as np
import pandas as pd
from brute import components, simhash as plain_simhash

from nearfield.llm import simhash as op
from nearfield.llm.bktree import Forest
from nearfield.llm.components import connected

SF = "/root/testdata/sf0.001"


def test_fingerprint_of_a_text():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one TWO", "one two three", "Ünï ÉÉ a\x0bb\x0cc d", "x y z z z z z"]
    texts += [" ".join(rng.choice(["ab", "CD", "é", "x"]) for _ in range(n)) for n in (4, 50, 700)]
    for text in texts:
        assert op.simhash(None if text is None else text.encode()) == plain_simhash(text)
    long = " ".join(rng.choice(["ab", "CD", "é", "x"]) + str(rng.randrange(99)) for _ in range(70_000))
    assert op.simhash(long.encode()) == plain_simhash(long)


def test_forest_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    tree = (codes % np.uint64(3)).astype(np.int64)
    forest = Forest(codes, tree)
    asks = np.concatenate([codes, rng.integers(0, 2**63, 30, dtype=np.uint64)])
    for radius in (0, 1, 2, 5):
        for t in (0, 2, 9):
            q, n = forest.within(asks, np.full(len(asks), t), radius)
            want = {(i, j) for i in range(len(asks)) for j in range(len(codes)) if tree[j] == t and int(asks[i] ^ codes[j]).bit_count() <= radius}
            assert len(q) == len(want) and set(zip(q.tolist(), n.tolist())) == want
    empty = Forest(np.empty(0, np.uint64), np.empty(0, np.int64)).within(codes, tree, 2)
    assert len(empty[0]) == 0


def test_connected_long_chain_hub_and_nulls(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (300, 200), (None, 1)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == components({n for link in real for n in link}, real)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    texts = [None, "", "  ", None, "single", "Single", "two words"]
    for b in base:
        texts += [" ".join(b), " ".join(b).upper(), " ".join(b[:-1]), " ".join(b[:60] + ["new"] + b[60:])]
    rows = [(1000 - i, t, "fp", 5) for i, t in enumerate(texts)]
    rows += [rows[10], (None, " ".join(base[0]), "x", 1), (None, None, None, None), (None, "alone in its group", None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")


def test_groups_equal_brute_force(spark):
    rows, frame = documents(spark)
    for radius in (2, 0):
        got = sorted(op.near_duplicates(frame, radius=radius).collect(), key=str)
        codes = [plain_simhash(r[1]) for r in rows]
        links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (codes[i] ^ codes[j]).bit_count() <= radius]
        group = components(range(len(rows)), links)
        best = {}
        for i, r in enumerate(rows):
            if r[0] is not None:
                best[group[i]] = min(r[0], best.get(group[i], r[0]))
        want = sorted(((r[0], int(np.uint64(codes[i]).view(np.int64)), best.get(group[i])) for i, r in enumerate(rows)), key=str)
        assert sorted((tuple(r) for r in got), key=str) == want


def test_full_shards_are_cut_into_trees_without_loss(spark, monkeypatch):
    monkeypatch.setattr(op, "TREE_NODES", 5)
    monkeypatch.setattr(op, "TASK_ROWS", 40)
    monkeypatch.setattr(op, "QUERIES_AT_ONCE", 7)
    rng = random.Random(1)
    codes = list({(1 << 40) ^ (1 << rng.randrange(21)) ^ (1 << rng.randrange(21)) for _ in range(60)} | {rng.getrandbits(63) for _ in range(20)})
    links = op.near_links(spark.createDataFrame([(c,) for c in codes], "code long")).collect()
    near = [(a, b) for a, b in itertools.combinations(codes, 2) if (a ^ b).bit_count() <= 2]
    assert components(codes, [(r["a"], r["b"]) for r in links]) == components(codes, near)


def test_empty_table_and_one_of_each_group(spark):
    rows, frame = documents(spark)
    assert op.near_duplicates(frame.limit(0)).count() == 0
    kept = op.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    groups = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(frame).collect() if r["doc_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values()))
    assert ids.count(None) == 3


def test_registered_query_over_the_smallest_tables(spark):
    got = op.op6_simhash(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    code = {i: plain_simhash(t) for i, t in zip(docs.doc_id, docs.text)}
    near = [(a, b) for a, b in itertools.combinations(sorted(code), 2) if (code[a] ^ code[b]).bit_count() <= 2]
    group = components(sorted(code), near)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {i: (f"{c:016x}", group[i]) for i, c in code.items()}
