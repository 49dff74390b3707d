"""Losses under both models against a plain computation."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfield.llm import crossentropy as op

SF = "/root/testdata/sf0.001"


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def plain(docs, target, background):
    """[(n_words, target loss, background loss)] of ``docs``, from counts of whole words."""
    sides = [[words(t) for t in target], [words(t) for t in background]]
    singles = [Counter(w for t in side for w in t) for side in sides]
    total = singles[0] + singles[1]
    vocabulary = {w for w, n in total.items() if n >= op.LEAST}
    pairs = [Counter(p for t in side if t for p in zip(["<s>", *t], t)) for side in sides]
    kept = {p for p, n in (pairs[0] + pairs[1]).items() if n >= op.LEAST}
    after = [Counter() for _ in sides]
    for s in range(2):
        for h, w in kept:
            after[s][h] += pairs[s][h, w]
    rare = [sum(n for w, n in side.items() if w not in vocabulary) for side in singles]
    out = []
    for text in docs:
        t = words(text)
        if not t:
            out.append((0, None, None))
            continue
        losses = []
        for s in range(2):
            loss = 0.0
            for h, w in zip(["<s>", *t], t):
                n = singles[s][w] if w in vocabulary else rare[s]
                share = (n + 1) / (sum(singles[s].values()) + len(vocabulary) + 1)
                count = pairs[s][h, w] if (h, w) in kept else 0
                loss -= math.log((count + op.PRIOR * share) / (after[s][h] + op.PRIOR))
            losses.append(loss / len(t))
        out.append((len(t), *losses))
    return out


def made():
    rng = random.Random(3)
    make = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    docs = [None, "", " \n", "ONE", "é É", "ONE two"] + [make(["a", "b", "c", "D", "é"], rng.randrange(1, 80)) for _ in range(30)]
    docs += [make(["a", "zz"], 9000), make([f"w{i}" for i in range(90)], 200), docs[7], docs[7]]
    return docs, [make(["a", "b", "x", "w3"], 40) for _ in range(10)] + [None, ""]


def same(frame, want):
    """Scores by doc_id against ``want`` by its place."""
    rows = frame.collect()
    for r in rows:
        n, a, b = want[r["doc_id"]]
        assert r["n_words"] == n
        if a is None:
            assert r["target_loss"] is None and r["background_loss"] is None and r["difference"] is None
        else:
            assert (r["target_loss"], r["background_loss"]) == pytest.approx((a, b), abs=1e-9)
            assert r["difference"] == pytest.approx(a - b, abs=1e-9)
    return len(rows)


@pytest.mark.parametrize("hot, least", [(100_000, 2), (40, 2), (1, 1), (300, 5)])
def test_equals_plain_models(spark, monkeypatch, hot, least):
    """Terms that travel, terms that are joined, and some of both."""
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "LEAST", least)
    monkeypatch.setattr(op, "FLUSH", 10)
    monkeypatch.setattr(op, "PORTION", 50)
    monkeypatch.setattr(op, "BUCKET_BYTES", 3000)
    docs, target = made()
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(docs)], "doc_id long, text string, key int, word string").repartition(3)
    conversations = spark.createDataFrame([(t, 5) for t in target], "text string, inside int")
    assert same(op.cross_entropy_difference(frame, conversations), plain(docs, target, docs)) == len(docs)
    other = conversations.withColumn("text", F.concat("text", F.lit(" b q q")))
    want = plain(docs, target, [None if t is None else f"{t} b q q" for t in target])
    assert same(op.cross_entropy_difference(frame, conversations, other), want) == len(docs)


def test_empty_tables_and_repeated_rows(spark):
    docs, target = made()
    rows = [(i, t) for i, t in enumerate(docs)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "text string")
    assert same(op.cross_entropy_difference(frame, none), plain(docs, [], docs * 2)) == len(rows)
    assert same(op.cross_entropy_difference(frame, none, none), plain(docs, [], [])) == len(rows)
    assert op.cross_entropy_difference(frame.limit(0), none).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (None, "a c"), (None, "a b"), (2**60 + 1, "a b")], "doc_id long, text string")
    got = op.cross_entropy_difference(nameless, none).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 3, 2**60 + 1: 1}
    assert len({r["background_loss"] for r in got}) == 2


def test_rare_words_count_at_any_size_of_the_corpus(spark):
    """A word of two target texts makes a text more like the target, among few words or many."""
    for size in (10, 3000):
        docs = [f"plain{i} plain{i} text{i} text{i}" for i in range(size)] + ["zebra", "other"]
        frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        target = spark.createDataFrame([("zebra",), ("zebra",)], "text string")
        got = {r["doc_id"]: r["difference"] for r in op.cross_entropy_difference(frame, target).where(F.col("doc_id") >= size).collect()}
        assert got[size] < got[size + 1] - 0.25


def test_models_sum_to_one(spark):
    target, background = ["a b a b c a b", "a b c c"], ["b b a c rare", "c a b"]
    texts = ["a", *[f"a {w}" for w in ("a", "b", "c", "unseen")]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = [spark.createDataFrame([(t,) for t in side], "text string") for side in (target, background)]
    got = {r["doc_id"]: r for r in op.cross_entropy_difference(docs, *tables).collect()}
    for side in ("target_loss", "background_loss"):
        assert sum(math.exp(-2 * got[i][side]) for i in range(1, 5)) == pytest.approx(math.exp(-got[0][side]))


def test_registered_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    target = pd.read_parquet(f"{SF}/conversations.parquet").text.tolist()
    got = op.op1_cross_entropy(spark, SF).toPandas().set_index("doc_id").loc[docs.doc_id]
    want = plain(docs.text.tolist(), target, docs.text.tolist())
    assert got.n_words.tolist() == [w[0] for w in want]
    assert got.target_loss.tolist() == pytest.approx([w[1] for w in want], abs=1e-9)
    assert got.background_loss.tolist() == pytest.approx([w[2] for w in want], abs=1e-9)
