"""Closed syncmers, fingerprints and edited texts against plain answers."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from nearfield.llm import syncmers as op

SF = "/root/testdata/sf0.001"


def codes_of(text):
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def test_anchors_are_context_free_and_edge_minimal():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdé \n") for _ in range(500))
    at, code = op.closed_syncmers(codes_of(text))
    chosen = dict(zip(at.tolist(), code.tolist()))

    def inner(s):
        h = np.zeros(1, dtype=np.uint64)
        for c in codes_of(s).astype(np.uint64):
            h = h * op._P + c
        return int(op._mix(h)[0])

    for i in range(len(text) - op.K + 1):
        kmer = text[i : i + op.K]
        least = [inner(kmer[j : j + op.S]) for j in range(op.K - op.S + 1)]
        assert (i in chosen) == (min(least) in (least[0], least[-1]))
        alone = op.closed_syncmers(codes_of(kmer))[1].tolist()
        assert alone == ([chosen[i]] if i in chosen else [])


def test_a_short_passage_of_very_long_texts_is_seen():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100_000)) for _ in range(3)]
    for at in (0, 40_000, 98_000):  # 2 of 100 code points, in the same place or in another
        shared = made[1][:at] + made[0][50_000:52_000] + made[1][at + 2_000 :]
        one, other, far = op.fingerprints([made[0], shared, made[2]])
        assert 0 < op.likeness(one, other) < 0.1 and op.likeness(one, far) == 0
    counts = [len(f) // 16 for f in op.fingerprints([made[0], made[0] + made[1], made[0][:5_000]])]
    assert counts[0] > 300 and counts[1] > 1.8 * counts[0] and counts[2] == op.KEPT


def test_fingerprints_and_likeness(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    long, other = (" ".join(rng.choice(words) for _ in range(700)) for _ in range(2))
    texts = [long, "", "x", "short", long, long[: len(long) // 2], "lead " + long, other, "é" * 5000]
    prints = op.fingerprints(texts)
    assert prints[0] == prints[4] and prints[1] == "" and len({*prints}) == len({*texts})
    assert prints == [op.fingerprints([t])[0] for t in texts]
    like = [op.likeness(prints[0], p) for p in prints]
    assert like[0] == 1 and like[1] == like[2] == like[3] == 0
    assert like[6] > 0.9 and 0.4 < like[5] < 0.9 and like[7] < 0.1
    assert op.likeness("", "") == 1 and op.likeness(prints[2], prints[2]) == 1
    monkeypatch.setattr(op, "PIECE", 97)
    assert op.fingerprints(texts) == prints


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for i, r in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        a, b, c = op.fingerprints([t, e, n])
        out.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(op.likeness(a, b), 9), round(op.likeness(a, c), 9)))
    return sorted(out, key=str)


def rows_in(frame):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_edits_follow_descending_ids(spark, parts):
    rng = random.Random(6)
    rows = [(rng.randrange(-50, 10**12), "".join(rng.choice("abc é") for _ in range(rng.randrange(200)))) for _ in range(60)]
    rows += [(5, None), (6, ""), (7, "ab"), (7, "ba"), (7, "ab"), (None, "last"), (None, "least"), (8, "y" * 30_000)]
    frame = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, part int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_in(op.fingerprint_edits(frame)) == expected(rows)
        assert rows_in(op.fingerprint_edits(frame.where("doc_id = 6"))) == expected([(6, "")])
        assert op.fingerprint_edits(frame.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_registered_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert rows_in(op.op10_syncmers(spark, SF)) == expected(list(zip(docs.doc_id.tolist(), docs.text)))
