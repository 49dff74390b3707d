"""Mixtures against SQL, and budgets against turn-by-turn redistribution."""

import random
from collections import defaultdict

import pytest
from compare import compare, duck

from nearfield.llm import mixing as op

SF = "/root/testdata/sf0.001"


def dealt(budget, children):
    """{name: tokens} by handing out what is left by weight until nobody takes any."""
    got = {n: 0.0 for n, _, _ in children}
    left = float(budget)
    while left > 1e-9:
        room = [(n, w, cap - got[n]) for n, w, cap in children if cap - got[n] > 1e-9 and w > 0]
        if not room:
            break
        weight = sum(w for _, w, _ in room)
        share = left
        left = 0.0
        for n, w, free in room:
            part = min(free, share * w / weight)
            got[n] += part
            left += share * w / weight - part
    return got


def test_budgets_redistribute_among_siblings_before_ancestors(spark):
    rng = random.Random(4)
    leaves = [(d, l, s, rng.choice([0, 3, 50, 400, 5000])) for d in ("a", "b", "c") for l in ("x", "y", None) for s in ("1", "2", "3", None)]
    weights = {"a": 7, "b": 1}, {"x": 3, "y": 0}, {"1": 2}
    frame = spark.createDataFrame(leaves, "_domain string, _lang string, _source string, tokens long")
    for share, epochs in ((0.1, 1), (0.9, 1), (1.4, 2), (5.0, 1)):
        got = {(r[0], r[1], r[2]): r["budget"] for r in op.leaf_budgets(frame, share, epochs, *weights).collect()}
        cap = defaultdict(float)
        for d, l, s, n in leaves:
            for node in ((d,), (d, l), (d, l, s)):
                cap[node] += n * epochs
        w = lambda level, name: float(weights[level].get(name, 1))
        whole = int(share * sum(n for *_, n in leaves))
        for d, b in dealt(whole, [(d, w(0, d), cap[d,]) for d in "abc"]).items():
            for l, bl in dealt(b, [(l, w(1, l), cap[d, l]) for l in ("x", "y", None)]).items():
                for s, bs in dealt(bl, [(s, w(2, s), cap[d, l, s]) for s in ("1", "2", "3", None)]).items():
                    assert got.get((d, l, s), 0) == pytest.approx(int(bs + 1e-6), abs=1), (d, l, s, share)


def frame_of(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        text = rng.choice([None, "", "one", "a b c", " ".join("w" for _ in range(rng.randrange(60)))])
        rows.append((i, text, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src3", "x", None, "src99999999999"]), "d", 1))
    rows += [rows[5], rows[5], (None, "no id here", "en", "src0", "d", 1), (None, "none", None, None, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _domain string, mixed int")


def test_prefix_of_every_epoch(spark):
    rows, frame = frame_of(spark)
    got = op.selection(frame, share=0.8, epochs=3).toPandas()
    assert got.columns.tolist() == [*frame.columns, "mixed_"]
    mixed = got["mixed_"]
    leaf = [(m["domain"], m["lang"], m["source"]) for m in mixed]
    used = defaultdict(int)
    for m, name, text in zip(mixed, leaf, got["text"]):
        used[name] += len((text or "").split())
        assert used[name] <= m["budget"]
    total = sum(len((r[1] or "").split()) for r in rows)
    longest = 60
    assert total * 0.8 - longest * len(used) <= sum(used.values()) <= total * 0.8
    per_epoch = defaultdict(set)
    for m, name, doc in zip(mixed, leaf, got["doc_id"]):
        per_epoch[name, m["epoch"]].add(str(doc))
    for (name, epoch), docs in per_epoch.items():
        assert epoch == 1 or docs <= per_epoch[name, 1]
    assert op.mix(frame, share=0.8, epochs=3).columns == frame.columns


def test_nothing_in_nothing_out_and_wide_mixtures_by_join(spark, monkeypatch):
    _, frame = frame_of(spark)
    assert op.selection(frame.limit(0)).count() == 0
    assert op.mix(frame.where("text = ''")).count() == 0
    want = sorted(map(str, op.mix(frame).collect()))
    monkeypatch.setattr(op, "SMALL_LEAVES", 0)
    assert sorted(map(str, op.mix(frame).collect())) == want


def test_registered_query_equals_sql(spark, tmp_path):
    name = "op4_mixing"
    text, _, _, fine = compare(spark, duck(SF), SF, name, op.QUERIES[name], op.ORACLES[name])
    assert fine, text
    _, frame = frame_of(spark)
    frame.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duck(SF)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    text, _, _, fine = compare(spark, con, str(tmp_path), name, op.QUERIES[name], op.ORACLES[name])
    assert fine, text
