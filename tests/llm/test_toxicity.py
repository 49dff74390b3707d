"""Restored words, learned labels and scores."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from nearfield.llm import toxicity as op

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    english = "you are a stupid idiot and a pathetic loser this moron is worthless trash what a clown the weather in the book was good " * 50
    return op.CharacterModel(op.trigrams([english]))


def test_decoder_restores_disguised_words(model):
    for disguised, word in {
        "1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "iiidiooot": "idiot", "m0r0n": "moron",
        "p@thet1c": "pathetic", "tr4$h": "trash", "STUP1D": "stupid", "cl0wn tr4sh": "clown trash", "l-o-s-e-r": "loser",
    }.items():
        assert model.restore(disguised) == word
        assert word.split()[0] in op.restored_words(f"so {disguised} it", model.restore)
    assert model.restore("book") == "book"


def test_lattice_search_is_the_cheapest_path(model):
    """Against all readings of a stretch without runs, one by one."""
    table, cost = op.class_table(), model.cost

    def readings(text):
        if not text:
            yield "", 0.0
            return
        c, rest = text[0], list(readings(text[1:]))
        options = [(c, 0.0)] if c.isalpha() else [(x, op.SIGN_COST) for x in op.SIGNS.get(c, "")]
        if not c.isalpha():
            options += [("", op.DROP_COST), (" ", 0.0)] if c in op.FILLERS else [(" ", op.KEEP_COST if c in op.SIGNS else 0.0)]
        for x, extra in options:
            for y, more in rest:
                yield x + y, extra + more

    def price(written):
        total, a, b = 0.0, 0, 0
        for x in written + " ":
            k = int(table[ord(x)]) if x != " " else 0
            if k == 0:
                total, a, b = total + (float(cost[a, b, 0]) if b else 0.0), 0, 0
            else:
                total, a, b = total + float(cost[a, b, k]), b, k
        return total

    for text in ("1d10t", "a b c", "w0rth|ess", "x@y.z1", "$0-1!"):
        best = min(price(w) + extra for w, extra in readings(text))
        got = model.restore(text)
        assert min(price(w) + extra for w, extra in readings(text) if " ".join(w.split()) == got) == pytest.approx(best, abs=1e-4)


def test_what_is_and_is_not_disguised():
    for plain in ("plain words, only. here", "ends### with$$$ signs%%% !!!", "phone 555-1234 and 2.5", "a b", "", "well, then... ok"):
        assert op.disguised(plain) == [], plain
    assert [" 1d10t x"[a:b] for a, b in op.disguised(" 1d10t x")] == ["1d10t"]
    assert op.disguised("so i-d-i-o-t it") and op.disguised("soooo")
    op.disguised("a1" * 100_000)
    assert op.restored_words(None, str) == [] and op.restored_words("  ", str) == []


def test_long_disguises_are_restored_too(model):
    spaced = "so " + " ".join("youareastupididiotandapatheticloserthismoronisworthlesstrash" * 4) + " it"
    words = op.restored_words(spaced, model.restore)
    assert len(spaced) > 400 and {"stupid", "pathetic", "moron"} <= set(words)
    joined = "-".join(["st0pid", "1d10t", "m0r0n", "p@thet1c"] * 20)
    assert len(joined) > 200 and {"idiot", "moron", "pathetic"} <= set(op.restored_words(joined, model.restore))
    assert op.disguised("x" + "a1" * 200 + " y") == [(0, 401)]
    assert len(model.restore("m0r0n " * 20_000).split()) == 20_000


def tables(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    bad = ["gronk", "snarfle", "blixum"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
            text.append(rng.choice(bad))
        docs.append((i, " ".join(text), "x", 0.5))
        if i < 500:
            labels.append((i, 1, int(toxic)))
    docs += [(700, None, None, None), (701, "", "", 0.0), (702, "you g r o n k here", "", 0.0), (703, "you sn4rfl3 here", "", 0.0), (None, docs[0][1], "", 0.0)]
    docs += [docs[3], (704, "w " * 50_000, "", 0.0)]
    labels += [(None, 1, 1), (701, 0, None), (9999, 1, 1), (0, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, feature string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs,
    )


def test_learns_scores_and_restores(spark):
    frame, labels, docs = tables(spark)
    got = op.score(frame, op.train(frame, labels), name="t").collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r["t"] for r in got}
    assert all((by[i] >= 0.5) == (i % 5 == 0) for i in range(500, 600))
    assert by[700] == by[701] < 0.1 and by[704] < 0.5
    assert by[702] >= 0.5 and by[703] >= 0.5 and by[None] == by[0]


def test_counts_of_the_whole_corpus_and_no_examples(spark):
    frame, labels, docs = tables(spark)
    assert (op.count_trigrams(frame.repartition(6)) == op.trigrams([d[1] for d in docs])).all()
    none = op.score(frame, op.train(frame, labels.where("toxic = 0")), name="t").collect()
    assert max(r["t"] for r in none) < 1e-9
    assert op.score(frame.limit(0), op.train(frame.limit(0), labels.limit(0))).count() == 0


def test_registered_query_on_held_out_labels(spark):
    got = op.op9_toxicity(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{SF}/documents.parquet"))
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    area = np.mean((toxic[:, None] > clean) + 0.5 * (toxic[:, None] == clean))
    assert area > 0.8 and (held.predicted[held.toxic == 0] == 0).mean() > 0.97
