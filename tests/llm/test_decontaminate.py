"""Benchmark windows in documents against a plain search."""

import hashlib
import random
import re

from compare import compare, duck

from nearfield.llm import decontaminate as op

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, size=10):
    wins = []
    for item, text in items:
        w = words(text)
        wins += [(item, w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    out = []
    for _, text in docs:
        w, hit, names = words(text), set(), set()
        for item, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    names.add(item)
        out.append((len(w), hit, sorted(str(n) for n in names if n is not None)))
    return out


def tables(spark):
    rng = random.Random(2)
    pool = ["alpha", "Beta", "gamma7", "Über", "naïve", "x"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate((25, 10, 9, 3, 1, 12, 30))]
    items += [(2, items[0][1]), (50, None), (51, " ... "), (None, "only words without an item id here"), items[1], (10, items[5][1].upper())]
    docs = [(1, None), (2, ""), (3, "!!! ?"), (4, " ".join(rng.choice(pool) for _ in range(4000)))]
    for k, (_, text) in enumerate(items):
        if text:
            docs.append((100 + k, f"before--{text.replace(' ', ',  ')}... after"))
            docs.append((200 + k, text.replace(" ", "\n", 3)[:-1]))
            docs.append((300 + k, f"{text}, {text}; tail"))
    docs += [docs[-1], (None, items[0][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def check(found, docs, want):
    got = sorted(((r["doc_id"], r["text"], r["f"]["n_words"], r["f"]["n_hit"], r["f"]["items"]) for r in found), key=str)
    assert got == sorted(((i, t, n, len(h), names) for (i, t), (n, h, names) in zip(docs, want)), key=str)


def test_equals_plain_search_in_one_and_in_many_blocks(spark, monkeypatch):
    docs, items, frame, benchmark = tables(spark)
    want = plain(docs, items)
    check(op.find_passages(frame, benchmark, name="f").collect(), docs, want)
    monkeypatch.setattr(op, "BLOCK_CHARS", 700)
    found = op.find_passages(frame, benchmark, name="f").collect()
    check(found, docs, want)
    for r in found:
        spans = [r["text"][p["start"] : p["end"]] for p in r["f"]["passages"]]
        assert sum(len(words(s)) for s in spans) == r["f"]["n_hit"]


def test_offsets_point_into_the_original():
    tree = op.ahocorasick.Automaton()
    tree.add_word(" a b ", (2, ["7"]))
    tree.make_automaton()
    text = "é A--B. a/b c"
    n, spans, items = op.scan(tree, text.encode())
    assert (n, spans, items) == (6, [1, 5], {"7"})
    assert [text[p["start"] : p["end"]] for p in op.original_spans(text, spans)] == ["A--B. a/b"]


def test_no_items_no_rows_and_clashing_names(spark):
    docs, items, frame, benchmark = tables(spark)
    none = op.find_passages(frame, benchmark.limit(0), name="f").collect()
    check(none, docs, [(len(words(t)), set(), []) for _, t in docs])
    assert op.find_passages(frame.limit(0), benchmark).count() == 0
    named = frame.selectExpr("*", "1 AS found", "2 AS FOUND_", "'x' AS items")
    kept = op.drop_contaminated(named, benchmark.selectExpr("*", "1 AS window"))
    assert kept.columns == named.columns
    clean = sorted(str(i) for (i, t), (_, h, _) in zip(docs, plain(docs, items)) if not h)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean


def test_registered_query_equals_sql(spark):
    name = "op7_decontamination"
    text, _, _, fine = compare(spark, duck(SF), SF, name, op.QUERIES[name], op.ORACLES[name])
    assert fine, text
    rows = op.QUERIES[name](spark, SF).where("n_items = 0").select("items_sha256").distinct().collect()
    assert [r[0] for r in rows] == [hashlib.sha256(b"").hexdigest()]
