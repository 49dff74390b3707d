"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from compare import compare, duck
from nearfield.llm import variants as op

SF = "/root/testdata/sf0.001"


def distance_is_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(words, ratio=op.RATIO):
    near = {w: [v for v in words if distance_is_one(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def made(rng, n, alphabet="abcdéÿ"):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7)))
        words[w] = 5 ** rng.randrange(0, 6) * rng.randrange(1, 4)
    return words


def grouped(spark, words):
    return {tuple(r) for r in op.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}


@pytest.mark.parametrize("shard", [20_000, 12, 1])
def test_equals_all_pairs(spark, monkeypatch, shard):
    """With small shards words lie in many, and with one word a shard all leaves of several words are overfull."""
    monkeypatch.setattr(op, "SHARD_WORDS", shard)
    words = made(random.Random(shard), 300)
    assert grouped(spark, words) == plain(words)


def test_long_words_anagrams_and_chains(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 40)
    rng = random.Random(2)
    words = {}
    while len(words) < 120:  # one profile for all
        words["".join(rng.sample("aabbcdef", 8))] = rng.randrange(1, 100)
    words |= {"aabbcdee": 3, "aabbcde": 900, "x" * 5000: 5, "x" * 4999: 25, "x" * 4998 + "y": 125, "x" * 4997: 625}
    words |= {"w" * k: 5**k for k in range(1, 9)}
    got = grouped(spark, words)
    assert got == plain(words)
    assert ("w", "ww", "w" * 8, 5, 1, 25) in got


def test_trie_search_loses_no_leaf():
    rng = random.Random(7)
    words = list(made(rng, 400, "abmnoyz"))
    trie = op.planted({op.profile(w): op.profile(w) for w in words})
    for w in words:
        reached = op.reached(trie, op.profile(w))
        assert len(reached) == len({*reached})
        near = {op.profile(v) for v in words if distance_is_one(w, v) and len(v) <= len(w)}
        assert near <= {*reached}
        for way in reached:
            gap = [a - b for a, b in zip(way[1:], op.profile(w)[1:])]
            assert sum(x for x in gap if x > 0) <= 1 and -sum(x for x in gap if x < 0) <= 1


def test_words_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "FLUSH", 3)
    rows = [(1, "Straße ÄPFEL äpfel x9 don't Ābc", "c"), (1, "Straße", "c"), (None, "Straße " * 500, None), (2, None, None), (3, "", "c"), (4, "q" * 90_000, "c"), (2**61, "wörter " * 3000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    for key, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 3 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            want[low] += 1
    got = {r["word"]: r["n"] for r in op.word_counts(docs, strike=3, length=1).collect()}
    assert got == {w: n for w, n in want.items() if w}
    out = op.spelling_variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert op.spelling_variants(docs.limit(0)).count() == 0


def test_whole_query(spark):
    text, _, _, fine = compare(spark, duck(SF), SF, "op11_variants", op.op11_variants, op.OP11_SQL)
    assert fine, text
