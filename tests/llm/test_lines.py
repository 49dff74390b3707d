"""Near-repeating lines against all-pairs comparison."""

import itertools
import random
import re
from collections import Counter

import pandas as pd
from brute import components

from nearfield.llm import lines as op

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_edit_distance():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        most = rng.randrange(9)
        got, want = op.edit_distance(a, b, most), distance(a, b)
        assert got == want if want <= most else got > most
    a = "".join(rng.choice("abcdefgh ") for _ in range(300))
    b = "".join(c if rng.random() > 0.1 else "z" for c in a)
    assert op.edit_distance(a, b, 100) == distance(a, b)
    assert op.edit_distance("x" * 50_000 + "y", "z" + "x" * 50_000, 10) == 2


def test_edits_that_are_enough_are_never_too_few():
    rng = random.Random(2)
    quick = 0
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh ", "a\u00e9\U0001f600 z"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
        b = "".join(c if rng.random() > 0.05 else rng.choice(["", "x", c + "yy"]) for c in a)
        most, want = rng.randrange(20), distance(a, b)
        found = op.edits_enough(a, b, most)
        assert found >= min(want, most + 1)
        quick += found <= most
        got = op.edit_distance(a, b, most)
        assert got == want if want <= most else got > most
    assert quick > 100
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    assert op.edit_distance(a, b, 80) > 80 and op.edits_enough(a, b, 80) > 80


def test_keys_of_a_line_depend_on_no_other_line():
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    for line, keys in zip(lines, op.line_keys(lines)):
        assert op.line_keys([line])[0].tolist() == keys.tolist()


def test_lines_that_meet_in_several_shards_are_compared_once(monkeypatch):
    seen = []
    monkeypatch.setattr(op, "alike", lambda a, b, similarity: seen.append((a, b)))
    rows = [(i, code, line, shard, [5, 7], shard) for shard in (5, 7) for i, code, line in ((1, 0, "a b c"), (2, 0, "a b d"))]
    links = op.verified(pd.DataFrame(rows, columns=["line_id", "code", "line", "shard", "everywhere", "cell"]), 0.2)
    assert len(seen) == 1 and links.empty


def test_distances_found_together_decide_as_single_ones():
    rng = random.Random(3)
    near = 0
    for _ in range(60):
        letters, pairs = rng.choice(["ab", "abcdefgh ", "a\u00e9\U0001f600 z"]), []
        for _ in range(rng.randrange(1, 12)):
            a = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))
            part = rng.choice([0, 0.05, 0.2, 0.4])
            pairs.append((a, "".join(c if rng.random() > part else rng.choice(["", "x", c + "yy"]) for c in a) or "q"))
        similarity = rng.choice([0.2, 0.5, 0.8, 0.9])
        want = [distance(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
        assert op.alike_together(pairs, similarity) == want
        near += sum(want)
    assert 100 < near


def test_long_lines_are_compared_together(monkeypatch):
    """Pairs that are not quickly seen to be alike cost no distance of their own, and link as before."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    turned = lambda w, n: " ".join(w[n:] + w[:n])
    lines = [turned(words, n) for n in (0, 2, 4, 30)]
    rows = [(i, 0, line, 5, [5], 5) for i, line in enumerate(lines)]
    monkeypatch.setattr(op, "edits_enough", lambda a, b, most: most + 1)
    monkeypatch.setattr(op, "edit_distance", None)
    links = op.verified(pd.DataFrame(rows, columns=["line_id", "code", "line", "shard", "everywhere", "cell"]), 0.8)
    group = components([0, 1, 2, 3], list(links.itertuples(index=False, name=None)))
    assert [group[i] for i in range(4)] == [0, 0, 0, 3]


def test_pairs_of_a_full_cell_come_in_portions(monkeypatch):
    monkeypatch.setattr(op, "PAIRS_AT_ONCE", 100)
    frame = pd.DataFrame({"line_id": range(60), "shard": 1, "code": 0, "cell": 1})
    portions = [(a.tolist(), b.tolist()) for a, b in op.near_pairs(frame)]
    assert max(len(a) for a, _ in portions) < 160
    found = sorted(tuple(sorted(pair)) for a, b in portions for pair in zip(a, b))
    assert found == list(itertools.combinations(range(60), 2))
    assert op.partners(frame)["line_id"].tolist() == list(range(60))


def test_white_space_of_a_line():
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    assert sorted(op.SPACES + " \n") == spaces
    text = "A" + "".join(f"{c}x{c}{c}" for c in spaces) + "\n \t\n\u00c9 y"
    assert op.normalised(text) == [" ".join(line.split()) for line in text.lower().split("\n")]


def test_shared_keys_equal_a_count_of_all_keys(spark, monkeypatch):
    rows = made()
    texts = [t for _, t in rows if t is not None]
    keys = {}
    for form in {x for t in texts for x in op.normalised(t) if x}:
        for key in op.line_keys([form])[0].tolist():
            keys.setdefault(key, set()).add(op._signed([op.line_id(form)])[0])
    want = sorted((i, key, len(ids)) for key, ids in keys.items() if len(ids) > 1 for i in ids)
    monkeypatch.setattr(op, "BUCKET_KEYS", 50)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert want and sorted(tuple(r) for r in op.shared_keys(frame, "text", 90).collect()) == want


def plain(line):
    return re.sub(r"[\s\xa0\x85]+", " ", line.lower()).strip(" ")


def expected(rows, similarity=op.SIMILARITY):
    """[(doc_id, text, kept text, dropped)] by comparing all pairs of lines."""
    forms = sorted({plain(x) for _, t in rows if t is not None for x in t.split("\n")} - {""})
    code = {f: op.line_simhash(f) for f in forms}
    links = []
    for a, b in itertools.combinations(forms, 2):
        if (code[a] ^ code[b]).bit_count() <= op.RADIUS:
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= 0.2 * longer and distance(a, b) <= int((1 - similarity) * longer + 1e-9):
                links.append((a, b))
    group = components(forms, links)
    spots = {}
    for i, t in rows:
        for no, x in enumerate((t or "").split("\n") if t is not None else [], 1):
            if plain(x):
                spots.setdefault(group[plain(x)], set()).add((i is None, i or 0, no, t))
    best = {g: min(s[:3] for s in found) for g, found in spots.items()}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, None, []))
            continue
        parts = t.split("\n")
        gone = [no for no, x in enumerate(parts, 1) if plain(x) and best[group[plain(x)]] != (i is None, i or 0, no)]
        out.append((i, t, "\n".join(x for no, x in enumerate(parts, 1) if no not in gone), gone))
    return sorted(out, key=str), len(links)


def rows_in(frame):
    return sorted(((r["doc_id"], r["text"], r["lines"]["text"], r["lines"]["dropped"]) for r in frame.collect()), key=str)


def made():
    rng = random.Random(7)
    words = [f"w{i}ord" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(40, None), (41, ""), (42, "\n\n"), (43, "same\nSAME \n  same\tx\nsame x")]
    for i in range(30):
        lines = []
        for b in rng.sample(base, 3):
            w = b.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] += rng.choice(["s", "", "xy"])
            lines.append("  ".join(w) if rng.random() < 0.3 else " ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [rows[6], (None, base[0] + "\nonly here and nowhere else"), (99, "word " * 30_000)]
    return rows


def test_equals_all_pairs(spark):
    rows = made()
    want, links = expected(rows)
    assert links > 20
    frame = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, line string, Lines_ int").repartition(3)
    got = op.dedup_lines(frame)
    assert got.columns == [*frame.columns, "lines"]
    assert rows_in(got) == want
    counts = {r["doc_id"]: (r["lines"]["n_lines"], r["lines"]["n_kept"]) for r in got.collect()}
    assert counts[40] == (0, 0) and counts[42] == (3, 3) and counts[43] == (4, 2)
    assert op.dedup_lines(frame.limit(0)).count() == 0
    assert op.dedup_lines(frame.withColumnRenamed("Lines_", "lines")).columns[-1] == "lines_"


def test_full_shards_and_joined_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_ROWS", 3)
    monkeypatch.setattr(op, "TASK_ROWS", 50)
    monkeypatch.setattr(op, "AT_ONCE", 2)
    monkeypatch.setattr(op, "BROADCAST_IDS", 0)
    rows = made()[:24]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_in(op.dedup_lines(frame)) == expected(rows)[0]


def test_registered_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = sorted(((r["doc_id"], r["text"], r["dropped"]) for r in op.op3_fuzzy_lines(spark, SF).collect()), key=str)
    want, _ = expected(list(zip(docs.doc_id.tolist(), docs.text)))
    assert got == sorted(((i, kept, gone) for i, _, kept, gone in want), key=str)


def test_finds_most_pairs_by_edit_similarity_alone(spark):
    """Without the bit filter: lines of any length with a word changed, dropped or added, or letters changed here and there."""
    rng = random.Random(11)
    make = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    forms = []
    for i in range(400):
        w = [make() for _ in range(rng.choice([5, 10, 20, 40]))]
        forms.append(" ".join(w))
        at = rng.randrange(len(w))
        if i % 4 == 3:
            letters = list(" ".join(w))
            for _ in range(max(1, len(letters) // 20)):
                letters[rng.randrange(len(letters))] = "z"
            forms.append(" ".join("".join(letters).split()))
        else:
            w[at : at + 1] = [[make()], [], [w[at], make()]][i % 4]
            forms.append(" ".join(w))
    forms = sorted(set(forms))
    links = [
        (a, b)
        for a, b in itertools.combinations(forms, 2)
        if sum((Counter(a) & Counter(b)).values()) >= 0.8 * max(len(a), len(b)) and op.alike(a, b)
    ]
    assert len(links) > 300
    assert sum((op.line_simhash(a) ^ op.line_simhash(b)).bit_count() <= 3 for a, b in links) < 0.5 * len(links)
    groups = {r["line_id"]: r["root"] for r in op.line_groups(spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "doc_id long, text string")).collect()}
    name = lambda f: op._signed([op.line_id(f)])[0]
    found = sum(name(a) in groups and groups[name(a)] == groups.get(name(b)) for a, b in links)
    assert found >= 0.95 * len(links), found / len(links)
    want = components(forms, links)
    roots = {}
    for f in forms:
        if name(f) in groups:
            roots.setdefault(groups[name(f)], set()).add(want[f])
    assert all(len(r) == 1 for r in roots.values())
