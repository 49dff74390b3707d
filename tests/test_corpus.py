import bz2

import pytest
from pyspark.sql import functions as F

from nearfield.functions.text import more_tokens_than, whitespace_tokens
from nearfield.operators import corpus as C
from nearfield.operators import schema as S


def reference_parse(lines, least=20):
    """Plain Python answer: (id, url, text) of the kept lines."""
    import re

    out = []
    for line in lines:
        if line.startswith("#") or len(line.split()) <= least:
            continue
        found = re.match(r"<([^>]+)>\s*", line)
        url = found.group(1) if found else ""
        rest = line[found.end():] if found else line
        rest = re.sub(r"^<[^>]+>\s*", "", rest)
        if rest.endswith("@en ."):
            rest = rest[: -len("@en .")]
        out.append((len(out) + 1, url, rest))
    return out


WORDS = " ".join(f"w{i}" for i in range(30))
LINES = [
    "# a comment " + WORDS,
    " ".join(["t"] * 20),
    " ".join(["t"] * 21),
    f'<http://a> <http://b> "{WORDS}"@en .',
    f"<http://only> {WORDS}",
    f'<http://x> <http://y> "{WORDS}"@de .',
    "a b c\x1fd\x85e " + WORDS,
    "",
    "carriage " + WORDS + ' "@en .\r',
    '<http://a> <http://b> ' + " ".join(["u"] * 19),
    "   " + WORDS + "   ",
]


def test_lines_from_compressed_files(spark, tmp_path):
    for name, part in (("a.bz2", LINES[:6]), ("b.bz2", LINES[6:])):
        (tmp_path / name).write_bytes(bz2.compress(("\n".join(part) + "\n").encode()))
    got = C.parse_corpus(C.read_lines(spark, str(tmp_path))).orderBy("id").collect()
    assert [(r["id"], r["url"], r["_text_"]) for r in got] == reference_parse(LINES)
    assert C.parse_corpus(C.read_lines(spark, str(tmp_path)), max_docs=3).count() == 3
    assert C.parse_corpus(C.read_lines(spark, str(tmp_path)), max_docs=0).count() == len(reference_parse(LINES))


def test_ids_follow_file_order_over_forced_splits(spark, tmp_path):
    lines = [f"{i} " + WORDS + (" x" * (i % 7)) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[2500:]))  # no newline at the end
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = C.read_lines(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 5
        got = C.parse_corpus(raw).orderBy("id").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["id"] for r in got] == list(range(1, 4001))
    assert [r["_text_"].split()[0] for r in got] == [str(i) for i in range(4000)]


def test_dense_id_over_sparse_and_negative_keys(spark):
    keys = [-5, 0, 3, 1 << 40, (1 << 40) + 1, 7, 1 << 22, -(1 << 33)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["n"] for r in C.dense_id(df, "k", out="n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert C.dense_id(df.where("false"), "k", out="n").count() == 0


def test_python_split_and_token_limit(spark):
    texts = LINES + ["x", " x ", "\x1c", "a b\tc\nd\x0be\x0cf\rg", "　a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", whitespace_tokens(F.col("t")), more_tokens_than(F.col("t"), 20), more_tokens_than(F.col("t"), 0)).collect()
    for text, tokens, over, some in rows:
        assert tokens == text.split()
        assert over == (len(text.split()) > 20)
        assert some == bool(text.split())


def test_corpus_metrics(spark):
    lines = spark.createDataFrame([(t,) for t in LINES], "value string")
    row = C.corpus_metrics(lines, max_docs=5000).first()
    plain = [t for t in LINES if not t.startswith("#")]
    assert (row["lines"], row["docs"]) == (len(plain), len(reference_parse(LINES)))
    assert row["max_tokens"] == max(len(t.split()) for t in plain)
    assert row["report_every"] == 5.0
    assert C.corpus_metrics(lines).first()["report_every"] == 1000.0


def test_zip_by_position(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    vecs = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "pos long, vector array<double>")
    assert {r["id"]: r["vector"] for r in C.zip_by_position(docs, vecs).collect()} == {1: [1.0], 2: [2.0]}
    with pytest.raises(Exception, match="no vector for document 2"):
        C.zip_by_position(docs, vecs.where("pos = 1")).collect()
    assert C.zip_by_position(docs, vecs.where("pos = 1"), strict=False).count() == 2


def test_truncation_reports(spark):
    df = spark.createDataFrame([("a b c",), ("a b",)], "t string")
    rows = C.truncate_tokens(df, "t", 2).orderBy(F.length("t")).collect()
    assert [(r["model_input"], r["truncated"], r["n_tokens"]) for r in rows] == [("a b", False, 2), ("a b", True, 3)]


def test_suffix_types_and_copies(spark):
    assert S.type_of("x_s_ns") == "string" and S.type_of("x_is") == "array<int>" and S.type_of("plain") is None
    df = spark.createDataFrame([("7", "8", "true", "n", "m", None)], "a_i string, b_ls string, c_b string, name string, manu string, author string")
    typed = S.cast_by_suffix(df)
    assert dict(typed.dtypes)["b_ls"] == "array<bigint>"
    row = S.copy_fields(typed).first()
    assert row["a_i"] == 7 and row["b_ls"] == [8] and row["c_b"] is True
    assert row["text"] == "n m" and row["manu_exact"] == "m" and row["author_s"] is None


def test_vector_validation(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0])]
    good, bad = S.validate_vectors(spark.createDataFrame(rows, "id long, vector array<double>"), 2)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        2: "dimensions", 3: "missing", 4: "not finite", 5: "not finite", 6: "null component"
    }


def test_repair_and_dates(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("t", "d", [["a", "b"], ["c"]])], "title string, description string, categories array<array<string>>"
    )
    first, second = sorted(S.repair_docs(df).collect(), key=lambda r: r["title"])
    assert (first["title"], first["description"], first["categories"]) == ("DUMMY_TITLE", "DUMMY_DESCRIPTION", ["DUMMY_CATEGORY"])
    assert second["categories"] == ["a", "b", "c"]
    dates = S.normalise_dates(spark.createDataFrame([("2020-01-02",), (None,)], "release_date string")).collect()
    assert [r[0] for r in dates] == ["2020-01-02T00:00:00Z", None]


def test_corpus_files_are_as_many_as_the_input_has_parts(spark, tmp_path, monkeypatch):
    from nearfield.plans import text_search

    path = str(tmp_path / "lines")
    monkeypatch.setattr(text_search, "scratch_path", lambda *_: path)
    docs = [(i, "word " * 30 + str(i), "en") for i in range(200)]
    monkeypatch.setattr(text_search, "documents", lambda *_: spark.createDataFrame(docs, "id long, text string, lang string").repartition(9))
    rows = text_search.corpus_files(spark, "").orderBy("id").collect()
    assert [(r["id"], r["url"]) for r in rows] == [(i + 1, f"http://example.org/doc/{i}") for i in range(200)]
    assert len(list((tmp_path / "lines").glob("part-*"))) == 9
