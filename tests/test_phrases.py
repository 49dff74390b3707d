"""Synonyms of phrases, token graphs and the older layout's types."""

import datetime
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from nearfield.operators import analysis as A
from nearfield.operators import schema as S
from nearfield.operators.lexical import bm25
from nearfield.functions.text import words

SETS = [["new york", "ny", "big apple city"], ["city", "town"], ["new york city hall", "seat"]]


def spans(spark, text, rules):
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    rows = A.phrase_table(frame, "id", F.split("text", " "), rules).collect()
    return sorted((r["pos"], r["token"], r["length"]) for r in rows)


def test_the_longest_phrase_from_the_left_counts(spark):
    rules = A.synonym_rules(SETS)
    assert spans(spark, "in new york city hall now", rules) == [
        (0, "in", 1), (1, "new", 1), (1, "seat", 4), (2, "york", 1), (3, "city", 1), (4, "hall", 1), (5, "now", 1)]
    # the longest alternative has three words, so what follows moves on and shorter ones are longer tokens
    assert spans(spark, "new york is", rules) == [
        (0, "big", 1), (0, "new", 1), (0, "ny", 3), (1, "apple", 1), (1, "york", 2), (2, "city", 1), (3, "is", 1)]
    assert spans(spark, "new york city", rules) == [
        (0, "big", 1), (0, "new", 1), (0, "ny", 3), (1, "apple", 1), (1, "york", 2), (2, "city", 1), (3, "city", 1), (3, "town", 1)]
    assert spans(spark, "new new", rules) == [(0, "new", 1), (1, "new", 1)]


def test_without_expansion_the_first_phrase_stands_for_all(spark):
    rules = A.synonym_rules(SETS, expand=False)
    assert spans(spark, "ny and town", rules) == [(0, "new", 1), (1, "york", 1), (2, "and", 1), (3, "city", 1)]
    assert spans(spark, "seat", rules) == [(0, "new", 1), (1, "york", 1), (2, "city", 1), (3, "hall", 1)]


def test_empty_and_missing_token_lists(spark):
    frame = spark.createDataFrame([(1, None), (2, [])], "id long, t array<string>")
    assert frame.select(A.phrase_synonyms(F.col("t"), A.synonym_rules(SETS)).alias("s")).collect()[0]["s"] is None
    assert A.phrase_table(frame, "id", F.col("t"), A.synonym_rules(SETS)).count() == 0


def test_bm25_finds_what_a_phrase_stands_for(spark):
    docs = spark.createDataFrame([(1, "a seat of learning"), (2, "new york city hall"), (3, "nothing here")], "id long, text string")
    queries = spark.createDataFrame([(7, "new york city hall")], "query_id long, text string")
    plain = {r["id"] for r in bm25(queries, docs, 5).collect()}
    both = {r["id"] for r in bm25(queries, docs, 5, query_terms=A.expanding_phrases(words, SETS)).collect()}
    assert plain == {2} and both == {1, 2}


def graph(spark, text, catenate=True):
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    out = A.split_graph(A.whitespace_table(frame, "id", "text"), catenate)
    return sorted((r["pos"], r["token"], r["length"]) for r in out.collect())


def test_parts_advance_and_catenations_span_them(spark):
    assert graph(spark, "the Wi-Fi box") == [(0, "the", 1), (1, "Wi", 1), (1, "WiFi", 2), (2, "Fi", 1), (3, "box", 1)]
    assert graph(spark, "PowerShot500-42x on") == [
        (0, "Power", 1), (0, "PowerShot", 2), (1, "Shot", 1), (2, "500", 1), (2, "50042", 2), (3, "42", 1), (4, "x", 1), (5, "on", 1)]
    assert graph(spark, "a -- b") == [(0, "a", 1), (2, "b", 1)]  # a token of signs leaves a gap
    assert graph(spark, "Joe's") == [(0, "Joe", 1)]


def test_queries_are_cut_without_catenation(spark):
    assert graph(spark, "Wi-Fi x", catenate=False) == [(0, "Wi", 1), (1, "Fi", 1), (2, "x", 1)]


def test_types_of_the_older_layout(spark):
    row = ("7", "8", "1.5", "2024-01-02", "a|1.5 b|2", "x", "y", "z")
    frame = spark.createDataFrame([row, (None,) * 8], "a_ti string, b_pls string, c_tf string, d_tdt string, e_dpf string, attr_f string, ignored_g string, h_txt_de string")
    typed = S.cast_by_suffix(frame, S.OLDER_TYPES)
    kinds = dict(typed.dtypes)
    assert kinds == {"a_ti": "int", "b_pls": "array<bigint>", "c_tf": "float", "d_tdt": "timestamp", "e_dpf": "map<string,float>", "attr_f": "array<string>", "h_txt_de": "string"}
    got, none = sorted(typed.collect(), key=lambda r: r["a_ti"] is None)
    assert got["d_tdt"] == datetime.datetime(2024, 1, 2) and got["e_dpf"] == {"a": 1.5, "b": 2.0} and got["attr_f"] == ["x"]
    assert not any(none)
    assert S.type_of("x_i") == "int" and S.type_of("attr_x") is None  # the newer layout is the default


def test_spans_hold_few_words_at_a_time(monkeypatch):
    """Batches cut by their words give the same spans, and hold no Python values of all of them."""
    plain = [None, [], ["a"], ["of", "the", "b"] * 40, None, ["of"], [], ["of", "the"] * 100, None]
    look = A.phrase_spans(A.synonym_rules([["of the", "whereof"], ["b", "c d"]]))
    whole = look(pa.array(plain, pa.list_(pa.string())))
    assert [n.as_py() for n in whole.value_lengths()] == [None, 0, 1, 240, None, 1, 0, 300, None]
    assert [tuple(x.values()) for x in whole[3].as_py()[:6]] == [(0, "of", 1), (1, "the", 1), (0, "whereof", 2), (2, "b", 2), (2, "c", 1), (3, "d", 1)]
    monkeypatch.setattr(A, "WORDS_AT_ONCE", 50)
    assert look(pa.array(plain, pa.list_(pa.string()))).equals(whole)
    assert len(look(pa.array([], pa.list_(pa.string())))) == 0
    many = pa.array([["of", "the", "x"] * 100] * 1000, pa.list_(pa.string()))
    tracemalloc.start()
    assert len(look(many).flatten()) == 400_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # 400000 spans as Python values are over 100 MB
