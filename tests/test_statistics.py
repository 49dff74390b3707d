import contextlib
import io

import pytest
from pyspark.sql import functions as F

from nearfield.operators import analysis as A
from nearfield.operators import blocks
from nearfield.plans import catalogue

TEXTS = [
    (1, "The Wi-Fi PowerShot 500, the powershot's o'neil's 's -x- x2 éTé ABCd don't", "en"),
    (2, "the cats' CAT cat, Cats ... news ponies Wi-Fi wifi 12-ab-34", "en"),
    (3, "l'homme d'été qu'il Überstraße", "fr"),
    (4, "die Straße über Äpfel", "de"),
    (5, None, "en"),
    (6, "   ", None),
    (7, "the tie\x85’s XMLHttp ΑΒΓδ ǅabc «Wort» (’s) a.b.c I.B.M. 3G", None),
]
AGAIN = [(2, "cat Wi-Fi cats", "en"), (None, "cat cat the Über", "de"), (None, "cat Äpfel", "de")]
CHAINS = {"general": {}, "ws": {}, "en": {"protected": ["news"]}, "splitting": {}, "tight": {}, "splitting_graph": {}, "splitting_query": {}, "lang": {"lang_col": "lang"}}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)


def by_table(tokens, by):
    rows = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("docs"), F.sum("pos").alias("pos_sum"))
    return sorted(map(tuple, rows.select(*by, "n", "docs", "pos_sum").collect()))


@pytest.mark.parametrize("chain", CHAINS)
@pytest.mark.parametrize("more", [[], AGAIN])
def test_statistics_are_those_of_the_token_table(spark, monkeypatch, chain, more):
    monkeypatch.setattr(blocks, "ITEMS_AT_ONCE", 3)
    rows = [*TEXTS, *(more if "graph" not in chain and "query" not in chain else more[:0])]
    by = ("token", "length") if chain.startswith("splitting_") else ("token",)
    got = A.term_statistics(frame(spark, rows), "id", "text", chain, by, **CHAINS[chain])
    assert got.columns == [*by, "n", "docs", "pos_sum"]
    want = by_table(A.analyze(frame(spark, rows), "id", "text", chain, **CHAINS[chain]), by)
    assert sorted(map(tuple, got.collect())) == want and want


def test_no_text_no_statistics(spark):
    assert A.term_statistics(frame(spark, []), "id", "text", "ws").collect() == []


@pytest.mark.parametrize("name", ["analyze_ws", "analyze_en", "analyze_splitting", "analyze_tight", "analyze_splitting_graph", "analyze_splitting_query", "fold_by_lang"])
def test_tokens_are_not_shuffled(spark, name):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    keys = [line for line in shown.getvalue().splitlines() if "Exchange hashpartitioning(" in line and "REPARTITION_BY_NUM" not in line]
    assert len(keys) == 1 and "hashpartitioning(token" in keys[0] and "id#" not in keys[0]


def test_plain_words_are_what_the_word_delimiter_makes_of_them(spark):
    tokens = ["cat", "Cat,", "CATS", "CATs", "cAT", "(été)", "'s", "-'s", "x's", "’S.", "a-b", "a1", "...", "", "ǅabc", "«Über»", "s", "cat's", "don't", "12", "(3.", "1,2", "½²x"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    parts = F.filter(F.split(A.delimited(F.col("token")), " "), lambda t: t != "")
    for row in df.select("token", A.word_parts(F.col("token")).alias("got"), parts.alias("want")).collect():
        assert row["got"] == row["want"], row["token"]
