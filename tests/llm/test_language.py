"""Languages against a plain nearest-centroid search and held-out labels."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nearfield.llm import language as op

SF = "/root/testdata/sf0.001"


def test_counts_of_ngrams(monkeypatch):
    # "a b": letters a, b; " a", "a ", " b", "b "; " a ", "a b", " b "
    for text in ("a, b", "A 1 -- B", "\na\tb!!"):
        assert op.gram_counts(text).sum() == 2 + 4 + 3
        assert (op.gram_counts(text) == op.gram_counts("a b")).all()
    for text in (None, "", "123", " !? "):
        assert not op.gram_counts(text).any()
    once, twice = op.gram_counts("ẞß İ déf"), op.gram_counts("ẞß İ déf ẞß İ déf")
    assert once.any() and ((twice > 0) >= (once > 0)).all()
    monkeypatch.setattr(op, "PIECE", 3)
    assert (op.gram_counts("abcdef") == op.gram_counts("abc") + op.gram_counts("def")).all()


def rows_of(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text", "lang"]]
    rows = [(int(r.doc_id), r.text, r.lang, "x", 1.0) for r in docs.itertuples()]
    rows += [(900, None, "en", None, None), (901, "", "en", "", 0.0), (902, "12 34 !?", "de", "", 0.0), (None, rows[0][1], None, None, None)]
    rows += [(903, "Съешь же ещё этих мягких французских булок, да выпей чаю", None, "", 0.0), (904, rows[3][1] * 300, rows[3][2], "", 0.0), rows[3]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, language string, score double")


def test_equals_plain_search_and_held_out_labels(spark):
    rows, frame = rows_of(spark)
    model = op.learned_model(frame)
    got = op.identify(frame, model, name="found").toPandas()
    assert len(got) == len(rows) and set(frame.columns) < set(got.columns)
    for r in got.itertuples():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.found["lang_pred"], r.found["score"], r.found["rejected"]) == ("und", 0.0, True)
            continue
        counts = op.gram_counts(r.text)
        vector = np.log1p(counts) * model.idf
        cosine = [float(vector @ c) / float(np.linalg.norm(vector)) for c in model.centers]
        assert r.found["lang_pred"] == model.names[int(np.argmax(cosine))]
        assert abs(r.found["score"] - max(cosine)) < 1e-4
    several = " ".join(r[1] for r in rows[:150] if r[1]) * 3
    assert not model.nearest(several)[2]
    known = got[got.doc_id < 900]
    assert (known.found.map(lambda f: f["lang_pred"]) == known.lang).mean() == 1.0
    assert not known.found.map(lambda f: f["rejected"]).any()
    assert got[got.doc_id == 903].found.iloc[0]["rejected"]
    names, counts = np.unique(model.names, return_counts=True)
    assert names.tolist() == ["de", "en", "es", "fr"] and counts.max() <= op.CENTROIDS


def test_statistics_count_all_documents(spark):
    rows, frame = rows_of(spark)
    seen = op.document_counts(frame.repartition(5), "text")
    has = np.stack([op.gram_counts(r[1]) for r in rows]) > 0
    assert (seen[:-1] == has.sum(axis=0)).all() and seen[-1] == has.any(axis=1).sum()


def test_held_out_texts_and_rows_without_language_teach_nothing(spark):
    _, frame = rows_of(spark)
    secret = op.held_out(2) | F.col("lang").isNull()
    other = frame.withColumn("text", F.when(secret, F.lit("zzz qqq")).otherwise(F.col("text")))
    assert frame.where(secret & F.col("lang").isNotNull()).count() > 20
    one, two = op.learned_model(frame), op.learned_model(other)
    assert one.names == two.names and (one.idf == two.idf).all() and (one.centers == two.centers).all()


def test_a_column_of_the_same_name_stays(spark):
    _, frame = rows_of(spark)
    out = op.identify(frame, op.learned_model(frame))
    assert out.columns == [*frame.columns, "language_"] and dict(out.dtypes)["language"] == "string"


def test_rejected_go_and_empty_tables(spark):
    _, frame = rows_of(spark)
    kept = op.drop_rejected(frame)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {900, 901, 902, 903} and 904 in ids and None in ids
    nothing = op.learned_model(frame.limit(0))
    assert op.identify(frame.limit(0), nothing).count() == 0
    unlearned = op.identify(frame, op.learned_model(frame.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")), name="f")
    assert {r["f"]["lang_pred"] for r in unlearned.collect()} == {"und"}


def test_registered_query_holds_out_by_crc(spark):
    got = op.op8_language_id(spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    import zlib

    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    held = got[got.held_out]
    assert len(got) == len(docs) and (held.lang_pred == docs.lang[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all()
