"""The stages against plain versions of their decisions, on a table with every odd case."""

import itertools
import re

import corpus_pipeline as pipeline
import numpy as np
import pandas as pd
from brute import components, simhash
from pyspark.sql import functions as F

from nearfield.llm import packing

SF = "/root/testdata/sf0.001"


def by_name(name):
    return dict(pipeline.STAGES)[name]


def odd(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    item = pd.read_parquet(f"{SF}/benchmark.parquet").text[0]
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars), "x") for r in docs.itertuples()]
    a = rows[7]
    rows += [
        a, (5000, a[1], *a[2:]), (5001, a[1] + " end", *a[2:]), (5002, None, "en", "src1", None, None), (5003, "", None, None, 0, ""),
        (None, rows[3][1] + " once more", "en", "src1", 9, ""), (5004, f"{rows[1][1]}\n{item.upper()}", "en", "src2", 9, ""),
        (5005, "123 456", "en", "src3", 7, ""), (5006, rows[2][1] * 50, rows[2][2], rows[2][3], 9, ""),
    ]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string").repartition(3)


def test_stages_take_effect_and_keep_the_columns(spark):
    rows, docs = odd(spark)
    seen = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, SF)
        assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
        seen = spark.createDataFrame(seen.collect(), docs.schema)
        was, now = before.collect(), seen.collect()
        if name == "language ID":
            gone = {r["doc_id"] for r in was} - {r["doc_id"] for r in now}
            assert gone == {5002, 5003, 5005}
        elif name == "SimHash near-dedup":
            with_id = [r for r in was if r["doc_id"] is not None]
            code = {r["doc_id"]: simhash(r["text"]) for r in with_id}
            near = [(x, y) for x, y in itertools.combinations(sorted(code), 2) if (code[x] ^ code[y]).bit_count() <= 2]
            assert sorted(r["doc_id"] for r in now if r["doc_id"] is not None) == sorted(set(components(code, near).values()))
            assert sum(r["doc_id"] is None for r in now) == 1
        elif name == "benchmark decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            items = [words(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
            windows = {" ".join(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
            dirty = [r for r in was if any(f" {w} " in f" {' '.join(words(r['text']))} " for w in windows)]
            assert 5004 in {r["doc_id"] for r in dirty}
            assert sorted(map(str, now)) == sorted(str(r) for r in was if r not in dirty)
        else:
            assert 0 < len(now) and {str(r) for r in now} <= {str(r) for r in was}
    packs = pipeline.packed(spark, seen, SF).collect()
    tokens = packing.tokenizer(packing.VOCABULARY)
    kept = sorted(len(packing.encode(r["text"], tokens)) for r in seen.collect())
    assert sum(p["n_tokens"] for p in packs) == sum(kept)


def test_nothing_in_nothing_out(spark):
    _, docs = odd(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    packs = pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    tokens = packing.tokenizer(packing.VOCABULARY)
    want = sum(len(packing.encode(r["text"], tokens)) for r in docs.select("text").collect())
    got = packs.agg(F.sum("n_tokens").alias("n")).first()["n"]
    assert got == want
    ids = {s["doc_id"] for r in packs.select("segments").collect() for s in r["segments"]}
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert np.frombuffer(packs.select("ids").first()["ids"], "<i4").max() <= tokens.n_vocab
