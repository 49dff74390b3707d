"""The plans that matter at scale keep their shape."""

import re

from helpers import random_rows, vectors
from pyspark.sql import functions as F

from nearfield.operators import corpus as C
from nearfield.operators import graph, ivf, lexical
from nearfield.operators.embedding import hash_embed
from nearfield.operators.exact import attach, search_exact
from nearfield.operators.lsh import lsh_codes
from nearfield.sources.index_table import latest_per_id

ROWS = random_rows(40, 4, 7)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"Exchange (?!Broadcast)\w+", plan)) - plan.count("BroadcastExchange")


def wide_table(spark, tmp_path):
    path = str(tmp_path / "wide")
    vectors(spark, ROWS).withColumn("text", F.lit("some words here")).withColumn("other", F.lit(1)).write.parquet(path)
    return spark.read.parquet(path)


def read_columns(plan):
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<([^\n]*)>", plan)]


def test_search_scans_two_columns_and_shuffles_only_the_hits(spark, tmp_path):
    corpus = wide_table(spark, tmp_path)
    plan = plan_of(search_exact(vectors(spark, ROWS[:3], "query_id", "q"), corpus, 5))
    assert shuffles(plan) == 1 and "WindowGroupLimit" in plan
    assert read_columns(plan) == [{"id", "vector"}]


def test_row_wise_jobs_do_not_shuffle(spark, tmp_path):
    corpus = wide_table(spark, tmp_path)
    centers = vectors(spark, random_rows(3, 4, 1), "cell")
    for frame in (
        hash_embed(corpus.select("id", "text"), "text"),
        lsh_codes(corpus.select("id", "vector"), 4),
        ivf.assign(corpus.select("id", "vector"), centers),
        lexical.forward_index(corpus, __import__("pyarrow").array(["some"])),
    ):
        assert shuffles(plan_of(frame)) == 0


def test_lines_are_numbered_without_being_moved(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join("x " * 30 for _ in range(50)))
    plan = plan_of(C.parse_corpus(C.read_lines(spark, str(tmp_path))))
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan text" in line)
    depth = len(re.match(r"[\s:+\-]*", lines[at]).group())
    above = []
    for line in reversed(lines[:at]):
        mine = len(re.match(r"[\s:+\-]*", line).group())
        if mine < depth:
            above.append(line)
            depth = mine
    assert not any("Exchange" in line for line in above)
    assert any("BroadcastHashJoin" in line for line in above)


def test_hits_fetch_their_columns_by_a_filtered_scan(spark, tmp_path):
    corpus = wide_table(spark, tmp_path)
    hits = search_exact(vectors(spark, ROWS[:3], "query_id", "q"), corpus, 5)
    out = attach(hits, corpus, ["text"])
    plan = plan_of(out)
    assert re.search(r"BroadcastHashJoin \[id#\d+L\], \[id#\d+L\], LeftSemi", plan)
    assert read_columns(plan) == [{"id", "text"}]
    assert out.count() == 15 and out.where("text is null").count() == 0


def test_versions_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(latest_per_id(spark.range(10).withColumn("v", F.lit(1)), "v"))


def test_saved_graph(spark, tmp_path):
    nodes = vectors(spark, ROWS)
    graph.save_graph(nodes, graph.knn_graph(nodes, 2), str(tmp_path / "g"))
    again_nodes, again_edges = graph.load_graph(spark, str(tmp_path / "g"))
    assert again_nodes.count() == 40 and again_edges.count() > 40
