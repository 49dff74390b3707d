"""Registered queries: BM25, corpus cleaning, text analysis, mean pooling, schema jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions.hashing import hash32
from nearfield.functions.text import keyword, words
from nearfield.operators import analysis as A
from nearfield.operators import corpus as C
from nearfield.operators import schema as S
from nearfield.operators import topk
from nearfield.operators.embedding import hash_embed, mean_pool
from nearfield.operators.evaluation import overlap
from nearfield.operators.exact import search_exact
from nearfield.operators.lexical import bm25, bm25_over, postings
from nearfield.plans.inputs import (
    DIGITS,
    DIMS,
    corpus,
    documents,
    hash_vector_sql,
    ranked_sql,
    table,
    text_queries,
    vector_queries,
    words_sql,
)
from nearfield.session import cut_lineage, scratch_path

QUERIES = {}
ORACLES = {}

# --- BM25 -------------------------------------------------------------------------


def bm25_query(spark, sf_dir):
    return bm25(text_queries(spark, sf_dir), documents(spark, sf_dir), 10, digits=DIGITS)


def bm25_sql(
    docs: str, id_col: str, text: str, factor: str = " * 2.2", k: int = 10, prefix: str = "b", terms=words_sql, query_terms=None
) -> str:
    """CTEs ending in ``{prefix}_hits(query_id, id, s, rank)``; ``terms`` gives the SQL of a text's term list."""
    query_terms = terms if query_terms is None else query_terms
    return f"""
{prefix}_qtok AS (SELECT item_id AS query_id, unnest({query_terms('text')}) AS term FROM benchmark),
{prefix}_ask AS (SELECT query_id, term, count(*) AS qtf FROM {prefix}_qtok GROUP BY 1, 2),
{prefix}_len AS (SELECT {id_col} AS id, len({terms(text)}) AS dl, {terms(text)} AS toks FROM {docs}),
{prefix}_tok AS (SELECT id, dl, unnest(toks) AS term FROM {prefix}_len),
{prefix}_post AS (SELECT id, dl, term, count(*) AS tf FROM {prefix}_tok GROUP BY 1, 2, 3),
{prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_post GROUP BY 1),
{prefix}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {prefix}_len),
{prefix}_sc AS (
  SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf{factor}
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), {DIGITS}) AS s
  FROM {prefix}_ask JOIN {prefix}_df USING (term) JOIN {prefix}_post USING (term), {prefix}_st GROUP BY 1, 2),
{prefix}_hits AS (
  SELECT * FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
                 FROM {prefix}_sc) WHERE rank <= {k})"""


QUERIES["bm25"] = bm25_query
ORACLES["bm25"] = (
    "WITH " + bm25_sql("documents", "doc_id", "text", " * 2.2::DOUBLE") + " SELECT query_id, rank, id, s AS _score FROM b_hits"
)


def bm25_stored(spark, sf_dir):
    """The same over a stored postings table, the plan for any number of queries."""
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "postings")
    postings(docs).write.parquet(path)
    return bm25_over(text_queries(spark, sf_dir), spark.read.parquet(path), 10, digits=DIGITS)


QUERIES["bm25_stored"] = bm25_stored
ORACLES["bm25_stored"] = ORACLES["bm25"]


def bm25_without_factor(spark, sf_dir):
    return bm25(text_queries(spark, sf_dir), documents(spark, sf_dir), 10, lucene8=True, digits=DIGITS)


QUERIES["bm25_lucene8"] = bm25_without_factor
ORACLES["bm25_lucene8"] = (
    "WITH " + bm25_sql("documents", "doc_id", "text", "") + " SELECT query_id, rank, id, s AS _score FROM b_hits"
)


def bm25_vs_vector_overlap(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lexical = bm25(text_queries(spark, sf_dir), docs, 10, digits=DIGITS)
    vectors = hash_embed(docs.select("id", "text"), "text", DIMS).select("id", "vector")
    semantic = search_exact(vector_queries(spark, sf_dir), vectors, 10, "cosine1p", digits=DIGITS)
    return overlap(lexical, semantic).select(
        "query_id", F.col("common").cast("long").alias("common"), F.col("either").cast("long").alias("either"), "jaccard"
    )


QUERIES["bm25_vs_vector_overlap"] = bm25_vs_vector_overlap
ORACLES["bm25_vs_vector_overlap"] = (
    "WITH "
    + bm25_sql("documents", "doc_id", "text", " * 2.2::DOUBLE")
    + ","
    + hash_vector_sql("benchmark", "item_id", "text", "q")
    + ","
    + hash_vector_sql("documents", "doc_id", "text", "d")
    + ",\ncorpus AS (SELECT doc_id AS id, q AS v FROM d),"
    + ranked_sql("1.0 + list_cosine_similarity(q.q, c.v)")
    + """
SELECT query_id, count(b.id)::BIGINT - sum(CASE WHEN h.id IS NULL THEN 1 ELSE 0 END)::BIGINT AS common, count(*) AS either,
       (count(b.id) - sum(CASE WHEN h.id IS NULL THEN 1 ELSE 0 END))::DOUBLE / count(*) AS jaccard
FROM b_hits b FULL JOIN hits h USING (query_id, id) GROUP BY query_id"""
)


def copy_fields(spark, sf_dir):
    """A catch-all text of several fields, searched by the field values of every brand."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manu"), F.col("p_type").alias("cat")
    )
    copied = S.copy_fields(parts).select("id", "text", "manu_exact")
    asked = (
        copied.groupBy("manu_exact")
        .agg(F.min("id").alias("query_id"))
        .select("query_id", F.col("manu_exact").alias("text"))
    )
    return bm25(asked, copied, 5, digits=DIGITS)


QUERIES["copy_fields"] = copy_fields
ORACLES["copy_fields"] = (
    "WITH asked AS (SELECT min(p_partkey) AS item_id, p_brand AS text FROM part GROUP BY p_brand),"
    "cat AS (SELECT p_partkey AS id, p_type || ' ' || p_name || ' ' || p_brand AS alltext FROM part),"
    + bm25_sql("cat", "id", "alltext", " * 2.2::DOUBLE", k=5).replace("FROM benchmark", "FROM asked")
    + " SELECT query_id, rank, id, s AS _score FROM b_hits"
)

# --- mean pooling ---------------------------------------------------------------------

POOL = 16


def mean_pool_query(spark, sf_dir):
    """Every distinct word of the documents has a fixed vector; a document is the average over its words."""
    docs = documents(spark, sf_dir)
    vocabulary = docs.select(F.explode(words(F.col("text"))).alias("token")).distinct()
    cell = lambda i: (hash32(F.concat_ws(":", F.col("token"), F.lit(i))) % 2001 - 1000) / 1009.0
    vectors = cut_lineage(vocabulary.select("token", F.array(*[cell(i) for i in range(POOL)]).alias("vec")))
    pooled = mean_pool(docs, "id", "text", vectors, keep=True)
    return pooled.select("id", F.posexplode("vector").alias("i", "x")).select(
        "id", F.col("i").cast("long").alias("i"), F.round("x", DIGITS).alias("x")
    )


QUERIES["mean_pool"] = mean_pool_query
ORACLES["mean_pool"] = f"""
WITH tok AS (SELECT doc_id AS id, unnest({words_sql('text')}) AS token FROM documents),
cnt AS (SELECT id, token, count(*) AS n FROM tok GROUP BY 1, 2),
dims AS (SELECT unnest(range({POOL})) AS i),
vec AS (SELECT token, i, (('0x' || substr(md5(token || ':' || i), 1, 8))::UBIGINT::BIGINT % 2001 - 1000) / 1009.0::DOUBLE AS x
        FROM (SELECT DISTINCT token FROM tok), dims)
SELECT id, i, round(sum(n * x) / sum(n), {DIGITS}) AS x FROM cnt JOIN vec USING (token) GROUP BY id, i"""

# --- corpus ------------------------------------------------------------------------------

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

LINES_SQL = """
lines AS (
  SELECT doc_id AS n, CASE WHEN lang = 'es' THEN '# ' ELSE '' END || '<http://example.org/doc/' || doc_id || '> <http://example.org/abstract> "'
         || replace(text, chr(10), ' ') || '"@' || lang || ' .' AS value FROM documents)"""


def lines_of(docs):
    """Documents as corpus lines; one language is commented out."""
    return docs.select(
        F.col("id").alias("n"),
        F.concat(
            F.when(F.col("lang") == "es", "# ").otherwise(""),
            F.lit("<http://example.org/doc/"),
            F.col("id"),
            F.lit('> <http://example.org/abstract> "'),
            F.regexp_replace("text", "\n", " "),
            F.lit('"@'),
            F.col("lang"),
            F.lit(" ."),
        ).alias("value"),
    )


def corpus_lines(spark, sf_dir):
    return lines_of(documents(spark, sf_dir))


def corpus_parse(spark, sf_dir):
    return C.parse_corpus(corpus_lines(spark, sf_dir), order="n")


TOKENS_SQL = f"list_filter(regexp_split_to_array(value, '{SPACE_SQL}+'), lambda t: t <> '')"
PARSE_SQL = f"""
{LINES_SQL},
kept AS (SELECT *, row_number() OVER (ORDER BY n) AS id FROM lines
         WHERE NOT starts_with(value, '#') AND len({TOKENS_SQL}) > 20),
docs AS (SELECT id, n, regexp_extract(value, '^<([^>]+)>', 1) AS url,
  regexp_replace(regexp_replace(regexp_replace(value, '^<[^>]+>{SPACE_SQL}*', ''), '^<[^>]+>{SPACE_SQL}*', ''), '@en \\.$', '') AS _text_ FROM kept)"""

QUERIES["corpus_parse"] = corpus_parse
ORACLES["corpus_parse"] = "WITH " + PARSE_SQL + " SELECT id, url, _text_ FROM docs"


def corpus_files(spark, sf_dir):
    """The same from compressed text files, whose lines are numbered in file order."""
    path = scratch_path(spark, "lines")
    docs = documents(spark, sf_dir)
    files = max(4, docs.rdd.getNumPartitions())  # a task packs and unpacks as much as it reads, however many documents there are
    lines = lines_of(docs).repartitionByRange(files, "n").sortWithinPartitions("n").select("value")
    lines.write.option("compression", "bzip2").text(path)
    return C.parse_corpus(C.read_lines(spark, path), written=True).select("id", "url", "_text_")


QUERIES["corpus_files"] = corpus_files
ORACLES["corpus_files"] = ORACLES["corpus_parse"]


def corpus_metrics(spark, sf_dir):
    return C.corpus_metrics(corpus_lines(spark, sf_dir))


QUERIES["corpus_metrics"] = corpus_metrics
ORACLES["corpus_metrics"] = f"""
WITH {LINES_SQL}, t AS (SELECT len({TOKENS_SQL}) AS t FROM lines WHERE NOT starts_with(value, '#'))
SELECT count(*) AS lines, count(*) FILTER (t > 20) AS docs, max(t) AS max_tokens, 1000.0::DOUBLE AS report_every FROM t"""


def max_docs(spark, sf_dir):
    """The first 100 documents of the corpus: the limit of a parse run."""
    return C.parse_corpus(corpus_lines(spark, sf_dir), max_docs=100, order="n").select("id", "url")


QUERIES["max_docs"] = max_docs
ORACLES["max_docs"] = "WITH " + PARSE_SQL + " SELECT id, url FROM docs WHERE id <= 100"


def zip_join(spark, sf_dir):
    """The i-th kept document with the i-th stored vector; vectors run out before or after the documents."""
    docs = C.parse_corpus(corpus_lines(spark, sf_dir), order="n").select("id", "url")
    vectors = C.dense_id(corpus(spark, sf_dir).select(F.col("id").alias("vec_id"), "vector"), "vec_id", out="pos")
    return C.zip_by_position(docs, vectors, strict=False).select(
        "id", "url", F.round(F.col("vector")[0].cast("double"), DIGITS).alias("x0"), F.size("vector").cast("long").alias("dims")
    )


QUERIES["zip_join"] = zip_join
ORACLES["zip_join"] = f"""
WITH {PARSE_SQL}, v AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS id FROM embeddings)
SELECT docs.id, url, round(embedding[1]::DOUBLE, {DIGITS}) AS x0, len(embedding) AS dims
FROM docs LEFT JOIN v USING (id)"""


def truncate_500(spark, sf_dir):
    cut = C.truncate_tokens(documents(spark, sf_dir), "text", 500)
    return cut.select("id", "n_tokens", "truncated", F.length("model_input").cast("long").alias("input_chars"))


QUERIES["truncate_500"] = truncate_500
ORACLES["truncate_500"] = f"""
WITH t AS (SELECT doc_id AS id, {TOKENS_SQL.replace('value', 'text')} AS toks FROM documents)
SELECT id, len(toks) AS n_tokens, len(toks) > 500 AS truncated, length(array_to_string(toks[1:500], ' ')) AS input_chars FROM t"""


def get_doc(spark, sf_dir):
    """Point lookups for every labelled document id."""
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return C.restrict_to(documents(spark, sf_dir), wanted).select("id", "text", "lang")


QUERIES["get_doc"] = get_doc
ORACLES["get_doc"] = "SELECT doc_id AS id, text, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def terms_filter(spark, sf_dir):
    """The best hundred by BM25 among a list of ids, here the labelled documents."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return bm25(text_queries(spark, sf_dir), documents(spark, sf_dir), 100, digits=DIGITS, ids=wanted)


QUERIES["terms_filter"] = terms_filter
ORACLES["terms_filter"] = (
    "WITH "
    + bm25_sql("documents", "doc_id", "text", " * 2.2::DOUBLE", k=100)
    + """ SELECT query_id, rank, id, s AS _score FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
  FROM b_sc WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE rank <= 100"""
)


def exclude_processed(spark, sf_dir):
    """Documents that have no label yet."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return C.exclude(documents(spark, sf_dir), done).select("id", "lang", "n_chars")


QUERIES["exclude_processed"] = exclude_processed
ORACLES["exclude_processed"] = (
    "SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
)


def cursor_page(spark, sf_dir):
    """The second page of 50 in id order, with its cursor, reached from the first page's cursor."""
    docs = documents(spark, sf_dir).select("id", "lang")
    first = topk.next_cursor(topk.page(docs, 50)).select("cursor").scalar()
    rows = topk.page(docs, 50, after=first)
    return rows.withColumn("cursor", topk.next_cursor(rows).select("cursor").scalar())


QUERIES["cursor_page"] = cursor_page
ORACLES["cursor_page"] = """
WITH p AS (SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 50)
SELECT id, lang, (SELECT max(id) FROM p) AS cursor FROM p"""


def batch_merge(spark, sf_dir):
    """Two batches appended with their duplicates: documents per language, kept and labelled."""
    docs = documents(spark, sf_dir).select("id", "lang")
    again = C.restrict_to(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return docs.unionByName(again).groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids")
    )


QUERIES["batch_merge"] = batch_merge
ORACLES["batch_merge"] = """
SELECT lang, count(*) AS rows, count(DISTINCT doc_id) AS ids FROM (
  SELECT doc_id, lang FROM documents UNION ALL
  SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY lang"""

# --- analysis ---------------------------------------------------------------------------------


def _chain(chain, **options):
    """Term statistics of a chain over all documents."""

    def run(spark, sf_dir):
        return A.term_statistics(documents(spark, sf_dir), "id", "text", chain, **options)

    return run


STATS_SQL = " SELECT token, count(*) AS n, count(DISTINCT id) AS docs, sum(pos)::BIGINT AS pos_sum FROM t GROUP BY token"


def unnest_sql(tokens: str, name: str = "u", extra: str = "") -> str:
    """CTE ``name(id, pos, token)`` over a token list expression of documents."""
    return f"""{name} AS (SELECT id{extra}, unnest(range(len(toks))) AS pos, unnest(toks) AS token
  FROM (SELECT doc_id AS id{extra}, {tokens} AS toks FROM documents))"""


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


STEM_SQL = """CASE WHEN length(token) < 3 OR NOT token LIKE '%s' THEN token
  WHEN regexp_matches(token, '[us]s$') THEN token
  WHEN regexp_matches(token, '[^ae]ies$') THEN substr(token, 1, length(token) - 3) || 'y'
  WHEN regexp_matches(token, '[iaoe]es$') THEN token ELSE substr(token, 1, length(token) - 1) END"""

EN = A.STOP_WORDS["en"]


def analyze_general(spark, sf_dir):
    """The whole token stream with offsets."""
    return A.analyze(documents(spark, sf_dir), "id", "text", "general")


QUERIES["analyze_general"] = analyze_general
ORACLES["analyze_general"] = (
    "WITH "
    + unnest_sql(r"regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+')")
    + r""", e AS (SELECT id, pos, regexp_replace(token, '^[^\p{L}\p{N}]+', '') AS raw,
       sum(length(token)) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS "end" FROM u)
SELECT id, pos, lower(raw) AS token, "end" - length(raw) AS start, "end" FROM e"""
)

QUERIES["analyze_ws"] = _chain("ws")
ORACLES["analyze_ws"] = "WITH " + unnest_sql(TOKENS_SQL.replace("value", "text"), "t") + STATS_SQL

QUERIES["analyze_en"] = _chain("en", protected=["news", "series"])
ORACLES["analyze_en"] = (
    "WITH "
    + unnest_sql(r"regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][sS]\b)?')")
    + f""", s AS (SELECT id, pos, regexp_replace(lower(token), '[''’][sS]$', '') AS token FROM u WHERE lower(token) NOT IN ({quoted(EN)})),
t AS (SELECT id, pos, CASE WHEN token IN ('news', 'series') THEN token ELSE {STEM_SQL} END AS token FROM s)"""
    + STATS_SQL
)

PROTECTED = ["news", "series"]
SYNONYMS = {"the": ["the", "that"], "that": ["that", "the"]}


def english_sql(text: str) -> str:
    tokens = rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+(?:[''’][sS]\b)?')"
    kept = f"list_filter({tokens}, lambda t: NOT list_contains([{quoted(EN)}], lower(t)))"
    bare = f"list_transform({kept}, lambda t: regexp_replace(lower(t), '[''’][sS]$', ''))"
    return f"list_transform({bare}, lambda token: CASE WHEN token IN ({quoted(PROTECTED)}) THEN token ELSE {STEM_SQL} END)"


def synonyms_sql(text: str) -> str:
    return f"flatten(list_transform({words_sql(text)}, lambda t: CASE t WHEN 'the' THEN ['the', 'that'] WHEN 'that' THEN ['that', 'the'] ELSE [t] END))"


def bm25_en(spark, sf_dir):
    """BM25 over the English chain, for documents and queries."""
    terms = lambda text: A.english_terms(text, PROTECTED)
    return bm25(text_queries(spark, sf_dir), documents(spark, sf_dir), 10, digits=DIGITS, terms=terms)


QUERIES["bm25_en"] = bm25_en
ORACLES["bm25_en"] = (
    "WITH "
    + bm25_sql("documents", "doc_id", "text", " * 2.2::DOUBLE", terms=english_sql)
    + " SELECT query_id, rank, id, s AS _score FROM b_hits"
)


def bm25_synonyms(spark, sf_dir):
    """BM25 with synonyms on the query side only."""
    asked = A.expanding(words, SYNONYMS)
    return bm25(text_queries(spark, sf_dir), documents(spark, sf_dir), 10, digits=DIGITS, query_terms=asked)


QUERIES["bm25_synonyms"] = bm25_synonyms
ORACLES["bm25_synonyms"] = (
    "WITH "
    + bm25_sql("documents", "doc_id", "text", " * 2.2::DOUBLE", query_terms=synonyms_sql)
    + " SELECT query_id, rank, id, s AS _score FROM b_hits"
)

SPLIT_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token,
  '[''’][sS]$', ''), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g'),
  '[^\p{L}\p{N}]+', ' ', 'g'))"""
GLUE_SQL = r"""regexp_extract_all(regexp_replace(regexp_replace(token, '[''’][sS]$', ''), '[^\p{L}\p{N}]+', '', 'g'), '\p{L}+|\p{N}+')"""

QUERIES["analyze_splitting"] = _chain("splitting")
ORACLES["analyze_splitting"] = (
    "WITH "
    + unnest_sql(TOKENS_SQL.replace("value", "text"))
    + f""", k AS (SELECT * FROM u WHERE lower(token) NOT IN ({quoted(EN)})),
p AS (SELECT id, pos, unnest(list_distinct(list_concat(list_filter(string_split({SPLIT_SQL}, ' '), lambda x: x <> ''), {GLUE_SQL}))) AS token FROM k),
l AS (SELECT id, pos, lower(token) AS token FROM p),
t AS (SELECT id, pos, {STEM_SQL} AS token FROM l)"""
    + STATS_SQL
)

QUERIES["analyze_tight"] = _chain("tight")
ORACLES["analyze_tight"] = (
    "WITH "
    + unnest_sql(TOKENS_SQL.replace("value", "text"))
    + f""", k AS (SELECT * FROM u WHERE lower(token) NOT IN ({quoted(EN)})),
p AS (SELECT id, pos, unnest(list_distinct({GLUE_SQL})) AS token FROM k),
l AS (SELECT id, pos, lower(token) AS token FROM p),
t AS (SELECT DISTINCT id, pos, {STEM_SQL} AS token FROM l)"""
    + STATS_SQL
)


def analyze_rev(spark, sf_dir):
    """Leading wildcard ``*tion`` over the reversed tokens of all documents."""
    found = A.ends_with(A.analyze(documents(spark, sf_dir), "id", "text", "rev"), "tion")
    return found.groupBy("token", "reversed").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("docs"))


QUERIES["analyze_rev"] = analyze_rev
ORACLES["analyze_rev"] = (
    "WITH "
    + unnest_sql(words_sql("text"), "t")
    + " SELECT token, reverse(token) AS reversed, count(*) AS n, count(DISTINCT id) AS docs FROM t WHERE token LIKE '%tion' GROUP BY 1, 2"
)


def stopwords_by_lang(spark, sf_dir):
    tokens = A.standard_tokens(documents(spark, sf_dir), "id", "text", "lang")
    kept = A.stop_by_language(tokens, A.word_table(spark, A.STOP_WORDS))
    return kept.groupBy("lang", F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


STOP_SQL = (
    "stops(lang, token) AS (VALUES "
    + ", ".join(f"('{lang}', '{w}')" for lang, ws in sorted(A.STOP_WORDS.items()) for w in ws)
    + ")"
)

QUERIES["stopwords_by_lang"] = stopwords_by_lang
ORACLES["stopwords_by_lang"] = (
    "WITH "
    + STOP_SQL
    + ","
    + unnest_sql(words_sql("text"), extra=", lang")
    + """ SELECT lang, token, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM u
WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = u.lang AND s.token = u.token) GROUP BY 1, 2"""
)

ARTICLE_SQL = A.ARTICLE.replace("'", "''")


def fold_by_lang(spark, sf_dir):
    """Folded terms of all documents; in French ones a preposition is elided, so that there is something to strip."""
    elided = F.when(F.col("lang") == "fr", F.replace(F.col("text"), F.lit(" de "), F.lit(" d'"))).otherwise(F.col("text"))
    return A.term_statistics(documents(spark, sf_dir).withColumn("text", elided), "id", "text", "lang", lang_col="lang")


QUERIES["fold_by_lang"] = fold_by_lang
ORACLES["fold_by_lang"] = (
    "WITH "
    + STOP_SQL
    + ","
    + unnest_sql(
        "CASE WHEN lang = 'fr' THEN regexp_extract_all(lower(replace(text, ' de ', ' d''')), "
        rf"'(?:{ARTICLE_SQL})?[\p{{L}}\p{{N}}]+') ELSE {words_sql('text')} END",
        name="w",
        extra=", lang",
    )
    + f""", u AS (SELECT id, lang, pos, CASE WHEN lang = 'fr' THEN regexp_replace(token, '^{ARTICLE_SQL}', '') ELSE token END AS token FROM w),
t AS (SELECT id, pos, CASE lang
  WHEN 'fr' THEN translate(token, '{A.ACCENTED}', '{A.PLAIN}')
  WHEN 'de' THEN translate(replace(token, 'ß', 'ss'), 'äöü', 'aou')
  WHEN 'es' THEN translate(token, '{A.ACCENTED}', '{A.PLAIN}') ELSE token END AS token FROM u
  WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = u.lang AND s.token = u.token))"""
    + STATS_SQL
)


def synonym_expand(spark, sf_dir):
    """Query-time expansion: two rules whose tokens come from the data, the commonest words of all documents."""
    tokens = A.plain_tokens(documents(spark, sf_dir), "id", words(F.col("text")))
    rules = spark.createDataFrame(
        [("the", "the", 0), ("the", "that", 1), ("that", "the", 0), ("that", "that", 1)], "token string, synonym string, ord int"
    )
    expanded = A.synonyms(tokens, rules, expand=True)
    first = A.synonyms(tokens, rules, expand=False)
    both = expanded.withColumn("mode", F.lit("expand")).unionByName(first.withColumn("mode", F.lit("first")))
    return both.groupBy("mode", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


QUERIES["synonyms"] = synonym_expand
ORACLES["synonyms"] = (
    "WITH r(token, synonym, ord) AS (VALUES ('the', 'the', 0), ('the', 'that', 1), ('that', 'the', 0), ('that', 'that', 1)),"
    + unnest_sql(words_sql("text"))
    + """, b AS (
SELECT 'expand' AS mode, coalesce(r.synonym, u.token) AS token, pos FROM u LEFT JOIN r USING (token) UNION ALL
SELECT 'first', coalesce(r.synonym, u.token), pos FROM u LEFT JOIN (SELECT * FROM r WHERE ord = 0) r USING (token))
SELECT mode, token, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM b GROUP BY 1, 2"""
)


def cjk_bigrams(spark, sf_dir):
    """Documents hold no CJK text, so every word is first mapped to one ideograph by its length and start."""
    docs = documents(spark, sf_dir)
    mapped = docs.select(
        "id",
        F.array_join(
            F.transform(words(F.col("text")), lambda w: F.when(F.length(w) > 3, F.translate(w.substr(1, 2), "aeioun", "一二三四五六")).otherwise(" ")),
            "",
        ).alias("text"),
    )
    return A.cjk_bigrams(mapped, "id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("docs"))


QUERIES["cjk_bigrams"] = cjk_bigrams
ORACLES["cjk_bigrams"] = f"""
WITH m AS (SELECT doc_id AS id, array_to_string(list_transform({words_sql('text')},
  lambda w: CASE WHEN length(w) > 3 THEN translate(substr(w, 1, 2), 'aeioun', '一二三四五六') ELSE ' ' END), '') AS text FROM documents),
r AS (SELECT id, unnest(regexp_extract_all(text, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]+')) AS run FROM m),
t AS (SELECT id, CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) END AS toks FROM r),
u AS (SELECT id, unnest(toks) AS token FROM t)
SELECT token, count(*) AS n, count(DISTINCT id) AS docs FROM u GROUP BY token"""


def keyword_256(spark, sf_dir):
    """Exact-value groups of the text; texts over 256 characters have no exact value."""
    return (
        documents(spark, sf_dir).select(keyword(F.col("text")).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    )


QUERIES["keyword_256"] = keyword_256
ORACLES["keyword_256"] = (
    "SELECT CASE WHEN length(text) <= 256 THEN text END AS keyword, count(*) AS n FROM documents GROUP BY 1"
)

# --- schema jobs ----------------------------------------------------------------------------------


def cast_by_suffix(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key_l"),
        F.col("o_custkey").cast("string").alias("cust_i"),
        F.col("o_totalprice").cast("string").alias("total_d"),
        F.col("o_orderdate").cast("string").alias("placed_dt"),
        F.col("o_orderpriority").alias("priority_ss"),
        (F.col("o_orderstatus") == "F").cast("string").alias("done_b"),
    )
    typed = S.cast_by_suffix(raw)
    return typed.withColumn("placed_dt", F.col("placed_dt").cast("timestamp_ntz")).withColumn(
        "priority_ss", F.array_join("priority_ss", ",")
    )


QUERIES["cast_by_suffix"] = cast_by_suffix
ORACLES["cast_by_suffix"] = """
SELECT o_orderkey AS key_l, o_custkey::INTEGER AS cust_i, o_totalprice AS total_d, o_orderdate AS placed_dt,
       o_orderpriority AS priority_ss, o_orderstatus = 'F' AS done_b FROM orders"""


def cast_by_older_suffix(spark, sf_dir):
    """Types of the older layout: point and trie numbers, payload maps, prefixes, columns that are ignored."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    raw = table(spark, sf_dir, "orders").select(
        key.alias("key_tl"),
        F.col("o_custkey").cast("string").alias("cust_pi"),
        price.alias("total_tds"),
        F.col("o_orderdate").cast("string").alias("placed_pdt"),
        F.concat(F.lit("price|"), price, F.lit(" key|"), key).alias("facts_dpf"),
        F.col("o_orderpriority").alias("attr_priority"),
        F.col("o_orderstatus").alias("status_txt_en"),
        price.alias("ignored_price"),
    )
    typed = S.cast_by_suffix(raw, S.OLDER_TYPES)
    return typed.select(
        "key_tl",
        "cust_pi",
        F.col("total_tds")[0].alias("total_tds"),
        F.col("placed_pdt").cast("timestamp_ntz").alias("placed_pdt"),
        F.col("facts_dpf")["price"].alias("price_dpf"),
        F.array_join("attr_priority", ",").alias("attr_priority"),
        "status_txt_en",
    )


QUERIES["cast_by_older_suffix"] = cast_by_older_suffix
ORACLES["cast_by_older_suffix"] = """
SELECT o_orderkey AS key_tl, o_custkey::INTEGER AS cust_pi, o_totalprice AS total_tds, o_orderdate AS placed_pdt, o_totalprice::FLOAT AS price_dpf,
       o_orderpriority AS attr_priority, o_orderstatus AS status_txt_en FROM orders"""


def release_date(spark, sf_dir):
    """Dates of finished orders only; the others have none."""
    dated = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_date"),
    )
    return S.normalise_dates(dated)


QUERIES["release_date"] = release_date
ORACLES["release_date"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END AS release_date
FROM orders"""


def sort_missing_last(spark, sf_dir):
    """Place of every order when sorted by date within its customer, orders without a date last."""
    from pyspark.sql import Window

    dated = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("day"),
    )
    place = F.row_number().over(Window.partitionBy("customer").orderBy(topk.missing_last("day", descending=True), "id"))
    return dated.withColumn("place", place.cast("long"))


QUERIES["sort_missing_last"] = sort_missing_last
ORACLES["sort_missing_last"] = """
WITH d AS (SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS day FROM orders)
SELECT *, row_number() OVER (PARTITION BY customer ORDER BY day DESC NULLS LAST, id) AS place FROM d"""


def alpha_sort(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lower("c_mktsegment").alias("lowercase"),
        A.alpha_sort_key(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("sort_key"),
    )


QUERIES["alpha_sort"] = alpha_sort
ORACLES["alpha_sort"] = """
SELECT c_custkey AS id, lower(c_mktsegment) AS lowercase,
       regexp_replace(trim(lower(c_mktsegment || ' ' || c_name)), '[^a-z]', '', 'g') AS sort_key FROM customer"""


def path_descendants(spark, sf_dir):
    """Pages under every path prefix of the site tree."""
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://|\?.*$", "").alias("path"))
    levels = paths.select("page_id", F.explode(A.path_levels(F.col("path"))).alias("prefix"))
    return levels.groupBy("prefix").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


QUERIES["path_descendants"] = path_descendants
ORACLES["path_descendants"] = r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://|\?.*$', '', 'g'), '/') AS parts FROM pages),
l AS (SELECT page_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS prefix FROM p)
SELECT prefix, count(*) AS pages, min(page_id) AS first_page FROM l GROUP BY prefix"""


def repair_docs(spark, sf_dir):
    """Parts as product documents: small ones lack a description, mid-size ones lack categories."""
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_name")).alias("title"),
        F.when(F.col("p_size") > 10, F.concat_ws(" ", "p_brand", "p_type")).alias("description"),
        F.when(~F.col("p_size").between(20, 30), F.array(F.array("p_brand", "p_type"), F.array("p_name"))).alias("categories"),
    )
    return S.repair_docs(raw).withColumn("categories", F.array_join("categories", "|"))


QUERIES["repair_docs"] = repair_docs
ORACLES["repair_docs"] = """
SELECT p_partkey AS id, CASE WHEN p_type <> 'ECONOMY' THEN p_name ELSE 'DUMMY_TITLE' END AS title,
       CASE WHEN p_size > 10 THEN p_brand || ' ' || p_type ELSE 'DUMMY_DESCRIPTION' END AS description,
       CASE WHEN p_size BETWEEN 20 AND 30 THEN 'DUMMY_CATEGORY' ELSE p_brand || '|' || p_type || '|' || p_name END AS categories
FROM part"""


def vector_validation(spark, sf_dir):
    """Stored vectors spoiled by class: cut short, missing, or with a not-a-number component."""
    spoiled = corpus(spark, sf_dir).select(
        "id",
        F.when(F.col("label") == 1, F.slice("vector", 1, 63))
        .when(F.col("label") == 2, F.lit(None))
        .when(F.col("label") == 3, F.transform("vector", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
        .when(F.col("label") == 4, F.transform("vector", lambda x, i: F.when(i != 7, x)))
        .otherwise(F.col("vector"))
        .alias("vector"),
    )
    good, bad = S.validate_vectors(spoiled, DIMS)
    return good.select("id", F.lit("accepted").alias("reason")).unionByName(bad.select("id", "reason"))


QUERIES["vector_validation"] = vector_validation
ORACLES["vector_validation"] = """
SELECT vec_id AS id, CASE label WHEN 1 THEN 'dimensions' WHEN 2 THEN 'missing' WHEN 3 THEN 'not finite'
       WHEN 4 THEN 'null component' ELSE 'accepted' END AS reason FROM embeddings"""


# --- phrases and token graphs ---------------------------------------------------------------------------

# Sets of phrases that stand for each other, made of common words of the documents.
PHRASES = [["of the", "whereof"], ["is", "are being", "be"], ["of the and", "thereof"], ["in", "within the"]]
SET_OF = {phrase: phrases for phrases in PHRASES for phrase in phrases}


def phrase_units_sql(expand: bool) -> str:
    """Tokens and matched phrases of a text in order, by a regular expression with the longest phrases first, and what stands for each."""
    longest = sorted(SET_OF, key=lambda p: -len(p.split()))
    pattern = "|".join(longest)
    rules = ", ".join(f"('{p}', {i}, '{other}')" for p, own in SET_OF.items() for i, other in enumerate(own if expand else own[:1]))
    return f"""
r(unit, ord, other) AS (VALUES {rules}),
line AS (SELECT doc_id AS id, regexp_replace(' ' || array_to_string({words_sql('text')}, '  ') || ' ', ' ({pattern.replace(' ', '  ')}) ', '|\\1|', 'g') AS t FROM documents),
cut AS (SELECT id, unnest(regexp_extract_all(t, '\\|[^|]*\\||[^ |]+')) AS u, generate_subscripts(regexp_extract_all(t, '\\|[^|]*\\||[^ |]+'), 1) AS n FROM line),
unit AS (SELECT id, n, replace(trim(u, '|'), '  ', ' ') AS unit FROM cut),
alt AS (SELECT id, n, coalesce(other, unit) AS other FROM unit LEFT JOIN r USING (unit)),
reach AS (SELECT id, n, max(len(string_split(other, ' '))) AS reach FROM alt GROUP BY id, n),
at AS (SELECT id, n, reach, sum(reach) OVER (PARTITION BY id ORDER BY n) - reach AS pos FROM reach),
tok AS (SELECT id, n, unnest(string_split(other, ' ')) AS token, generate_subscripts(string_split(other, ' '), 1) - 1 AS k, len(string_split(other, ' ')) AS m FROM alt),
placed AS (SELECT id, (pos + k)::BIGINT AS pos, token, (CASE WHEN k < m - 1 THEN 1 ELSE reach - k END)::BIGINT AS length FROM tok JOIN "at" USING (id, n))"""


def synonyms_phrases(spark, sf_dir):
    """Synonyms of several words in both modes, counted by token, place and length."""
    docs = documents(spark, sf_dir)
    modes = [
        A.phrase_table(docs, "id", words(F.col("text")), A.synonym_rules(PHRASES, expand)).withColumn("mode", F.lit(mode))
        for mode, expand in (("expand", True), ("first", False))
    ]
    both = modes[0].unionByName(modes[1])
    return both.groupBy("mode", "token", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


def _phrases_sql(mode: str, expand: bool) -> str:
    return (
        f"(WITH {phrase_units_sql(expand).replace('at AS', '\"at\" AS', 1)} "
        f"SELECT '{mode}' AS mode, token, length, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM placed GROUP BY token, length)"
    )


QUERIES["synonyms_phrases"] = synonyms_phrases
ORACLES["synonyms_phrases"] = f"SELECT * FROM {_phrases_sql('expand', True)} UNION ALL SELECT * FROM {_phrases_sql('first', False)}"


def _graph_chain(chain):
    """Token counts with positions and lengths, so that the graph has to agree and not only the words."""

    def run(spark, sf_dir):
        return A.term_statistics(documents(spark, sf_dir), "id", "text", chain, by=("token", "length"), protected=PROTECTED)

    return run


def _graph_sql(catenate: bool) -> str:
    glued = f"""
UNION ALL SELECT id, pos + min(i), string_agg(part, '' ORDER BY i), count(*) FROM (
  SELECT *, i - row_number() OVER (PARTITION BY id, pos, regexp_full_match(part, '\\p{{N}}+') ORDER BY i) AS run FROM part)
GROUP BY id, pos, regexp_full_match(part, '\\p{{N}}+'), run HAVING count(*) > 1""" if catenate else ""
    return (
        "WITH "
        + unnest_sql(TOKENS_SQL.replace("value", "text"))
        + f""", k AS (SELECT id, pos, list_filter(string_split({SPLIT_SQL}, ' '), lambda x: x <> '') AS parts FROM u WHERE lower(token) NOT IN ({quoted(EN)})),
moved AS (SELECT id, parts, pos + coalesce(sum(greatest(len(parts), 1) - 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM k),
part AS (SELECT id, pos, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM moved),
span(id, pos, token, length) AS (SELECT id, pos + i, lower(part), 1 FROM part {glued.replace("string_agg(part", "string_agg(lower(part)")}),
t AS (SELECT id, pos, length, CASE WHEN token IN ({quoted(PROTECTED)}) THEN token ELSE {STEM_SQL} END AS token FROM span)
SELECT token, length::BIGINT AS length, count(*) AS n, sum(pos)::BIGINT AS pos_sum, count(DISTINCT id) AS docs FROM t GROUP BY token, length"""
    )


for _name, _catenate in (("splitting_graph", True), ("splitting_query", False)):
    QUERIES[f"analyze_{_name}"] = _graph_chain(_name)
    ORACLES[f"analyze_{_name}"] = _graph_sql(_catenate)


def bm25_phrases(spark, sf_dir):
    """BM25 with synonyms of words and phrases on the query side."""
    asked = A.expanding_phrases(words, PHRASES)
    return bm25(text_queries(spark, sf_dir), documents(spark, sf_dir), 10, digits=DIGITS, query_terms=asked)


QUERIES["bm25_phrases"] = bm25_phrases
