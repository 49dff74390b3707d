"""BM25 ranking over a table of postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.text import words
from nearfield.operators.blocks import BROADCAST_ROWS, CELLS, METRICS, PAIR, Block, TopK, bounded_table, counted, few_items, list_rows
from nearfield.operators.corpus import split_by_repeats
from nearfield.operators.topk import top_k
from nearfield.session import cut_lineage


DOCUMENT_MARK = ""  # the posting every document has, which carries its length


Terms = Callable[[Column], Column]  # from a text to the array of its terms


def postings(
    docs: DataFrame, id_col: str = "id", text_col: str = "text", vocabulary: DataFrame | None = None, terms: Terms = words
) -> DataFrame:
    """``(id, dl, term, tf)``: one row per distinct word of a document, with the document length in words. Ids are whole numbers.

    ``terms`` is the chain that turns a text into words, for documents.

    Every document also has one row for DOCUMENT_MARK, so document count and
    average length come from the same table. With a ``vocabulary`` (``term``)
    other words are dropped. Words are counted in the task of their document, and
    nothing is shuffled; only counts of rows that share an id are added up.
    """
    once, again = split_by_repeats(docs, id_col)
    counts = term_counts(once, id_col, text_col, terms)
    if again is not None:
        more = term_counts(again, id_col, text_col, terms).groupBy("id", "dl", "term").agg(F.sum("tf").alias("tf"))
        counts = counts.unionByName(more)
    if vocabulary is not None:
        marked = vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([(DOCUMENT_MARK,)], "term string"))
        counts = counts.join(marked, "term", "left_semi")
    return counts


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: Terms = words) -> DataFrame:
    """``(id, dl, term, tf)`` of every row on its own, DOCUMENT_MARK included: counted on the flat words of an Arrow batch. A null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in few_items(whole, "tokens")):
            batch = batch.filter(batch.column("tokens").is_valid())
            tokens = batch.column("tokens")
            coded = pc.dictionary_encode(tokens.flatten())
            size = max(1, len(coded.dictionary))
            cells, counts = np.unique(list_rows(tokens) * size + coded.indices.to_numpy(), return_counts=True)
            row = np.concatenate([np.arange(batch.num_rows), cells // size])
            marks = pa.array([DOCUMENT_MARK] * batch.num_rows, pa.string())
            lengths = tokens.value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    lengths.take(pa.array(row)),
                    pa.concat_arrays([marks, coded.dictionary.take(pa.array(cells % size))]),
                    pa.array(np.concatenate([np.ones(batch.num_rows, np.int64), counts])),
                ],
                names=["id", "dl", "term", "tf"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), terms(F.col(text_col)).alias("tokens"))
    return rows.mapInArrow(count, "id long, dl long, term string, tf long")


def bm25_over(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    k1: float = 1.2,
    b: float = 0.75,
    lucene8: bool = False,
    digits: int | None = None,
    salt: int = 16,
    ids: DataFrame | None = None,
    query_terms: Terms = words,
) -> DataFrame:
    """BM25 over a stored postings table, ranked among the documents in ``ids`` (``id``) if given.

    ``query_terms`` is the chain for queries, which may expand a word to several.

    Postings of other words are dropped where they are read. Up to VOCABULARY words
    and their weights travel to the postings; of more, a word that most documents
    hold is spread over ``salt`` tasks by document id, and each gets its own copy of
    the (small) query side of that word.
    """
    asked = (
        queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    whole = index.where(F.col("term") == DOCUMENT_MARK).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    n, avgdl = whole.select("n").scalar(), whole.select("avgdl").scalar()
    few = counted(asked, VOCABULARY) is not None
    salt = 1 if few else salt
    listed = asked.select("term").distinct()
    listed = F.broadcast(listed) if few else listed
    found = index.where(F.col("term") != DOCUMENT_MARK).join(listed, "term", "left_semi")
    df_of = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df_of, "term").select(
        "query_id",
        "term",
        (F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"),
        F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"),
    )
    gain = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    if not lucene8:
        gain = gain * (k1 + 1)
    ranked = found if ids is None else found.join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_semi")
    scored = (
        ranked.select("id", "term", gain.alias("gain"), F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int").alias("salt"))
        .join(F.broadcast(weighted) if few else weighted, ["term", "salt"])
        .groupBy("query_id", "id")
        .agg(F.sum(F.col("idf") * F.col("gain")).alias("_score"))
    )
    if digits is not None:
        scored = scored.withColumn("_score", F.round("_score", digits))
    return top_k(scored, k).select("query_id", "rank", "id", "_score")


VOCABULARY = 1_000_000  # distinct query words sent to every task at most


def forward_index(docs: DataFrame, vocabulary: pa.Array, id_col: str = "id", text_col: str = "text", terms: Terms = words) -> DataFrame:
    """``(id, dl, terms, tfs)``: per document its length and the counts of the vocabulary words in it.

    Spark cuts the text into words; the counting works on the flat word column
    of an Arrow batch. A document is one row, so nothing is shuffled.
    """
    schema = T.StructType.fromDDL("id long, dl long, terms array<int>, tfs array<int>")
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in few_items(whole, "tokens")):
            tokens = batch.column("tokens")
            code = pc.index_in(tokens.flatten(), value_set=vocabulary)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            cell = list_rows(tokens)[known] * size + code.fill_null(0).to_numpy().astype(np.int64)[known]
            cells, counts = np.unique(cell, return_counts=True)
            offsets = pa.array(np.searchsorted(cells, np.arange(len(tokens) + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    tokens.value_lengths().fill_null(0).cast(pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(cells % size if size else cells, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                names=["id", "dl", "terms", "tfs"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), terms(F.col(text_col)).alias("tokens")).mapInArrow(count, schema)


def bm25(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    k1: float = 1.2,
    b: float = 0.75,
    lucene8: bool = False,
    digits: int | None = None,
    id_col: str = "id",
    text_col: str = "text",
    ids: DataFrame | None = None,
    terms: Terms = words,
    query_terms: Terms | None = None,
) -> DataFrame:
    """Top-k documents per query text, any word may match; a repeated query word counts each time.

    ``terms`` is the chain for documents, and for queries unless they have their
    own in ``query_terms``, which may expand a word to several.

    With ``ids`` (``id``) only those documents are ranked; frequencies and the
    average length are still those of all. Ids are whole numbers.

    For a counted number of queries the texts are read once: word counts per
    document are written, document frequencies and the average length are taken
    from them, and each task multiplies its documents by the word weights of the
    queries and keeps its k best. More queries than that go through ``postings``
    and ``bm25_over``, which join word by word.
    """
    query_terms = terms if query_terms is None else query_terms
    among = None if ids is None else ids.select(F.col("id").cast("long").alias("id"))
    asked = (
        queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    few = counted(queries, BROADCAST_ROWS) is not None
    table = bounded_table(asked, 4 * VOCABULARY) if few else None
    vocabulary = None if table is None else pc.unique(table.column("term"))
    if vocabulary is None or len(vocabulary) > VOCABULARY:
        listed = asked.select("term").distinct()
        index = cut_lineage(postings(docs, id_col, text_col, listed, terms))
        return bm25_over(queries, index, k, k1, b, lucene8, digits, ids=among, query_terms=query_terms)

    index = cut_lineage(forward_index(docs, vocabulary, id_col, text_col, terms))
    n, avgdl = index.agg(F.count(F.lit(1)), F.avg("dl")).first()
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(vocabulary))
    df[np.asarray(found.column("term"))] = np.asarray(found.column("df"))

    ids, asked_by = np.unique(np.asarray(table.column("query_id")).astype(np.int64), return_inverse=True)
    term = pc.index_in(table.column("term"), value_set=vocabulary).to_numpy()
    weight = np.asarray(table.column("qtf")) * np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
    order = np.argsort(term, kind="stable")
    term, asked_by, weight = term[order], asked_by[order], weight[order]
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    factor = 1.0 if lucene8 else k1 + 1
    step = max(1, CELLS // max(len(ids), 1))
    block = Block(ids, np.empty((len(ids), 0)))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        """(queries x documents) scores, one outer product per word of the batch."""
        out = np.zeros((len(ids), batch.num_rows))
        terms = batch.column("terms")
        doc, word = list_rows(terms), np.asarray(terms.flatten())
        tf = np.asarray(batch.column("tfs").flatten()).astype(float)
        dl = np.asarray(batch.column("dl"))[doc]
        gain = factor * tf / (tf + k1 * (1 - b + b * dl / avgdl))
        by_word = np.argsort(word, kind="stable")
        doc, word, gain = doc[by_word], word[by_word], gain[by_word]
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else []
        for start, end in zip(starts, [*starts[1:], len(word)]):
            w = slice(first[word[start]], first[word[start] + 1])
            out[np.ix_(asked_by[w], doc[start:end])] += np.outer(weight[w], gain[start:end])
        out = np.where(out > 0, out, np.nan)
        return out if digits is None else np.round(out, digits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(k, METRICS["dot"])
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield from best.add(0, block, np.asarray(part.column("id")), score(part))
        yield from best.rest([block])

    ranked = index if among is None else index.join(among, "id", "left_semi")
    pairs = ranked.mapInArrow(scan, PAIR)
    return top_k(pairs, k, score="value").select("query_id", "rank", "id", F.col("value").alias("_score"))
