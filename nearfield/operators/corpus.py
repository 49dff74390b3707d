"""Corpus jobs: reading lines, cleaning, dense numbering, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.text import SPACE, more_tokens_than, whitespace_tokens
from nearfield.operators.blocks import counted
from nearfield.session import cut_lineage

# The parts of a corpus line.
COMMENT = "#"
SUBJECT = r"^<([^>]+)>"
LEADING_URL = rf"^<[^>]+>[{SPACE}]*"
LANGUAGE_END = r"@en \.\z"
MIN_TOKENS = 20

SPLITS = 2_000_000  # input splits whose offsets go to every task at most
RANGE_BITS = 33  # a task numbers its rows in the low bits of monotonically_increasing_id

FILE_ORDER = ("_file", "_block", "_length")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of plain or compressed text, with its place in the input.

    Only ``\\n`` ends a line. Splittable codecs are split; the place of a row is
    (file, start of its split); inside a split rows come in order.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_block_length").alias("_length"),
    )


# --- dense ids -------------------------------------------------------------------


def _before(over) -> Column:
    """Running total without the row itself."""
    return F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def dense_id(df: DataFrame, order: str, out: str = "id", start: int = 1) -> DataFrame:
    """Number rows 1, 2, 3 ... along a unique column, dense or sparse.

    Rows are dealt into ranges of the column of about equal size, sorted and
    written once; a task numbers its range, the ranges are counted, and the count
    of the ranges before is added. No window spans the table: only one row per
    range is summed up.
    """
    if out == order:
        raise ValueError("the number needs a column of its own")
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    numbered = cut_lineage(ranged.withColumn("_kept", F.monotonically_increasing_id()))
    part = F.shiftright("_kept", RANGE_BITS)
    parts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_kept").alias("_first"))
    offsets = parts.select("_part", (_before(Window.orderBy("_part")) - F.col("_first") + start).alias("_shift"))
    known = F.broadcast(offsets) if counted(parts, SPLITS) is not None else offsets
    placed = numbered.withColumn("_part", part).join(known, "_part")
    return placed.withColumn(out, F.col("_kept") + F.col("_shift")).drop("_part", "_kept", "_shift")


def dense_id_in_file_order(df: DataFrame, out: str = "id", start: int = 1, written: bool = False) -> DataFrame:
    """Number rows in file order: files by path, splits by offset, rows as read.

    For frames that come from ``read_lines`` by filters and projections. A task
    numbers the rows it keeps one after another, so a row's place in its split is
    its number less the smallest number of the split. The first pass notes that
    number and the count per split; the counts are summed up per file and over
    files (one row per file), and the result, one small row per split, goes to
    every task of the second pass. The rows are not moved.

    Both passes must cut the input alike. A row of a split that the first pass
    did not see, start and length, fails the job. Where the cut may change, as
    with a number of cores that comes and goes, let the numbered rows be
    ``written`` once, where they lie, for both passes.
    """
    numbered = df.withColumn("_kept", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered) if written else numbered
    splits = cut_lineage(
        numbered.groupBy(*FILE_ORDER).agg(F.count(F.lit(1)).alias("_n"), F.min("_kept").alias("_first"))
    )
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n"))
    file_before = files.select("_file", _before(Window.orderBy("_file")).alias("_file_before"))
    inside = splits.select(
        *FILE_ORDER, "_first", _before(Window.partitionBy("_file").orderBy("_block")).alias("_inside")
    )
    offsets = inside.join(file_before, "_file").select(
        *FILE_ORDER, (F.col("_inside") + F.col("_file_before") - F.col("_first") + start).alias("_shift")
    )
    known = F.broadcast(offsets) if counted(splits, SPLITS) is not None else offsets
    lost = F.raise_error(F.concat(F.lit("no place for a row of "), F.col("_file")))
    shift = F.when(F.col("_shift").isNotNull(), F.col("_shift")).otherwise(lost)
    return numbered.join(known, list(FILE_ORDER), "left").withColumn(out, F.col("_kept") + shift).drop("_kept", "_shift")


# --- cleaning ------------------------------------------------------------------------


def token_count(line: Column) -> Column:
    return F.size(whitespace_tokens(line))


def clean_line(line: Column) -> Column:
    """Drop the subject and predicate URLs in front and the language mark at the end."""
    without_subject = F.regexp_replace(line, LEADING_URL, "")
    without_urls = F.regexp_replace(without_subject, LEADING_URL, "")
    return F.regexp_replace(without_urls, LANGUAGE_END, "")


def parse_corpus(
    lines: DataFrame,
    min_tokens: int = MIN_TOKENS,
    max_docs: int = -1,
    order: str | None = None,
    own_ids: bool = False,
    written: bool = False,
) -> DataFrame:
    """``(id, url, _text_)`` of the lines that hold more than ``min_tokens`` tokens.

    Tokens are counted on the raw line. Comment lines are left out. Ids follow
    the input order of the kept lines: the ``order`` column, or the file order of
    ``read_lines`` (``written`` as in ``dense_id_in_file_order``). With ``own_ids`` the ``order`` column is the id itself, which
    stays the same whatever else arrives with it. ``max_docs`` below 1 keeps all.
    """
    if own_ids and order is None:
        raise ValueError("own ids need the column they are in")
    keys = list(FILE_ORDER) if order is None else [order]
    kept = (
        lines.where(~F.col("value").startswith(COMMENT))
        .where(more_tokens_than(F.col("value"), min_tokens))
        .select(
            *keys,
            F.regexp_extract("value", SUBJECT, 1).alias("url"),
            clean_line(F.col("value")).alias("_text_"),
        )
    )
    if own_ids:
        numbered = kept.withColumn("id", F.col(order).cast("long"))
    else:
        numbered = dense_id_in_file_order(kept, written=written) if order is None else dense_id(kept, order)
    docs = numbered.select("id", "url", "_text_")
    return docs if max_docs < 1 else docs.where(F.col("id") <= max_docs)


def corpus_metrics(lines: DataFrame, min_tokens: int = MIN_TOKENS, max_docs: int = -1) -> DataFrame:
    """Lines and kept documents, the longest line in tokens, and the report interval of a run."""
    counted = lines.where(~F.col("value").startswith(COMMENT)).select(token_count(F.col("value")).cast("long").alias("t"))
    interval = max(0.001 * max_docs, 0) or 1000
    return counted.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(F.col("t") > min_tokens, 1)).alias("docs"),
        F.max("t").alias("max_tokens"),
    ).withColumn("report_every", F.lit(float(interval)))


def observed(df: DataFrame, name: str, text_col: str = "_text_") -> DataFrame:
    """Report rows and the longest text in tokens while another job runs over the frame."""
    return df.observe(name, F.count(F.lit(1)).alias("docs"), F.max(token_count(F.col(text_col))).alias("max_tokens"))


def truncate_tokens(df: DataFrame, text_col: str, max_len: int = 500) -> DataFrame:
    """Model input: the first ``max_len`` tokens, and whether any were cut off."""
    tokens = whitespace_tokens(F.col(text_col))
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("n_tokens", F.size("_tokens").cast("long"))
        .withColumn("model_input", F.array_join(F.slice("_tokens", 1, max_len), " "))
        .withColumn("truncated", F.col("n_tokens") > max_len)
        .drop("_tokens")
    )


# --- repeated ids -------------------------------------------------------------------------


def split_by_repeats(df: DataFrame, id: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and the rest, None if there is none. Rows without an id repeat one another."""
    again = cut_lineage(df.groupBy(F.col(id).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"))
    if again.isEmpty():
        return df, None
    again = F.broadcast(again) if counted(again, 1_000_000) is not None else again
    same = F.col(id).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


# --- joins -----------------------------------------------------------------------------


def zip_by_position(docs: DataFrame, vectors: DataFrame, strict: bool = True, position: str = "pos") -> DataFrame:
    """The i-th document with the i-th vector. Vectors left over are ignored; with
    ``strict`` a document without a vector fails the job when it is read."""
    joined = docs.join(vectors.select(F.col(position).alias("id"), "vector"), "id", "left")
    if not strict:
        return joined
    short = F.raise_error(F.concat(F.lit("no vector for document "), F.col("id").cast("string")))
    return joined.withColumn("vector", F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(short))


def restrict_to(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(F.col("id").alias(id)), id, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(F.col("id").alias(id)), id, "left_anti")
