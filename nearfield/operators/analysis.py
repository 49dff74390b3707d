"""Text analysis: token tables and the steps that rewrite them.

A token table has ``(id, pos, token)``, plus ``start`` and ``end`` character
offsets from ``analyze`` and ``lang`` where given. Steps are column expressions
or joins with small word tables.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearfield.functions.numbers import running_total
from nearfield.functions.text import WORD, minimal_stem, possessive, whitespace_tokens
from nearfield.operators.blocks import few_items, list_rows
from nearfield.operators.corpus import split_by_repeats

# Stop words. English is the usual 33-word search engine list, the
# others are articles, prepositions and conjunctions.
STOP_WORDS = {
    "en": (
        "a an and are as at be but by for if in into is it no not of on or such that the their then there these "
        "they this to was will with"
    ).split(),
    "de": "der die das den dem des ein eine einer eines und oder aber in im an am auf aus bei mit nach von zu zum zur ist nicht".split(),
    "fr": "le la les un une des du de et ou mais dans en au aux par pour que qui est ne pas sur avec".split(),
    "es": "el la los las un una unos unas y o pero en de del al por para que es no con se su".split(),
}

# Elided articles and the letters folding replaces.
ARTICLE = r"(?:l|m|t|qu|n|s|j|d|c|jusqu|quoiqu|lorsqu|puisqu)['’]"
ELISIONS = "(?i)^" + ARTICLE
ACCENTED = "àáâãåèéêëìíîïòóôõùúûñçý"
PLAIN = "aaaaaeeeeiiiioooouuuncy"

# One run of letters, or of digits, between punctuation that no rule of the word delimiter cuts: no change
# from a small to a capital letter inside, and no 's that is a possessive mark.
PLAIN_WORD = r"^(?:[^\p{L}\p{N}]*[^\p{L}\p{N}'’])?(?:\p{Lu}*\p{Ll}+|\p{Lu}+|\p{N}+)[^\p{L}\p{N}]*\z"

CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

Step = Callable[[DataFrame], DataFrame]


# --- tokenizers ---------------------------------------------------------------------


def standard_tokens(df: DataFrame, id_col: str, text_col: str, *keep: str, articles: Column | None = None) -> DataFrame:
    """Runs of letters and digits with position and character offsets.

    Where ``articles`` holds, an elided article stays in front of its word.
    """
    pieces = lambda word: F.regexp_extract_all(F.col(text_col), F.lit(r"[^\p{L}\p{N}]*" + word), F.lit(0))
    piece = pieces(WORD) if articles is None else F.when(articles, pieces(f"(?:(?i){ARTICLE})?{WORD}")).otherwise(pieces(WORD))
    cut = df.select(F.col(id_col).alias("id"), *keep, piece.alias("_pieces"))
    ends = running_total(F.transform("_pieces", F.length))
    rows = cut.select("id", *keep, F.posexplode(F.arrays_zip("_pieces", ends.alias("_ends"))).alias("pos", "_t"))
    token = F.regexp_replace(F.col("_t")["_pieces"], r"^[^\p{L}\p{N}]+", "")
    return rows.select(
        "id",
        *keep,
        F.col("pos").cast("long").alias("pos"),
        token.alias("token"),
        (F.col("_t")["_ends"] - F.length(token)).cast("long").alias("start"),
        F.col("_t")["_ends"].cast("long").alias("end"),
    )


def plain_tokens(df: DataFrame, id_col: str, tokens: Column, *keep: str) -> DataFrame:
    """Any token array as ``(id, pos, token)``."""
    return df.select(F.col(id_col).alias("id"), *keep, F.posexplode(tokens).alias("pos", "token")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def whitespace_table(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    return plain_tokens(df, id_col, whitespace_tokens(F.col(text_col)), *keep)


# --- steps ---------------------------------------------------------------------------


def rewrite(f: Callable[[Column], Column]) -> Step:
    return lambda df: df.withColumn("token", f(F.col("token")))


lower: Step = rewrite(F.lower)
strip_possessive: Step = rewrite(possessive)


def stop(words: list[str]) -> Step:
    """Drop listed words whatever their case; positions keep their gaps."""
    return lambda df: df.where(~F.lower("token").isin(words))


def word_table(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    rows = [(lang, word) for lang, words in sorted(lists.items()) for word in words]
    return spark.createDataFrame(rows, "lang string, token string")


def stop_by_language(df: DataFrame, lists: DataFrame) -> DataFrame:
    """Drop the words listed for a row's language; ``lists`` is ``(lang, token)``."""
    return df.join(lists, (df["lang"] == lists["lang"]) & (F.lower(df["token"]) == lists["token"]), "left_anti")


def stem(protected: list[str] = ()) -> Step:
    """English plural stemmer, leaving protected words alone."""
    return rewrite(lambda token: stem_of(token, protected))


def stem_of(token: Column, protected: list[str] = ()) -> Column:
    return F.when(token.isin(list(protected)), token).otherwise(minimal_stem(token)) if protected else minimal_stem(token)


def synonyms(df: DataFrame, rules: DataFrame, expand: bool) -> DataFrame:
    """Single-word synonyms from ``(token, synonym, ord)`` rows.

    ``expand`` puts every synonym at the position of the token, otherwise the
    token becomes its first synonym. Tokens without a rule stay.
    """
    wanted = rules if expand else rules.where(F.col("ord") == 0)
    joined = df.join(wanted.select("token", "synonym"), "token", "left")
    return joined.withColumn("token", F.coalesce("synonym", "token")).drop("synonym").select(*df.columns)


SPAN = "array<struct<pos:long,token:string,length:long>>"
WORDS_AT_ONCE = 100_000  # words of an Arrow batch that are Python values at a time, or those of one text


def synonym_rules(sets: list[list[str]], expand: bool = True) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """What stands for each phrase: all phrases of the sets it is in if ``expand``, else the first one of its first set."""
    rules: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for phrases in sets:
        split = [tuple(p.split()) for p in phrases if p.split()]
        for phrase in split:
            held = rules.setdefault(phrase, [])
            if expand or not held:
                held += [p for p in (split if expand else split[:1]) if p not in held]
    return rules


def phrase_synonyms(tokens: Column, rules: dict[tuple[str, ...], list[tuple[str, ...]]]) -> Column:
    """A token array as spans ``(pos, token, length)`` with the synonyms of phrases, which may have several words.

    From left to right the longest phrase that a rule knows is taken, found in a trie
    of the rules, and all that stands for it begins at its position. What follows
    comes after the longest of these; a shorter one ends in a token whose length, in
    positions, reaches that far. Matched phrases don't overlap. A null array stays null.
    """
    return F.arrow_udf(phrase_spans(rules), SPAN)(tokens)


def phrase_spans(rules: dict[tuple[str, ...], list[tuple[str, ...]]]) -> Callable[[pa.Array], pa.Array]:
    """``phrase_synonyms`` of an Arrow array, whose spans are flat columns, never Python values of a whole batch."""
    trie: dict = {}
    for phrase, others in rules.items():
        node = trie
        for word in phrase:
            node = node.setdefault(word, {})
        node[None] = others

    def spans(words: list[str]) -> Iterator[tuple[int, str, int]]:
        pos, i = 0, 0
        while i < len(words):
            node, j, found, after = trie, i, None, i + 1
            while j < len(words) and words[j] in node:
                node, j = node[words[j]], j + 1
                if None in node:
                    found, after = node[None], j
            i, others = after, found or [(words[i],)]
            reach = max(map(len, others))
            for other in others:
                for k, word in enumerate(other):
                    yield pos + k, word, 1 if k < len(other) - 1 else reach - k
            pos += reach

    kind = pa.list_(pa.struct([("pos", pa.int64()), ("token", pa.string()), ("length", pa.int64())]))

    def part(texts: pa.Array) -> pa.Array:
        places, found, lengths, ends = array("q"), [], array("q"), [0]
        for words in texts:
            for pos, token, length in spans(words.as_py() or []):
                places.append(pos)
                found.append(token)
                lengths.append(length)
            ends.append(len(places))
        flat = pa.StructArray.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.string()), pa.array(lengths, pa.int64())], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=kind, mask=texts.is_null())

    def look(column: pa.Array) -> pa.Array:
        ends = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).cumsum()
        cuts = [0, *(1 + np.flatnonzero(np.diff(ends // WORDS_AT_ONCE))).tolist(), *([len(column)] if len(column) else [])]
        return pa.concat_arrays([part(column.slice(at, end - at)) for at, end in zip(cuts, cuts[1:])] or [pa.array([], kind)])

    return look


def phrase_table(df: DataFrame, id_col: str, tokens: Column, rules: dict[tuple[str, ...], list[tuple[str, ...]]]) -> DataFrame:
    """``(id, pos, token, length)`` of token arrays with synonyms of phrases (``phrase_synonyms``)."""
    return df.select(F.col(id_col).alias("id"), F.inline(phrase_synonyms(tokens, rules)))


def expanding_phrases(terms: Callable[[Column], Column], sets: list[list[str]]) -> Callable[[Column], Column]:
    """A chain for queries: the terms of ``terms`` with all synonyms of words and phrases."""
    rules = synonym_rules(sets)
    return lambda text: F.transform(phrase_synonyms(terms(text), rules), lambda s: s["token"])


def unique_at_position(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["id", "pos", "token"])


def with_reversed(df: DataFrame) -> DataFrame:
    return df.withColumn("reversed", F.reverse("token"))


def ends_with(df: DataFrame, suffix: str) -> DataFrame:
    """Leading wildcard ``*suffix`` as a prefix condition on the reversed token, which a scan can prune."""
    return df.where(F.col("reversed").startswith(suffix[::-1]))


def delimited(token: Column) -> Column:
    """The token with a blank wherever letter case, kind or punctuation splits it."""
    out = F.regexp_replace(token, "['’][sS]$", "")
    out = F.regexp_replace(out, r"(\p{Ll})(\p{Lu})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{L})(\p{N})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{N})(\p{L})", "$1 $2")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def _unless_plain(token: Column, plain: Callable[[Column], Column], other: Column) -> Column:
    """``plain`` of the only word of a token that the word delimiter leaves whole, else ``other``, whose many patterns most tokens are spared."""
    return F.when(token.rlike(PLAIN_WORD), plain(F.regexp_extract(token, WORD, 0))).otherwise(other)


def word_parts(token: Column) -> Column:
    return _unless_plain(token, F.array, F.filter(F.split(delimited(token), " "), lambda t: t != ""))


def joined_runs(token: Column) -> Column:
    """Adjacent word parts glued together, and adjacent number parts likewise."""
    solid = F.regexp_replace(F.regexp_replace(token, "['’][sS]$", ""), r"[^\p{L}\p{N}]+", "")
    return _unless_plain(token, F.array, F.regexp_extract_all(solid, F.lit(r"\p{L}+|\p{N}+"), F.lit(0)))


def split_words(df: DataFrame, parts: bool = True, catenate: bool = True) -> DataFrame:
    """Word delimiter: parts of a token, their catenations, or both, all at the token's position."""
    return df.withColumn("token", F.explode(split_word(F.col("token"), parts, catenate)))


def split_word(token: Column, parts: bool = True, catenate: bool = True) -> Column:
    pieces = []
    if parts:
        pieces.append(word_parts(token))
    if catenate:
        pieces.append(joined_runs(token))
    both = pieces[0] if len(pieces) == 1 else F.array_union(*pieces)
    return _unless_plain(token, F.array, F.array_distinct(both))


def part_spans(token: Column, catenate: bool = True) -> Column:
    """Word delimiter as a graph: parts of a token at advancing positions, their catenations over all the parts they join.

    An array of ``(pos, token, length)`` from position 0. Adjacent word parts, and
    adjacent number parts, are one catenation, which begins at its first part and
    is as long as they are; a single part is its own. For queries leave ``catenate`` off.
    """
    parts = word_parts(token)

    def number(part: Column) -> Column:
        return part.rlike(r"^\p{N}+$")

    def span(part: Column, i: Column) -> Column:
        return F.struct(i.cast("long").alias("pos"), part.alias("token"), F.lit(1).cast("long").alias("length"))

    whole = lambda word: F.array(F.struct(F.lit(0).cast("long").alias("pos"), word.alias("token"), F.lit(1).cast("long").alias("length")))
    if not catenate:
        return _unless_plain(token, whole, F.transform(parts, span))

    def joined(own: Column) -> Column:
        def run(part: Column, i: Column) -> Column:
            """The parts that a catenation beginning here joins; none if the part before is of the same kind."""
            begins = F.when(i == 0, F.lit(True)).otherwise(number(own[F.greatest(i - 1, F.lit(0))]) != number(part))
            rest = F.slice(own, i + 1, F.size(own) - i)
            other = F.transform(rest, lambda p, j: F.when(number(p) != number(part), j).otherwise(F.size(rest)))
            length = F.array_min(other)
            glued = F.array_join(F.slice(rest, F.lit(1), length), "")
            return F.when(begins & (length > 1), F.struct(i.cast("long").alias("pos"), glued.alias("token"), length.cast("long").alias("length")))

        return F.concat(F.transform(own, span), F.filter(F.transform(own, run), lambda s: s.isNotNull()))

    return _unless_plain(token, whole, F.when(F.size(parts) > 0, F.transform(F.array(parts), joined)[0]).otherwise(F.array()).cast(SPAN))


def split_graph(df: DataFrame, catenate: bool = True) -> DataFrame:
    """Word delimiter over a token table ``(id, pos, token, ...)`` with advancing positions, and ``length`` in positions.

    A token of n parts takes n positions, so what follows moves on by n - 1; gaps
    stay. Tokens without a letter or digit go, and leave their position as a gap.
    """
    parts = df.withColumn("_n", F.greatest(F.size(word_parts(F.col("token"))), F.lit(1)))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.withColumn("pos", F.col("pos") + F.coalesce(F.sum(F.col("_n") - 1).over(before), F.lit(0))).drop("_n")
    spans = moved.withColumn("_s", F.explode(part_spans(F.col("token"), catenate)))
    return spans.withColumn("token", F.col("_s.token")).withColumn("length", F.col("_s.length")).withColumn("pos", F.col("pos") + F.col("_s.pos")).drop("_s")


def fold(token: Column, lang: Column) -> Column:
    """French loses elided articles and accents, German turns umlauts and sharp s into base letters, Spanish loses accents."""
    low = F.lower(token)
    french = F.translate(F.regexp_replace(low, ELISIONS, ""), ACCENTED, PLAIN)
    german = F.translate(F.regexp_replace(low, "ß", "ss"), "äöü", "aou")
    return F.when(lang == "fr", french).when(lang == "de", german).when(lang == "es", F.translate(low, ACCENTED, PLAIN)).otherwise(low)


# --- chains as term arrays, for ranking ------------------------------------------------


def english_terms(text: Column, protected: list[str] = (), stop_words: list[str] | None = None) -> Column:
    """The terms of the en chain: English stop words and possessive marks dropped, lower case, plurals stemmed."""
    stops = STOP_WORDS["en"] if stop_words is None else stop_words
    tokens = F.regexp_extract_all(text, F.lit(WORD + r"(?:['’][sS]\b)?"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~F.lower(t).isin(list(stops)))
    bare = F.transform(kept, lambda t: possessive(F.lower(t)))
    return F.transform(bare, lambda t: F.when(t.isin(list(protected)), t).otherwise(minimal_stem(t)) if protected else minimal_stem(t))


def expanding(terms: Callable[[Column], Column], synonyms: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A chain for queries: every term of ``terms`` and, where there is a rule for it, its synonyms instead."""
    rules = F.create_map(*[x for word, others in synonyms.items() for x in (F.lit(word), F.array(*map(F.lit, others)))])
    return lambda text: F.flatten(F.transform(terms(text), lambda t: F.coalesce(F.try_element_at(rules, t), F.array(t))))


def cjk_bigrams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Overlapping pairs of characters of every CJK run; a run of one character stays single."""
    runs = plain_tokens(df, id_col, F.regexp_extract_all(F.col(text_col), F.lit(CJK + "+"), F.lit(0)))
    n = F.length("token")
    pairs = F.when(n == 1, F.array("token")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.col("token").substr(i, F.lit(2)))
    )
    return runs.select("id", F.col("pos").alias("run"), F.posexplode(pairs).alias("pos", "token")).withColumn(
        "pos", F.col("pos").cast("long")
    )


# --- chains -----------------------------------------------------------------------------


def _span(pos: Column, token: Column, length: Column | None = None) -> Column:
    one = F.lit(1).cast("long")
    return F.struct(pos.cast("long").alias("pos"), token.alias("token"), (one if length is None else length).alias("length"))


def _each(spans: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(spans, lambda s: _span(s["pos"], f(s["token"]), s["length"]))


def _without(spans: Column, words: list[str]) -> Column:
    return F.filter(spans, lambda s: ~F.lower(s["token"]).isin(words)) if words else spans


def _stemmed(spans: Column, protected: list[str]) -> Column:
    return _each(_each(spans, F.lower), lambda t: stem_of(t, protected))


def chain_spans(
    text: Column, chain: str, lang: Column | None = None, protected: list[str] = (), stop_words: list[str] | None = None
) -> Column:
    """The tokens of one text by a chain of ``analyze``: an array of ``(pos, token, length)``, without offsets and reversed forms.

    For the chains of the word delimiter as a graph see ``graph_spans``.
    """
    stops = STOP_WORDS["en"] if stop_words is None else stop_words

    def placed(tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: _span(i, t))

    if chain in ("general", "rev"):
        return _each(_without(placed(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), stop_words or []), F.lower)
    if chain == "ws":
        return placed(whitespace_tokens(text))
    if chain == "en":
        tokens = _without(placed(F.regexp_extract_all(text, F.lit(WORD + r"(?:['’][sS]\b)?"), F.lit(0))), stops)
        return _each(_each(tokens, lambda t: possessive(F.lower(t))), lambda t: stem_of(t, protected))
    if chain in ("splitting", "tight"):
        split = lambda s: F.transform(split_word(s["token"], parts=chain == "splitting"), lambda t: _span(s["pos"], t))
        kept = _without(placed(whitespace_tokens(text)), stops)
        if chain == "splitting":
            return _stemmed(F.flatten(F.transform(kept, split)), protected)
        return F.flatten(F.transform(kept, lambda s: F.array_distinct(_stemmed(split(s), protected))))
    if chain == "lang":
        if lang is None:
            raise ValueError("the lang chain needs a language column")
        french = F.coalesce(lang == "fr", F.lit(False))
        cut = lambda word: F.regexp_extract_all(text, F.lit(word), F.lit(0))
        tokens = placed(F.when(french, F.transform(cut(f"(?:(?i){ARTICLE})?{WORD}"), lambda t: F.regexp_replace(t, ELISIONS, ""))).otherwise(cut(WORD)))
        kept = F.when(F.lit(False), tokens)
        for name, listed in sorted(STOP_WORDS.items()):
            kept = kept.when(lang == name, _without(tokens, listed))
        return _each(kept.otherwise(tokens), lambda t: fold(t, lang))
    raise ValueError(f"unknown chain: {chain}")


def graph_spans(df: DataFrame, id_col: str, text_col: str, protected: list[str], stop_words: list[str], catenate: bool) -> DataFrame:
    """``(id, spans)``: ``split_graph`` of the white-space tokens of a text inside its row, without stop words, lower case, plural stem."""
    more = lambda t: F.when(t.rlike(PLAIN_WORD) | F.lower(t).isin(stop_words), 0).otherwise(F.greatest(F.size(word_parts(t)), F.lit(1)) - 1)
    words = df.select(F.col(id_col).alias("id"), whitespace_tokens(F.col(text_col)).alias("words")).withColumn("more", F.transform("words", more))
    moved = words.withColumn("moved", running_total(F.col("more")))
    place = F.transform(F.arrays_zip("words", "more", "moved"), lambda t, i: _span(i + t["moved"] - t["more"], t["words"]))
    graph = lambda s: F.transform(part_spans(s["token"], catenate), lambda p: _span(s["pos"] + p["pos"], p["token"], p["length"]))
    return moved.select("id", _stemmed(F.flatten(F.transform(_without(place, stop_words), graph)), protected).alias("spans"))


def analyze(
    df: DataFrame,
    id_col: str,
    text_col: str,
    chain: str = "general",
    lang_col: str | None = None,
    protected: list[str] = (),
    stop_words: list[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """Token table of a text column by the named chain; ``whole``: a row per text, its tokens as ``spans`` (``chain_spans``).


    general: words, no stop words by default, lower case, offsets.
    ws: white-space tokens. en: words, English stop words, lower case, possessive, plural stem.
    splitting: white-space tokens, stop words, word delimiter with catenation, lower case, plural stem.
    splitting_graph, splitting_query: the same with parts at advancing positions and ``length``, the latter without catenation.
    tight: as splitting, catenations only, unique per position. rev: general plus reversed tokens.
    lang: words without elided articles, stop words of the row's language, folding by language.
    """
    stops = STOP_WORDS["en"] if stop_words is None else stop_words
    if whole:
        if chain in ("splitting_graph", "splitting_query"):
            return graph_spans(df, id_col, text_col, protected, stops, chain == "splitting_graph")
        lang = None if lang_col is None else F.col(lang_col)
        return df.select(F.col(id_col).alias("id"), chain_spans(F.col(text_col), chain, lang, protected, stop_words).alias("spans"))
    if chain in ("general", "rev"):
        out = lower(stop(stop_words)(standard_tokens(df, id_col, text_col)) if stop_words else standard_tokens(df, id_col, text_col))
        return with_reversed(out) if chain == "rev" else out
    if chain == "ws":
        return whitespace_table(df, id_col, text_col)
    if chain == "en":
        # The possessive mark is part of the token until it is stripped.
        tokens = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"(?:['’][sS]\b)?"), F.lit(0))
        out = lower(stop(stops)(plain_tokens(df, id_col, tokens)))
        return stem(protected)(strip_possessive(out))
    if chain in ("splitting", "tight"):
        out = split_words(stop(stops)(whitespace_table(df, id_col, text_col)), parts=chain == "splitting")
        out = stem(protected)(lower(out))
        return unique_at_position(out) if chain == "tight" else out
    if chain in ("splitting_graph", "splitting_query"):
        return stem(protected)(lower(split_graph(stop(stops)(whitespace_table(df, id_col, text_col)), chain == "splitting_graph")))
    if chain == "lang":
        if lang_col is None:
            raise ValueError("the lang chain needs a language column")
        french = F.col("lang") == "fr"
        tokens = standard_tokens(df.withColumn("lang", F.col(lang_col)), id_col, text_col, "lang", articles=F.coalesce(french, F.lit(False)))
        bare = tokens.withColumn("token", F.when(french, F.regexp_replace("token", ELISIONS, "")).otherwise(F.col("token")))
        kept = stop_by_language(bare, word_table(df.sparkSession, STOP_WORDS))
        return kept.withColumn("token", fold(F.col("token"), F.col("lang")))
    raise ValueError(f"unknown chain: {chain}")


# --- statistics of terms -----------------------------------------------------------------


def _term_sums(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``by`` and ``n``, ``docs``, ``pos_sum`` of a slice of texts ``(id, spans)``, whose ids are distinct."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in few_items(whole, "spans")):
            flat = batch.column("spans").flatten()
            coded = [pc.dictionary_encode(flat.field(name), null_encoding="encode") for name in by]
            sizes = [max(1, len(c.dictionary)) for c in coded]
            codes = np.ravel_multi_index([c.indices.to_numpy() for c in coded], sizes)
            terms, term = np.unique(codes, return_inverse=True) if len(by) > 1 else (np.arange(len(coded[0].dictionary)), codes)
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            row = list_rows(batch.column("spans"))
            pairs = np.unique((row * max(1, len(terms)) + term)[known[row]])
            totals = np.zeros(len(terms), np.int64)
            np.add.at(totals, term, flat.field("pos").to_numpy())
            counts = [np.bincount(term, minlength=len(terms)), np.bincount(pairs % max(1, len(terms)), minlength=len(terms)), totals]
            names = [c.dictionary.take(pa.array(at)) for c, at in zip(coded, np.unravel_index(terms, sizes))]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(c, pa.int64()) for c in counts)], names=[*by, "n", "docs", "pos_sum"])

    return sums


def term_statistics(df: DataFrame, id_col: str, text_col: str, chain: str = "general", by: tuple[str, ...] = ("token",), **options) -> DataFrame:
    """``by``, ``n``, ``docs`` and ``pos_sum`` of the token table of a chain: occurrences, distinct ids, sum of positions.

    The tokens of a text stay in one row of its task, and are summed up there before
    anything is shuffled; only of texts whose id is in other rows too are the pairs
    of token and id shuffled.
    """
    once, again = split_by_repeats(df, id_col)
    shape = ", ".join(f"{name} {'string' if name == 'token' else 'long'}" for name in by) + ", n long, docs long, pos_sum long"
    parts = analyze(once, id_col, text_col, chain, whole=True, **options).mapInArrow(_term_sums(list(by)), shape)
    if again is not None:
        rows = analyze(again, id_col, text_col, chain, **options)
        counts = (F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("docs"), F.sum("pos").alias("pos_sum"))
        parts = parts.unionByName(rows.groupBy(*by).agg(*counts))
    return parts.groupBy(*by).agg(*(F.sum(name).alias(name) for name in ("n", "docs", "pos_sum")))


# --- whole values ----------------------------------------------------------------------------


def alpha_sort_key(value: Column) -> Column:
    """Lower case, trimmed, letters a-z only."""
    return F.regexp_replace(F.trim(F.lower(value)), "[^a-z]", "")


def path_levels(path: Column) -> Column:
    """Every ancestor of a path and the path itself, shortest first: indexed, they find all descendants."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def under_path(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows at a path or below it."""
    return df.where((F.col(column) == path) | F.col(column).startswith(path.rstrip("/") + "/"))


def above_path(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows at a path or at one of its ancestors."""
    parts = path.split("/")
    return df.where(F.col(column).isin(["/".join(parts[: i + 1]) for i in range(len(parts))]))
