"""Personal data and the words that give it away, found and taken out with column expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.components import connected
from nearfield.llm.frames import columns, free_name
from nearfield.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8  # words on either side of an entity, in its line, that make up its context
SUPPORT = 2  # different passages about an entity in which a term has to stand before it can disclose it
RARE = 0.05  # chance of a window to hold a word, below which the word tells passages apart
BANDS, LEAST = 8, 2  # keys of a context, and least word hashes that make up a key: copies of a passage share one
SHARE = 0.9  # of an entity's information: a term that gives away so much of it discloses it
STEM = 3  # letters of a term that its generalisation keeps
BROADCAST_TERMS = 200_000  # so many terms or documents with terms (below 50 MB) travel to the documents; more are joined

BLOCK = 256  # lengths summed at once
MARK, OTHER = "\x01", "\x02"
LOCAL = r"A-Za-z0-9._%+\x01-"
# As the plain patterns match, but in time linear in the text: a match begins where its run of characters does, a sign
# between two characters of a chain is MARK, and a chain is one run then.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD = r"(?<![0-9\x01])[0-9][0-9\x01]++"
SPACE = r"(?<=[0-9])[\x20-](?=[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}+"

SPANS = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` (0 changes nothing) along an array of int, block by block, so that long arrays aren't copied for each value."""

    def inside(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))

        def step(held: Column, x: Column) -> Column:
            return let(op(held["last"], x), lambda y: F.struct(y.alias("last"), F.concat(held["all"], F.array(y)).alias("all")))

        return F.aggregate(block, start, step, lambda held: held["all"])

    def joined(blocks: Column) -> Column:
        ends = inside(F.transform(blocks, lambda b: b[F.size(b) - 1]))
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, x: F.transform(b, lambda y: op(y, x))))

    def cut(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_values), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: inside(F.slice(all_values, i, F.lit(BLOCK))))
        return F.when(F.size(all_values) > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, cut)


def found(text: Column, pattern: str, guard: str) -> Column:
    """Matches of ``pattern`` from left to right, with their code points; texts without ``guard`` have none."""

    def placed(matches: Column, pieces: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(pieces[i]) + F.when(i > 0, F.length(matches[i - 1])).otherwise(0))
        return F.zip_with(
            matches,
            running(lengths, lambda a, b: a + b),
            lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")),
        )

    all_matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(all_matches, lambda m: let(F.split(text, pattern, -1), lambda p: placed(m, p)))
    return F.when(text.rlike(guard), spans).otherwise(F.array()).cast(SPANS)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass the check of card numbers: every second one from the right doubled, the digits add up to tens."""

    def add(total: Column, i: Column) -> Column:
        x = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def bases(text: Column) -> dict[str, Column]:
    """Spans of personal data by kind, each with its value."""
    clean = F.translate(text, MARK, OTHER)
    cards = found(F.regexp_replace(clean, SPACE, MARK), CARD, "[0-9][0-9\\x01]{12}")
    return {
        "email": found(F.regexp_replace(clean, DOT, MARK), EMAIL, "@"),
        "ip": F.filter(found(text, IP, r"[0-9]\.[0-9]"), lambda s: s["value"].rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")),
        "card": F.filter(cards, lambda s: let(digits(s["value"]), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))),
        "phone": F.filter(found(text, PHONE, r"\+[0-9]"), lambda s: F.length(digits(s["value"])).between(9, 15)),
    }


def entity(kind: str, value: Column) -> Column:
    """One spelling of a value, however it is written."""
    if kind == "ip":
        return value
    return F.lower(F.translate(value, MARK, ".")) if kind == "email" else digits(value)


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def general(term: Column) -> Column:
    """What a term is generalised to: its first letters, for all words that begin so."""
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, entity, words, n)``: different contexts of entities and how often they stand.

    ``words`` are the different words of the line around an entity, WINDOW on
    either side and no farther than the entities next to it.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(whole.alias("text")).where(F.col("text").rlike("[@0-9]"))
    rows = rows.select("text", *(spans.alias(kind) for kind, spans in bases(F.col("text")).items()))

    def named(kind: str) -> Column:
        return F.transform(
            F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), entity(kind, s["value"]).alias("entity"))
        )

    def around(spans: Column) -> Column:
        def context(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, spans[i - 1]["end"]).otherwise(0)
            end = F.when(i < F.size(spans) - 1, spans[i + 1]["start"]).otherwise(F.length("text"))
            left = F.substring_index(F.substr("text", begin + 1, F.greatest(F.lit(0), s["start"] - begin)), "\n", -1)
            right = F.substring_index(F.substr("text", s["end"] + 1, F.greatest(F.lit(0), end - s["end"])), "\n", 1)
            near = F.concat(F.slice(F.reverse(terms_of(left)), 1, WINDOW), F.slice(terms_of(right), 1, WINDOW))
            return F.struct(s["kind"].alias("kind"), s["entity"].alias("entity"), F.array_sort(F.array_distinct(near)).alias("words"))

        return F.transform(spans, context)

    spans = rows.select("text", F.array_sort(F.concat(*map(named, KINDS))).alias("spans"))
    one = spans.select(F.explode_outer(let(F.col("spans"), around)).alias("c")).where("c IS NOT NULL")
    return one.groupBy("c.kind", "c.entity", "c.words").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(term, n)``: how often every word stands in all texts."""
    words = docs.select(F.explode_outer(F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0))).alias("term"))
    return words.where("term IS NOT NULL").groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))


def passages(spots: DataFrame, chances: DataFrame) -> DataFrame:
    """``spots`` ``(spot, kind, entity, words)`` with ``passage``, the lowest spot of the copies of a passage.

    Contexts of an entity are copies of one passage if they share a key of least
    hashes of their rare words, or through others that do; ``chances`` are ``(term,
    chance)``. Contexts without a rare word count as one passage. An entity with
    very many contexts is counted by key and joined, never listed.
    """
    words = spots.select("spot", F.explode("words").alias("term")).join(chances.where(F.col("chance") < RARE), "term")
    least = [F.min(F.xxhash64(F.concat(F.lit(f"{i}:"), "term"))) for i in range(BANDS * LEAST)]
    keys = F.array(*(F.xxhash64(F.lit(b), *least[b * LEAST : (b + 1) * LEAST]) for b in range(BANDS)))
    keyed = spots.join(words.groupBy("spot").agg(keys.alias("keys")), "spot", "left")
    own = keyed.select("kind", "entity", "spot", F.explode(F.coalesce("keys", F.array(F.lit(0).cast("long")))).alias("key"))
    lowest = own.groupBy("kind", "entity", "key").agg(F.min("spot").alias("first"))
    links = own.join(lowest, ["kind", "entity", "key"]).select(F.col("spot").alias("a"), F.col("first").alias("b"))
    groups = connected(links).select(F.col("node").alias("spot"), F.col("root"))
    return spots.join(groups, "spot", "left").select("kind", "entity", "words", "n", F.coalesce("root", "spot").alias("passage"))


def disclosing(docs: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``(term, replacement)``: words whose presence gives an entity away, and what to write for them.

    Of the D different passages around an entity, a term stands in d. Its pointwise
    mutual information with the entity is log2((d / D) / p(term)), where p is the
    chance of a window of the corpus to hold the term, 2 WINDOW n / N for a term
    that is n of the N words; the entity's own information is -log2(p(entity)).
    A term discloses the entity if it stands in ``support`` different passages or
    more and gives away ``share`` of that information. Copies and near copies of a
    passage are one piece of evidence (``passages``), so that copied documents
    alone disclose nothing.

    A term is generalised to its first STEM letters and a star, unless all words
    that begin so, taken as one term, would disclose one of the entities as well;
    then it is removed (the empty text).
    """
    counts = cut_lineage(vocabulary(docs, text))
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    spots = cut_lineage(contexts(docs, text)).withColumn("spot", F.monotonically_increasing_id())

    def chance(n: Column) -> Column:
        return F.least(F.lit(1.0), 2.0 * WINDOW * n / F.lit(max(total, 1.0)))

    spots = cut_lineage(passages(spots, counts.select("term", chance(F.col("n")).alias("chance"))))
    known = ["kind", "entity"]
    entities = spots.groupBy(*known).agg(F.count_distinct("passage").alias("all"), F.sum("n").alias("n")).where(F.col("all") >= support)
    entities = entities.select(*known, "all", (-F.log2(chance(F.col("n")))).alias("information"))

    def told(term: Column, name: str, held: DataFrame) -> DataFrame:
        """Terms of the contexts by entity, with what they give away."""
        seen = spots.select(*known, "passage", F.explode_outer(F.array_distinct(F.transform("words", lambda w: term(w)))).alias(name)).where(f"{name} IS NOT NULL")
        seen = seen.groupBy(*known, name).agg(F.count_distinct("passage").alias("both")).where(F.col("both") >= support)
        given = F.log2(F.col("both") / F.col("all") / chance(F.col("n")))
        return seen.join(entities, known).join(held, name).select(
            *known, name, ((given >= share * F.col("information")) & (F.col("information") > 0)).alias("tells")
        )

    single = told(lambda w: w, "term", counts).where("tells").select(*known, "term", general(F.col("term")).alias("stem"))
    classes = counts.groupBy(general(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"))
    stems = told(general, "stem", classes).where("tells").select(*known, "stem", F.lit(True).alias("both_tell"))
    worst = single.join(stems, [*known, "stem"], "left").groupBy("term").agg(F.max(F.coalesce("both_tell", F.lit(False))).alias("too"))
    return worst.select("term", F.when(F.col("too"), F.lit("")).otherwise(general(F.col("term"))).alias("replacement"))


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``docs`` with one more column ``privacy``: spans ``email``, ``ip``, ``card``, ``phone`` and ``term``, and the ``text`` without them.

    Personal data is found by its patterns, per kind from left to right without
    overlaps; then the corpus shows which words disclose it (``disclosing``), and
    those are spans in every text they stand in, outside the others. A span counts
    code points from 0, its end excluded. In ``text`` personal data is its kind in
    brackets and a term its replacement.

    A null text has no spans and stays null. Texts of any length are searched in
    time linear in them. Rows that repeat are found alike, and count as often as
    they stand in word counts, once as contexts. No rows, no rows.
    """
    name = free_name(docs, "privacy")
    terms = cut_lineage(disclosing(docs, text, support, share))
    few = terms.count() <= BROADCAST_TERMS
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(body).alias("text_id"), F.octet_length(body).alias("bytes"), F.explode_outer(F.array_distinct(terms_of(body))).alias("term"))
    hits = keyed.where("term IS NOT NULL").join(F.broadcast(terms) if few else terms, "term")
    hits = cut_lineage(hits.groupBy("text_id", "bytes").agg(F.map_from_entries(F.collect_set(F.struct("term", "replacement"))).alias("hits")))
    few = hits.count() <= BROADCAST_TERMS

    rows = docs.select(F.struct(*columns(docs)).alias("row"), body.alias("body"), F.xxhash64(body).alias("text_id"), F.octet_length(body).alias("bytes"))
    rows = rows.join(F.broadcast(hits) if few else hits, ["text_id", "bytes"], "left")
    rows = rows.select("row", "body", "hits", *(spans.alias(kind) for kind, spans in bases(F.col("body")).items()))
    rows = rows.withColumn("base", F.concat(*(F.col(k) for k in KINDS)))

    def free(s: Column) -> Column:
        return F.map_contains_key("hits", F.lower(s["value"])) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    rows = rows.withColumn("term", F.when(F.col("hits").isNotNull(), F.filter(found(F.col("body"), WORD, r"\p{L}"), free)).otherwise(F.array()).cast(SPANS))

    def put(kind: str) -> Column:
        new = (lambda s: F.col("hits")[F.lower(s["value"])]) if kind == "term" else (lambda s: F.lit(f"[{kind.upper()}]"))
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), new(s).alias("new")))

    def rewritten(spans: Column) -> Column:
        def pieces(ends: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.when(i > 0, ends[i - 1]).otherwise(0)
                kept = F.substr("body", before + 1, F.greatest(F.lit(0), s["start"] - before))
                return F.concat(kept, F.when(s["start"] >= before, s["new"]).otherwise(""))

            rest = F.substr("body", F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + 1, F.length("body"))
            return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), pieces)

    new_text = let(F.array_sort(F.concat(*map(put, (*KINDS, "term")))), rewritten)
    plain = [F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"])).alias(k) for k in (*KINDS, "term")]
    return rows.select("row.*", F.struct(F.when(F.col("row")[text].isNotNull(), new_text).alias("text"), *plain).alias(name))


def listed(*kinds: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""

    def one(kind: str) -> Column:
        return F.transform(F.col(f"privacy.{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def op12_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sanitise(docs).select(
        "doc_id",
        *(F.size(f"privacy.{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(*KINDS).cast("binary"), 256).alias("base_sha256"),
        listed(*KINDS, "term").alias("spans"),
    )


QUERIES = {"op12_privacy": op12_privacy}
