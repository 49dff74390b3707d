"""Mixing documents to target weights along a tree of domain, language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nearfield.llm.frames import columns, free_name
from nearfield.session import cut_lineage

# The production mixture: domains by the number at a source's end, and relative weights; anything else weighs 1.
DOMAINS = (("web", 0, 0), ("forums", 1, 6), ("news", 7, 13), ("reference", 14, 19))
DOMAIN_WEIGHTS = {"web": 4, "forums": 2, "news": 2, "reference": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
SHARE = 0.75  # of all tokens
EPOCHS = 2
SEED = 17

BUCKETS = 3  # hex digits of a document's order key that name its bucket
SMALL_LEAVES = 100_000  # so many leaves (below 20 MB) travel to the documents; more are joined
LEAF = ["_domain", "_lang", "_source"]


def domain_of(source: str = "source") -> Column:
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1)
    number = F.when(number != "", number.cast("int"))
    out = F.lit("other")
    for name, low, high in reversed(DOMAINS):
        out = F.when(number.between(low, high), F.lit(name)).otherwise(out)
    return out


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast("double")


def _filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` with ``budget``: the share of ``given`` by ``weight``, at most ``cap``.

    What one child can't take goes to its siblings by their weights, again and
    again, which has a closed form: in order of cap per weight, the children up
    to some point are full and the rest share the remainder. A child of weight 0
    gets nothing.
    """
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = F.max("level").over(W.partitionBy(*parent))
    return (
        children.where("weight > 0")
        .withColumn("level", (F.col("given") - full.cast("double")) / rest)
        .withColumn("budget", F.least(F.col("cap").cast("double"), F.col("weight") * level))
        .drop("level", "given")
    )


def leaf_budgets(
    leaves: DataFrame, share: float, epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict
) -> DataFrame:
    """``leaves`` (the three names and ``tokens``) with ``budget`` tokens each.

    A node can take ``epochs`` times the tokens below it. The whole budget,
    ``share`` of all tokens, is dealt to domains by weight, theirs to languages,
    and theirs to sources. As a node never gets more than it can take, a
    shortage stays among siblings as long as they have room, and only what the
    whole branch can't take has gone to the branches beside it.
    """
    sized = leaves.withColumn("cap", F.col("tokens") * epochs)
    domains = sized.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("own")).withColumn("root", F.lit(0))
    whole = F.sum("own").over(W.partitionBy("root")).cast("double")
    domains = domains.withColumn("given", F.floor(whole * share)).withColumn("weight", _weight("_domain", domain_weights))
    domains = _filled(domains, ["root"], "_domain").select(F.col("_domain").alias("d"), F.col("budget").alias("given"))
    langs = sized.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("_lang", lang_weights))
    langs = langs.join(domains, F.col("_domain").eqNullSafe(F.col("d"))).drop("d")
    langs = _filled(langs, ["_domain"], "_lang").select(
        F.col("_domain").alias("d"), F.col("_lang").alias("l"), F.col("budget").alias("given")
    )
    sources = sized.withColumn("weight", _weight("_source", source_weights)).join(
        langs, F.col("_domain").eqNullSafe(F.col("d")) & F.col("_lang").eqNullSafe(F.col("l"))
    )
    return _filled(sources.drop("d", "l"), ["_domain", "_lang"], "_source").select(
        *LEAF, "tokens", F.floor("budget").cast("long").alias("budget")
    )


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))


def selection(
    docs: DataFrame,
    domain: Column | None = None,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain_weights: dict = DOMAIN_WEIGHTS,
    lang_weights: dict = LANG_WEIGHTS,
    source_weights: dict | None = None,
) -> DataFrame:
    """``docs`` with one more column ``mixed``: ``epoch``, ``domain``, ``lang``, ``source``, ``budget``.

    A row appears once for each epoch that takes it, and not at all if none
    does. In epoch e the documents of a leaf stand in the order of
    md5(seed:e:doc_id); a leaf takes whole epochs while its budget lasts and then
    the longest prefix of the next one whose tokens fit. Tokens are runs without
    ASCII white space; a null text has none. Rows without language or source
    have a leaf of their own; rows with the same ``doc_id``, or none, stand at
    one place of the order and go together. An empty table gives no rows.

    Only ids, names and token counts are shuffled, never texts: a leaf's tokens
    are first summed per bucket of order keys, before the shuffle, so a leaf with
    a third of all rows is a few thousand sums; only the one bucket in which its
    budget ends is ordered row by row. The result is a filter of ``docs`` by one
    key per leaf.
    """
    name = free_name(docs, "mixed")
    domain = domain_of() if domain is None else domain
    named = docs.select(
        F.col("doc_id").alias("_id"),
        domain.alias("_domain"),
        F.col("lang").cast("string").alias("_lang"),
        F.col("source").cast("string").alias("_source"),
        token_count().alias("_tokens"),
    )
    counted = cut_lineage(named)
    leaves = counted.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"))
    budgets = leaf_budgets(cut_lineage(leaves), share, epochs, domain_weights, lang_weights, source_weights or {})
    plan = cut_lineage(
        budgets.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
        .select(*[F.col(c).alias(c[1:]) for c in LEAF], "budget", "whole", "rest")
    )
    small = plan.count() <= SMALL_LEAVES
    hint = F.broadcast if small else (lambda df: df)

    def leaf(frame: DataFrame) -> Column:
        return (
            F.col("_domain").eqNullSafe(frame["domain"])
            & F.col("_lang").eqNullSafe(frame["lang"])
            & F.col("_source").eqNullSafe(frame["source"])
        )

    ending = plan.where("rest > 0")
    keyed = (
        counted.join(hint(ending), leaf(ending))
        .withColumn("key", _key(seed, F.col("whole") + 1))
        .select(*LEAF, "rest", "key", "_tokens", F.substring("key", 1, BUCKETS).alias("bucket"))
    )
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(W.partitionBy(*LEAF).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    edges = (
        sums.withColumn("upto", upto)
        .where("upto > rest AND upto - n <= rest")
        .select(*[F.col(c).alias(c[1:]) for c in LEAF], "bucket", (F.col("upto") - F.col("n")).alias("before"))
        .groupBy("domain", "lang", "source")
        .agg(F.min(F.struct("bucket", "before")).alias("edge"))
    )
    edges = cut_lineage(edges)
    inside = keyed.join(hint(edges), leaf(edges) & (F.col("bucket") == F.col("edge")["bucket"]))
    run = F.sum("_tokens").over(W.partitionBy(*LEAF).orderBy("key")) + F.col("edge")["before"]  # equal keys go together
    cuts = (
        inside.select(*LEAF, "key", "rest", run.alias("run"))
        .groupBy(*LEAF)
        .agg(F.max(F.when(F.col("run") <= F.col("rest"), F.col("key"))).alias("cut"))
        .select(F.col("_domain").alias("cd"), F.col("_lang").alias("cl"), F.col("_source").alias("cs"), "cut")
    )
    rule = (
        plan.join(edges.select(F.col("domain").alias("ed"), F.col("lang").alias("el"), F.col("source").alias("es"), "edge"),
                  F.expr("domain <=> ed AND lang <=> el AND source <=> es"), "left")
        .join(cuts, F.expr("domain <=> cd AND lang <=> cl AND source <=> cs"), "left")
        .select("domain", "lang", "source", "budget", "whole", "rest",
                F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("cut", F.col("edge")["bucket"], F.lit("~"))).alias("upto"))
        .where("whole > 0 OR rest > 0")
    )
    rule = cut_lineage(rule)
    taken = docs.select(
        F.struct(*columns(docs)).alias("row"),
        F.col("doc_id").alias("_id"),
        domain.alias("_domain"),
        F.col("lang").cast("string").alias("_lang"),
        F.col("source").cast("string").alias("_source"),
    ).join(hint(rule), leaf(rule))
    last = F.when(_key(seed, F.col("whole") + 1) <= F.col("upto"), F.col("whole") + 1).otherwise(F.col("whole"))
    return (
        taken.withColumn("_last", last)
        .where("_last > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_last"))))
        .select(
            "row.*",
            F.struct(F.col("_epoch").alias("epoch"), "domain", "lang", "source", "budget").alias(name),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once per epoch that takes them."""
    return selection(docs, **options).select(*columns(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return selection(docs).select("doc_id", "mixed.*", token_count().alias("n_tokens"))


def _case(column: str, weights: dict) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END AS DOUBLE)"


def _fill_sql(name: str, table: str, parent: str, key: str) -> str:
    return f"""
{name}_level AS (SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {key} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {key} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {table}),
{name} AS (SELECT *, least(cap, weight * max(level) OVER (PARTITION BY {parent})) AS budget FROM {name}_level)"""


_NUMBER = "CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS INTEGER)"
_DOMAIN = "CASE " + " ".join(f"WHEN {_NUMBER} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in DOMAINS) + " ELSE 'other' END"
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, {_DOMAIN} AS domain, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS DOUBLE) AS cap FROM d GROUP BY ALL),
whole AS (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {SHARE}) AS given FROM leaf),
dom0 AS (SELECT domain, sum(cap) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS weight, any_value(given) AS given, 0 AS root FROM leaf, whole GROUP BY domain),
{_fill_sql("dom", "dom0", "root", "domain")},
lang0 AS (
  SELECT l.domain, l.lang, l.cap, l.weight, dom.budget AS given
  FROM (SELECT domain, lang, sum(cap) AS cap, {_case("lang", LANG_WEIGHTS)} AS weight FROM leaf GROUP BY domain, lang) l
  JOIN dom ON dom.domain = l.domain),
{_fill_sql("lng", "lang0", "domain", "lang")},
src0 AS (
  SELECT leaf.*, 1.0::DOUBLE AS weight, lng.budget AS given FROM leaf JOIN lng ON lng.domain = leaf.domain AND lng.lang IS NOT DISTINCT FROM leaf.lang),
{_fill_sql("src", "src0", "domain, lang", "source")},
plan AS (
  SELECT domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(budget) AS BIGINT) AS budget FROM src),
rows AS (
  SELECT d.*, p.tokens, p.budget, e.epoch, md5('{SEED}:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM d JOIN plan p ON p.domain = d.domain AND p.lang IS NOT DISTINCT FROM d.lang AND p.source IS NOT DISTINCT FROM d.source,
       (SELECT unnest(range(1, {EPOCHS} + 1)) AS epoch) e),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY k) AS upto, budget - (epoch - 1) * tokens AS rest FROM rows)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, budget, n_tokens FROM run WHERE rest > 0 AND upto <= rest
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": OP4_SQL}
