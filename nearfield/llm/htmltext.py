"""Main text of web pages: templates shared by the pages of a host are deduced, and what fills their slots is extracted."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.frames import columns, free_name
from nearfield.session import cut_lineage

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# elements, and words in class, id and role, that never hold the article
ASIDE_TAGS = frozenset("head nav footer aside form script style noscript iframe template svg math button select textarea dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promotion"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin"
    " sidebar sidebars widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu"
    " menus pagination pager masthead topbar footer copyright disclaimer comment comments commentlist reply replies respond discussion disqus"
    " search searchform skip toolbar contentinfo complementary".split()
)
HEADER_WORDS = frozenset(["header", "banner"])
MAIN_WORDS = frozenset(["main", "article"])

LEAST_PAGES = 4  # pages of a host from which a template is deduced
LEAST_SHARE = 0.5  # of a host's pages on which a class of tokens stands
LEAST_TOKENS = 3  # of a class
BROADCAST_TOKENS = 500_000  # template tokens of all hosts (below 50 MB) that travel to the pages; more are joined

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = re.compile(r"[a-z]+")


def named(attrs: str) -> tuple[str, set[str], bool]:
    """Class and id as written, the words of class, id and role, and whether the element is hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    label = f"{found.get('class', '')}#{found.get('id', '')}"
    written = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = set(NAMED.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", written).lower()))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    return label, words, hidden


class Block:
    """A stretch of text between block borders, and where it stands."""

    __slots__ = ("text", "path", "place", "aside", "main", "linked")

    def __init__(self, text, path, place, aside, main, linked):
        self.text, self.path, self.place, self.aside, self.main, self.linked = text, path, place, aside, main, linked


def parse(html: str | None) -> tuple[list[Block], list[tuple[str, int]]]:
    """Text blocks of a page, in order, and its block-level tags as (path, position)."""
    blocks: list[Block] = []
    tags: list[tuple[str, int]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, aside, main
    pieces: list[str] = []
    linked = 0
    in_link = 0
    place = 0

    def flush():
        nonlocal linked, place
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            _, path, aside, main = stack[-1] if stack else ("", "", False, False)
            blocks.append(Block(text, path, place, aside, main, min(linked, len(text))))
            place += 1
        linked = 0

    def text(part: str):
        nonlocal linked
        pieces.append(part)
        if in_link:
            linked += len(part)

    at = 0
    html = html or ""
    while at < len(html):
        m = MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK:
                flush()
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
            continue
        if name == "br":
            text(" ")
        if name == "a":
            in_link += 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in BLOCK:
            continue
        flush()
        if stack and stack[-1][0] == CLOSED_BY_BLOCK:
            stack.pop()
        while stack and stack[-1][0] in SIBLINGS.get(name, ()):
            stack.pop()
        _, path, aside, main = stack[-1] if stack else ("", "", False, False)
        label, words, hidden = named(m["attrs"])
        path = f"{path}/{name}.{label}" if len(stack) < 40 else path
        tags.append((path, place))
        place += 1
        if name not in ("html", "body"):
            heading = name == "header" or bool(words & HEADER_WORDS)
            aside = aside or hidden or name in ASIDE_TAGS or (heading and not main) or bool(words & (ASIDE_WORDS - HEADER_WORDS))
        main = main or (name in ("article", "main") or bool(words & MAIN_WORDS) and name in ("div", "section", "td")) and not aside
        if name in VOID:
            continue
        stack.append((name, path, aside, main))
    flush()
    return blocks, tags


def _code(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "surrogatepass")) >> 1


def tokens_of(blocks: list[Block], tags: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """(token, position) of all tags, told apart by their path, and of all blocks, told apart by path and text."""
    out = [(_code("tag", path), place) for path, place in tags]
    return sorted(out + [(_code("text", b.path, b.text), b.place) for b in blocks], key=lambda t: t[1])


def host_of(url: str = "url"):
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``(host, token, class_id, rank)``: the tokens of the equivalence classes of every host.

    A token's occurrence vector says how often it stands on each page of the
    host. It is carried as a sum of hashes of (page, times), which tasks add up
    before the shuffle, so a host of any size is one row per token. Tokens of a
    host with equal vectors are a class; kept are classes of LEAST_TOKENS or
    more, with a tag among them, on LEAST_SHARE of the host's pages or more, of hosts with LEAST_PAGES or
    more. ``rank`` orders a class by where its tokens first stand on average.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, raw in zip(batch["host"], batch["page"], batch["html"]):
                blocks, tags = parse(raw)
                tokens = tokens_of(blocks, tags)
                times = Counter(t for t, _ in tokens)
                first: dict[int, int] = {}
                for t, p in tokens:
                    first.setdefault(t, p)
                tag = {_code("tag", path) for path, _ in tags}
                for t, n in times.items():
                    vector = xxhash.xxh64_intdigest(f"{page}:{n}".encode()) >> 28
                    rows.append((host, t, t in tag, vector, first[t]))
                rows.append((host, -1, False, 0, 0))  # counts the pages
            yield pd.DataFrame(rows, columns=["host", "token", "tag", "vector", "place"])

    counted = (
        pages.select(host_of(url).alias("host"), F.xxhash64(*columns(pages)).alias("page"), F.col(html).cast("string").alias("html"))
        .where("host != ''")
        .mapInPandas(count, "host string, token long, tag boolean, vector long, place int")
        .groupBy("host", "token")
        .agg(
            F.max("tag").alias("tag"),
            F.sum("vector").alias("vector"),
            F.count("*").alias("n"),
            F.avg("place").alias("place"),
        )
    )
    counted = cut_lineage(counted.where(f"token = -1 OR (n >= {LEAST_PAGES // 2})"))
    hosts = counted.where(f"token = -1 AND n >= {LEAST_PAGES}").select("host", F.col("n").alias("pages"))
    often = counted.where("token != -1").join(hosts, "host").where(F.col("n") >= F.col("pages") * LEAST_SHARE)
    large = (
        often.groupBy("host", "n", "vector")
        .agg(F.count("*").alias("size"), F.max("tag").alias("tag"))
        .where(f"tag AND size >= {LEAST_TOKENS}")
        .select("host", "n", "vector")
    )
    return often.join(large, ["host", "n", "vector"]).select(
        "host", "token", F.xxhash64("n", "vector").alias("class_id"), (F.col("pages") - F.col("n")).alias("missing"), "place"
    )


def nested(tokens: list[tuple[int, int]], known: dict[int, tuple[int, int, float]]) -> set[int]:
    """Positions of the template tokens of a page: classes that stand in order and nest in one slot of those before.

    Classes are taken from the most to the least common. One whose tokens don't
    all stand on the page, and equally often, or stand in another order than on
    average in one of their repetitions, or reach over a token of a class that
    encloses them, is left out.
    """
    members: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    sizes: Counter = Counter((missing, c) for c, missing, _ in known.values())
    for token, place in tokens:
        if token in known:
            c, missing, _ = known[token]
            members[(missing, c)][token].append(place)
    taken: list[list[list[int]]] = []
    for name in sorted(members):
        found = sorted((known[token][2], places) for token, places in members[name].items())
        if len(found) != sizes[name] or len({len(places) for _, places in found}) != 1:
            continue
        repeated = [list(places) for places in zip(*(places for _, places in found))]
        flat = [p for places in repeated for p in places]
        if flat != sorted(flat):
            continue
        if all(_in_gaps(repeated, outer) or _in_gaps(outer, repeated) for outer in taken):
            taken.append(repeated)
    return {p for repeated in taken for places in repeated for p in places}


def _in_gaps(repeated: list[list[int]], outer: list[list[int]]) -> bool:
    """Whether each of the ``repeated`` places lies in one gap of ``outer``, its two ends included."""
    border = [p for places in outer for p in places]
    return all(bisect_left(border, places[0]) == bisect_left(border, places[-1]) for places in repeated)


def main_text(html: str | None, known: dict[int, tuple[int, int, float]]) -> tuple[str, int]:
    """The article of a page and how many of its tokens belong to the host's template.

    What the host's template leaves are the page's slots, divided by the text
    that the host repeats; if it leaves nothing, the page is taken as if it had no
    template. If ``article`` and ``main`` elements hold at least half of the text
    in slots, the article is all that is left in them; else it is all that is left
    on the page, but for slots that are mostly links. Nothing is left out for
    being short. Blocks in menus, headers, footers, sidebars, notices, adverts,
    forms and comments are never part of it.
    """
    blocks, tags = parse(html)
    tokens = tokens_of(blocks, tags)
    template = nested(tokens, known) if known else set()
    open_blocks = [b for b in blocks if not b.aside]
    left = [b for b in open_blocks if b.place not in template] or open_blocks
    border = [b.place for b in blocks if b.place in template]
    slots: dict[int, list[Block]] = defaultdict(list)
    for b in left:
        slots[bisect_left(border, b.place)].append(b)
    marked = sum(len(b.text) for b in left if b.main)
    if 2 * marked >= sum(len(b.text) for b in left):
        own = [b for b in left if b.main]
    else:
        own = [b for v in slots.values() if sum(len(b.text) - 2 * b.linked for b in v) > 0 for b in v]
    return "\n".join(b.text for b in own), len(template)


def extract(pages: DataFrame, html: str = "html", url: str = "url", name: str = "main") -> DataFrame:
    """``pages`` with one more column ``name``: ``text`` and ``template_tokens``.

    Templates are deduced per host (see ``templates``); a page without a host, or
    of a host with few pages, has none and goes by its markup alone. Character
    references are decoded, white space inside a block becomes one blank, blocks
    are joined by \\n. A null page is an empty text. Repeated rows stay.
    """
    found = cut_lineage(templates(pages, html, url))
    few = found.count() <= BROADCAST_TOKENS
    own_host = free_name(pages, "_host")
    known = found.groupBy(F.col("host").alias(own_host)).agg(
        F.to_json(F.collect_list(F.array(*[F.col(c).cast("string") for c in ("token", "class_id", "missing", "place")]))).alias("_known")
    )

    @F.pandas_udf("text string, template_tokens int")
    def look(raws: pd.Series, hosts: pd.Series, listed: pd.Series) -> pd.DataFrame:
        seen: dict[str, dict] = {}  # a host's template is the same in all its rows
        rows = []
        for raw, host, packed in zip(raws, hosts, listed):
            if host not in seen:
                seen[host] = {int(t): (int(c), int(m), float(p)) for t, c, m, p in json.loads(packed)} if packed else {}
            rows.append(main_text(raw, seen[host]))
        return pd.DataFrame(rows, columns=["text", "template_tokens"])

    joined = pages.withColumn(own_host, host_of(url)).join(F.broadcast(known) if few else known, own_host, "left")
    return joined.withColumn(name, look(F.col(html).cast("string"), own_host, "_known")).select(*columns(pages), name)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select(
        "page_id", "url", "main.text", F.length("main.text").cast("long").alias("n_chars"), "main.template_tokens"
    )


QUERIES = {"op2_html_text": op2_html_text}
