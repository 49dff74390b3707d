"""Main text of pages, and templates from tokens that occur together."""

import random

import pandas as pd

from nearfield.llm import htmltext as op

SF = "/root/testdata/sf0.001"


def text_of(html, known=None):
    return op.main_text(html, known or {})[0]


def test_blocks_references_and_markup():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header>site</header><nav><ul><li><a href="/">menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <article><header><h1>Title &amp; more</h1></header><p>First   &lt;one&gt;&nbsp;\n here<p>Second <b>bold<br>line</b> é&#233;&#xe9;
    <form>no<input></form><ul><li>item 1<li>item <a href=x>2</a></ul><table><tr><td>a<td>b</table>
    <section class="comments"><article>no comment</article></section><div style="display:none">no</div></article>
    <aside>no</aside><footer>&copy; no</footer></body></html>"""
    assert text_of(page) == "Title & more\nFirst <one> here\nSecond bold line ééé\nitem 1\nitem 2\na\nb"


def test_odd_pages():
    assert text_of("<") == "<"
    for empty in (None, "", "   ", "<!-- never closed", "<script>x", "<nav>only menu</nav>", "<p></p>"):
        assert text_of(empty) == ""
    assert text_of("plain text,  no tags & all") == "plain text, no tags & all"
    assert text_of("a < b and 3 > 2") == "a < b and 3 > 2"
    assert text_of("<article>one</p></div>two<p>three</article>") == "one\ntwo\nthree"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text_of("<p " + "x" * 100_000 + ">long tag") == "long tag"
    assert text_of("<p title='>'>quoted</p>") == "quoted"
    assert text_of('<p a="never closed>odd</p> <p>end</p>').endswith("end")
    long = " ".join(f"w{i}" for i in range(200_000))
    assert text_of(f"<article><p>{long}</p></article>") == long


def soup(rng, i, article, extra=""):
    """A page without any telling name: the site's parts repeat, the article does not."""
    return (
        f"<html><body><div class='q1'><div>Acme daily</div><div>The paper of the town of Acme, founded in 1870 by the brothers</div></div>"
        f"<div class='q2'>{article}</div><div class='q3'><div>Read our terms and the rules of this house before you write to us</div>"
        f"<div>All rights reserved to the brothers and their heirs, who live here</div></div>{extra}</body></html>"
    )


def pages(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(12):
        paragraphs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 5))]
        rows.append((i, f"https://acme.example.com/{i}", soup(rng, i, "".join(f"<p>{p}</p>" for p in paragraphs)), "m", 1))
        want[i] = "\n".join(paragraphs)
    rows += [(50, None, "<article>no host</article>", None, None), (51, "", None, "", 0), (52, "https://acme.example.com/x", "", "", 0), rows[3]]
    rows += [(None, "http://other.example.com", "<main><p>other</p></main>", "", 0)]
    want |= {50: "no host", 51: "", 52: "", None: "other"}
    return rows, want, spark.createDataFrame(rows, "page_id long, url string, html string, main string, host int")


def test_template_leaves_the_slots(spark, monkeypatch):
    rows, want, frame = pages(spark)
    classes = op.templates(frame).collect()
    assert {r["host"] for r in classes} == {"acme.example.com"}
    known = {r["token"]: (r["class_id"], r["missing"], r["place"]) for r in classes}
    blocks, tags = op.parse(rows[0][2])
    template = op.nested(op.tokens_of(blocks, tags), known)
    assert [b.text for b in blocks if b.place not in template] == want[0].split("\n")
    for limit in (500_000, 0):
        monkeypatch.setattr(op, "BROADCAST_TOKENS", limit)
        got = op.extract(frame, name="found").collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["found"]["text"] == want[r["page_id"]], r["page_id"]
    assert op.extract(frame.limit(0)).count() == 0
    assert op.extract(frame.drop("main")).columns == ["page_id", "url", "html", "host", "main"]


def test_classes_out_of_order_or_crossing_are_left_out():
    tokens = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    root = {1: (9, 0, 0.0), 4: (9, 0, 3.0), 6: (9, 0, 5.0)}
    assert op.nested(tokens, root) == {0, 3, 5}
    assert op.nested(tokens, root | {2: (8, 1, 1.0), 3: (8, 1, 2.0)}) == {0, 1, 2, 3, 5}
    assert op.nested(tokens, root | {2: (8, 1, 2.0), 3: (8, 1, 1.0)}) == {0, 3, 5}
    assert op.nested(tokens, {1: (9, 0, 0.0), 7: (9, 0, 1.0)}) == set()
    crossing = {2: (8, 0, 1.0), 4: (8, 0, 3.0), 3: (7, 1, 2.0), 5: (7, 1, 4.0)}
    assert op.nested(tokens, crossing) == {1, 3}


def test_registered_query_keeps_articles_whole(spark):
    got = op.op2_html_text(spark, SF).toPandas().set_index("page_id")
    stored = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    assert len(got) == len(stored) and (got.n_chars == got.text.str.len()).all()
    import html
    import re

    for i, page in stored.html.items():
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inside)]
        assert got.text[i] == "\n".join(x for x in plain if x)


def known_of(spark, rows):
    found = op.templates(spark.createDataFrame([(f"https://h.example.com/{i}", r) for i, r in enumerate(rows)], "url string, html string")).collect()
    return {r["token"]: (r["class_id"], r["missing"], r["place"]) for r in found}


def test_template_counts_inside_articles_and_teasers_do_not_hide_the_body(spark):
    ends = "<p class='x1'>All of us thank all our readers</p><p class='x2'>Write to the house of Acme</p>"
    rows = [f"<body><article><h1>Title {i}</h1><p>body {i} {'w' * 50}</p>{ends}</article></body>" for i in range(8)]
    known = known_of(spark, rows)
    assert [text_of(r, known) for r in rows] == [f"Title {i}\nbody {i} {'w' * 50}" for i in range(8)]
    long = "real words of the body " * 30
    assert text_of(f"<article>teaser</article><main>small</main><div>{long}</div>") == f"teaser\nsmall\n{long.strip()}"


def test_short_blocks_in_scopes_of_their_own_stay(spark):
    long = "words of a long paragraph " * 20
    parts = "<div>Heading {0}</div><div><p>{1}{0}</p></div><div>short {0}</div><ul><li>item {0}</ul><table><tr><td>cell {0}</table><blockquote>said {0}</blockquote>"
    rows = [soup(None, i, parts.format(i, long)) for i in range(8)]
    known = known_of(spark, rows)
    for i, r in enumerate(rows):
        want = f"Heading {i}\n{long}{i}\nshort {i}\nitem {i}\ncell {i}\nsaid {i}"
        assert text_of(r, known) == want
        assert text_of(f"<body>{parts.format(i, long)}</body>") == want


def test_rich_templates_give_the_same_text(spark):
    def page(i, n):
        menu = "".join(f"<p class='m{j}'>menu entry {j}</p>" for j in range(n))
        links = "".join(f"<a href=x>headline {i} {j} of today</a> " for j in range(4))
        return f"<body>{menu}<p class='a'>short news {i}</p><p class='b'>Latest</p><p class='c'>{links}</p><p class='d'>The end</p></body>"

    for n in (10, 300):
        rows = [page(i, n) for i in range(6)]
        known = known_of(spark, rows)
        assert [text_of(r, known) for r in rows] == [f"short news {i}" for i in range(6)], n


def test_text_repeated_on_each_page_is_template(spark):
    share = "<div class='s'>Share this with your friends<p class='r'>Read more</p></div>"
    rows = [f"<body><h1>Title {i}</h1>{share}<p>first {i}</p>{share}<p>second {i}</p>{'<p>third</p>' * (i % 2)}</body>" for i in range(8)]
    known = known_of(spark, rows)
    assert [text_of(r, known) for r in rows] == [f"Title {i}\nfirst {i}\nsecond {i}" + "\nthird" * (i % 2) for i in range(8)]
    twice = {1: (9, 0, 0.0), 2: (9, 0, 1.0)}
    assert op.nested([(1, 0), (2, 1), (5, 2), (1, 3), (2, 4)], twice) == {0, 1, 3, 4}
    assert op.nested([(1, 0), (2, 1), (2, 2), (1, 3)], twice) == set()
    assert op.nested([(1, 0), (2, 1), (1, 2)], twice) == set()
