"""Elements of pages against a parser, item blocks and records on literals, references by the RFC's own examples."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillspark.operators import markup as M
from quillspark.plans import ingest


class Tree(HTMLParser):
    """Elements of wanted tags with their text: an end tag closes the last open one of its name and what is open within."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.found, self.place = wanted, [], [], -1

    def handle_starttag(self, tag, attrs):
        self.place += 1
        node = [tag, dict(attrs).get("class") or "", self.place, []]
        self.found.append(node)
        if tag not in M.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.place += 1
        self.found.append([tag, dict(attrs).get("class") or "", self.place, []])

    def handle_endtag(self, tag):
        at = [i for i, n in enumerate(self.open) if n[0] == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if self.open and self.open[-1][0] in M.RAW:
            return
        for n in self.open:
            n[3].append(data)


def parsed(page, tag, cls=None):
    tree = Tree(tag)
    tree.feed(page)
    tree.close()
    return [(n[2], "".join(n[3])) for n in tree.found if re.fullmatch(tag, n[0]) and (cls is None or re.search(cls, n[1]))]


def random_page(rng):
    out, open_ = [], []
    for _ in range(rng.randint(0, 40)):
        k = rng.random()
        if k < 0.4:
            tag = rng.choice(["div", "div", "p", "span", "article", "br", "img"])
            out.append(f"<{tag} class={rng.choice(['x', '"content main"', "'y body'"])}>")
            if tag not in M.VOID:
                open_.append(tag)
        elif k < 0.65 and open_:
            out.append(f"</{rng.choice([open_.pop(), 'div', 'p'])}>")
        elif k < 0.7:
            out.append(rng.choice(["<!-- <div class=content> -->", "<script>if (a<b) '</div>'</script>", "<style>p{}</style>", "</nothing>", "<br/>", "<hr />"]))
        else:
            out.append(rng.choice(["word ", "a &amp; b", " \n", "x < y "]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_elements_against_a_parser(seed):
    page = random_page(random.Random(seed))
    for tag, cls in (("div", None), ("div", "content|body"), ("p|span", None), ("br", None)):
        got = [(r[1], r[3]) for r in M.scan(page, {"k": (re.compile(tag), re.compile(cls) if cls else None)})]
        assert got == parsed(page, tag, cls)


PAGE = """<html><body><div class="lx-latest-news-item big"><h2>Asker <b>One</b></h2><h2>No. 7</h2>
<div class="post-text">What &amp; why? <div>deep <div>deeper</div></div></div><div class="post-text">Because.</div><blockquote>A source</blockquote><a class="shareable-link" href="/q/7?x=1">link</a></div>
<div class="lx-latest-news-item"><h2>No. 8</h2><div class="post-text">Only a question</div><div class="other-post-text-x">no</div></div>
<div class="lx-latest-news-item"><h2>No. 9</h2></div>
<div class="lx-latest-news-item"><div class="post-text">without heading</div></div>
<div class="lx-latest-news-item"><h2>10</h2><div class="post-text">q</div><div class="post-text">the A source is in it</div><blockquote>A source</blockquote></div>"""


def test_item_blocks(spark):
    d = spark.createDataFrame([(1, "http://h/a/b", PAGE), (2, "http://h/", None), (3, None, "<p>none</p>")], "page_id long, url string, html string")
    got = [tuple(r)[2:] for r in ingest.news_items(d).orderBy("page_id", "item").collect()]
    assert got == [
        ("Asker One", "No. 7", "What & why? deep deeper", "Because." + ingest.SOURCES_HEAD + "A source", "http://h/q/7?x=1"),
        ("", "No. 8", "Only a question", "", "http://h/a/b"),
        ("", "10", "q", "the A source is in it", "http://h/a/b"),
    ]


def test_page_records(spark):
    pages = [
        "<h3>third</h3><h2>second</h2><h1> the\n first </h1><div class='Main-Content'>outer <div>inner</div> end</div><div class=content>later</div><time> 2024-01-02 </time>",
        "<h2>title</h2><div class=answer-box>প্রশ্ন: কেন?\nউত্তরঃ কারণ।</div><span class='post-date'>May 1</span>",
        "<article>only an article</article>",
        "<p>nothing</p>",
        "<h1>প্রশ্ন (১২) : শিরোনাম</h1><div class=body></div>",
        None,
    ]
    d = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: tuple(r)[1:] for r in ingest.page_records(d).collect()}
    assert got == {
        0: ("the first", "the first", "outer inner end", "2024-01-02"),
        1: ("title", "কেন?", "কারণ।", "May 1"),
        2: ("", "", "only an article", None),
        4: ("প্রশ্ন (১২) : শিরোনাম", "শিরোনাম", "", None),
    }


# RFC 3986, sections 5.4.1 and 5.4.2.
BASE = "http://a/b/c/d;p?q"
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references(spark):
    rows = [(BASE, r, want) for r, want in EXAMPLES.items()] + [("http://h", "x/y", "http://h/x/y"), ("http://h", "?q", "http://h?q"), ("https://h/a?b#c", "//k/l", "https://k/l"), ("http://h/a", "mailto:x@y", "mailto:x@y")]
    d = spark.createDataFrame(rows, "base string, ref string, want string")
    bad = d.withColumn("got", M.resolve(F.col("base"), F.col("ref"))).where("NOT got <=> want").collect()
    assert bad == []


def test_links_in_order_of_first_place(spark):
    pages = [(2, "http://h/d/e", "<a href='../x'>1</a><a href=\"/y?a=1&amp;b=2#top\">2</a><a>3</a><a href=''>4</a><a href=' z '>5</a>"), (1, "http://h/", "<base href='http://k/m/'><a href=n>1</a><a href='http://h/x'>2</a>"), (3, "http://h/", None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.link: (r.first_page, r.first_place) for r in M.links(d).collect()}
    assert got == {"http://h/x": (1, 2), "http://h/y?a=1&b=2": (2, 1), "http://h/d/z": (2, 4), "http://k/m/n": (1, 1)}


def test_snippets_keep_marks_with_their_letters(spark):
    from quillspark.operators import expansion as E

    text = "aaaa কি খী নামাজের সময় éé <b> নামাজ"
    rows = [(text, ["নামাজের"], 3, 6), (text, ["নামাজের"], 1, 12), (text, ["é"[:1] + "x"], 80, 5), ("é̂a", ["a"], 1, 1), ("é̂a", ["a"], 2, 4), ("́a b", ["b"], 3, 9), ("Über über ÜBERMUT", ["über"], 80, 50), ("", ["x"], 80, 5)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, terms array<string>, before int, most int")
    for before, most in {r[2:] for r in rows}:
        placed = d.where((F.col("before") == before) & (F.col("most") == most)).withColumn("at", E.snippet_start(F.col("text"), F.col("terms"), before))
        plain, marked = E.snippet(F.col("text"), F.col("terms"), F.col("at"), most)
        for r in placed.select("i", "text", "at", plain.alias("plain"), marked.alias("marked")).collect():
            whole = r.text
            assert not re.match(r"[̀-ͯঀ-ঃ়া-্]", whole[r.at - 1 : r.at]) or r.at == 1
            end = r.at - 1 + len(r.plain.replace("&lt;", "<").replace("&gt;", ">"))
            assert not re.match(r"[̀-ͯঀ-ঃ়া-্]", whole[end : end + 1])
            assert end - r.at + 1 >= min(most, len(whole) - r.at + 1)
            if r.i in (0, 1):
                assert ("<mark>নামাজের</mark>" in r.marked) == (r.i == 1)
            if r.i == 6:
                assert r.marked == "<mark>Über</mark> <mark>über</mark> ÜBERMUT"


def test_references_without_an_end_are_text(spark, tmp_path):
    import duckdb
    from duck import rows

    from quillspark.plans.catalog import QUERIES, SQL

    pages = [(1, "http://h/", "<h1>a &amp;&amp</h1><article>b &copy; &amp;lt; &am</article>"), (2, "http://h/", "<h1>c &quo</h1><article>d &amp</article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows(QUERIES["extract_pages"](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL["extract_pages"]).df())
    assert M.unescape("&#65;&#x42;&nosuch;&Eacute;&copy=2&amp;lt;") == "AB&nosuch;É&copy=2&lt;"
