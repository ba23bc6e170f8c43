import re

import pytest

from trackloom.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad-slot">Buy</div>
<div class="box"><p>We are the example site.</p></div>
<article class="post"><header><h1>Title {n} &amp;&lt;</h1></header><p><b>First   para<br>graph<br><p>Second &eacute; 1 < 2</p>
<ul class="links"><li><a href="/1">one</a><li><a href="/2">two</a></ul><ol><li>step {n}<li>step b</ol>
<div class="comments"><p>nice!</p></div><form><p>email</p></form></article>
<aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_page():
    page = ht.Page(PAGE.format(n=1))
    assert page.main_text().split("\n") == ["Title 1 &<", "First para graph", "Second é 1 < 2", "one", "two", "step 1", "step b"]


@pytest.mark.parametrize("html,text", [("", ""), ("plain text", "plain text"), ("<p>a<p>b <i>c</i>d", "a\nb cd"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("a < b <c", "a < b <c"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<main><p>x</p></main><p>y</p>", "x"), ("<p>x&nbsp; y\n z</p>", "x y z"), ("<script>a", ""), ("<p title='>'>q</p>", "q"), ("<div hidden>h</div><p>v", "v"), ("</p></div>x", "x"), ("<article><p>in</article>out", "in"), ("<p><b>bold<br><p>next", "bold\nnext")])
def test_small_pages(html, text):
    assert ht.Page(html).main_text() == text


NAMED = [
    ('<div class="layout no-sidebar"><article><p>x</p></article></div>', "x"),
    ('<div id="page" class="site has-sidebar"><p>y</p><article>x</article><div class="comments"><article>c</article></div></div>', "x"),
    ('<div class="sidebar"><div class="widget"><main>x</main></div></div>', "x"),
    ('<article class="post category-social">x</article>', "x"),
    ('<article class="post related">x</article><article class="comment">c</article>', "x"),
    ('<article><p>x<section class="discussion"><h2>Discussion</h2><p>y</section></article>', "x\nDiscussion\ny"),
    ('<form id="f" class="search"><div>a</div><article>x y<p>z</article></form>', "x y\nz"),
    ('<div>a long story</div><div class="sidebar"><article>x</article></div>', "a long story"),
    ('<p>x</p><div class="comment-list">c</div><div class="site-footer">f</div><div class="ad-slot-2">a</div><div class="cookie-banner">b</div><nav><article>n</article></nav>', "x"),
    ("<article>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b<noscript><p>n</p></noscript><object><param>o</object><textarea>1 &lt; <b></textarea></article>", "a x=1 b\nn\no1 < <b>"),
]


@pytest.mark.parametrize("html,text", NAMED)
def test_names(html, text):
    assert ht.Page(html).main_text() == text


@pytest.mark.parametrize("broadcast", [ht.BROADCAST, 1])
def test_templates_of_a_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ht, "BROADCAST", broadcast)
    rows = [(i, f"http://h.com/{i}", PAGE.format(n=i)) for i in range(12)]
    rows += [(100 + i, "http://copies.com/", "<div><p>Same box</p></div><article><p>same article</p></article>") for i in range(12)]
    body = "<div><p>About us</p></div><section><p>story {n}</p></section>"
    rows += [(200 + i, f"https://U@plain.org:80/{i}", body.format(n=i)) for i in range(11)] + [(300, "http://few.org/", body.format(n=1)), (301, None, None), (302, "x", ""), (None, "http://few.org/", "<p>x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in ht.extracted(df).collect()}
    assert len(got) == len(rows)
    assert got[3].text.split("\n") == ["Title 3 &<", "First para graph", "Second é 1 < 2", "step 3", "step b"]
    assert got[105].text == "same article" and got[204].text == "story 4" and got[300].text == "About us\nstory 1"
    assert (got[301].text, got[301].n_chars, got[302].text, got[None].text) == ("", 0, "", "x")
    assert got[3].n_chars == len(got[3].text)
    assert ht.extracted(df.where("false")).collect() == []


@pytest.mark.parametrize("page", ['<main><p>story</p><div class="comments"><p>c{i}</p></div></main>', '<div><p>story</p></div><div class="comments"><p>c{i}</p></div><footer>f{i}</footer>', "<main><h1>story</h1><div>{i}</div></main>", "<body><blockquote>story</blockquote><ul><li>{i}</ul>"])
def test_copies_are_no_template(spark, page):
    df = spark.createDataFrame([(i, "http://copies.com/", page.format(i=i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.text.split("\n")[0] for r in ht.extracted(df).collect()} == {"story"}


def test_given_pages(spark, sf):
    """The generator's articles: what a plain pattern finds between the article tags."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import html

    for r in ht.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<(?!p\b|/p\b|h1|/h1)[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert re.sub(r"\s", "", r.text) == re.sub(r"\s", "", "".join(re.sub(r"<[^>]*>", "", w) for w in want))


def test_names_in_an_article():
    for html, want in [
        ('<article><h2 id="search">Search trees</h2><p>a b</p></article>', "Search trees\na b"),
        ('<article><section id="discussion"><p>kept</p></section></article>', "kept"),
        ('<article><p class="notice">kept</p></article>', "kept"),
        ('<article><figure class="social"><figcaption>cap</figcaption></figure></article>', "cap"),
        ('<article class="search"><p>art</p></article><footer>foot</footer>', "art"),
        ('<div class="post-with-sidebar"><p>hello main</p></div>', "hello main"),
        ("<article>let <math><mi>x</mi></math> be</article>", "let x be"),
        ('<article><p>t</p><p class="advert">Buy</p><div class="share">Share</div><div class="comments"><p>c</p></div></article>', "t"),
    ]:
        assert ht.Page(html).main_text() == want, html


@pytest.mark.parametrize("html,text", [
    ('<article><div class="promotion"><p>The promotion of chess players</p></div><p>x</p></article>', "The promotion of chess players\nx"),
    ('<article><section id="search"><p>binary search text</p></section></article>', "binary search text"),
    ('<article><div id="widget"><p>How widgets work</p></div></article>', "How widgets work"),
    ('<article><div class="banner"><p>Banners of war</p></div></article>', "Banners of war"),
    ('<article><div class="share"><p>share of votes</p></div></article>', "share of votes"),
    ('<main><div class="social"><p>Only text</p></div></main>', "Only text"),
    ('<article><p>t</p><div class="share">Share</div><div class="related"><p><a href="/1">One more story</a></p></div><div class="newsletter"><p>Get it</p><input name="m"></div></article>', "t"),
    ('<main><p>t</p><div class="comments"><p>c</p></div></main>', "t"),
])
def test_a_word_alone_drops_nothing_of_an_article(html, text):
    assert ht.Page(html).main_text() == text


@pytest.mark.parametrize("html", ["<div>" * 40_000 + "</span>" * 40_000, '<a "' * 250_000, "<![CDATA[" * 100_000, "<article>" + "<div>x" * 40_000, "<script" * 100_000, "<a '\">" * 100_000, "<select>" * 100_000 + ">", "<b>" * 60_000 + "</i>" * 60_000, "<ul><li>" * 20_000, "<" * 500_000])
def test_long_odd_pages_take_linear_time(html):
    import time

    began = time.process_time()
    ht.Page(html).main_text()
    assert time.process_time() - began < 20


def test_templates_equal_a_count_of_trees(spark):
    """Boxes outside the article, counted by an XML parser: those that a fifth of a host's pages hold, and three, go."""
    import random
    import xml.etree.ElementTree as ET
    from collections import defaultdict

    r = random.Random(8)
    box = lambda host, k: f'<section class="k{k % 2}"><span>{host} box {k}</span><div>inner {k % 3}</div></section>'
    rows = []
    for host, n in (("a.com", 40), ("b.com", 9), ("c.com", 2)):
        for i in range(n):
            boxes = [box(host, k) for k in range(12) if r.random() < (0.9, 0.5, 0.3, 0.15, 0.1, 0.05)[k % 6]]
            rows.append((len(rows), f"http://{host}/{i}", f"<body><p>page {len(rows)}</p>{''.join(boxes)}</body>"))
    pages, total = defaultdict(set), defaultdict(int)
    for i, url, html in rows:
        host = url.split("/")[2]
        total[host] += 1
        for e in ET.fromstring(html).iter():
            if e.tag in ("section", "div"):
                pages[host, ET.tostring(e)].add(i)
    gone = {k for k, v in pages.items() if len(v) >= 3 and len(v) >= 0.2 * total[k[0]]}
    want = {}
    for i, url, html in rows:
        out = []
        for e in ET.fromstring(html):
            if (url.split("/")[2], ET.tostring(e)) not in gone:
                out += [e.text] if e.tag == "p" else [e[0].text] + ([e[1].text] if (url.split("/")[2], ET.tostring(e[1])) not in gone else [])
        want[i] = "\n".join(out)
    got = {x.page_id: x.text for x in ht.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and any(len(want[i].split("\n")) > 2 for i in want) and len(gone) > 5
