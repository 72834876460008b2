import random
import re
from html import escape, unescape

import pytest

from spindle.llm import webpages

WORDS = "alpha beta gamma delta omega river stone cloud quiet lamp & < café".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + f" {rng.randrange(10**6)}."


def text_of(html):
    return webpages.main_text(webpages.Page(html), None)


def test_elements_and_references():
    assert text_of("<article><h1>A&amp;B</h1><p>one <b>tw</b>o<br>three&nbsp;&copy 4<p>five<ul><li>x<li>y</ul></article>") == "A&B one two three © 4 five x y"
    assert text_of("<nav>menu</nav><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no --><article>yes</article><footer>end</footer>") == "yes"
    assert text_of('<article>kept<form><input value=">"><p>field</form><aside>side</aside><div class="promo-box">buy</div><p>more</article>') == "kept more"
    assert text_of("<article><p>body</p><section id=comments><article><p>me too</article></section><article>first!</article></article><article class='comment'>x</article>") == "body"
    assert text_of("<article><header><h1>Title</h1><p>by line</header><p>body</article>") == "Title body"
    assert text_of("<main class='has-sidebar'><p>in main</p><div class=sidebar>x</div></main><p>out") == "in main"
    assert text_of("<div><p>some unclosed <a href='x'>link") == "some unclosed link" and text_of("<p>a<p hidden>b<p style='display: none'>c") == "a"
    assert text_of("<div class='no-ad adjacent'>x</div><article>y") == "y"


@pytest.mark.parametrize("html", ["", " \n", "<", "<p", "<!--", "</p></div>", "<script>", "<article></article>", "<nav>only", "&#0;&#xD800;"[:4], "<a b='", "<p>" * 3000, "<div>" * 3000 + "deep" + "</div>" * 3000])
def test_broken_pages(html):
    assert text_of(html) == {"<": "<", "&#0;&#xD800;"[:4]: "�", "<div>" * 3000 + "deep" + "</div>" * 3000: "deep"}.get(html, "")


def test_simple_tree_matching():
    tree = lambda s: webpages.Page(s).tree
    a, b = tree("<body><div id=x><p>1<ul><li>2</ul></div><table><tr><td>3</table>"), tree("<body><div id=x><h2>0</h2><p>1</div><hr><table><tr><td>3</table>")
    assert webpages._weight(a, a, {}) == sum(1 for _ in a.walk())
    # all but the list and the heading: html, body, div, p, its text, table, tr, td, its text
    assert webpages._weight(a, b, {}) == webpages._weight(b, a, {}) == 9
    webpages.merge(a, b)
    assert "div#x(h2(#;)p(#;)ul(li(#;)))" in a.shape()


def sites():
    """(url, html, main text) of pages of hosts whose markup says little: what is constant and what varies tells it."""
    rng, out = random.Random(11), []

    def add(host, n, page, copies=0):
        made = [page(k) for k in range(n)]
        made += [made[0]] * copies
        out.extend((f"https://{host}/{k}?x=1", html, text) for k, (html, text) in enumerate(made))

    def boxes(k):
        parts = [prose(rng, rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{escape(p)}</p>" for p in parts)
        return f"<body><div><a href=/>Home</a> <a href=/x>News of all kinds and places</a></div><div><div>Welcome to this small site about lamps</div>{body}<div>Thank you for reading this page</div></div><div>All rights kept</div></body>", " ".join(parts)

    def cells(k):
        parts = [prose(rng, 25) for _ in range(3)]
        return f"<html><table><tr><td><ul><li><a href=/{k}>{prose(rng, 3)}</a><li><a href=/b>{prose(rng, 2)}</a></ul><td><h2>{escape(parts[0])}</h2>{escape(parts[1])}<br>{escape(parts[2])}</table>", " ".join(parts)

    def article(k):
        parts = [prose(rng, 12) for _ in range(4)]
        if k % 3 == 0:
            parts[2] = "the same line on many pages"
        return "<nav>" + prose(rng, 2) + "</nav><div class=ad>" + prose(rng, 9) + "</div><article><h1>" + "</h1><p>".join(map(escape, parts)) + "<div>Read on in our letters</div></article>", " ".join(parts)

    add("plain.example.com", 12, boxes)
    add("cells.example.com", 9, cells)
    add("article.example.com", 30, article, copies=20)
    html, text = article(1)
    out += [(f"http://copies.example.com/{k}", html.replace("<nav>", f"<nav>{k}"), text + " Read on in our letters") for k in range(9)]
    return out


def test_hosts(spark):
    rows = [(k, *r) for k, r in enumerate(sites())]
    odd = [(900, None, "<article>x<div>y</div></article>", "x y"), (901, "https://plain.example.com/e", None, ""), (902, "/relative", " ", ""), (None, "HTTPS://User@Plain.example.com:80", rows[0][2], rows[0][3]), (3, rows[3][1], rows[3][2], rows[3][3])]
    df = spark.createDataFrame([(i, u, h, "x", 1.0, 5) for i, u, h, _ in rows + odd], "page_id long, url string, html string, host string, template double, chars int").repartition(7)
    got = webpages.extract(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted((str(i), str(u), t, len(t)) for i, u, _, t in rows + odd)
    assert webpages.extract(df.limit(0)).count() == 0


def plainly(html):
    """Main text of the given tables' pages, all of which have one article of headings, paragraphs, line breaks and bold text."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))).split())


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plainly(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in webpages.extract(pages).collect()} == want


def test_very_long_page(spark):
    text = " ".join(f"word{k}" for k in range(300_000))
    html = "<body><article>" + "".join(f"<p>{p}" for p in re.findall(r"(?:\S+ ?){1,7}", text)) + "".join(f"<x{k} class=c{k}>" for k in range(500))
    r = webpages.extract(spark.createDataFrame([(1, "http://a.b/c", html)], "page_id long, url string, html string")).first()
    assert r.text == text and r.n_chars == len(text)
