from __future__ import annotations

from collections import Counter

import pytest

from paperloom.llm.html import align, blocks_of, extract_text, parse, summarise

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
<body><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div><!-- ad --><div class="ad">Buy</div>
<article><h1>{title}</h1><p><b>First &lt;b&gt; {n}<br><p>Second&nbsp;&eacute; &amp
 x</p><aside>Side</aside><ul><li>One<li>Two</ul><form><input value=q>Search</form><div class="ad-box">Ad</div>
<section id="comments"><p>Reader says</p></section></article>
<aside class="sidebar">Related</aside><footer>&copy; host</footer>"""


def text_of(html):
    return "\n".join(blocks_of(parse(html), frozenset()))


def test_article_without_furniture():
    got = text_of(PAGE.format(title="A  \n title", n=7))
    assert got == "A title\nFirst <b> 7\nSecond é & x\nOne\nTwo"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article></article>", ""),
    ("<article>x &am</article>", "x &am"), ("<main><p>a</p></main><p>b</p>", "a"), ("<p>a <i>b</i>c</p>", "a bc"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<article><p>1</p></article><article><p>2</p></article>", "1\n2"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<script>x</script><p>y", "y"), ("</p></div><p>z", "z"),
    ("<div>" * 3000 + "deep", "deep"), ("<p>" + "w " * 50000, ("w " * 50000).strip()),
])
def test_single_pages(html, text):
    assert text_of(html) == text


def test_tree_matching_finds_the_common_structure():
    a = summarise(parse("<body><div class=x><p>1</p></div><ul><li>a</li></ul></body>"))
    b = summarise(parse("<body><span>new</span><div class=x><p>2</p><p>3</p></div></body>"))
    found = align(a, b)

    def names(tree):
        return {tree[3]: tree[0], **{n: s for c in tree[2] for n, s in names(c).items()}}

    left, right = names(a), names(b)
    assert sorted((right[page], left[model]) for page, model in found.items()) == [
        ("", ""), ("body", "body"), ("div.x", "div.x"), ("p", "p")]


def test_constant_nodes_are_template_and_varying_slots_content(spark):
    rows = [(i, f"http://host.example/{i}", f"<body><div id=top>Same words</div><div id=x><p>Text {i}</p></div>"
             "<div id=end>The end</div></body>") for i in range(5)]
    rows += [(9, "http://other.example/", "<body><div id=top>Alone</div></body>"), (10, None, None), (11, "no host", "<p>n"),
             (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect())
    expected = Counter({(i, f"Text {i}", 6): 1 for i in range(5)})
    expected[(0, "Text 0", 6)] = 2
    expected.update([(9, "Alone", 5), (10, "", 0), (11, "n", 1)])
    assert got == expected
    assert extract_text(df.filter("false")).collect() == []


def test_articles_of_identical_pages_stay(spark):
    rows = [(i, "http://h.example/", "<body><article><p>Same</p></article></body>", "clash") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    assert {r.text for r in extract_text(df).collect()} == {"Same"}


def extracted(spark, sources, host="h.example"):
    rows = [(i, f"http://{host}/{i}", h) for i, h in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in extract_text(df).collect()}


def test_wrapper_decides_inside_articles(spark):
    got = extracted(spark, [f"<body><article><h1>Title {i}</h1><p>Text {i}</p><p>Read more</p><div class=who>By us</div>"
                            "</article></body>" for i in range(5)])
    assert got == {i: f"Title {i}\nText {i}" for i in range(5)}


def test_one_odd_page_does_not_spoil_a_host(spark):
    pages = [f"<body><div id=top>Menu words</div><div id=x><p>Text {i}</p></div></body>" for i in range(12)]
    got = extracted(spark, [*pages, "<body><center>Error</center></body>"])
    assert got == {**{i: f"Text {i}" for i in range(12)}, 12: "Error"}


def test_copies_of_one_page_are_no_template(spark):
    page = "<body><div id=top>Menu</div><p>Main text</p><script>var n={}</script></body>"
    got = extracted(spark, [page.format(i) for i in range(5)])
    assert set(got.values()) == {"Menu\nMain text"}


@pytest.mark.parametrize("html, text", [
    ("<body class=has-sidebar><p>a</p><div class=sidebar>b</div></body>", "a"),
    ("<div class=page-with-sidebar><p>long enough text</p></div><div class=share-bar>b</div>", "long enough text"),
    ("<div class=banner><article>x</article></div>", "x"), ("<form><p>whole page</p></form><p>b</p>", "whole page\nb"),
    ("<div class=related-posts><article>no</article></div><main>yes</main>", "yes")])
def test_main_text_inside_furniture_words(html, text):
    assert text_of(html) == text
