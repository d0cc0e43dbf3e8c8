import html
import random
import re

from lumenframe.llm import wrapper
from lumenframe.llm.dom import Node, parse
from lumenframe.llm.registry import QUERIES


def article(page):
    """The text of a generated page by its fixed outer layout."""
    page = re.sub(r"<script.*?</script>", "", page, flags=re.S)
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?b>", "", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_every_generated_page(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        found = QUERIES["op2_html"](spark, sf).collect()
        assert len(found) == len(pages)
        for r in found:
            assert r.text == article(pages[r.page_id].html)
            assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_alignment_alone_finds_the_generated_articles(spark):
    """No tag or name is heeded but those of scripts, styles and form controls."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    pages = {r.page_id: article(r.html) for r in df.select("page_id", "html").collect()}
    found = wrapper.extract(df, hints=False).collect()
    assert sum(r.text == pages[r.page_id] for r in found) >= 0.99 * len(pages)


def show(node):
    return node if isinstance(node, str) else [node.label, *map(show, node.kids)]


def test_parser_mends_pages():
    assert show(parse("<p>a<p>b<div>c</p>d")) == ["#page", ["p", "a"], ["p", "b"], ["div", "c", "d"]]
    assert show(parse("<ul><li>x<li>y<ul><li>z</ul></ul>t")) == ["#page", ["ul", ["li", "x"], ["li", "y", ["ul", ["li", "z"]]]], "t"]
    assert show(parse("a &lt;b&gt; 1 < 2<br>d<!-- <p> --><SCRIPT>if (a<b) '</p>'</Script>e")) == ["#page", "a <b> 1 < 2", ["br"], "d", ["script", "if (a<b) '</p>'"], "e"]
    assert show(parse("<div class='Ad b2' id=x>t</div>")) == ["#page", ["div.ad.b0.x", "t"]]
    assert show(parse("<p title=\"a>b\">c</p><!-- open")) == ["#page", ["p", "c"]]
    deep, n = parse("<div>" * 50000 + "x"), 0
    while any(isinstance(k, Node) for k in deep.kids):
        deep, n = next(k for k in deep.kids if isinstance(k, Node)), n + 1
    assert n == 50000 and deep.kids == ["x"]


def tree(text):
    return wrapper.skeleton(parse(text))


def brute_match(a, b):
    """All order-keeping mappings of the child lists."""
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute_match(xs[0], ys[0]) + best(xs[1:], ys[1:]) if xs[0][0] == ys[0][0] else 0)

    return 1 + best(a[2], b[2])


def test_tree_matching():
    texts = ["<div><h1>a</h1><p>b</p><ul><li>c</li></ul></div>", "<div><p>b</p><h2>x</h2><ul><li>q</li><li>r</li></ul><p>z</p></div>", "<div></div>", "<p>a</p><div><h1>a</h1></div><p>b</p>", "<div><h1>a</h1><ul></ul><p>b</p></div>"]
    for a in map(tree, texts):
        for b in map(tree, texts):
            assert wrapper.match(a, b) == brute_match(a, b)
            assert sum(i is not None for i, _ in wrapper.align(a[2], b[2])) == len(a[2])
            assert wrapper.merge(a, b)[1] == 2


def test_long_lists_are_aligned_as_well_as_short_ones():
    rng = random.Random(3)
    for n in (3, 30, 130):
        xs = [[rng.choice("abc"), 1, []] for _ in range(n)]
        ys = [[rng.choice("abc"), 1, []] for _ in range(n + 7)]
        pairs = wrapper.align(xs, ys)
        assert [i for i, _ in pairs if i is not None] == list(range(n)) and [j for _, j in pairs if j is not None] == list(range(n + 7))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(xs[i][0] == ys[j][0] for i, j in both)
        assert len(both) == wrapper._table(xs, ys, {}, False)[-1][-1]


def test_templates_go_to_text_and_back():
    t = tree("<div><h1>a</h1><p>b</p><p>b</p><ul><li>c</li></ul></div>x")
    strip = lambda t: [t[0], t[1], [strip(k) for k in t[2]]]
    assert strip(wrapper.grown(wrapper.flat(t))) == t


LAYOUT = """<html><head><title>T{n}</title><style>x</style></head><body><header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div>
<nav><a>Home</a></nav><aside class="sidebar"><p>s{n}</p></aside><div id="content"><p class="tagline">Always the same words</p><h1>Title&nbsp;{n} &amp; more</h1>
<p>Body   text <b>bo</b>ld {n}.<br>line<p>Second &lt;{n}&gt;</div><form><p>Your mail {n}</p></form><div class="ad">Buy {n}</div>
<section id="comments"><p>reader {n}</p></section><footer>f{n}</footer><script>var p = "<p>no</p>";</script></body></html>"""


def test_constant_slots_and_furniture_leave_content(spark):
    rows = [(i, "http://h/%d" % i, LAYOUT.replace("{n}", str(i)), 1) for i in range(30)]
    rows += [(100, None, None, 1), (101, "odd", "", 1), (102, "http://k/1", "plain words", 1), (102, "http://k/1", "plain words", 1), (None, "http://k/2", "<p>x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(5)
    found = [(r.page_id, r.url, r.text) for r in wrapper.extract(df).collect()]
    want = [(i, "http://h/%d" % i, f"Title {i} & more Body text bold {i}. line Second <{i}>") for i in range(30)]
    want += [(100, None, ""), (101, "odd", ""), (102, "http://k/1", "plain words"), (102, "http://k/1", "plain words"), (None, "http://k/2", "x")]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert wrapper.extract(df.limit(0)).count() == 0


#: No article or main element, and names that say nothing.
PLAIN = """<body><div class="k0"><a href=/>Home</a> <a href=/a>All about us and our many works</a> <a href=/c>Contact</a></div><div class="k1"><p>{notice}</p></div>
<div class="k2"><div class="k3"><h1>{title}</h1>{body}<p>Write to the editor if you find a mistake in this text.</p></div>
<div class="k4"><ul>{links}</ul></div></div><div class="k5"><p>Printed on paper, sold on the corner, read at home.</p></div></body>"""


def plain_pages(rng, host, n):
    words = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(k))
    for i in range(n):
        title, paragraphs = words(6), [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        links = "".join(f"<li><a href=/{words(1)}>{words(4)}</a></li>" for _ in range(5))
        page = PLAIN.format(title=title, body="".join(f"<p>{p}</p>" for p in paragraphs), links=links, notice="Shop closed on Monday" if i % 7 else "Shop open")
        yield f"http://{host}/{i}", page, " ".join([title, *paragraphs])


def test_hosts_without_marks(spark):
    rng = random.Random(5)
    pages = [p for host, n in (("a.org", 40), ("b.org", 12)) for p in plain_pages(rng, host, n)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    for hints in (True, False):
        found = {r.page_id: r.text for r in wrapper.extract(df, hints=hints).collect()}
        assert [found[i] for i in range(len(pages))] == [w for _, _, w in pages]
    # without other pages of its host a page has no template, and more than its article is left
    alone = wrapper.extract(df.selectExpr("page_id", "concat('http://', page_id, '.org/') as url", "html")).collect()
    assert sum(r.text != pages[r.page_id][2] for r in alone) > 0.9 * len(pages)


def test_no_word_is_lost_in_deep_or_long_pages(spark):
    deep = "<div id=main>" + "<div>" * 400 + "<p>one</p><nav>menu</nav>" + "</div>" * 400 + "<p>after</p></div>"
    many = "<article>" + "".join(f"<h3>h{i}</h3><p>p{i}</p>" * (1 + i % 2) + "<ul><li>x</li></ul>" * (i % 3 == 0) for i in range(900)) + "</article>"
    more = "<article>" + "".join(f"<p>p{i}</p><h3>h{i}</h3>" * (1 + i % 3) + "<ul><li>x</li></ul>" * (i % 5 == 0) for i in range(900)) + "</article>"
    df = spark.createDataFrame([(0, "http://a/", deep), (1, "http://b/", many), (2, "http://b/1", more)], "page_id long, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in wrapper.extract(df).collect()}
    assert found[0] == "one after"
    for i, page in ((1, many), (2, more)):
        assert found[i] == " ".join(re.sub("<[^>]*>", " ", page).split())


def test_copies_of_one_article_keep_it(spark):
    page = "<article><h1>T</h1><p>the same words</p></article><footer>f</footer>"
    df = spark.createDataFrame([(i, f"http://a/{i}", page) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in wrapper.extract(df).collect()} == {"T the same words"}
