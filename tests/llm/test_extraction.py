from __future__ import annotations

from alertledger.llm.extraction import extract, main_text, read_page


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><div id="cookie-notice">We use</div><main><article><header><h1>Head &amp; line</h1></header>
    <p>One<b>two</b>
     three<br>four &lt;x&gt; &nbsp;y<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><div class="share">Share</div>
    <script>if(a<b)x("</p>")</script><!-- no --><p hidden>no<p>last<form><input>Name</form>
    <section class="comments"><article class="comment">hi</article></section></article></main><aside>side</aside>
    <footer>f</footer>"""
    assert main_text(page, set()) == "Head & line\n\nOnetwo three four <x> y\n\na\n\nb\n\n1 2\n\nlast"


def test_pages_without_article_and_broken_ones():
    assert main_text("", set()) == ""
    assert main_text("plain &am text &amp", set()) == "plain &am text &"
    assert main_text("<p>a<div>b</div>c <nav>x</nav> 1 < 2 & 3", set()) == "a\n\nb\n\nc\n\n1 < 2 & 3"
    assert main_text("<article><p>open <b>bold<p>next", set()) == "open bold\n\nnext"
    deep = "<div>" * 3000 + "in" + "</div>" * 3000
    assert main_text(deep, set()) == "in"


def test_templates_are_deleted_by_host_only(spark):
    def page(host, i, extra):
        return (i, f"https://{host}/p{i}", f"<body><div><p>menu of site</p></div><div><p>text {i}</p><p>{extra}</p></div></body>", 1, "h")

    rows = [page("a.example", i, "often quoted" if i % 2 else f"own {i}") for i in range(12)]
    rows += [page("b.example", 100 + i, "x") for i in range(2)]
    article = "<article><p>copied line</p><p>text {}</p></article><div>menu of site</div>"
    rows += [(200 + i, "http://c.example/", article.format(i), 1, "h") for i in range(9)]
    rows += [(300, None, "<p>no host</p>", 1, "h"), (301, "http://a.example/x", None, 1, "h"), (None, "nonsense", "", 1, "h"),
             (302, "http://a.example/x", None, 1, "h")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int, template string")
    out = {r["page_id"]: r["text"] for r in extract(frame).collect()}
    assert len(out) == len(rows)
    assert out[0] == "text 0\n\nown 0" and out[100] == "menu of site\n\ntext 100\n\nx"  # too few pages for a template
    assert out[203] == "copied line\n\ntext 3"  # prose of an article is kept however often it occurs
    assert out[300] == "no host" and out[301] == "" and out[None] == ""
    assert extract(frame.limit(0)).count() == 0


def test_equal_subtrees_have_equal_hashes():
    _, one = read_page("<div><p>same  text</p></div>")
    _, two = read_page("<section><div>\n<p>same text</p></div></section>")
    assert one and set(one) & set(two)


def test_template_of_few_pages_of_a_large_host(spark):
    """Unnamed boilerplate on 3 % of a host's pages goes; what is on fewer than five pages stays."""
    def page(i):
        extra = "<div><span>offer of the week</span></div>" if i % 33 == 0 else "<div>seen four times</div>" if i % 75 == 1 else ""
        return (i, f"https://large.example/p{i}", f"<body>{extra}<div><p>text {i}</p></div></body>")

    out = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame([page(i) for i in range(300)],
                                                                         "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(0, 300, 33)} == {f"text {i}" for i in range(0, 300, 33)}
    assert out[1] == "seen four times\n\ntext 1"
