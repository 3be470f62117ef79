import gc
from urllib.parse import urljoin

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as hx
from pagemill.functions import urls as ux
from pagemill.operators import html_records as hr
from pagemill.operators import markdown as md
from pagemill.operators import pages as px

PAGE = """<html lang="DE-de"><head><title>T</title><meta name="author" content="Ann"><meta name="keywords" content="a, b,,a">
<meta property="og:description" content="About"><meta property="article:published_time" content="2024-03-01T10:00:00Z">
<script type="application/ld+json">{"k": 1}</script></head><body><nav class="breadcrumb"><a href="/">Home</a><a href="/x">X</a></nav>
<main><h2 id="s">Two</h2><h1>One</h1><h3></h3><p>Some words to read here, more than twenty of them so that the main part is taken as the content of this page, yes indeed.</p>
<span class="tag">b</span><span class="tag">c</span><span class="category">Cat</span><span class="category">Cat</span><div class="ads">buy</div><div style="display: none">hid</div>
<pre><code class="language-python">x = 1</code></pre><pre>plain</pre><code class="json">{}</code>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><ol><li>x</li><li></li><li>y<ul><li>z</li></ul></li></ol>
<img src="i.png" alt="I" width="10"><a href="../up?q=1">Up</a><a href="#frag">F</a><a href="mailto:x@y">M</a></main></body></html>"""


@pytest.fixture(scope="module")
def record(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/d/e/f", PAGE)], "page_id long, url string, html string")
    return hr.extract_full(df).first()


def test_full_record(record):
    assert record["title"] == "One" and record["description"] == "About" and record["author"] == "Ann" and record["language"] == "de"
    assert record["tags"] == ["a", "b", "a", "c"] and record["categories"] == ["Cat"]
    assert [(h["level"], h["text"], h["id"]) for h in record["headings"]] == [(1, "One", ""), (2, "Two", "s")]
    assert [(c["language"], c["code"]) for c in record["code_blocks"]] == [("python", "x = 1"), ("text", "plain"), ("json", "{}")]
    assert record["tables"] == ["A | B\n1 | 2"]
    assert record["lists"] == ["1. x\n2. yz", "- z"]
    assert [lk["url"] for lk in record["links"]] == ["https://a.example.com/d/up?q=1"]
    assert record["images"][0]["url"] == "https://a.example.com/d/e/i.png" and record["images"][0]["width"] == "10"
    assert str(record["published"]) == "2024-03-01 10:00:00"
    assert "buy" not in record["main_content"] and "hid" not in record["main_content"]
    # noise goes first, so breadcrumbs and structured data are gone
    assert record["breadcrumbs"] == [] and record["structured_data"] is None


def test_metadata_first_keeps_what_noise_removal_drops(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/", PAGE)], "page_id long, url string, html string")
    r = hr.extract_full(df, metadata_first=True).first()
    assert r["breadcrumbs"] == ["Home", "X"] and r["structured_data"] == '{"k": 1}' and r["metadata"]["author"] == "Ann"


def test_bad_page_fails_alone(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/", None), (2, "https://a.example.com/", "<body>ok</body>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["status"] for r in hr.extract_full(df).collect()}
    assert got == {1: "failed", 2: "completed"}


def test_other_record_forms(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/d", PAGE)], "page_id long, url string, html string")
    flat, site = hr.extract_flat(df).first(), hr.extract_site(df).first()
    assert flat["title"] == "T" and flat["content"].startswith("Two\nOne") and 'class="ads"' not in flat["content_html"]
    assert [h["text"] for h in site["headings"]][:2] == ["Two", "One"]


def test_markdown():
    html = '<h2>A<b>b</b></h2><p>x <a href="/y">y</a></p><ul><li>i</li></ul><a href="/z">Z</a><pre><code class="language-js">a &lt; b</code></pre><table><tr><td>1</td></tr><tr><td>2</td></tr></table><img src="/p.png" width="1600" height="100" alt="P">'
    out = md.to_markdown(html, "https://a.example.com/d")
    assert "## Ab" in out and "x [y](https://a.example.com/y)" in out and "- i" in out and "[Z](https://a.example.com/z)" in out and "```js\na < b\n```" in out
    assert "| 1 |\n| --- |\n| 2 |" in out and 'width="800" height="50"' in out


@pytest.mark.parametrize("html, want", [
    ("", ""), (None, ""), ("<p></p>", ""), ("a  b\n c", "a b c"), ("<p>a<br>b</p>c", "a  \nb\n\nc"), ("<h3> x\n y </h3>", "### x y"),
    ("<ol><li>a<ul><li>b</li></ul></li><li><p>c</p><p>d</p></li><li></li></ol>", "1. a\n\n   - b\n2. c\n\n   d"),
    ("<blockquote>a<p>b</p></blockquote>", "> a\n>\n> b"), ("<pre>x\n```\n</pre>", "````\nx\n```\n````"), ("<code>a`b</code>", "``a`b``"),
    ("<table><tr><th>A|B</th></tr><tr><td>1<table><tr><td>n</td></tr></table></td></tr></table>", "| A\\|B |\n| --- |\n| 1 \\| n \\| \\| --- \\| |"),
    ("<script>x</script><p>a &lt;b&eacute;", "a <b\u00e9"), ('<img src="data:x"><img src="/q.png">', "![q_{0}.png](shared_assets/q_{0}.png)"), ("</p></ul>x", "x"),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_markdown_blocks(html, want):
    digest = md.asset_name("https://a.example.com/q.png").split("_")[1].removesuffix(".png")
    assert md.to_markdown(html, "https://a.example.com/d") == want.replace("{0}", digest)


@pytest.mark.parametrize("text, want", [("2024-01-05", "2024-01-05"), ("2024-01-05T01:02:03Z", "2024-01-05"), ("on 03/04/2024", "2024-03-04"), ("04.03.2024", "2024-03-04"),
                                        ("March 4, 2024", None), ("2024-13-45", None), ("13/45/2024 or 04.03.2024", "2024-03-04"), ("", None)])
def test_parse_date(spark, text, want):
    got = spark.createDataFrame([(text,)], "c string").select(F.date_format(hr.parse_date(F.col("c")), "yyyy-MM-dd").alias("d")).first()["d"]
    assert got == want


CASES = ["/a", "b", "../c", "./d/./e", "../../../f", "?x=1", "#top", "", "//h.example.org/p", "http://z.example.org/", "g/../h/", "..", "."]


def test_resolve_matches_the_standard_join(spark):
    for base in ("https://a.example.com/d/e/f?q=2", "https://a.example.com/d/", "https://a.example.com"):
        df = spark.createDataFrame([(c,) for c in CASES], "r string").withColumn("b", F.lit(base))
        for r in df.select("r", ux.resolve_url(F.col("b"), F.col("r")).alias("x")).collect():
            want = urljoin(base, r["r"])
            assert r["x"].rstrip("/") == want.rstrip("/"), (base, r["r"])


@pytest.mark.parametrize("url, want", [("HTTP://A.Example.com:80", "http://a.example.com/"), ("https://a.example.com:443/x?b=2&a=1#f", "https://a.example.com/x?a=1&b=2"),
                                       ("http://a.example.com:8080/", "http://a.example.com:8080/"), ("https://a.example.com/?b&a=", "https://a.example.com/?a=&b=")])
def test_normalize_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(ux.normalize_url(F.col("u")).alias("x")).first()["x"] == want


WORDS = " ".join(f"word{i}" for i in range(30))
MARKED = {
    "author": ('<meta name="author" content="Ann Example">', ""),
    "byline": ("", '<p class="byline">By Bo</p>'),
    "date": ('<meta property="article:published_time" content="2024-03-05T10:00:00Z">', ""),
    "tags": ('<meta name="keywords" content="one, two">', ""),
    "noise": ("", '<div class="sidebar">menu words</div><div style="display: none">unseen</div>'),
    "role": ("", f'<div role="main"><p>{WORDS} inside</p></div>'),
    "entities": ("", "<p>caf&eacute; &#8217;s</p>"),
    "plain": ("", "<ul><li>item</li></ul><p>fish &amp; chips</p>"),
}


def marked_pages(spark):
    rows = [(i, f"http://h/{k}", f"<html><head><title>T{i}</title>{head}</head><body><h1>Head {i}</h1><h2>Part</h2><p>{WORDS}</p>{body}</body></html>") for i, (k, (head, body)) in enumerate(MARKED.items())]
    return spark.createDataFrame([*rows, (99, "http://h/none", None)], "page_id long, url string, html string")


def test_records_follow_the_tree_where_selectors_can_match(spark):
    pages = marked_pages(spark)
    got = {r["page_id"]: r for r in px.extract_basic(pages).collect()}
    want = {r["page_id"]: r for r in hr.extract_full(pages.filter("html IS NOT NULL")).collect()}
    for i, w in want.items():
        for field in ("title", "description", "main_content", "author", "tags", "published", "language"):
            assert got[i][field] == w[field], (i, field)
        assert [(h["level"], h["text"]) for h in got[i]["headings"]] == [(h["level"], h["text"]) for h in w["headings"]]
        assert got[i]["has_lists"] == bool(w["lists"])
    names = list(MARKED)
    assert got[names.index("noise")]["main_content"].endswith("word29") and "café ’s" in got[names.index("entities")]["main_content"]
    assert got[99]["title"] in (None, "")
    plain = pages.filter(~hr.needs_tree(F.col("html")))
    assert {r["url"] for r in plain.collect()} == {"http://h/plain", "http://h/none"}


def test_authors_dates_and_tags_count_in_the_scores(spark):
    got = {r["url"].rsplit("/", 1)[1]: r for r in px.assess_pages(marked_pages(spark)).collect()}
    bare = got["plain"]
    assert "Missing author information" in bare["warnings"] and "Missing publication date" in bare["warnings"]
    for name in ("author", "byline"):
        assert "Missing author information" not in got[name]["warnings"]
    assert "Missing publication date" not in got["date"]["warnings"]
    assert got["tags"]["structure_score"] > got["noise"]["structure_score"]


MARKDOWN_PAGE = """<html><head><title>T</title><style>p{}</style></head><body>Bare <b>text</b> first<div>lost &amp; found<h2 id=x>A <i>head</i></h2>after</div>
<ul><li><p>one</p> tail</li><li>two<ul><li>deep</li></ul></li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2 <code>x</code></td></tr></table>
<pre class="k"><code>if a &lt; b:
    go()
</code></pre><blockquote><p>said</p></blockquote><!-- gone --><script>var p = "<p>no</p>";</script>line<br>break<footer>end</footer></body></html>"""


def test_native_markdown_keeps_all_text(spark, sf):
    df = spark.createDataFrame([(MARKDOWN_PAGE,), ("",), (None,), ("plain",)], "html string")
    got = [r["m"] for r in df.select(hx.text_blocks_markdown(F.col("html")).alias("m")).collect()]
    assert got[0] == "\n\n".join(["Bare text first", "lost & found", "## A head", "after", "- one", "tail", "- two", "- deep", "a | b", "1 | 2 `x`",
                                  "```\nif a < b:\n    go()\n```", "> said", "line break", "end"])
    assert got[1:] == ["", None, "plain"]
    # on every page of the table: the same characters as the body's text, but for blanks and marks
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    body = F.regexp_replace("html", hx.MARKDOWN_STEPS[0][0], "")
    bare = lambda c: F.regexp_replace(c, r"[\s\p{Z}|`>#-]+", "")
    rows = pages.select(bare(hx.text_blocks_markdown(F.col("html"))).alias("a"), bare(hx.inner_text(body)).alias("b")).collect()
    assert len(rows) > 20 and all(r["a"] == r["b"] != "" for r in rows)


def test_noise_selectors_reach_the_cleaned_source(spark):
    page = ('<body class="x"><div class="sidebar big">S<div>in</div></div><p>keep</p><div style="display: none">H</div><!-- c --><p class="menu">M</p>keep 2'
            '<nav>N</nav><span class="cookie-notice">C</span> tail<br class="ads"><img class=hidden src=a>&hellip;</body>')
    plain = "<body><nav>N</nav><p>keep</p><!-- c --><aside>A</aside></body>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", plain), (3, "u", None), (4, "u", '<p>a<div class="hidden">open')], "page_id long, url string, html string")
    got = {r["page_id"]: r["html"] for r in px.clean_pages(df).collect()}
    assert got[1] == '<body class="x"><p>keep</p>keep 2 tail&hellip;</body>'
    assert got[2] == "<body><p>keep</p></body>" and got[3] is None and got[4] == "<p>a"


def test_references_without_semicolon_stay(spark):
    body = '<h1 title="a&amp b&lt;">x &&amp</h1><p>1 &lt 2 &lt;&amp;&#65;&#66 &notit; &eacute; \ue000</p><script type="application/ld+json">{"a": "b &&amp; c"}</script>'
    markup = f"<html><body><article>{body}{'word ' * 30}</article></body></html>"
    root = hr.parse(markup)
    assert [n.text() for n in root.tags("h1")] == ["x &&amp"] and root.tags("h1")[0].attrs["title"] == "a&amp b<"
    assert root.tags("p")[0].text() == "1 &lt 2 <&A&#66 &notit; \u00e9 \ue000"
    assert hr.meta_of(root)[1] == '{"a": "b &&amp; c"}'
    plain = f"<html><body><article><h1>x &&amp</h1>{'a &lt;b&amp ' * 30}</article></body></html>"
    df = spark.createDataFrame([(1, "https://a.example.com/", plain)], "page_id long, url string, html string")
    full, basic, site = hr.extract_full(df).first(), px.extract_basic(df).first(), hr.extract_site(df).first()
    assert full["main_content"] == basic["main_content"] and full["title"] == basic["title"] == "x &&amp" == site["headings"][0]["text"]


def test_a_tree_is_freed_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        hr.full_record(PAGE, "https://a.example.com/")
        hr.flat_record(PAGE, "https://a.example.com/")
        hr.site_record(PAGE, "https://a.example.com/")
        assert not [o for o in gc.get_objects() if isinstance(o, hr.Node)]
    finally:
        gc.enable()


def test_records_leave_the_task_in_small_frames():
    pages = pd.DataFrame({"page_id": range(600), "url": "https://a.example.com/", "html": [PAGE] * 599 + [None]})
    frames = list(hr.record_frames(iter([pages, pages.iloc[:0]]), hr.full_record, ["title"]))
    assert [i for f in frames for i in f["page_id"]] == list(range(600)) and max(map(len, frames)) <= hr.OUT_ROWS
    assert list(pd.concat(frames)["status"]) == ["completed"] * 599 + ["failed"]
