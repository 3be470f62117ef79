"""Page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import html as hx
from pagemill.functions import text as tx
from pagemill.functions import urls as ux
from pagemill.operators import html_records as hr
from pagemill.operators import markdown as md
from pagemill.operators import pages as px
from pagemill.plans import sqlparts as sp
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q
from pagemill.plans.urls import HOST, NORMAL, SCHEME

REC = "WITH " + sp.PAGES_CTE


def pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


def records(spark, sf):
    return px.extract_basic(pages(spark, sf))


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("H1_remove_noise", REC + " SELECT page_id, md5(c) AS clean_hash, length(c) AS clean_length FROM rec")
def remove_noise(spark, sf):
    return px.clean_pages(pages(spark, sf)).select("page_id", F.md5(F.encode("html", "UTF-8")).alias("clean_hash"), F.length("html").cast("long").alias("clean_length"))


@query("H2_extract_title", REC + " SELECT page_id, title FROM rec")
def title(spark, sf):
    return records(spark, sf).select("page_id", "title")


@query("H3_extract_description", REC + " SELECT page_id, description FROM rec")
def description(spark, sf):
    return records(spark, sf).select("page_id", "description")


@query("H4_extract_main_content", REC + " SELECT page_id, main_content FROM rec")
def main_content(spark, sf):
    return records(spark, sf).select("page_id", "main_content")


@query("H4_main_content_tree", REC + " SELECT page_id, md5(main_content) AS content_hash, len(h1s) AS n_headings FROM rec")
def main_content_tree(spark, sf):
    """The tree pass must agree with the expressions on well-marked articles."""
    return hr.extract_full(pages(spark, sf)).select(
        "page_id", F.md5(F.encode("main_content", "UTF-8")).alias("content_hash"), F.size("headings").cast("long").alias("n_headings"))


@query("H5_extract_author", """SELECT page_id, nullif(regexp_extract(html, '(?is)<meta[^>]*name=["'']author["''][^>]*content=["'']([^"'']*)', 1), '') AS author FROM pages""")
def author(spark, sf):
    return hr.extract_full(pages(spark, sf)).select("page_id", "author")


_STYLES = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN '2' THEN 'on ' || strftime(o_orderdate, '%m/%d/%Y') WHEN '3' THEN strftime(o_orderdate, '%d.%m.%Y')
 WHEN '4' THEN 'published ' || strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%B %d, %Y') END"""


@query("H6_parse_date", "SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3', '4') THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders")
def parse_date(spark, sf):
    """Order dates written in five layouts, one per priority, and read back."""
    d = F.col("o_orderdate").cast("timestamp")
    p = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(p == "1", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(p == "2", F.concat(F.lit("on "), F.date_format(d, "MM/dd/yyyy")))
        .when(p == "3", F.date_format(d, "dd.MM.yyyy")).when(p == "4", F.concat(F.lit("published "), F.date_format(d, "yyyy-MM-dd")))
        .otherwise(F.date_format(d, "MMMM dd, yyyy"))
    )
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(hr.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("H7_extract_language", REC + " SELECT page_id, language FROM rec")
def language(spark, sf):
    return records(spark, sf).select("page_id", "language")


def _tree(name, oracle, columns):
    """The generated pages hold no such element: nothing may be found on them."""
    @query(name, f"SELECT page_id, {oracle} FROM pages")
    def run(spark, sf):
        return hr.extract_full(pages(spark, sf)).select("page_id", columns())


_tree("H8_extract_tags", "'' AS tags", lambda: F.array_join("tags", "|").alias("tags"))
_tree("H9_extract_categories", "'' AS categories", lambda: F.array_join("categories", "|").alias("categories"))
_tree("H10_extract_breadcrumbs", "'' AS breadcrumbs", lambda: F.array_join("breadcrumbs", "|").alias("breadcrumbs"))
_tree("H15_extract_images", "'[]' AS images", lambda: F.to_json("images").alias("images"))
_tree("H16_extract_code_blocks", "'[]' AS code_blocks", lambda: F.to_json("code_blocks").alias("code_blocks"))
_tree("H17_extract_tables", "'' AS tables", lambda: F.array_join("tables", "\n\n").alias("tables"))


def marked_pages(spark, sf):
    """The pages with elements in front that the generated ones lack, filled from their keys."""
    i, b = F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string")
    front = F.concat(
        F.lit('<meta name="keywords" content="key '), i, F.lit(', second"><meta property="og:kind" content="kind '), b, F.lit('"><script type="application/ld+json">{"id": '), i, F.lit('}</script>'),
        F.lit('<div class="breadcrumbs"><a href="/">Home</a> / <a href="/s">Section '), b, F.lit('</a></div><span class="tag wide">tag '), b, F.lit('</span><span class="tag">second</span>'),
        F.lit('<span class="category">Cat '), b, F.lit('</span><p class="post-category">Page '), i, F.lit('</p><span class="category">Cat '), b, F.lit('</span><span class="byline">Writer '), b,
        F.lit('</span><img src="/img/'), i, F.lit('.png" alt="Picture '), b, F.lit('" width="10"><pre><code class="big language-python">x = '), i, F.lit('\n</code></pre><code>y'), b,
        F.lit('</code><table><tr><th>name</th><th> n </th></tr><tr><td>row '), b, F.lit('</td><td>'), i, F.lit('</td></tr></table>'))
    return pages(spark, sf).withColumn("html", F.concat(front, "html"))


def _marked(name, oracle, columns, **settings):
    @query(name, f"SELECT page_id, {oracle} FROM (SELECT *, page_id % 7 AS b FROM pages)")
    def run(spark, sf):
        return hr.extract_full(marked_pages(spark, sf), **settings).select("page_id", *columns())


_marked("H5_marked_author", "'Writer ' || b AS author", lambda: ["author"])
_marked("H8_marked_tags", "'key ' || page_id || '|second|tag ' || b AS tags", lambda: [F.array_join("tags", "|").alias("tags")])
_marked("H9_marked_categories", "'Cat ' || b || '|Page ' || page_id AS categories", lambda: [F.array_join("categories", "|").alias("categories")])
_marked("H10_marked_breadcrumbs", "'Home|Section ' || b AS breadcrumbs", lambda: [F.array_join("breadcrumbs", "|").alias("breadcrumbs")])
_marked("H15_marked_images", f"""'[{{"url":"' || {SCHEME} || '://' || {HOST} || '/img/' || page_id || '.png","alt":"Picture ' || b || '","title":"","width":"10","height":""}}]' AS images""",
        lambda: [F.to_json("images").alias("images")])
_marked("H16_marked_code_blocks", r"""'[{"language":"python","code":"x = ' || page_id || '\n"},{"language":"text","code":"y' || b || '"}]' AS code_blocks""", lambda: [F.to_json("code_blocks").alias("code_blocks")])
_marked("H17_marked_tables", "'name | n' || chr(10) || 'row ' || b || ' | ' || page_id AS tables", lambda: [F.array_join("tables", "\n\n").alias("tables")])
_marked("H19_marked_meta_map", "'key ' || page_id || ', second' AS keywords, 'kind ' || b AS kind, '{\"id\": ' || page_id || '}' AS structured_data",
        lambda: [F.col("metadata")["keywords"].alias("keywords"), F.col("metadata")["og:kind"].alias("kind"), "structured_data"], metadata_first=True)


@query("H23_marked_record_flat", """SELECT page_id, 'completed' AS status, 'Picture ' || page_id % 7 AS alt, 'x = ' || page_id || '|x = ' || page_id || '|y' || page_id % 7 AS code, 'big' AS language FROM pages""")
def marked_record_flat(spark, sf):
    r = hr.extract_flat(marked_pages(spark, sf))
    return r.select("page_id", "status", F.col("images")[0]["alt"].alias("alt"), F.array_join(F.transform("code_blocks", lambda c: c["content"]), "|").alias("code"), F.col("code_blocks")[1]["language"].alias("language"))


@query("H24_page_record_site_headings", f"""WITH x AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]\\s*>', 1), lambda h: {sp.strip(sp.inner_text('h'))}), lambda h: h <> '') AS h FROM pages)
SELECT page_id, 'completed' AS status, array_to_string(h, '|') AS headings FROM x""")
def record_site_headings(spark, sf):
    r = hr.extract_site(pages(spark, sf))
    return r.select("page_id", "status", F.array_join(F.filter(F.transform("headings", lambda h: F.trim(h["text"])), lambda t: t != ""), "|").alias("headings"))


@query("H11_extract_headings", REC + ", x AS (SELECT page_id, unnest(h1s) AS text, generate_subscripts(h1s, 1) AS pos FROM rec) SELECT page_id, pos, 1::BIGINT AS level, text FROM x")
def headings(spark, sf):
    r = scale.rows_of(records(spark, sf), ["page_id"], "headings", "h", "pos")
    return r.select("page_id", (F.col("pos") + 1).alias("pos"), "h.level", "h.text")


_LINKS = f""", l AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM rec),
t AS (SELECT page_id, unnest(regexp_extract_all(html, {q(hx.LINK_PATTERN)}, 2)) AS txt, generate_subscripts(regexp_extract_all(html, {q(hx.LINK_PATTERN)}, 2), 1) - 1 AS pos FROM rec)"""


@query("H12_extract_links", REC + _LINKS + f" SELECT l.page_id, l.pos, {SCHEME} || '://' || {HOST} || href AS link, {sp.strip(sp.inner_text('txt'))} AS text FROM l JOIN t ON l.page_id = t.page_id AND l.pos = t.pos")
def links(spark, sf):
    r = scale.rows_of(records(spark, sf), ["page_id", "url"], "raw_links", "l", "pos")
    return r.select("page_id", "pos", ux.resolve_url(F.col("url"), F.col("l.href")).alias("link"), F.col("l.text").alias("text"))


@query("H13_extract_links_distinct", REC + _LINKS + f" SELECT DISTINCT page_id, regexp_replace({SCHEME} || '://' || {HOST} || href, '#.*$', '') AS link FROM l")
def links_distinct(spark, sf):
    resolved = F.transform("raw_links", lambda l: ux.drop_fragment(ux.resolve_url(F.col("url"), l["href"])))
    return scale.rows_of(records(spark, sf), ["page_id"], F.array_distinct(resolved), "link")


@query("H14_extract_urls", f"""WITH m AS (SELECT page_id, url AS base, list_concat(regexp_extract_all(html, {q(ux.HREF_PATTERNS[0])}, 1), list_concat(regexp_extract_all(html, {q(ux.HREF_PATTERNS[1])}, 1), regexp_extract_all(html, {q(ux.HREF_PATTERNS[2])}, 1))) AS h FROM pages),
x AS (SELECT page_id, {SCHEME.replace('url', 'base')} || '://' || {HOST.replace('url', 'base')} || unnest(list_filter(h, lambda y: NOT regexp_matches(y, '^(#|javascript:|mailto:)'))) AS url FROM m)
SELECT DISTINCT page_id, {NORMAL} AS link FROM x""")
def urls_in_markup(spark, sf):
    return scale.rows_of(pages(spark, sf), ["page_id"], ux.urls_in_markup(F.col("html"), F.col("url")), "link")


@query("H18_extract_lists", f"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, {q(hx.element('ul'))}, 1)) AS body FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(body, {q(hx.element('li'))}, 1), lambda i: {sp.strip(sp.inner_text('i'))}), lambda i: i <> ''), lambda i: '- ' || i), e'\\n') AS list_text FROM u""")
def lists(spark, sf):
    return scale.rows_of(pages(spark, sf), ["page_id"], hx.list_texts(F.col("html")), "list_text")


@query("H19_extract_meta_map")
def meta_map(spark, sf):
    r = hr.extract_full(pages(spark, sf), metadata_first=True)
    return r.select("page_id", F.to_json("metadata").alias("metadata"), F.try_parse_json("structured_data").isNotNull().alias("has_structured_data"))


@query("H20_clean_whitespace", f"SELECT doc_id, {sp.squash('text')} AS cleaned FROM documents")
def clean_whitespace(spark, sf):
    return docs(spark, sf).select("doc_id", tx.squash(F.col("text")).alias("cleaned"))


@query("H21_content_hash16", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", tx.content_hash16(F.col("text")).alias("content_hash"))


@query("H22_word_count_reading_time", f"WITH w AS (SELECT doc_id, {sp.wc('text')} AS word_count FROM documents) SELECT doc_id, word_count, greatest(1, word_count // 200)::BIGINT AS reading_time FROM w")
def reading_time(spark, sf):
    return docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("word_count")).withColumn("reading_time", tx.reading_minutes(F.col("word_count")))


@query("H23_page_record_flat")
def record_flat(spark, sf):
    r = hr.extract_flat(pages(spark, sf))
    return r.select("page_id", "status", "title", "content_hash", "word_count", F.length("content_html").alias("html_length"),
                    F.size("headings").alias("n_headings"), F.size("links").alias("n_links"))


@query("H24_page_record_site")
def record_site(spark, sf):
    r = hr.extract_site(pages(spark, sf))
    return r.select("page_id", "status", "title", "word_count", "character_count", F.array_join(F.transform("headings", lambda h: h["text"]), "|").alias("headings"))


_MARKED = "html"
for _pattern, _to in hx.MARKDOWN_STEPS:
    _MARKED = sp.replace_all(_MARKED, _pattern, q(_to.replace("{1}", "\\1")))
_RUN_MARK = f"regexp_extract(r, {q(f'^{hx.OPEN}(.){hx.CLOSE}')}, 1)"
_RUN_TEXT = sp.inner_text(f"regexp_replace(r, {q(f'^{hx.OPEN}.{hx.CLOSE}')}, '')")


@query("H25_html_to_markdown", f"""WITH m AS (SELECT page_id, {_MARKED} AS m FROM pages), r AS (SELECT page_id, unnest(string_split(m, {q(hx.RUN)})) AS r, generate_subscripts(string_split(m, {q(hx.RUN)}), 1) AS i FROM m),
b AS (SELECT page_id, i, {_RUN_MARK} AS mark, CASE WHEN {_RUN_MARK} = '`' THEN {sp.replace_all(_RUN_TEXT, r'^[ \t\n\x0B\f\r]*\n|[ \t\n\x0B\f\r]+\z', "''")} ELSE {sp.strip(sp.replace_all(_RUN_TEXT, sp.WS + '+', q(' ')))} END AS t FROM r)
SELECT page_id, string_agg(CASE WHEN mark = '' THEN t WHEN mark = '`' THEN '```' || chr(10) || t || chr(10) || '```' WHEN mark IN ('-', '>') THEN mark || ' ' || t ELSE repeat('#', TRY_CAST(mark AS INT)) || ' ' || t END, e'\n\n' ORDER BY i) AS markdown
FROM b WHERE t <> '' GROUP BY page_id""")
def html_to_markdown(spark, sf):
    return pages(spark, sf).select("page_id", hx.text_blocks_markdown(F.col("html")).alias("markdown"))


@query("H25_html_to_markdown_full")
def html_to_markdown_full(spark, sf):
    return md.markdown_pages(pages(spark, sf)).select("page_id", "markdown")


@query("H26_markdown_index", "SELECT '# Scraped Content' || e'\\n\\n> Scraped from: [https://site.example.com](https://site.example.com)\\n> Scraped on: 2024-02-01T00:00:00Z\\n> Total pages: ' || count(*) || e'\\n> Total assets: 0' AS index_text FROM pages")
def markdown_index(spark, sf):
    return md.index_text(table(spark, sf, "pages"), "https://site.example.com", "2024-02-01T00:00:00Z")


@query("S6_scan_raw_html", REC + " SELECT page_id, 'completed' AS status, 0::BIGINT AS n_errors, length(main_content) AS content_length FROM rec")
def scan_raw_html(spark, sf):
    r = hr.extract_full(pages(spark, sf))
    return r.select("page_id", "status", F.size("errors").cast("long").alias("n_errors"), F.length("main_content").cast("long").alias("content_length"))


@query("S7_csv_page_counts", REC + f""" SELECT page_id, url, title, {sp.wc('main_content')} AS word_count, len(h1s) AS headings_count, len(hrefs) AS links_count FROM rec""")
def csv_page_counts(spark, sf):
    r = records(spark, sf)
    return r.select("page_id", "url", "title", tx.word_count(F.col("main_content")).alias("word_count"),
                    F.size("headings").cast("long").alias("headings_count"), F.size("raw_links").cast("long").alias("links_count"))


@query("S9_text_blocks", REC + f""" SELECT page_id, repeat('=', 80) || e'\\nURL: ' || url || e'\\nTitle: ' || title || e'\\n' || repeat('=', 80) || e'\\n' || main_content AS block,
'# ' || title || e'\\n\\n' || main_content AS markdown FROM rec""")
def text_blocks(spark, sf):
    from pagemill.sources import sinks
    r = records(spark, sf)
    return r.select("page_id", sinks.text_block(F.col("url"), F.col("title"), F.col("main_content")).alias("block"),
                    sinks.markdown_block(F.col("title"), F.col("main_content")).alias("markdown"))
