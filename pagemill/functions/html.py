"""Column functions over raw HTML: the part that regular expressions express.

Selectors that need nesting or class tests live in ``operators.html_records``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import WS, decode_entities, squash, strip

# Element types dropped as noise.
NOISE_TAGS = ("nav", "header", "footer", "aside", "script", "style", "noscript")


def element(tag: str) -> str:
    """Pattern of one element; group 1 is its inside."""
    return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"


def region(tag: str) -> str:
    """Pattern of a large element that may run to the end of a cut-off page."""
    return rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)"


NOISE_PATTERN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in NOISE_TAGS)
ANY_TAG = "<[^>]*>"
LINK_PATTERN = r"""(?is)<a\b[^>]*?href=["']([^"'>]*)["'][^>]*>(.*?)</a\s*>"""
SKIPPED_LINK = r"^(#|javascript:|mailto:)"


def remove_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE_PATTERN, "")


def inner_text(html: Column) -> Column:
    """Text of a fragment: tags vanish without leaving a blank."""
    return decode_entities(F.regexp_replace(html, ANY_TAG, ""))


def first_text(html: Column, tag: str) -> Column:
    return strip(inner_text(F.regexp_extract(html, element(tag), 1)))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    """Content of the first meta element whose attribute has the given value."""
    whole = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b{attribute}=["']{value}["'][^>]*>""", 0)
    found = strip(decode_entities(F.regexp_extract(whole, r"""(?is)\bcontent=["']([^"']*)["']""", 1)))
    return F.when(html.contains(value), found).otherwise("")


def _first_filled(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def title_without_h1(html: Column) -> Column:
    return _first_filled(
        first_text(html, "title"), meta_content(html, "property", "og:title"), meta_content(html, "name", "twitter:title"))


def description_or(html: Column, lead: Column) -> Column:
    """Meta description, or the first paragraph when it says enough."""
    cut = F.when(F.length(lead) > 300, F.concat(F.substring(lead, 1, 300), F.lit("..."))).when(F.length(lead) > 50, lead).otherwise("")
    named = _first_filled(
        meta_content(html, "name", "description"), meta_content(html, "property", "og:description"), meta_content(html, "name", "twitter:description"), cut)
    return F.when(html.contains("description"), named).otherwise(cut)


def region_text(html: Column, tag: str) -> Column:
    return squash(inner_text(F.regexp_extract(html, region(tag), 1)))


def language(html: Column) -> Column:
    root = F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang=["']([^"']+)["']""", 1)
    return _first_filled(
        F.lower(F.substring(root, 1, 2)),
        F.lower(F.substring(meta_content(html, "http-equiv", "content-language"), 1, 2)), F.lit("en"),
    )


def heading_texts(html: Column, level: int) -> Column:
    none = F.array().cast("array<string>")
    found = F.when(html.rlike(f"(?i)<h{level}"), F.regexp_extract_all(html, F.lit(element(f"h{level}")), F.lit(1))).otherwise(none)
    return F.filter(F.transform(found, lambda h: strip(inner_text(h))), lambda t: t != "")


def headings(html: Column) -> Column:
    """All h1, then all h2, ...: grouped by level, not in document order."""
    def of_level(n: int) -> Column:
        return F.transform(heading_texts(html, n), lambda t: F.struct(F.lit(n).cast("long").alias("level"), t.alias("text")))

    return F.concat(*[of_level(n) for n in range(1, 7)])


def raw_links(html: Column) -> Column:
    """(href, text) pairs of anchors in document order, page-internal ones left out."""
    hrefs = F.regexp_extract_all(html, F.lit(LINK_PATTERN), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(LINK_PATTERN), F.lit(2))
    pairs = F.zip_with(hrefs, texts, lambda h, t: F.struct(decode_entities(h).alias("href"), strip(inner_text(t)).alias("text")))
    return F.filter(pairs, lambda p: (p["href"] != "") & ~p["href"].rlike(SKIPPED_LINK))


def list_texts(html: Column) -> Column:
    """Unordered lists without nesting, one '- ' line per filled item."""
    bodies = F.regexp_extract_all(html, F.lit(element("ul")), F.lit(1))

    def lines(body: Column) -> Column:
        items = F.transform(F.regexp_extract_all(body, F.lit(element("li")), F.lit(1)), lambda i: strip(inner_text(i)))
        return F.array_join(F.transform(F.filter(items, lambda i: i != ""), lambda i: F.concat(F.lit("- "), i)), "\n")

    return F.filter(F.transform(bodies, lines), lambda t: t != "")


def has_element(html: Column, tag: str) -> Column:
    return html.rlike(rf"(?i)<{tag}[\s>/]")


# Elements that end a run of text. Fixed values.
BLOCK_TAGS = ("address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
              "form", "header", "hgroup", "hr", "html", "legend", "main", "menu", "nav", "ol", "option", "p", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "td", "th", "ul")
RUN, OPEN, CLOSE = "\x01", "\x02", "\x03"  # between runs; around the mark of a run
# Patterns and what stands in their place (group 1 is written {1}), in order.
MARKDOWN_STEPS = (
    ("(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("head", "script", "style", "noscript", "template")), ""),
    (r"(?is)<pre\b[^>]*>(?:\s*<code\b[^>]*>)?", f"{RUN}{OPEN}`{CLOSE}"),
    (r"(?is)(?:</code\s*>)?\s*</pre\s*>", RUN),
    (r"(?is)</?code\b[^>]*>", "`"),
    (r"(?is)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | "),
    (r"(?is)<li\b[^>]*>(?:\s*<p\b[^>]*>)?", f"{RUN}{OPEN}-{CLOSE}"),
    (r"(?is)<blockquote\b[^>]*>(?:\s*<p\b[^>]*>)?", f"{RUN}{OPEN}>{CLOSE}"),
    (r"(?is)<h([1-6])\b[^>]*>", f"{RUN}{OPEN}{{1}}{CLOSE}"),
    (r"(?is)<br\b[^>]*>", " "),
    (rf"(?is)</?(?:{'|'.join(BLOCK_TAGS)}|h[1-6]|li|blockquote)\b[^>]*>", RUN),
)


def text_blocks_markdown(html: Column) -> Column:
    """All text of a page as markdown blocks, in page order.

    Built-in functions only: every tag of a block element ends a run of text, and each run
    that holds any is a block. Headings, list items, quotes and preformatted text carry
    their mark, cells of a row stand between bars, inline code between backticks; other
    marks inside a run are dropped. The tree walk of the markdown operator writes those too.
    """
    marked = html
    for pattern, to in MARKDOWN_STEPS:
        marked = F.regexp_replace(marked, pattern, to.replace("{1}", "$1"))

    def block(run: Column) -> Column:
        mark = F.regexp_extract(run, f"^{OPEN}(.){CLOSE}", 1)
        text = inner_text(F.regexp_replace(run, f"^{OPEN}.{CLOSE}", ""))
        plain = F.struct(mark.alias("mark"), F.when(mark == "`", F.regexp_replace(text, r"^\s*\n|\s+\z", "")).otherwise(strip(F.regexp_replace(text, WS + "+", " "))).alias("text"))
        return plain

    def written(b: Column) -> Column:
        mark, text = b["mark"], b["text"]
        heading = F.concat(F.repeat(F.lit("#"), mark.try_cast("int")), F.lit(" "), text)
        return (F.when(mark == "", text).when(mark == "`", F.concat(F.lit("```\n"), text, F.lit("\n```")))
                .when(mark.isin("-", ">"), F.concat(mark, F.lit(" "), text)).otherwise(heading))

    blocks = F.filter(F.transform(F.split(marked, RUN, -1), block), lambda b: b["text"] != "")
    return F.array_join(F.transform(blocks, written), "\n\n")
