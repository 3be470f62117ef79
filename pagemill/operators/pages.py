"""Page records from raw HTML: built-in functions, and the tree pass where they cannot decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import html as hx
from pagemill.functions import quality as qx
from pagemill.functions import text as tx
from pagemill.operators import html_records as hr


def clean_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and html with the noise taken out; only pages on which a class, style or
    role selector can match pass through the tree."""
    marked = hr.needs_tree(F.col("html"))
    plain = pages.filter(~marked).select("page_id", "url", hx.remove_noise(F.col("html")).alias("html"))
    return plain.unionByName(pages.filter(marked).select("page_id", "url", hr.noise_removed(F.col("html")).alias("html")))


def extract_basic(pages: DataFrame) -> DataFrame:
    """One structured record per page; narrow, without a shuffle.

    Noise goes first, so text, headings and description never see it. Links and
    lists are read from the untouched page. Pages on which a class, role, style or
    author selector can match, or with rarer entities, take their fields from the tree
    pass; all others stay with the expressions and have no author, date or tags.
    """
    marked = hr.needs_tree(F.col("html"))
    return _by_expressions(pages.filter(~marked)).unionByName(_by_tree(pages.filter(marked)))


_SHARED = ("page_id", "url", "title", "description", "main_content", "language", "headings", "raw_links", "has_code", "has_tables", "has_lists", "has_images", "author")


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select(*_SHARED, hr.first_date(F.col("published_candidates")).alias("published"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
                       F.transform("headings", lambda h: h["level"]).alias("heading_levels"))


def _by_tree(pages: DataFrame) -> DataFrame:
    staged = pages.select("page_id", "url", hx.raw_links(F.col("html")).alias("raw_links"), hr.tree_fields(F.col("html"), F.col("url")).alias("_tree"))
    return _finished(staged.select("page_id", "url", "raw_links", *[F.col("_tree")[n].alias(n) for n in hr.TREE_FIELDS.names if n != "found"]))


def _by_expressions(pages: DataFrame) -> DataFrame:
    clean, html, lead = F.col("_clean"), F.col("html"), F.col("_lead")
    # Each costly part is a column of its own, read by name afterwards, so that no
    # regular expression runs twice; the literal tests skip pages without the tag.
    staged = pages.withColumn("_clean", hx.remove_noise(html)).withColumns({
        "_h1": hx.first_text(clean, "h1"), "_lead": hx.first_text(clean, "p"),
        "_main": F.when(clean.rlike("(?i)<main"), hx.region_text(clean, "main")).otherwise(""),
        "_article": F.when(clean.rlike("(?i)<article"), hx.region_text(clean, "article")).otherwise(""),
        "headings": hx.headings(clean), "raw_links": hx.raw_links(html),
    })
    none = F.lit(None).cast("array<string>")
    return _finished(staged.select(
        "page_id", "url", "headings", "raw_links",
        F.when(F.col("_h1") != "", F.col("_h1")).otherwise(hx.title_without_h1(clean)).alias("title"),
        hx.description_or(clean, lead).alias("description"),
        F.when(tx.word_count(F.col("_main")) > 20, F.col("_main")).when(tx.word_count(F.col("_article")) > 20, F.col("_article"))
        .otherwise(hx.region_text(clean, "body")).alias("main_content"),
        hx.language(clean).alias("language"),
        hx.has_element(clean, "pre").alias("has_code"), hx.has_element(clean, "table").alias("has_tables"),
        (hx.has_element(clean, "ul") | hx.has_element(clean, "ol")).alias("has_lists"), hx.has_element(clean, "img").alias("has_images"),
        F.lit(None).cast("string").alias("author"), none.alias("published_candidates"), none.alias("tags")))


def assess_pages(pages: DataFrame) -> DataFrame:
    record = extract_basic(pages).withColumns({
        "has_author": F.coalesce(F.col("author"), F.lit("")) != "", "has_published": F.col("published").isNotNull(), "has_tags": F.size("tags") > 0})
    return qx.assess(record, lists="has_lists", tables="has_tables", code="has_code", author="has_author", published="has_published", tags="has_tags")


def processing_gates(assessed: DataFrame, min_quality: float = 40.0, min_words: int = 50, max_words: int = 50000) -> DataFrame:
    """Status, errors and warnings of the extraction funnel, first gate wins."""
    cleaned = tx.strip(tx.clean_processed_text(F.col("main_content"), normalize=False))
    missing_title, missing_body = F.col("title") == "", F.col("main_content") == ""
    low_quality, short = F.col("overall_score") < min_quality, F.col("word_count") < min_words
    too_little = F.length(cleaned) < 10
    status = (
        F.when(missing_title | missing_body, "failed").when(low_quality | short, "skipped")
        .when(too_little, "failed").otherwise("completed")
    )
    error = (
        F.when(missing_title, "Missing required element: title")
        .when(missing_body, "Missing required element: main_content")
        .when(~low_quality & ~short & too_little, "Insufficient content after processing")
    )
    warning = (
        F.when(missing_title | missing_body, None)
        .when(low_quality, F.lit("Quality score below threshold"))
        .when(short, F.lit("Word count below minimum"))
        .when(F.col("word_count") > max_words, F.lit("Word count exceeds maximum"))
    )
    return assessed.withColumns({"status": status, "error": error, "gate_warning": warning})


def processing_stats(gated: DataFrame) -> DataFrame:
    """One row: rows per status and per quality level, average word count."""
    count_if = lambda c: F.count_if(c)
    return gated.agg(
        F.count("*").alias("total_processed"),
        count_if(F.col("status") == "completed").alias("successful"),
        count_if(F.col("status") == "skipped").alias("skipped"),
        count_if(F.col("status") == "failed").alias("failed"),
        *[count_if(F.col("quality_level") == v).alias(f"level_{v}") for v in ("excellent", "good", "fair", "poor", "very_poor")],
        F.round(F.avg("word_count"), 4).alias("avg_word_count"),
    )


def outlines_ok(headings: DataFrame, key: str, position: str, level: str, width: int = 100_000) -> DataFrame:
    """heading_hierarchy_ok for headings held as rows. Position and level form one
    order value, whose predecessor is found in segments, so a document with very
    many headings is not gathered."""
    rows = headings.select(key, (F.col(position).cast("long") * 10 + F.col(level)).alias("_o"))
    lagged = scale.with_previous(rows, [key], "_o", width, "_o")
    step_ok = F.when(F.col("prev").isNull(), F.col("_o") % 10 <= 2).otherwise(F.col("_o") % 10 - F.col("prev") % 10 <= 1)
    return lagged.groupBy(key).agg(F.bool_and(step_ok).alias("hierarchy_ok"))
