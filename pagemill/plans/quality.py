"""Quality queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import quality as qx
from pagemill.functions import text as tx
from pagemill.functions import urls as ux
from pagemill.operators import pages as px
from pagemill.plans import sqlparts as sp
from pagemill.plans.registry import query, table


def _assessed(spark, sf):
    return px.assess_pages(table(spark, sf, "pages").select("page_id", "url", "html"))


def _docs(spark, sf):
    return qx.assess(table(spark, sf, "documents").select("doc_id", "text"), text="text", title=None, description=None, levels=None)


@query("Q13_assess_quality", sp.PAGE_SCORES + f"""
SELECT {sp.HOST} AS host, quality_level, count(*) AS pages, round(avg(overall_score), 4) AS avg_score, round(avg(word_count), 4) AS avg_words
FROM scored GROUP BY ALL""")
def assess_quality(spark, sf):
    """Flagship: level of every page, then pages and averages per site and level."""
    scored = _assessed(spark, sf).select(ux.host(F.col("url")).alias("host"), "quality_level", "overall_score", "word_count")
    return (
        scored.groupBy("host", "quality_level")
        .agg(F.count("*").alias("pages"), F.round(F.avg("overall_score"), 4).alias("avg_score"),
             F.round(F.avg("word_count"), 4).alias("avg_words"))
        .orderBy("host", "quality_level")
    )


@query("Q1_basic_metrics", sp.DOC_SCORES + """
SELECT doc_id, word_count, sentence_count, paragraph_count, round(avg_sentence_length, 6) AS avg_sentence_length, round(avg_paragraph_length, 6) AS avg_paragraph_length FROM scored""")
def basic_metrics(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", "word_count", "sentence_count", "paragraph_count",
        F.round("avg_sentence_length", 6).alias("avg_sentence_length"), F.round("avg_paragraph_length", 6).alias("avg_paragraph_length"))


def _score(name, columns):
    parts = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(f"{name}_documents", sp.DOC_SCORES + f" SELECT doc_id, {parts} FROM scored")
    def on_documents(spark, sf):
        return _docs(spark, sf).select("doc_id", *[F.round(c, 6).alias(c) for c in columns])

    @query(name, sp.PAGE_SCORES + f" SELECT page_id, {parts} FROM scored")
    def on_pages(spark, sf):
        return _assessed(spark, sf).select("page_id", *[F.round(c, 6).alias(c) for c in columns])


_score("Q2_score_length", ["content_length_score"])
_score("Q3_score_readability", ["readability_score"])
_score("Q4_score_structure", ["structure_score"])
_score("Q6_score_uniqueness", ["boilerplate_ratio", "duplicate_content_ratio", "uniqueness_score"])
_score("Q7_score_completeness", ["completeness_score"])
_score("Q8_score_technical", ["technical_score"])
_score("Q9_score_overall", ["overall_score"])


@query("Q5_heading_hierarchy_ok", """
WITH lv AS (SELECT l_orderkey AS k, l_linenumber AS pos, least(6, 1 + (l_quantity::BIGINT % 4))::BIGINT AS lv FROM lineitem),
d AS (SELECT k, pos, lv, lag(lv) OVER (PARTITION BY k ORDER BY pos, lv) AS prev FROM lv)
SELECT k AS document_id, bool_and(CASE WHEN prev IS NULL THEN lv <= 2 ELSE lv - prev <= 1 END) AS hierarchy_ok FROM d GROUP BY k""")
def heading_hierarchy(spark, sf):
    """Outlines taken from order lines: level from quantity, position from line number."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("pos"),
        F.least(F.lit(6), 1 + F.col("l_quantity").cast("long") % 4).alias("lv"))
    return px.outlines_ok(lines, "document_id", "pos", "lv")


@query("Q10_quality_level", sp.PAGE_SCORES + " SELECT page_id, quality_level FROM scored")
def quality_level(spark, sf):
    return _assessed(spark, sf).select("page_id", "quality_level")


@query("Q11_quality_issues", sp.PAGE_SCORES + " SELECT page_id, array_to_string(issues, '; ') AS issues, array_to_string(warnings, '; ') AS warnings FROM scored")
def quality_issues(spark, sf):
    return _assessed(spark, sf).select("page_id", F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"))


@query("Q12_quality_summary", sp.PAGE_SCORES + """
SELECT page_id, quality_level IN ('excellent', 'good') AS is_high_quality,
  'Overall Quality: ' || CASE quality_level WHEN 'very_poor' THEN 'Very_Poor' ELSE upper(substr(quality_level, 1, 1)) || substr(quality_level, 2) END
  || ' (' || printf('%.1f', round(overall_score, 1)) || '/100) | Word Count: ' || word_count
  || ' | Structure Score: ' || printf('%.1f', structure_score) || '/100 | Readability Score: ' || printf('%.1f', readability_score) || '/100'
  || CASE WHEN len(issues) > 0 THEN ' | Issues: ' || array_to_string(issues, ', ') ELSE '' END
  || CASE WHEN len(warnings) > 0 THEN ' | Warnings: ' || array_to_string(warnings, ', ') ELSE '' END AS summary FROM scored""")
def quality_summary(spark, sf):
    return _assessed(spark, sf).select("page_id", qx.is_high_quality(F.col("quality_level")).alias("is_high_quality"), qx.quality_summary().alias("summary"))


_GATES = sp.PAGE_SCORES + f""", gated AS (SELECT *, length({sp.strip("replace(replace(replace(replace(main_content, 'advertisement', ''), 'popup', ''), 'cookie-notice', ''), 'newsletter', '')")}) AS clean_len FROM scored),
status AS (SELECT *, CASE WHEN title = '' OR main_content = '' THEN 'failed' WHEN overall_score < 40 OR word_count < 50 THEN 'skipped' WHEN clean_len < 10 THEN 'failed' ELSE 'completed' END AS status FROM gated)"""


@query("Q14_processing_gates", _GATES + """
SELECT page_id, status, CASE WHEN title = '' THEN 'Missing required element: title' WHEN main_content = '' THEN 'Missing required element: main_content' WHEN status = 'failed' THEN 'Insufficient content after processing' END AS error,
CASE WHEN title = '' OR main_content = '' THEN NULL WHEN overall_score < 40 THEN 'Quality score below threshold' WHEN word_count < 50 THEN 'Word count below minimum' WHEN word_count > 50000 THEN 'Word count exceeds maximum' END AS gate_warning FROM status""")
def processing_gates(spark, sf):
    return px.processing_gates(_assessed(spark, sf)).select("page_id", "status", "error", "gate_warning")


@query("Q15_processing_stats", _GATES + """
SELECT count(*) AS total_processed, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (quality_level = 'excellent') AS level_excellent, count(*) FILTER (quality_level = 'good') AS level_good, count(*) FILTER (quality_level = 'fair') AS level_fair,
count(*) FILTER (quality_level = 'poor') AS level_poor, count(*) FILTER (quality_level = 'very_poor') AS level_very_poor, round(avg(word_count), 4) AS avg_word_count FROM status""")
def processing_stats(spark, sf):
    return px.processing_stats(px.processing_gates(_assessed(spark, sf)))


@query("Q16_min_quality_filter", sp.PAGE_SCORES + " SELECT page_id, overall_score FROM scored WHERE overall_score >= 60 AND language <> 'xx'")
def min_quality_filter(spark, sf):
    scored = _assessed(spark, sf).select("page_id", "overall_score")
    return scale.keep_computed(scored, lambda r: r["overall_score"] >= 60)


@query("Q1_basic_metrics_pages", sp.PAGE_SCORES + " SELECT page_id, word_count, sentence_count, paragraph_count, title <> '' AS has_title, len(h1s) > 0 AS has_headings, description <> '' AS has_description FROM scored")
def basic_metrics_pages(spark, sf):
    return _assessed(spark, sf).select(
        "page_id", "word_count", "sentence_count", "paragraph_count", (F.col("title") != "").alias("has_title"),
        (F.size("headings") > 0).alias("has_headings"), (F.col("description") != "").alias("has_description"))
