"""Complexity, readability, category and constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import labels as lb
from pagemill.functions import text as tx
from pagemill.functions import urls as ux
from pagemill.operators import pages as px
from pagemill.operators import rules
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import docs
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q
from pagemill.plans.urls import SECTION_CTE, section_urls

_W, _S = sp.wc("text"), "len(string_split(text, '.'))"
_CHARS = f"length(regexp_replace(text, {q(tx.WS + '+')}, '', 'g'))"
_TECH = f"len(list_filter({sp.words('text')}, lambda w: lower(w) IN ({', '.join(map(q, lb.TECH_TERMS))})))"
_COMPLEX = f"least(1.0::DOUBLE, {_W} / {_S}::DOUBLE / 20 * 0.4::DOUBLE + {_CHARS} / greatest({_W}, 1)::DOUBLE / 10 * 0.3::DOUBLE + {_TECH} / greatest({_W}, 1)::DOUBLE * 0.3::DOUBLE)"
_SYL = f"list_sum(list_transform({sp.words('lower(text)')}, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CAST(ends_with(w, 'e') AS INT))))"
_FLESCH = f"CASE WHEN {_W} = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (206.835::DOUBLE - 1.015::DOUBLE * ({_W} / {_S}::DOUBLE) - 84.6::DOUBLE * ({_SYL} / {_W}::DOUBLE)) / 100)) END::DOUBLE"


@query("Q17_complexity_score", f"SELECT doc_id, round({_COMPLEX}, 6) AS complexity FROM documents")
def complexity(spark, sf):
    return lb.with_complexity(docs(spark, sf), "text").select("doc_id", F.round("complexity", 6).alias("complexity"))


@query("Q18_flesch_readability", f"SELECT doc_id, round({_FLESCH}, 6) AS readability FROM documents")
def flesch(spark, sf):
    return lb.with_complexity(docs(spark, sf), "text", True).select("doc_id", F.round("readability", 6).alias("readability"))


def _cat_sql(content: str, title: str, url: str | None) -> str:
    low = f"lower({content})"
    by_url = "" if url is None else " ".join(f"WHEN {sp.any_of(f'lower({url})', ps)} THEN {q(n)}" for n, ps in lb.URL_CATEGORIES)
    by_text = " ".join(f"WHEN {sp.any_of(low, ks)} OR {sp.any_of(f'lower({title})', ks)} THEN {q(n)}" for n, ks in lb.CATEGORIES)
    return f"CASE {by_url} {by_text} ELSE 'general' END"


_DOC_CAT = _cat_sql("text", "''", None)
_CONF = "least(1.0, CASE cat " + " ".join(f"WHEN {q(n)} THEN {sp.hit_sum('lower(text)', ks)} / {len(ks)}::DOUBLE + 0.3::DOUBLE" for n, ks in lb.CATEGORIES) + " ELSE 0.3 END)::DOUBLE"


def _category():
    return lb.categorize(F.col("text"), F.lit(""), F.lit(""))


@query("Q19_categorize_content", f"SELECT doc_id, {_DOC_CAT} AS category FROM documents")
def categorize(spark, sf):
    return docs(spark, sf).select("doc_id", _category().alias("category"))


_SEC_PAGES = "WITH " + SECTION_CTE + ", " + sp.PAGES_CTE + ", sp AS (SELECT rec.page_id, rec.title, rec.main_content, rec.h1s, sec.url FROM rec JOIN sec USING (page_id))"


def section_records(spark, sf):
    """Page records whose URL is moved below a documentation section, in one pass."""
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    r = px.extract_basic(p)
    lang, seg = F.regexp_extract("url", r"^[^:]+://[^/]+/([a-z]+)/", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    section = F.when(lang == "en", "integrations/builtin/").when(lang == "fr", "release-notes/0-x/").when(lang == "de", "hosting/installation/").otherwise("flow-logic/")
    return r.withColumn("url", F.concat(F.lit("https://site.example.com/"), section, lang, F.lit("-"), seg))


@query("Q19_categorize_pages", _SEC_PAGES + f" SELECT page_id, {_cat_sql('main_content', 'title', 'url')} AS category FROM sp")
def categorize_pages(spark, sf):
    return section_records(spark, sf).select("page_id", lb.categorize(F.col("main_content"), F.col("title"), F.col("url")).alias("category"))


@query("Q20_primary_category", f"WITH c AS (SELECT doc_id, text, {_DOC_CAT} AS cat FROM documents) SELECT doc_id, cat AS category, round({_CONF}, 6) AS confidence FROM c")
def primary_category(spark, sf):
    return docs(spark, sf).withColumn("category", _category()).select(
        "doc_id", "category", F.round(lb.category_confidence(F.col("category"), F.col("text")), 6).alias("confidence"))


_SECONDARY = "list_filter([" + ", ".join(f"CASE WHEN {sp.any_of('lower(text)', ks)} THEN {q(n)} END" for n, ks in lb.CATEGORIES) + "], lambda x: x IS NOT NULL)"
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {sp.any_of('lower(text)', ps)} THEN {q(n)} END" for n, ps in lb.TAG_PATTERNS) + "], lambda x: x IS NOT NULL)"
_DIFF = f"CASE WHEN {_COMPLEX} < 0.3 THEN 'beginner' WHEN {_COMPLEX} < 0.7 THEN 'intermediate' ELSE 'advanced' END"
_TYPE = lambda c, t: f"CASE WHEN {sp.any_of(f'lower({t})', ('tutorial', 'how to'))} THEN 'tutorial' WHEN {sp.any_of(f'lower({t})', ('reference', 'api'))} THEN 'reference' WHEN {sp.any_of(f'lower({c})', ('example', 'sample'))} THEN 'example' WHEN {sp.any_of(f'lower({c})', ('troubleshoot', 'error'))} THEN 'troubleshooting' ELSE 'documentation' END"


@query("Q21_secondary_categories", f"SELECT doc_id, array_to_string({_SECONDARY}, '|') AS categories FROM documents")
def secondary(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(lb.secondary_categories(F.col("text")), "|").alias("categories"))


@query("Q22_content_tags", f"SELECT doc_id, array_to_string({_TAGS}, '|') AS tags FROM documents")
def content_tags(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(lb.content_tags(F.col("text")), "|").alias("tags"))


@query("Q23_difficulty_level", f"SELECT doc_id, {_DIFF} AS difficulty FROM documents")
def difficulty(spark, sf):
    return lb.with_complexity(docs(spark, sf), "text").select("doc_id", lb.difficulty(F.col("complexity")).alias("difficulty"))


@query("Q24_content_type", "WITH " + sp.PAGES_CTE + f" SELECT page_id, {_TYPE('main_content', 'title')} AS content_type FROM rec")
def content_type(spark, sf):
    return section_records(spark, sf).select("page_id", lb.content_type(F.col("main_content"), F.col("title")).alias("content_type"))


_Q01 = f"""least(1.0, greatest(0.0, (CASE WHEN {_W} < 500 THEN least(1.0, {_W} / 500.0::DOUBLE) ELSE least(1.0, 2000.0::DOUBLE / {_W}) END) * 0.3::DOUBLE + ({_FLESCH}) * 0.25::DOUBLE + 0 + 0.5::DOUBLE * 0.15::DOUBLE + (1 - abs({_COMPLEX} - 0.5::DOUBLE)) * 0.1::DOUBLE))"""


def _analysis(spark, sf):
    d = lb.with_complexity(docs(spark, sf), "text", True)
    return d.withColumn("quality", lb.quality_0_1(F.col("n_words"), F.col("readability"), F.col("complexity"), F.lit(0), F.lit(0.0)))


@query("Q25_quality_0_1", f"SELECT doc_id, round({_Q01}, 6) AS quality FROM documents")
def quality01(spark, sf):
    return _analysis(spark, sf).select("doc_id", F.round("quality", 6).alias("quality"))


@query("Q26_analyze_content", f"""WITH c AS (SELECT *, {_DOC_CAT} AS cat FROM documents) SELECT doc_id, round({_COMPLEX}, 6) AS complexity, round({_FLESCH}, 6) AS readability, round({_Q01}, 6) AS quality,
CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary, cat AS primary_category, round({_CONF}, 6) AS confidence, array_to_string({_SECONDARY}, '|') AS secondary_categories, array_to_string({_TAGS}, '|') AS tags, {_DIFF} AS difficulty_level, {_TYPE('text', "''")} AS content_type FROM c""")
def analyze(spark, sf):
    c = F.col("text")
    d = _analysis(spark, sf).withColumn("primary_category", _category())
    return d.select(
        "doc_id", *[F.round(n, 6).alias(n) for n in ("complexity", "readability", "quality")], tx.lead_summary(c).alias("summary"), "primary_category",
        F.round(lb.category_confidence(F.col("primary_category"), c), 6).alias("confidence"), F.array_join(lb.secondary_categories(c), "|").alias("secondary_categories"),
        F.array_join(lb.content_tags(c), "|").alias("tags"), lb.difficulty(F.col("complexity")).alias("difficulty_level"), lb.content_type(c, F.lit("")).alias("content_type"))


@query("Q27_kb_quality_score", """WITH s AS (SELECT source, avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END) AS completeness, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS freshness, avg(CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END) AS coverage,
avg(CASE WHEN lang = 'de' THEN quality END) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(CASE WHEN accuracy IS NULL THEN (completeness + freshness + coverage) / 3 ELSE (completeness + freshness + coverage + accuracy) / 4 END, 6) AS score FROM s""")
def kb_quality(spark, sf):
    """Shares per source stand for the four parts; labels give the optional one."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = d.groupBy("source").agg(
        F.avg((F.col("n_chars") >= 500).cast("double")).alias("c"), F.avg((F.col("lang") == "en").cast("double")).alias("f"),
        F.avg((F.length("text") > 0).cast("double")).alias("v"), F.avg(F.when(F.col("lang") == "de", F.col("quality"))).alias("a"))
    return s.select("source", F.round(lb.mean_of_present(F.col("c"), F.col("f"), F.col("v"), F.col("a")), 6).alias("score"))


@query("Q28_normalize_score", "SELECT p_partkey, CASE WHEN p_retailprice > 1 THEN least(p_retailprice / 100.0::DOUBLE, 1.0) ELSE p_retailprice END::DOUBLE AS price_score, CASE WHEN p_size > 1 THEN least(p_size / 100.0::DOUBLE, 1.0) ELSE p_size END::DOUBLE AS size_score FROM part")
def normalize_score(spark, sf):
    return table(spark, sf, "part").select("p_partkey", lb.normalize_0_100(F.col("p_retailprice")).alias("price_score"), lb.normalize_0_100(F.col("p_size").cast("double")).alias("size_score"))


_LOW = "lower(main_content)"
_MENTIONS = f"len(list_filter(regexp_extract_all({_LOW}, {q(tx.WORD_CHAR + '+')}), lambda w: w = 'node'))"


@query("Q29_page_type_metadata", "WITH " + sp.PAGES_CTE + f""" SELECT page_id, CASE WHEN contains({_LOW}, 'trigger node') THEN 'trigger' WHEN contains({_LOW}, 'regular node') THEN 'regular' END AS node_type,
{sp.any_of(_LOW, lb.CREDENTIAL_WORDS)} AS credentials_required, array_to_string(list_filter(h1s, lambda h: {sp.any_of('lower(h)', lb.OPERATION_WORDS)}), '|') AS operations,
contains({_LOW}, 'workflow.json') OR contains(main_content, '"nodes":') AS has_workflow_json, CASE WHEN {_MENTIONS} > 10 THEN {_MENTIONS} ELSE 0 END AS node_count,
CASE WHEN {_MENTIONS} > 20 THEN 'complex' WHEN {_MENTIONS} > 10 THEN 'medium' ELSE 'simple' END AS workflow_complexity, array_to_string(list_filter(h1s, lambda h: {sp.any_of('lower(h)', lb.USE_CASE_WORDS)}), '|') AS use_cases,
array_to_string(list_sort(list_distinct(regexp_extract_all(main_content, {q(lb.HTTP_METHODS)}, 1))), '|') AS methods, array_to_string(list_sort(list_distinct(regexp_extract_all(main_content, {q(lb.ENDPOINT)}))), '|') AS endpoints,
array_to_string(list_filter([CASE WHEN contains({_LOW}, 'json') THEN 'json' END, CASE WHEN contains({_LOW}, 'xml') THEN 'xml' END], lambda x: x IS NOT NULL), '|') AS response_formats FROM rec""")
def page_type_metadata(spark, sf):
    r = section_records(spark, sf)
    m = lb.page_type_metadata(F.col("main_content"), F.transform("headings", lambda h: h["text"]))
    arrays = ("operations", "use_cases", "methods", "endpoints", "response_formats")
    return r.select("page_id", *[(F.array_join(c, "|") if n in arrays else c).alias(n) for n, c in m.items()])


_KIND = f"CASE {' '.join(f'WHEN regexp_matches(lower(p), {q(pat)}) THEN {q(n)}' for n, pat in ux.PATH_RULES)} ELSE 'other' END"


@query("Q30_min_length_by_type", _SEC_PAGES + f", k AS (SELECT page_id, length(main_content) AS n, regexp_extract(url, '^[^:]+://[^/]+(/.*)', 1) AS p FROM sp) SELECT page_id, {_KIND} = 'integration' AS is_integration, n AS content_length FROM k WHERE n >= CASE {_KIND} WHEN 'integration' THEN 200 WHEN 'tutorial' THEN 500 ELSE 100 END")
def min_length(spark, sf):
    r = section_records(spark, sf).select("page_id", F.length("main_content").cast("long").alias("content_length"), ux.classify_path(F.col("url")).alias("kind"))
    kept = scale.keep_computed(r, lambda x: lb.long_enough(x["content_length"], x["kind"]))
    return kept.select("page_id", (F.col("kind") == "integration").alias("is_integration"), "content_length")


@query("Q31_constraint_checks", """SELECT 'lang_in_set' AS rule, count(*) FILTER (NOT lang IN ('en', 'fr', 'de')) AS violations FROM documents UNION ALL SELECT 'content_length', count(*) FILTER (NOT length(text) <= 10000) FROM documents
UNION ALL SELECT 'n_chars_not_negative', count(*) FILTER (NOT n_chars >= 0) FROM documents UNION ALL SELECT 'english_needs_source', count(*) FILTER (lang = 'en' AND source IS NULL) FROM documents
UNION ALL SELECT 'unique_source_text', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY source, text HAVING count(*) > 1)
UNION ALL SELECT 'unique_text', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)""")
def constraint_checks(spark, sf):
    d = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    checks = {
        "lang_in_set": F.col("lang").isin("en", "fr", "de"), "content_length": F.length("text") <= 10000, "n_chars_not_negative": F.col("n_chars") >= 0,
        "english_needs_source": (F.col("lang") != "en") | F.col("source").isNotNull(),
    }
    return rules.violation_counts(d, checks, {"unique_source_text": ["source", "h"], "unique_text": ["h"]})
