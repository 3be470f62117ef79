"""Labels, categories and small scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

# Words of the complexity score.
TECH_TERMS = ("api", "webhook", "node", "workflow", "json", "http", "authentication")

# Categories in order with their keywords.
CATEGORIES = (
    ("getting-started", ("introduction", "setup", "installation", "quickstart")),
    ("nodes", ("node", "integration", "service", "api", "webhook")),
    ("workflows", ("workflow", "automation", "trigger", "execution")),
    ("advanced", ("code", "expression", "function", "custom")),
    ("hosting", ("deployment", "docker", "kubernetes", "cloud")),
    ("troubleshooting", ("error", "debug", "issue", "problem", "fix")),
)
URL_CATEGORIES = (
    ("getting-started", ("/getting-started", "/quickstart")), ("nodes", ("/nodes/", "/integrations/")), ("workflows", ("/workflows/", "/automation/")),
    ("advanced", ("/code/", "/expressions/")), ("hosting", ("/hosting/", "/deployment/")),
)

# Tags by substring.
TAG_PATTERNS = (
    ("webhook", ("webhook", "http trigger")), ("api", ("api", "rest", "endpoint")), ("database", ("database", "sql", "mongodb")),
    ("email", ("email", "smtp", "mail")), ("automation", ("automation", "trigger", "schedule")), ("javascript", ("javascript", "js", "code node")),
    ("json", ("json", "data transformation")), ("error-handling", ("error", "try", "catch", "exception")),
)

# Workflow categories in order with their keywords.
KEYWORD_CATEGORIES = (
    ("email", ("email", "gmail", "outlook", "smtp", "imap")), ("communication", ("slack", "discord", "telegram", "whatsapp", "teams")),
    ("crm", ("hubspot", "salesforce", "pipedrive", "zoho")), ("ecommerce", ("shopify", "woocommerce", "stripe", "paypal")),
    ("cloud", ("aws", "azure", "gcp", "google cloud")), ("data", ("database", "mysql", "postgres", "mongodb", "airtable")),
    ("monitoring", ("prometheus", "grafana", "datadog", "newrelic")), ("api", ("rest", "graphql", "webhook", "http request")),
    ("automation", ("cron", "schedule", "trigger", "automation")), ("social", ("twitter", "facebook", "linkedin", "instagram")),
    ("productivity", ("notion", "trello", "asana", "jira")),
)


def first_label(pairs, test, default: str) -> Column:
    chain = None
    for name, needles in pairs:
        t = test(needles)
        chain = F.when(t, name) if chain is None else chain.when(t, name)
    return chain.otherwise(default)


# Whole-text forms of the per-word syllable rule: vowel runs, words ending in e,
# words without a vowel, and words whose only vowel run ends in e at the word's end.
_OUTSIDE = r"(?<![^\s\x0b\x1c-\x1f\x{85}\p{Z}])"
_END = r"(?![^\s\x0b\x1c-\x1f\x{85}\p{Z}])"
_CONSONANT = r"[^aeiouy\s\x0b\x1c-\x1f\x{85}\p{Z}]"
VOWELS = "[aeiouy]+"
FINAL_E = "e" + _END
NO_VOWEL = _OUTSIDE + _CONSONANT + "+" + _END
ONE_FINAL_RUN = _OUTSIDE + _CONSONANT + "*[aeiouy]*e" + _END


def syllables(low: Column) -> Column:
    """Sum over the words of max(1, vowel runs - 1 if the word ends in e), in four
    scans of the text and without a step per word."""
    n = lambda p: F.regexp_count(low, F.lit(p))
    return n(VOWELS) - n(FINAL_E) + n(NO_VOWEL) + n(ONE_FINAL_RUN)


def with_complexity(df: DataFrame, text: str, readability: bool = False) -> DataFrame:
    """Adds n_words, complexity and, if asked, readability; helpers are computed once."""
    c, low = F.col(text), F.col("_low")
    n_dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    terms = F.lit(0)
    for t in TECH_TERMS:
        count = F.regexp_count(low, F.lit(_OUTSIDE + t + _END))
        terms = terms + F.when(low.contains(t), count).otherwise(0)
    helpers = {"_low": F.lower(c), "n_words": tx.word_count(c), "_ns": n_dots + 1, "_chars": tx.chars_in_words(c)}
    n = F.greatest("n_words", F.lit(1))
    score = F.least(F.lit(1.0), F.col("n_words") / F.col("_ns") / 20 * 0.4 + F.col("_chars") / n / 10 * 0.3 + terms / n * 0.3)
    out = df.withColumns(helpers).withColumn("complexity", score)
    if readability:
        raw = 206.835 - 1.015 * (F.col("n_words") / F.col("_ns")) - 84.6 * (syllables(low) / F.col("n_words"))
        out = out.withColumn("readability", F.when(F.col("n_words") == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / 100))))
    return out.drop("_low", "_ns", "_chars")


def categorize(content: Column, title: Column, url: Column) -> Column:
    by_url = first_label(URL_CATEGORIES, lambda ps: tx.contains_any(F.lower(url), ps), "")
    low, t = F.lower(content), F.lower(title)
    by_text = first_label(CATEGORIES, lambda ks: tx.contains_any(low, ks) | tx.contains_any(t, ks), "general")
    return F.when(by_url != "", by_url).otherwise(by_text)


def category_confidence(category: Column, content: Column) -> Column:
    low = F.lower(content)
    score = F.lit(0.3)
    for name, keywords in CATEGORIES:
        score = F.when(category == name, tx.hits(low, keywords) / len(keywords) + 0.3).otherwise(score)
    return F.least(F.lit(1.0), score)


def secondary_categories(content: Column, n: int | None = None) -> Column:
    """Labels in the order of the categories: all, or the first n."""
    low = F.lower(content)
    found = F.array_compact(F.array(*[F.when(tx.contains_any(low, ks), name) for name, ks in CATEGORIES]))
    return found if n is None else F.slice(found, 1, n)


def content_tags(content: Column) -> Column:
    low = F.lower(content)
    return F.array_compact(F.array(*[F.when(tx.contains_any(low, ps), tag) for tag, ps in TAG_PATTERNS]))


def difficulty(complexity: Column) -> Column:
    return F.when(complexity < 0.3, "beginner").when(complexity < 0.7, "intermediate").otherwise("advanced")


def content_type(content: Column, title: Column) -> Column:
    low, t = F.lower(content), F.lower(title)
    return (
        F.when(tx.contains_any(t, ("tutorial", "how to")), "tutorial").when(tx.contains_any(t, ("reference", "api")), "reference")
        .when(tx.contains_any(low, ("example", "sample")), "example").when(tx.contains_any(low, ("troubleshoot", "error")), "troubleshooting")
        .otherwise("documentation")
    )


def quality_0_1(n_words: Column, readability: Column, complexity: Column, entity_count: Column, sentiment: Column) -> Column:
    length = F.when(n_words < 500, F.least(F.lit(1.0), n_words / 500)).otherwise(F.least(F.lit(1.0), 2000 / n_words))
    raw = (
        length * 0.3 + readability * 0.25 + F.least(F.lit(1.0), entity_count / 10) * 0.2
        + F.greatest(F.lit(0.5), (sentiment + 1) / 2) * 0.15 + (1 - F.abs(complexity - 0.5)) * 0.1
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def mean_of_present(*scores: Column) -> Column:
    present = F.array_compact(F.array(*scores))
    return F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)


def normalize_0_100(c: Column) -> Column:
    return F.when(c > 1, F.least(c / 100.0, F.lit(1.0))).otherwise(c)


def keyword_category(content: Column) -> Column:
    low = F.lower(content)
    return first_label([(n.title(), ks) for n, ks in KEYWORD_CATEGORIES], lambda ks: tx.contains_any(low, ks), "General")


# Words of the page-type metadata.
CREDENTIAL_WORDS = ("credentials", "authentication", "api key", "token")
OPERATION_WORDS = ("create", "read", "update", "delete", "get", "post", "put")
USE_CASE_WORDS = ("use case", "example", "scenario")
HTTP_METHODS = r"(?:^|[^\p{L}\p{N}_])(GET|POST|PUT|DELETE|PATCH)(?:$|[^\p{L}\p{N}_])"
ENDPOINT = r"/api/[\p{L}\p{N}_/{}-]+"


def page_type_metadata(content: Column, heading_texts: Column) -> dict[str, Column]:
    low = F.lower(content)
    mentions = F.size(F.filter(F.regexp_extract_all(low, F.lit(tx.WORD_CHAR + "+"), F.lit(0)), lambda w: w == "node"))
    return {
        "node_type": F.when(low.contains("trigger node"), "trigger").when(low.contains("regular node"), "regular"),
        "credentials_required": tx.contains_any(low, CREDENTIAL_WORDS),
        "operations": F.filter(heading_texts, lambda h: tx.contains_any(F.lower(h), OPERATION_WORDS)),
        "has_workflow_json": low.contains("workflow.json") | content.contains('"nodes":'),
        "node_count": F.when(mentions > 10, mentions).otherwise(0).cast("long"),
        "workflow_complexity": F.when(mentions > 20, "complex").when(mentions > 10, "medium").otherwise("simple"),
        "use_cases": F.filter(heading_texts, lambda h: tx.contains_any(F.lower(h), USE_CASE_WORDS)),
        "methods": F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(HTTP_METHODS), F.lit(1)))),
        "endpoints": F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(ENDPOINT), F.lit(0)))),
        "response_formats": F.array_compact(F.array(F.when(low.contains("json"), "json"), F.when(low.contains("xml"), "xml"))),
    }


# Least content length per page type.
MIN_LENGTHS = {"integration": 200, "tutorial": 500}


def long_enough(length: Column, kind: Column) -> Column:
    limit = F.lit(100)
    for name, value in MIN_LENGTHS.items():
        limit = F.when(kind == name, value).otherwise(limit)
    return length >= limit
