"""Content quality scores: per-row Column expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

# Boilerplate phrases, each with a literal stem tested first.
BOILERPLATE = (
    ("copyright", r"copyright\s+\d{4}"),
    ("rights", r"all\s+rights\s+reserved"),
    ("privacy", r"privacy\s+policy"),
    ("terms", r"terms\s+of\s+service"),
    ("cookie", r"cookie\s+policy"),
    ("subscribe", r"subscribe\s+to\s+newsletter"),
    ("follow", r"follow\s+us\s+on"),
    ("share", r"share\s+this\s+article"),
    ("related", r"related\s+articles"),
    ("might", r"you\s+might\s+also\s+like"),
    ("advertisement", r"advertisement"),
    ("sponsored", r"sponsored\s+content"),
)

# Noise phrases; the first counts only the characters of its group.
NOISE = (
    ("here", r"\b(click|tap)\s+here\b", 1),
    ("more", r"\bread\s+more\b", 0),
    ("more", r"\blearn\s+more\b", 0),
    ("also", r"\bsee\s+also\b", 0),
    ("all", r"\bview\s+all\b", 0),
    ("more", r"\bshow\s+more\b", 0),
    ("more", r"\bload\s+more\b", 0),
    ("page", r"\bnext\s+page\b", 0),
    ("page", r"\bprevious\s+page\b", 0),
)

# Words that mark technical text.
TECHNICAL = (
    "api", "function", "method", "class", "variable", "parameter", "return", "example",
    "tutorial", "guide", "documentation", "install", "configure", "setup",
)

# Level thresholds and weights of the overall score.
LEVELS = ((85.0, "excellent"), (70.0, "good"), (55.0, "fair"), (40.0, "poor"))
WEIGHTS = (
    ("content_length", 0.15), ("readability", 0.25), ("structure", 0.20),
    ("uniqueness", 0.15), ("completeness", 0.15), ("technical", 0.10),
)


def matched_chars(c: Column, stem: str, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.when(c.contains(stem), F.length(F.array_join(found, ""))).otherwise(0)


def score_length(n_words: Column) -> Column:
    return (
        F.when(n_words < 50, 10.0).when(n_words < 150, 30.0).when(n_words < 300, 60.0)
        .when(n_words <= 2000, 100.0).when(n_words <= 5000, 80.0).otherwise(60.0)
    )


def score_readability(text: Column, n_words: Column, n_sentences: Column, n_paragraphs: Column,
                      has_headings: Column) -> Column:
    per_sentence = tx.word_count(F.regexp_replace(text, tx.SENTENCE_END, " ")) / n_sentences
    per_paragraph = n_words / n_paragraphs
    long_share = tx.count_matches(text, tx.WORD_CHAR + "{10,}") / n_words
    sentence = (
        F.when(n_sentences == 0, 0.0).when(per_sentence.between(10, 25), 30.0)
        .when(per_sentence.between(8, 30), 20.0).otherwise(10.0)
    )
    paragraph = (
        F.when(n_paragraphs == 0, 0.0).when(per_paragraph.between(30, 200), 25.0)
        .when(per_paragraph.between(20, 300), 15.0).otherwise(5.0)
    )
    long_words = F.when(n_words == 0, 0.0).when(long_share < 0.1, 25.0).when(long_share < 0.2, 15.0).otherwise(5.0)
    total = sentence + paragraph + long_words + F.when(has_headings, 20.0).otherwise(0.0)
    return F.when(text == "", 0.0).otherwise(F.least(total, F.lit(100.0)))


def heading_hierarchy_ok(levels: Column) -> Column:
    """First level at most 2 and no step down by more than one level."""
    steps = F.zip_with(F.slice(levels, 2, F.size(levels)), levels, lambda nxt, cur: F.coalesce(nxt - cur, F.lit(0)))
    return F.when(F.size(levels) == 0, False).otherwise((F.try_element_at(levels, F.lit(1)) <= 2) & F.forall(steps, lambda d: d <= 1))


def _points(*pairs: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for test, value in pairs:
        total = total + F.when(test, value).otherwise(0.0)
    return F.least(total, F.lit(100.0))


def score_structure(title: Column, description: Column, levels: Column, lists: Column, tables: Column,
                    author: Column, published: Column, tags: Column) -> Column:
    return _points(
        (title != "", 20.0), (tx.word_count(title).between(10, 15), 10.0), (description != "", 15.0),
        (F.size(levels) > 0, 20.0), (heading_hierarchy_ok(levels), 15.0), (lists, 10.0), (tables, 10.0),
        (author, 5.0), (published, 5.0), (tags, 5.0),
    )


def boilerplate_ratio(lowered: Column) -> Column:
    total = F.lit(0)
    for stem, pattern in BOILERPLATE:
        total = total + matched_chars(lowered, stem, pattern)
    return F.when(lowered == "", 0.0).otherwise(total / F.length(lowered))


def duplicate_ratio(lowered: Column) -> Column:
    pieces = tx.segments(lowered)
    distinct = F.size(F.array_distinct(F.transform(F.filter(pieces, tx.not_blank), tx.strip)))
    return F.when(lowered == "", 0.0).otherwise(1 - distinct / F.size(pieces))


def score_uniqueness(lowered: Column, boilerplate: Column, duplicate: Column) -> Column:
    return F.when(lowered == "", 0.0).otherwise(F.greatest(100 - boilerplate * 50 - duplicate * 30, F.lit(0.0)))


def score_completeness(title: Column, text: Column, n_words: Column, description: Column, has_headings: Column,
                       author: Column, published: Column, tags: Column) -> Column:
    body = F.when(n_words >= 100, 40.0).when(text != "", 20.0).otherwise(0.0)
    return _points((title != "", 25.0), (description != "", 10.0), (has_headings, 10.0),
                   (author, 5.0), (published, 5.0), (tags, 5.0)) + body


def score_technical(lowered: Column, code: Column, tables: Column) -> Column:
    terms = F.lit(0)
    for word in TECHNICAL:
        terms = terms + tx.has_word(lowered, word).cast("int")
    noise = F.lit(0)
    for stem, pattern, group in NOISE:
        noise = noise + matched_chars(lowered, stem, pattern, group)
    raw = (
        F.lit(50.0) + F.when(terms >= 5, 30.0).when(terms >= 3, 20.0).when(terms >= 1, 10.0).otherwise(0.0)
        + F.when(code, 20.0).otherwise(0.0) + F.when(tables, 10.0).otherwise(0.0) - noise / F.length(lowered) * 30
    )
    return F.when(lowered == "", 0.0).otherwise(F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)))


def score_overall(df_cols: dict[str, Column] | None = None) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS:
        part = df_cols[name] if df_cols else F.col(f"{name}_score")
        total = total + part * weight
    return F.round(total, 2)


def quality_level(score: Column) -> Column:
    level = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for threshold, name in LEVELS[1:]:
        level = level.when(score >= threshold, name)
    return level.otherwise("very_poor")


def _texts(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in pairs]))


def assess(df: DataFrame, text: str = "main_content", title: str | None = "title", description: str | None = "description",
           levels: str | None = "heading_levels", lists: str | None = None, tables: str | None = None,
           code: str | None = None, author: str | None = None, published: str | None = None,
           tags: str | None = None) -> DataFrame:
    """All metrics, scores, the level, issues and warnings as added columns.

    Names that are None stand for absent elements. Narrow: no shuffle.
    """
    yes_no = lambda name: F.lit(False) if name is None else F.coalesce(F.col(name), F.lit(False))
    string = lambda name: F.lit("") if name is None else F.coalesce(F.col(name), F.lit(""))
    lv = F.array().cast("array<bigint>") if levels is None else F.col(levels)
    t, low = F.col(text), F.col("_low")
    author_c, published_c, tags_c = yes_no(author), yes_no(published), yes_no(tags)
    base = df.withColumns({
        "_low": F.lower(t), "word_count": tx.word_count(t), "sentence_count": tx.sentence_count(t),
        "paragraph_count": tx.paragraph_count(t), "_has_headings": F.size(lv) > 0,
    }).withColumns({
        "avg_sentence_length": F.when(F.col("sentence_count") > 0, F.col("word_count") / F.col("sentence_count")).otherwise(0.0),
        "avg_paragraph_length": F.when(F.col("paragraph_count") > 0, F.col("sentence_count") / F.col("paragraph_count")).otherwise(0.0),
        "boilerplate_ratio": boilerplate_ratio(low), "duplicate_content_ratio": duplicate_ratio(low),
        "content_length_score": score_length(F.col("word_count")),
        "readability_score": score_readability(t, F.col("word_count"), F.col("sentence_count"), F.col("paragraph_count"), F.col("_has_headings")),
        "structure_score": score_structure(string(title), string(description), lv, yes_no(lists), yes_no(tables), author_c, published_c, tags_c),
        "completeness_score": score_completeness(string(title), t, F.col("word_count"), string(description), F.col("_has_headings"), author_c, published_c, tags_c),
        "technical_score": score_technical(low, yes_no(code), yes_no(tables)),
    }).withColumn("uniqueness_score", score_uniqueness(low, F.col("boilerplate_ratio"), F.col("duplicate_content_ratio")))
    return base.withColumn("overall_score", score_overall()).withColumns({
        "quality_level": quality_level(F.col("overall_score")),
        "issues": _texts(
            (string(title) == "", "Missing title"), (F.col("word_count") < 50, "Insufficient content length"),
            (F.col("boilerplate_ratio") > 0.3, "High boilerplate content ratio"),
            (F.col("duplicate_content_ratio") > 0.5, "High duplicate content ratio")),
        "warnings": _texts(
            (string(description) == "", "Missing description"), (~F.col("_has_headings"), "No headings found - poor structure"),
            (F.col("avg_sentence_length") > 30, "Sentences too long - poor readability"),
            (F.col("avg_sentence_length") < 8, "Sentences too short - choppy reading"),
            (~author_c, "Missing author information"), (~published_c, "Missing publication date")),
    }).drop("_low", "_has_headings")


def is_high_quality(level: Column) -> Column:
    return level.isin("excellent", "good")


def quality_summary() -> Column:
    one = lambda name: F.format_string("%.1f", F.round(F.col(name), 1))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Overall Quality: "), F.when(F.col("quality_level") == "very_poor", "Very_Poor").otherwise(F.initcap("quality_level")),
                 F.lit(" ("), one("overall_score"), F.lit("/100)")),
        F.concat(F.lit("Word Count: "), F.col("word_count").cast("string")),
        F.concat(F.lit("Structure Score: "), one("structure_score"), F.lit("/100")),
        F.concat(F.lit("Readability Score: "), one("readability_score"), F.lit("/100")),
        F.when(F.size("issues") > 0, F.concat(F.lit("Issues: "), F.array_join("issues", ", "))),
        F.when(F.size("warnings") > 0, F.concat(F.lit("Warnings: "), F.array_join("warnings", ", "))),
    )
