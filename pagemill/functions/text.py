"""Column functions over plain text: whitespace, words, sentences, statistics."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.split() and \s treat as blank, and the
# letter, digit and underscore class; both spelled so Java and RE2 read them alike.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
SENTENCE_END = r"[.!?]+"
SENTENCE_BREAK = r"[.!?]+" + WS + "+"
PARAGRAPH_BREAK = r"\n" + WS + r"*\n"

# Patterns of the text cleaner ('|' inside the mail suffix is literal).
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = r"https?://" + NOT_WS + "+"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"

# Entities decoded without Python; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def squash(c: Column) -> Column:
    """Every run of whitespace becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def not_blank(c: Column) -> Column:
    return c.rlike(NOT_WS)


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(T.StringType())
def unescape_all(texts: pd.Series) -> pd.Series:
    """Full HTML entity table, for text that goes beyond the common ones."""
    return texts.map(html.unescape, na_action="ignore")


# Entities beyond the common ones.
OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in ENTITIES) + ");)(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]{1,31};)"


def decode_all(c: Column) -> Column:
    """Every HTML entity; only texts with one beyond the common ones go to Python."""
    rare = c.rlike(OTHER_ENTITY)
    return F.when(rare, unescape_all(F.when(rare, c))).otherwise(decode_entities(c))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form; Catalyst has no such function."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def segments(c: Column) -> Column:
    """All pieces between sentence ends, the empty tail included."""
    return F.split(c, SENTENCE_END)


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(segments(c), not_blank)).cast("long")


def paragraph_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n\n"), not_blank)).cast("long")


def clean_text(c: Column, remove_html: bool = True, normalize_whitespace: bool = True,
               preserve_urls: bool = False, preserve_emails: bool = False,
               full_entities: bool = True) -> Column:
    c = decode_all(c) if full_entities else decode_entities(c)
    if remove_html:
        c = F.regexp_replace(c, TAG_PATTERN, " ")
    if not preserve_urls:
        c = F.regexp_replace(c, URL_PATTERN, "[URL]")
    if not preserve_emails:
        # the literal test keeps the costly pattern away from texts without an '@'
        c = F.when(c.contains("@"), F.regexp_replace(c, EMAIL_PATTERN, "[EMAIL]")).otherwise(c)
    if normalize_whitespace:
        c = F.regexp_replace(c, WS + "+", " ")
    return strip(c)


def clean_knowledge_text(c: Column) -> Column:
    return squash(F.regexp_replace(F.regexp_replace(c, WS + "+", " "), TAG_PATTERN, ""))


# Literal words removed from processed text, case-sensitive.
BLOCKED_WORDS = ("advertisement", "popup", "cookie-notice", "newsletter")


def clean_processed_text(c: Column, blocked: tuple[str, ...] = BLOCKED_WORDS, normalize: bool = True) -> Column:
    c = squash(c)
    for word in blocked:
        c = F.replace(c, F.lit(word), F.lit(""))
    return nfkc(c) if normalize else c


def content_hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def reading_minutes(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words / 200)).cast("long")


def detect_language_simple(c: Column) -> Column:
    ascii_share = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.length(c)
    return F.when(F.length(c) == 0, "unknown").when(ascii_share > 0.9, "en").otherwise("unknown")


def chars_in_words(c: Column) -> Column:
    """Characters outside whitespace: the summed word lengths."""
    return F.length(F.regexp_replace(c, WS + "+", ""))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def text_metadata(c: Column) -> dict[str, Column]:
    return {
        "char_count": F.length(c).cast("long"),
        "word_count": word_count(c),
        "line_count": count_matches(c, "\n") + 1,
        "paragraph_count": count_matches(c, PARAGRAPH_BREAK) + 1,
        "sentence_count": count_matches(c, SENTENCE_BREAK) + 1,
        "has_urls": c.contains("://") & c.rlike(URL_PATTERN),
        "has_emails": c.contains("@") & c.rlike(EMAIL_PATTERN),
        "has_html": c.contains("<") & c.rlike(TAG_PATTERN),
        "urls": F.when(c.contains("://"), F.regexp_extract_all(c, F.lit(URL_PATTERN), F.lit(0)))
        .otherwise(F.array().cast("array<string>")),
        "emails": F.when(c.contains("@"), F.regexp_extract_all(c, F.lit(EMAIL_PATTERN), F.lit(0)))
        .otherwise(F.array().cast("array<string>")),
        "language": detect_language_simple(c),
    }


def text_statistics(c: Column) -> dict[str, Column]:
    n_words = word_count(c)
    n_sent = count_matches(c, SENTENCE_BREAK) + 1
    n_par = count_matches(c, PARAGRAPH_BREAK) + 1
    return {
        "total_characters": F.length(c).cast("long"),
        "total_words": n_words,
        "total_sentences": n_sent,
        "total_paragraphs": n_par,
        "avg_word_length": F.round(F.when(n_words > 0, chars_in_words(c) / n_words).otherwise(0.0), 2),
        "avg_sentence_length": F.round(n_words / n_sent, 2),
        "avg_paragraph_length": F.round(n_words / n_par, 2),
    }


def readability_simple(c: Column) -> Column:
    n_words = word_count(c)
    n_sent = count_matches(c, SENTENCE_BREAK) + 1
    raw = 100 - 1.5 * (n_words / n_sent) - 2.0 * (chars_in_words(c) / n_words)
    return F.when(n_words == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def lead_summary(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def has_word(c: Column, word: str) -> Column:
    """Whole-word test on Unicode word characters, behind a cheap substring test."""
    return c.contains(word) & c.rlike(f"(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])")


def contains_any(c: Column, needles) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def hits(c: Column, needles) -> Column:
    total = F.lit(0)
    for needle in needles:
        total = total + c.contains(needle).cast("int")
    return total
