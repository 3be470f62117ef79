"""Word counts per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import text as tx

# Stop words of the keyword report.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how",
    "man", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she", "too", "use", "this", "that", "with",
    "have", "from", "they", "know", "want", "been", "good", "much", "some", "time", "very", "when", "come", "here", "just", "like", "long", "make",
    "many", "over", "such", "take", "than", "them", "well", "were", "will", "would", "there", "could", "other", "after", "first", "little", "only",
    "right", "think", "where", "being", "every", "great", "might", "shall", "still", "those", "under", "while",
)

# Stop words of the topic report.
TOPIC_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)


def ascii_words(c: Column) -> Column:
    """Whole words made of ASCII letters only, lower case, three letters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(tx.WORD_CHAR + "+"), F.lit(0)), lambda w: w.rlike("^[a-z]{3,}$"))


def top_terms(df: DataFrame, key: str, terms: Column, stop_words: list[str], n: int, min_len: int = 4) -> DataFrame:
    """n most frequent terms per key, ties by first place.

    Counts combine before the shuffle (the terms of a document sit in one task)
    and the rank filter runs below the second exchange.
    """
    kept = scale.rows_of(df, [key], terms, "term", "pos").filter((F.length("term") >= min_len) & ~F.col("term").isin(*stop_words))
    counted = kept.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    ranked = scale.top_n_per_key(counted, [key], [F.col("n").desc(), F.col("first_pos")], n)
    return ranked.select(key, F.col("rank").cast("long").alias("rank"), "term", "n")


def top_keywords(df: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    return top_terms(df, key, ascii_words(F.col(text)), STOP_WORDS, n)


def top_topics(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    return top_terms(df, key, tx.words(F.lower(F.col(text))), TOPIC_STOP_WORDS, n)
