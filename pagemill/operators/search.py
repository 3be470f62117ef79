"""Text search, ranking and result handling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import text as tx

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(tx.WORD_CHAR + "+"), F.lit(0))


def keyword_score(terms: list[str], title: Column, content: Column, tags: Column) -> Column:
    low_t, low_c, total = F.lower(title), F.lower(content), F.lit(0)
    for t in terms:
        total = total + low_t.contains(t).cast("int") * 3 + low_c.contains(t).cast("int") + F.array_contains(tags, t).cast("int") * 2
    return total


def keyword_search(df: DataFrame, query: str, key: str, n: int = 5) -> DataFrame:
    """df(key, title, content, tags): best n with a positive score, first rows first."""
    terms = query.lower().split()
    scored = df.withColumn("score", keyword_score(terms, F.col("title"), F.col("content"), F.col("tags")))
    return scored.orderBy(F.col("score").desc(), key).limit(n).filter("score > 0")


def confidence(n_hits: Column) -> Column:
    return F.when(n_hits == 0, 0.1).otherwise(F.least(F.lit(0.9), n_hits * 0.15 + 0.25))


def answer(hits: DataFrame, key: str, size: int = 500, least: float = 0.3) -> DataFrame:
    """Text of the few given hits, cut to size; a fixed message below the least confidence."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.concat(F.lit("**"), "title", F.lit("**\n"), F.substring("content", 1, 400), F.lit("...")).alias("t"))))
    one = hits.agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))
    sure = confidence(F.col("n"))
    return one.select(F.round(sure, 4).alias("confidence"), F.when(sure < least, "No sufficiently relevant answer was found.").otherwise(F.substring("text", 1, size)).alias("answer"))


def lookup_topic(df: DataFrame, word: str, key: str, n: int = 3, snippet: int = 500) -> DataFrame:
    w = word.lower()
    test = F.lower("title").contains(w) | F.lower("content").contains(w) | F.exists("tags", lambda t: F.lower(t).contains(w))
    return df.filter(test).orderBy(key).limit(n).select(key, "title", F.concat(F.substring("content", 1, snippet), F.lit("...")).alias("snippet"))


# Words that mark examples and good practice.
EXAMPLE_WORDS = ("workflow", "example", "tutorial")
PRACTICE_WORDS = ("best practice", "recommendation", "tip", "should", "avoid")


def lookup_words(df: DataFrame, words: list[str], key: str, n: int, snippet: int, title_words: tuple[str, ...] = ()) -> DataFrame:
    """First n rows holding any word and, if asked, one of the title words."""
    pattern = "|".join(re.escape(w.lower()) for w in words)
    found = df.filter(F.lower("content").rlike(pattern))
    if title_words:
        found = found.filter(tx.contains_any(F.lower("title"), title_words))
    return found.orderBy(key).limit(n).select(key, "title", F.concat(F.substring("content", 1, snippet), F.lit("...")).alias("snippet"))


def idf(n: float, df: float) -> float:
    from math import log

    return log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_scan(docs: DataFrame, key: str, text: str, terms: list[str], where: Column | None = None) -> DataFrame:
    """All documents holding every term, with their score. No word rows and no
    shuffle: term counts are array sizes; one aggregate row gives the statistics."""
    t, terms = F.col("_tokens"), list(dict.fromkeys(terms))
    rows = docs.withColumn("_tokens", tokens(F.col(text)))
    counted = rows.select(*docs.columns, F.size(t).alias("_dl"), *[F.size(F.filter(t, _equals(term))).alias(f"_tf{i}") for i, term in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score, all_terms = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        tf = F.col(f"_tf{i}")
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / (stats["avgdl"] or 1.0)))
        score, all_terms = score + idf(stats["n"], stats[f"df{i}"]) * weight, all_terms & (tf > 0)
    found = counted if where is None else counted.filter(where)
    scored = found.select(key, F.when(all_terms, F.round(score, 6)).alias("score"))
    return scale.keep_computed(scored, lambda r: r["score"].isNotNull())


def _equals(term: str):
    return lambda x: x == term


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index rows (term, key, tf, dl); counts combine before the shuffle."""
    t = scale.rows_of(docs.select(key, tokens(F.col(text)).alias("t")), [key, F.size("t").alias("dl")], "t", "term")
    return t.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def search_index(index: DataFrame, key: str, terms: list[str], n_docs: int, avgdl: float) -> DataFrame:
    """Scores from the index rows of the query's terms only."""
    terms = list(dict.fromkeys(terms))
    rows = index.filter(F.col("term").isin(*terms))
    dfs = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per query term
    weight = F.lit(0.0)
    for t, d in dfs.items():
        weight = F.when(F.col("term") == t, idf(n_docs, d)).otherwise(weight)
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    scored = rows.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("hit_terms"))
    return scored.filter(F.col("hit_terms") == len(terms)).select(key, F.round("score", 6).alias("score"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def ilike_search(df: DataFrame, needle: str, columns: list[str], equals: dict[str, str] | None = None) -> DataFrame:
    pattern = "%" + re.sub(r"([%_\\])", r"\\\1", needle) + "%"
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).ilike(pattern)
    for c, v in (equals or {}).items():
        test = test & (F.col(c) == v)
    return df.filter(test)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, key: str, wv: float = 0.7, wt: float = 0.3) -> DataFrame:
    """Both hit lists merged by id; a missing side counts 0. One stacked aggregate."""
    both = vector_hits.select(key, F.col("score").alias("v"), F.lit(0.0).alias("t")).unionByName(text_hits.select(key, F.lit(0.0).alias("v"), F.col("score").alias("t")))
    return both.groupBy(key).agg(F.round(F.max("v") * wv + F.max("t") * wt, 6).alias("combined_score"))


def field_boost(scores: dict[str, Column], boosts: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for field, score in scores.items():
        total = total + score * boosts.get(field, 1.0)
    return total


def deduplicate(hits: DataFrame, key: str, score: str) -> DataFrame:
    return hits.groupBy(key).agg(F.max(score).alias(score))


def enrich(hits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Hits with document fields. The hit list is short: broadcast behind a check."""
    return documents.join(scale.maybe_broadcast(hits), key, "right")


def highlight(content: Column, query: str) -> Column:
    words = "|".join(re.escape(w) for w in query.split())
    return F.regexp_replace(content, rf"(?i)(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])", "<em>$1</em>")


def facets(df: DataFrame, category: str, tags: str) -> DataFrame:
    by_category = df.groupBy(F.col(category).alias("name")).agg(F.count("*").alias("n")).select(F.lit("category").alias("facet"), "name", "n")
    by_tag = scale.rows_of(df, [], tags, "name").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("tag").alias("facet"), "name", "n")
    return by_category.unionByName(by_tag)


def suggestions(queries: DataFrame, column: str, prefix: str, n: int = 10) -> DataFrame:
    hits = queries.filter(F.col(column).startswith(prefix)).groupBy(column).agg(F.count("*").alias("n"))
    return hits.orderBy(F.col("n").desc(), column).limit(n)


def spell_correct(vocabulary: DataFrame, words: list[str]) -> DataFrame:
    """vocabulary(term, n): closest word to each given word, more frequent ones first.
    All words are tested in one pass with partial minima."""
    best = vocabulary.agg(*[F.min(F.struct(F.levenshtein("term", F.lit(w)).alias("d"), (-F.col("n")).alias("m"), F.col("term").alias("t"))).alias(f"b{i}") for i, w in enumerate(words)])
    rows = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"b{i}")["t"].alias("correction"), F.col(f"b{i}")["d"].cast("long").alias("distance")) for i, w in enumerate(words)])
    return best.select(F.inline(rows))


def expand_query(queries: DataFrame, column: str, synonyms: dict[str, list[str]]) -> DataFrame:
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.coalesce(F.try_element_at(table, F.col(column)), F.array().cast("array<string>"))
    return queries.withColumn("terms", F.array_distinct(F.concat(F.array(column), more)))


def cluster_by(hits: DataFrame, label: str, key: str, score: str, n: int = 3) -> DataFrame:
    """Groups with size and their best n members."""
    sizes = hits.groupBy(label).agg(F.count("*").alias("n"))
    best = scale.top_n_per_key(hits.select(label, key, score), [label], [F.col(score).desc(), F.col(key)], n)
    members = best.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("m"))
    return sizes.join(members, label).select(label, "n", F.transform("m", lambda s: s[key]).alias("members"))


def cluster_vectors(df: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(vector))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready).drop("_v")


def personalize(hits: DataFrame, category: str, preferred: list[str], bonus: float = 0.3) -> DataFrame:
    return hits.withColumn("personal_score", F.round(F.col("score") + F.when(F.col(category).isin(*preferred), bonus).otherwise(0.0), 6))


def search_analytics(log: DataFrame, query: str, ok: Column, took: str, ts: str, n: int = 5) -> DataFrame:
    """Long form: totals, top queries and daily counts."""
    row = log.agg(F.count("*").cast("double").alias("total"), F.count_if(ok).cast("double").alias("successful"), F.count_if(~ok).cast("double").alias("failed"), F.round(F.avg(took), 6).alias("avg_time"))
    totals = row.select(F.lit("total").alias("metric"), F.expr("stack(4, 'total', total, 'successful', successful, 'failed', failed, 'avg_time', avg_time) AS (name, value)"))
    top = log.groupBy(F.col(query).alias("name")).agg(F.count("*").cast("double").alias("value")).orderBy(F.col("value").desc(), "name").limit(n)
    daily = log.groupBy(F.to_date(ts).cast("string").alias("name")).agg(F.count("*").cast("double").alias("value"))
    return totals.unionByName(top.select(F.lit("popular").alias("metric"), "name", "value")).unionByName(daily.select(F.lit("daily").alias("metric"), "name", "value"))


def user_timeline(log: DataFrame, user: str, kinds: dict[str, Column], ts: str) -> DataFrame:
    return log.groupBy(user, F.to_date(ts).alias("day")).agg(*[F.count_if(test).alias(name) for name, test in kinds.items()])
