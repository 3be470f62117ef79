"""Similarity joins over sets and over spellings, by keys that near values must share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import scale
from pagemill.session import materialize


def set_classes(df: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """One row (rep, members, tokens) for each different set, named by its smallest key, and
    (key, rep) for every row with a set. Copies of a set are never paired with each other.

    Sets and classes are stored, since joins read them many times and sets may be costly to make.
    """
    rows = materialize(df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("tokens"))).filter("tokens IS NOT NULL")
    classes = materialize(rows.groupBy("tokens").agg(F.min("key").alias("rep"), F.count("*").alias("members")))
    named = scale.maybe_broadcast(classes, stored=True).select("tokens", "rep")
    return classes, rows.join(named, "tokens").select(F.col("key").alias(key), "rep")


def similar_sets(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for classes a < b with Jaccard similarity of at least the threshold.

    Tokens are put in order of rarity. Two similar sets share a token among the first
    n - ceil(threshold * n) + 1 of each, so only those are joined, under the bounds that size
    and place of the token set to the similarity; the pairs that are left are compared whole.
    A frequent token stands late in its sets and is rarely among the joined ones.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    each = scale.rows_of(classes, ["rep"], "tokens", "token")
    counts = each.groupBy("token").agg(F.count("*").alias("held"))
    ranked = each.join(scale.maybe_broadcast(counts), "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("o"))
    ordered = ranked.select("rep", F.transform("o", lambda x: x["token"]).alias("tokens"), F.size("o").alias("n"))
    least = lambda n: F.ceil(n * threshold - 1e-9).cast("int")
    first = F.slice("tokens", 1, F.col("n") - least(F.col("n")) + 1)
    keys = ordered.select("rep", "n", F.posexplode(first).alias("place", "token"))
    a, b = (keys.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "place")]) for side in "ab")
    shared = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    sized = (F.col("n_a") >= least(F.col("n_b"))) & (F.col("n_b") >= least(F.col("n_a")))
    placed = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + F.least("place_a", "place_b") >= shared
    pairs = a.join(b, "token").filter((F.col("rep_a") < F.col("rep_b")) & sized & placed).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    left, right = (classes.select(F.col("rep").alias(s), F.col("tokens").alias(f"t_{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    similarity = F.col("common") / (F.size("t_a") + F.size("t_b") - F.col("common"))
    return both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def deletions(word: Column, limit: int, head: int = 10) -> Column:
    """The first `head` characters without up to `limit` of them, in every way.

    Two words within `limit` edits share one: what is left of both beginnings when the
    edited characters are taken out.
    """
    def shorter(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))

    out = F.array(F.substring(word, 1, head))
    for _ in range(limit):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def correct_words(vocabulary: DataFrame, asked: DataFrame, word: str, limit: int = 2) -> DataFrame:
    """vocabulary(term, n): the nearest term within `limit` edits for each asked word, frequent
    ones first; null where there is none. Asked words may be a table of any size."""
    words = asked.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct()
    index = scale.rows_of(vocabulary.filter("term IS NOT NULL"), ["term", "n"], deletions(F.col("term"), limit), "part").select("term", "n", F.xxhash64("part").alias("k"))
    probes = scale.rows_of(words, ["word"], deletions(F.col("word"), limit), "part").select("word", F.xxhash64("part").alias("k"))
    met = probes.join(index, "k").filter(F.abs(F.length("word") - F.length("term")) <= limit)
    near = met.withColumn("d", F.levenshtein("word", "term", limit)).filter("d >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("d", (-F.col("n")).alias("m"), "term")).alias("b"))
    return words.join(best, "word", "left").select("word", F.col("b.term").alias("correction"), F.col("b.d").cast("long").alias("distance"))
