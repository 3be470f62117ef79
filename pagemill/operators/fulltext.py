"""Full-text search over positional postings: phrases, prefixes, OR and NOT.

An index is one row (term, key, size, tf, positions) for every different word of every text.
It consists of segments: the texts are dealt by key, SEGMENT bytes to each, and a segment's
rows are sorted by (term, key) where they are made, so that no row a word is shuffled and a
segment is sorted in memory. A frequent term is spread over all segments; a term or a prefix
reads the pages of each that hold it. A phrase is met where its words stand at consecutive
positions: every word's positions are moved back by its place in the phrase, and a start
that all words share is one occurrence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.search import K1, B, idf, tokens
from pagemill.session import materialize

SEGMENT = 16 << 20  # bytes of text in a segment, about 1.6 million rows


@dataclass(frozen=True)
class Unit:
    """Consecutive words; with `prefix` the last one stands for all words that begin with it."""

    words: tuple[str, ...]
    prefix: bool = False


def word(w: str) -> Unit:
    return Unit((w.lower(),))


def prefix(w: str) -> Unit:
    return Unit((w.lower(),), True)


def phrase(text: str, prefix: bool = False) -> Unit:
    return Unit(tuple(text.lower().split()), prefix)


@dataclass(frozen=True)
class All:
    """Documents that hold every unit and none of the forbidden ones."""

    units: tuple[Unit, ...]
    without: tuple[Unit, ...] = ()


def positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Index rows of the texts; a null text has no words."""
    length = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    dealt = docs.select(key, text).repartition(-(-length // SEGMENT) or 1, key)
    placed = dealt.select(key, F.sort_array(F.transform(tokens(F.col(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("s"))
    size, term = F.size("s"), lambda i: F.col("s")[i]["w"]
    # where the rows of the next word begin in the sorted list
    first = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (term(i) != term(F.greatest(i - 1, F.lit(0)))))
    runs = placed.select(key, size.alias("size"), F.col("s.w").alias("w"), F.col("s.i").alias("i"), F.when(size > 0, first).alias("first"))
    row = lambda at, n: F.struct(F.col("w")[at].alias("term"), F.slice("i", at + 1, F.coalesce(F.get("first", n + 1), F.col("size")) - at).alias("positions"))
    rows = runs.select(key, "size", F.inline_outer(F.transform("first", row))).filter("term IS NOT NULL")
    return rows.select("term", key, "size", F.size("positions").alias("tf"), "positions").sortWithinPartitions("term", key)


def _is(term: str, beginning: bool) -> Column:
    return F.col("term").startswith(term) if beginning else F.col("term") == term


def _held(index: DataFrame, key: str, units: list[Unit]) -> DataFrame:
    """(key, size, tf0, tf1, ...) of every document that holds a word of the units."""
    slots = [(u, i, _is(w, unit.prefix and i == len(unit.words) - 1)) for u, unit in enumerate(units) for i, w in enumerate(unit.words)]
    wanted = F.lit(False)
    for _, _, test in slots:
        wanted = wanted | test
    counts = {u: F.lit(0) for u in range(len(units))}
    starts, back = {}, lambda n: F.transform("positions", lambda p: p - n)
    for u, i, test in slots:
        if len(units[u].words) == 1:
            counts[u] = F.coalesce(F.sum(F.when(test, F.col("tf"))), F.lit(0))
        else:  # the words that a prefix stands for share no position
            here = F.flatten(F.collect_list(F.when(test, back(i))))
            starts[u] = F.array_intersect(starts[u], here) if u in starts else here
    counts |= {u: F.size(s) for u, s in starts.items()}
    return index.filter(wanted).groupBy(key, "size").agg(*[c.cast("long").alias(f"tf{u}") for u, c in counts.items()])


def occurrences(index: DataFrame, key: str, units: list[Unit]) -> DataFrame:
    """(key, size, unit, tf): how often each document holds the unit of that number."""
    each = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"tf{u}").alias("tf")) for u in range(len(units))])
    return _held(index, key, units).select(key, "size", F.inline(each)).filter("tf > 0")


def search(index: DataFrame, key: str, branches: list[All], n_docs: int) -> DataFrame:
    """Documents that any branch accepts, with their BM25 score over the units they hold.

    n_docs counts all documents, those without words too; the index itself gives the words.
    """
    units = list(dict.fromkeys(u for b in branches for u in (*b.units, *b.without)))
    number = {u: i for i, u in enumerate(units)}
    scored = sorted({number[u] for b in branches for u in b.units})
    per = materialize(_held(index, key, units))
    accepted = F.lit(False)
    for b in branches:
        one = F.lit(bool(b.units))
        for u in b.units:
            one = one & (F.col(f"tf{number[u]}") > 0)
        for u in b.without:
            one = one & (F.col(f"tf{number[u]}") == 0)
        accepted = accepted | one
    held = per.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in scored]).first()
    mean = (index.agg(F.sum("tf")).first()[0] or 0) / n_docs if n_docs else 1.0
    score = F.lit(0.0)
    for i in scored:
        tf = F.col(f"tf{i}")
        score = score + idf(n_docs, held[f"df{i}"]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / (mean or 1.0)))
    return per.filter(accepted).select(key, F.round(score, 6).alias("score"))
