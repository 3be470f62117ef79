"""License scans by diagonal voting.

Each text's words give rolling k-gram hashes; a broadcast join meets them with the hashes
of the template words. A meeting votes for the diagonal (word number - template word
number). Votes are counted by diagonal; diagonals at most `gap` apart merge, since an
inserted or lost word moves the rest by one; and a merged span is verified: its votes must
cover enough of the template, it must not be much longer than the template, and it must
hold the words that tell the template from its siblings: a version, a "lesser", an "nc".

Phrases are templates too, with every gram demanded on a single diagonal. All grams join
on the hash of their first two words, and the words themselves are compared in the join,
so no hash collision votes. The templates are fixed configuration of a few hundred words:
their gram table is broadcast under that bound and its row count is checked.

Only DataFrame functions run here. Defined results: a null text has no words; rows of one
key are told apart by their text, and identical rows get the same result; no match gives
no labels, score 0 and null word numbers. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import folded_text

# Phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Notices in public use, with the labels that the scan gives them and the
# words of each that tell it from its siblings, which a span must hold.
NOTICES = (
    ("released under the mit license", "mit-notice", ("the mit license",)),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license version", "version 2 0")),
    ("licensed under the apache license version 1 1", "apache-1.1", ("apache license version", "version 1 1")),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("gnu general public", "license version 3")),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ("gnu general public", "license version 2")),
    ("this work is licensed under the gnu lesser general public license version 2 1", "lgpl-2.1", ("gnu lesser general", "version 2 1")),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3.0", ("gnu lesser general", "license version 3")),
    ("this work is licensed under the gnu affero general public license version 3", "agpl-3.0", ("gnu affero general", "license version 3")),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("by nc 4", "nc 4 0")),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ("by sa 4", "sa 4 0")),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0", ("by nc sa", "sa 4 0")),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0", ("by nc nd", "nd 4 0")),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text", ()),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-text", ()),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text", ("gnu general public",)),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl-text", ("gnu lesser general",)),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl-text", ("gnu affero general",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text", ()),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS = 10_000  # most rows of the gram table, which is broadcast


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(folded_text(text), F.lit(WORD), F.lit(0))


def template_grams(k: int, phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(gram, size, label, base, position, grams, told, tells) of all templates."""
    rows = []
    for templates, size, base in (([(*p, ()) for p in phrases], 2, True), (notices, k, False)):
        for text, label, telling in templates:
            words = text.split()
            grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
            told = []
            for phrase in telling:
                n, found = len(phrase.split()), [i for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
                if not found:
                    raise ValueError(f"{phrase!r} is not in {text!r}")
                # grams inside the phrase, or around it where they are longer
                told += [i for i in range(len(grams)) if found[0] <= i and i + size <= found[0] + n] or [max(0, min(found[0], len(grams) - 1))]
            rows += [(g, size, label, base, i, len(grams), i in told, len(set(told))) for i, g in enumerate(grams)]
    return rows


def gram_table(spark: SparkSession, k: int = 3, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(h, gram, k, label, base, position, grams, told, tells) of every template gram; h hashes
    two words, told marks the grams that touch a telling word, tells counts them."""
    rows = [(" ".join(gram.split()[:2]), gram, *rest) for gram, *rest in template_grams(k, phrases, notices)]
    if len(rows) > GRAMS:
        raise ValueError(f"templates give {len(rows)} grams, more than {GRAMS}")
    frame = spark.createDataFrame(rows, "pair string, gram string, k int, label string, base boolean, position int, grams int, told boolean, tells int")
    return frame.withColumn("h", F.xxhash64("pair")).drop("pair")


def votes(docs: DataFrame, grams: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, mark, label, base, grams, k, told, tells, place, position, diagonal) of all meetings."""
    words = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), words_of(F.col(text)).alias("w"))
    places = F.when(F.size("w") >= 2, F.sequence(F.lit(0), F.size("w") - 2))
    at = words.select("key", "mark", "w", F.explode(places).alias("place"))
    first, second = F.get("w", F.col("place")), F.get("w", F.col("place") + 1)
    hashed = at.withColumn("h", F.xxhash64(F.concat_ws(" ", first, second)))
    run = F.concat_ws(" ", F.slice("w", F.col("place") + 1, F.col("k")))
    met = hashed.join(F.broadcast(grams), "h").filter(run == F.col("gram"))
    return met.select("key", "mark", "label", "base", "grams", "k", "told", "tells", "place", "position", (F.col("place") - F.col("position")).alias("diagonal")).distinct()


def spans(met: DataFrame, gap: int = 2, cover: float = 0.6, longer: float = 1.5) -> DataFrame:
    """Verified spans (key, mark, label, base, first, last, share)."""
    by = ["key", "mark", "label", "base"]
    lines = met.groupBy(*by, "grams", "k", "tells", "diagonal").agg(
        F.min("place").alias("lo"), F.max("place").alias("hi"), F.collect_set("position").alias("seen"), F.collect_set(F.when(F.col("told"), F.col("position"))).alias("said"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(order), F.lit(-1 << 30)) > gap)
    runs = lines.withColumn("run", F.sum(apart.cast("int")).over(order))
    different = lambda lists: F.size(F.array_distinct(F.flatten(F.collect_list(lists))))
    whole = runs.groupBy(*by, "grams", "k", "tells", "run").agg(
        F.min("lo").alias("first"), (F.max("hi") + F.max("k") - 1).alias("last"), different("seen").alias("covered"), different("said").alias("said"))
    share = F.col("covered") / F.col("grams")
    length, template = F.col("last") - F.col("first") + 1, F.col("grams") + F.col("k") - 1
    good = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise((share >= cover) & (length <= template * longer) & (F.col("said") == F.col("tells")))
    return whole.filter(good).select(*by, "first", "last", share.alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(votes(docs, gram_table(docs.sparkSession, k), key, text))
    base = F.col("base")
    names = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    per = found.groupBy("key", "mark").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"), names(base).alias("base_labels"), names(F.lit(True)).alias("labels"),
        F.max("share").alias("score"))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"), F.regexp_count(folded_text(F.col(text)), F.lit(WORD)).cast("long").alias("n_words"))
    joined = rows.join(per, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_mark") == F.col("mark")), "left")
    return joined.select(
        F.col("_key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
