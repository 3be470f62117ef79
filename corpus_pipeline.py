"""Corpus pipeline: language, line dedup, near-dedup, decontamination, tokens.

Each stage works on all rows that the stage before kept, written as Parquet and reread.
All but the last return the columns of `documents`. SQL cannot express language trees,
fingerprints by XXH64 or BPE merges, so ORACLE_SQL is None and the tests compare each
stage with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, language_id, line_dedup, simhash
from pagemill.llm.common import fold_of, stored
from pagemill.llm.components import components

ORACLE_SQL = None


def held(docs: DataFrame, *names: str) -> DataFrame:
    """Text, the named columns, and the whole row as one value, so that no column's name
    can meet a name that an operator adds."""
    return docs.select(*names, "text", F.struct(*docs.columns).alias("_row"))


def rows_again(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of the held rows, with the changed ones put in their places."""
    return found.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the learned languages; lang becomes the prediction."""
    trees = language_id.fit(docs, usable=fold_of(F.col("doc_id"), 4) != 2)
    named = language_id.predict(held(docs), trees, ["_row"]).filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return rows_again(named, docs, lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line holds; texts left empty go."""
    kept = line_dedup.without_repeats(held(docs, "doc_id"), short=True).filter((F.col("n_dropped") == 0) | (F.length("text") > 0))
    return rows_again(kept, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the first by doc_id (nulls last) and text.

    Keys need not be unique or known: rows of a fingerprint are gathered under the smallest
    fingerprint that its links reach.
    """
    order = F.struct(F.col("_row.doc_id").isNull(), F.col("_row.doc_id"), F.sha2(F.coalesce("_row.text", F.lit("")), 256), F.xxhash64("_row"))
    prints = simhash.fingerprints(docs.select("text", F.struct(*docs.columns).alias("_row")), ["_row"])
    first = stored(prints.groupBy("fingerprint").agg(F.min_by("_row", order).alias("_row")))
    labels = components(stored(simhash.near_links(first.select("fingerprint")))).withColumnRenamed("node", "fingerprint")
    named = first.join(labels, "fingerprint", "left").withColumn("_group", F.coalesce("label", "fingerprint"))
    return named.groupBy("_group").agg(F.min_by("_row", order).alias("_row")).select("_row.*")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(held(docs), items, ["_row"])
    return rows_again(found.filter(F.size("runs") == 0), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontaminate", clean_of_benchmarks),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
