"""Null keys, null and empty texts, repeated rows and repeated words."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import activity, chunks, folds, knowledge, merge, search
from tests.conftest import rows


def events(spark):
    return spark.createDataFrame([(1, None, 0), (2, None, 10), (3, 7, 0), (4, 7, 10)], "id long, user long, us long")


def test_null_keys_keep_their_rows(spark):
    sessions = activity.presence_sessions(events(spark), "user", "us", "id")
    assert sorted(rows(sessions.select("user", "events")), key=str) == sorted([(None, 2), (7, 2)], key=str)
    assert folds.token_bucket(events(spark), "user", "us", "id", 1.0, 0.001).filter("allowed").count() == 2
    assert folds.sliding_log(events(spark), "user", "us", "id", 60, 1).filter("allowed").count() == 2
    assert activity.limiter_stats(events(spark), "user", "us").count() == 2


def test_null_and_empty_texts_have_no_chunks(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two.")], "id long, text string")
    for mode in chunks.MODES:
        assert {r["id"] for r in chunks.chunk_table(docs, "id", "text", mode).collect()} == {3}


def test_upsert_takes_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k long, h string, seq int")
    for batch in ([(1, "b", 1), (1, "c", 2)], [(1, "c", 2), (1, "b", 1)]):
        got = merge.upsert(old, spark.createDataFrame(batch, "k long, h string, seq int"), "k", "h", order="seq")
        assert rows(got.select("h", "action")) == [("c", "updated")]


def test_repeated_search_words_count_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string")
    once, twice = (rows(search.bm25_scan(docs, "id", "text", t)) for t in (["alpha"], ["alpha", "alpha"]))
    assert once == twice and len(once) == 1
    index = search.build_index(docs, "id", "text")
    assert rows(search.search_index(index, "id", ["alpha", "alpha"], 2, 1.5)) == rows(search.search_index(index, "id", ["alpha"], 2, 1.5))


def test_null_times_are_not_new_or_deleted(spark):
    old = spark.createDataFrame([("a", None), ("b", 1), ("c", 1)], "k string, t long")
    new = spark.createDataFrame([("a", 5), ("b", None), ("d", None)], "k string, t long")
    assert sorted(rows(merge.snapshot_diff(old, new, "k", "t"))) == [("c", "deleted"), ("d", "new")]


def test_repeated_manifest_rows_give_a_file_once(spark):
    files = spark.createDataFrame([("a", 5)], "k string, t long")
    manifest = spark.createDataFrame([("a", 1), ("a", 2)], "k string, t long")
    assert rows(knowledge.changed_files(files, manifest, "k", "t")) == [("a", 5)]


def test_long_texts_keep_all_chunks(spark):
    docs = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: i.cast("string")), " ").alias("text"))
    assert chunks.word_chunks(docs, "text", size=20, overlap=10).select(F.size("chunks")).first()[0] > 100
