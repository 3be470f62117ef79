"""The corpus pipeline, stage by stage, against brute force on a small table."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from tests.llm.test_llm import ODD, grouped, plain_fingerprint, plain_hits, plain_line_dedup


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage was given and returned, as {doc_id: row}."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 90"), []
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stored(stage(spark, docs, sf))
        out.append((name, {r["doc_id"]: r for r in given.collect()}, docs.collect(), docs.columns))
    return {name: (given, got, columns) for name, given, got, columns in out}


def test_columns_and_keys(stages):
    for name, (given, got, columns) in stages.items():
        assert len({r["doc_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} <= set(given)
        if name != "bpe":
            assert sorted(columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"])


def test_language_keeps_texts_with_letters(stages):
    given, got, _ = stages["language_id"]
    assert {r["doc_id"] for r in got} == {i for i, r in given.items() if any(c.isalpha() for c in r["text"] or "")}


def test_lines(stages):
    given, got, _ = stages["line_dedup"]
    want = plain_line_dedup(sorted((i, r["text"]) for i, r in given.items()), 30, 2, short=True)
    assert {r["doc_id"]: r["text"] for r in got} == {i: t for i, t in want.items() if t or t == given[i]["text"]}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_one_of_each_group_stays(stages):
    given, got, _ = stages["simhash"]
    prints = {i: plain_fingerprint(r["text"]) for i, r in given.items()}
    group = grouped([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], prints)
    assert {r["doc_id"] for r in got} == set(group.values())


def test_benchmark_passages_go(spark, sf, stages):
    given, got, _ = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in got} == {i for i, r in given.items() if not plain_hits(r["text"], items, 10)[1]}


def test_all_texts_are_encoded(stages):
    given, got, _ = stages["bpe"]
    assert {r["doc_id"] for r in got} == set(given) and all(r["n_tokens"] > 0 for r in got)


def test_odd_and_empty_tables(spark, sf):
    rows = [(1, "words enough to make a line that is long", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "b", 0)]
    for table in (spark.createDataFrame(rows, ODD.split(", fingerprint")[0]), spark.createDataFrame([], ODD.split(", fingerprint")[0])):
        for _, stage in corpus_pipeline.STAGES:
            table = stored(stage(spark, table, sf))
        assert table.count() <= 1


def test_rows_without_or_with_repeated_keys_stay(spark, sf):
    said = ["".join(f"{w}{i} " for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for i in range(6)]
    rows = [(None, said[0], "en", "a", 1), (None, said[1], "en", "a", 1), (None, said[0], "en", "a", 1), (7, said[2], "en", "a", 1), (7, said[3], "en", "a", 1),
            (8, said[4], "en", "a", 1), (9, said[4], "en", "a", 1), (None, said[4], "en", "a", 1), (9, said[5], "en", "a", 1)]
    want = [(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3]), (8, said[4]), (9, said[5])]
    for given in (rows, rows[::-1]):
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(given, ODD.split(", fingerprint")[0]), sf)
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_column_name_of_an_operator_is_in_the_way(spark, sf):
    """Every name that the five operators return or use inside, as an extra column."""
    names = ["lang_pred", "score", "bits_per_byte", "n_lines", "n_dropped", "n_near", "n_words", "runs", "spans", "item_ids", "_t", "_letters", "_row", "_key", "_mark",
             "_lines", "fingerprint", "component_id", "_group", "label", "node", "key", "mark", "line", "lines", "id", "near", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 30").withColumns({n: F.lit(f"own {n}") for n in names})
    plain = docs.drop(*names)
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = stored(stage(spark, docs, sf)), stored(stage(spark, plain, sf))
        if name != "bpe":
            assert docs.columns == plain.columns + names
            assert all(r[n] == f"own {n}" for r in docs.collect() for n in names)
        assert sorted(map(str, docs.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
