import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import labels as lb
from pagemill.functions import quality as qx
from pagemill.functions import text as tx
from pagemill.operators import chunks as ch
from pagemill.operators import keywords as kw
from pagemill.operators import table_functions as tables
from tests.conftest import rows

WORDS = "alpha beta gamma. delta! epsilon? zeta eta theta, iota kappa\nlambda".split(" ")


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(["\n\n", " ", "\n \n"]).join(parts))
    return out + ["", "   ", "x" * 2500, "One. Two! Three?"]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("x")).first()["x"]


def test_whitespace_is_unicode(spark):
    assert one(spark, "a b c\x1fd", tx.squash(F.col("c"))) == "a b c d"
    assert one(spark, " 　x ", tx.strip(F.col("c"))) == "x"


def test_clean_text_switches(spark):
    c = F.col("c")
    s = "<b>Hi</b> &amp; see http://x.y/z or me@x.org"
    assert one(spark, s, tx.clean_text(c)) == "Hi & see [URL] or [EMAIL]"
    assert one(spark, s, tx.clean_text(c, preserve_urls=True, preserve_emails=True)) == "Hi & see http://x.y/z or me@x.org"
    assert one(spark, "&hellip;&eacute;", tx.clean_text(c)) == "…é" and one(spark, "&#8217;&amp;", tx.clean_text(c)) == "’&"
    assert one(spark, "&hellip;&amp;", tx.clean_text(c, full_entities=False)) == "&hellip;&"
    assert one(spark, "ﬁ ½", tx.clean_processed_text(c)) == "fi 1⁄2"


@pytest.mark.parametrize("n, score", [(49, 10), (50, 30), (149, 30), (150, 60), (299, 60), (300, 100), (2000, 100), (2001, 80), (5000, 80), (5001, 60)])
def test_length_ladder(spark, n, score):
    assert spark.range(1).select(qx.score_length(F.lit(n)).alias("s")).first()["s"] == score


@pytest.mark.parametrize("score, level", [(85, "excellent"), (84.99, "good"), (70, "good"), (55, "fair"), (40, "poor"), (39.99, "very_poor")])
def test_levels(spark, score, level):
    assert spark.range(1).select(qx.quality_level(F.lit(score)).alias("s")).first()["s"] == level


@pytest.mark.parametrize("levels, ok", [([1, 2, 3], True), ([2, 3, 2], True), ([3], False), ([1, 3], False), ([], False), ([1, 2, 1, 2, 3, 4], True)])
def test_heading_hierarchy(spark, levels, ok):
    df = spark.createDataFrame([(levels,)], "l array<bigint>")
    assert df.select(qx.heading_hierarchy_ok(F.col("l")).alias("x")).first()["x"] is ok


def test_duplicate_ratio_counts_the_empty_tail(spark):
    # segments: 'a', ' a', '' -> one distinct of three
    assert one(spark, "a. a.", F.round(qx.duplicate_ratio(F.col("c")), 6)) == pytest.approx(1 - 1 / 3, abs=1e-6)


def test_noise_group_counts_only_the_group(spark):
    assert one(spark, "please click here now", qx.matched_chars(F.col("c"), *qx.NOISE[0])) == len("click")


def naive_syllables(word):
    n = len(re.findall("[aeiouy]+", word)) - word.endswith("e")
    return max(1, n)


def test_syllables_match_the_per_word_rule(spark):
    rng = random.Random(3)
    values = [" ".join("".join(rng.choice("aebcdey,é") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    got = dict(frame(spark, values).select("doc_id", lb.syllables(F.lower("text")).alias("s")).collect())
    for i, v in enumerate(values):
        assert got[i] == sum(naive_syllables(w) for w in v.lower().split()), v


@pytest.mark.parametrize("mode", ["paragraph", "sentence", "char", "char_sentence"])
def test_chunks_cover_the_text(spark, mode):
    values = texts()
    df = ch.chunk_table(frame(spark, values), "doc_id", "text", mode, 300, 60)
    by_doc = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, v in enumerate(values):
        got = by_doc.get(i, [])
        assert [r["chunk_index"] for r in got] == list(range(len(got)))
        letters = set(re.findall(r"\w+", v)) - {"x" * 2500}
        seen = set(re.findall(r"\w+", " ".join(r["content"] for r in got)))
        if "x" * 300 not in v and mode in ("paragraph", "sentence"):
            assert letters <= seen
        if mode.startswith("char"):
            assert all(len(r["content"]) <= 301 for r in got)
            assert all(v[r["start_index"]:r["end_index"]] == r["content"] for r in got if r["content"] in v[r["start_index"]:])


def naive_words(v, size, overlap, cap):
    w, out = v.split(), []
    for i in range(0, len(w), size - overlap):
        c = " ".join(w[i:i + size])
        if len(c) > 50:
            out.append(c)
        if len(out) >= cap:
            break
    return out


def test_word_and_stride_chunks_match_brute_force(spark):
    values = texts(5)
    df = ch.word_chunks(frame(spark, values), "text", "c", 20, 5, 4)
    df = df.withColumn("s", ch.stride_chunks(F.col("text"), 50, 10)).withColumn("m", ch.merge_chunk_array(F.col("s"), 120))
    for r in df.collect():
        assert r["c"] == naive_words(r["text"], 20, 5, 4)
        stride = [r["text"][i:i + 50] for i in range(0, len(r["text"]), 40)]
        stride = [s for s in stride if s.strip()]
        assert r["s"] == stride
        merged, cur = [], ""
        for s in stride:
            if len(cur) + len(s) + 1 > 120:
                if cur:
                    merged.append(cur.strip())
                cur = s
            else:
                cur = cur + " " + s if cur else s
        if cur:
            merged.append(cur.strip())
        assert r["m"] == merged


def test_keywords_ties_by_first_place(spark):
    df = frame(spark, ["zebra apple apple zebra mango the with café cafés"])
    assert [r["term"] for r in kw.top_keywords(df, "doc_id", "text").orderBy("rank").collect()] == ["zebra", "apple", "mango"]


def test_chunkers_in_sql(spark):
    """The table functions give what the DataFrame chunkers give, null and empty texts included."""
    tables.register(spark)
    said = "One two three. Four five six! Seven eight nine? Ten.\n\nA new paragraph of words here. And more of them, up to the end.\n\nLast."
    docs = spark.createDataFrame([(1, said), (2, None), (3, ""), (4, "word " * 60), (5, "x" * 130)], "id long, text string")
    columns = ["id", "chunk_index", "total_chunks", "content", "start_index", "end_index"]
    for mode in ch.MODES:
        got = spark.sql(f"SELECT id, c.* FROM {{d}}, LATERAL chunk_text(text, '{mode}', 50, 10, true) AS c", d=docs)
        want = ch.chunk_table(docs, "id", "text", mode, 50, 10)
        assert got.columns == columns and sorted(rows(got)) == sorted(rows(want.select(*columns))) and got.count() > 5
    short = spark.sql("SELECT c.* FROM VALUES ('Aa bb. Cc dd.') AS t(text), LATERAL chunk_text(text, 'sentence', 8, 0) AS c")
    assert rows(short) == [(0, 2, "Aa bb."), (1, 2, "Cc dd.")]
    pieces = spark.createDataFrame([(1, ["aa", "bb", "", "c" * 9, "d"]), (2, None), (3, [])], "id long, p array<string>")
    packed = spark.sql("SELECT id, c.* FROM {d}, LATERAL merge_chunks(p, 8) AS c", d=pieces)
    want = ch.explode_chunks(pieces, "id", ch.merge_chunk_array(F.col("p"), 8)).select("id", "chunk_index", "content")
    assert sorted(rows(packed)) == sorted(rows(want)) and packed.count() > 2
    for bad in ("'nothing', 50, 10", "'char', 10, 10", "'char', id, 0"):
        with pytest.raises(Exception, match="mode must be|overlap must be|must be a constant"):
            spark.sql(f"SELECT c.* FROM {{d}}, LATERAL chunk_text(text, {bad}) AS c", d=docs).collect()


def test_chunks_leave_the_task_in_small_frames():
    import pandas as pd

    texts = pd.DataFrame({"k": range(9), "t": ["word. " * 100_000] * 7 + [None, ""]})
    frames = list(ch.chunk_frames(iter([texts]), "k", "t", "sentence", 1000, 200))
    whole = [(k, *row) for k, t in zip(texts["k"], texts["t"]) for row in ch.placed_chunks(t, "sentence", 1000, 200)]
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == whole and len(frames) == 2
    assert max(f["content"].str.len().sum() for f in frames) < 2 * ch.OUT_CHARS
