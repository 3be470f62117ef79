"""Skewed input: one key holds a large share of the rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import scale, session
from pagemill.operators import activity as ac
from pagemill.operators import folds
from pagemill.operators import frontier as fr
from pagemill.operators import fulltext as ft
from pagemill.operators import ivf
from pagemill.operators import knowledge as kn
from pagemill.operators import merge as mg
from pagemill.operators import search as se
from pagemill.operators import vectors as ve
from pagemill.operators.vectors import hashing_encoder

S = ac.SECOND


def skewed_events(spark, n=3000, seed=2):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 60, 1800, 4000]) * S // rng.choice([1, 2])
        key = 1 if rng.random() < 0.4 else rng.randint(2, 9)
        rows.append((i, key, t, rng.choice(["success"] * 6 + ["rate_limit", "failure"])))
    return rows, spark.createDataFrame(rows, "id long, k long, us long, outcome string").repartition(6)


def by_key(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    return groups


def test_previous_and_running_sum(spark):
    rows, df = skewed_events(spark)
    got = {r["id"]: (r["prev"], r["n"]) for r in scale.running_sum(scale.with_previous(df, ["k"], "us", 3600 * S, "id"), ["k"], "us", 3600 * S, "id", F.lit(1), "n").collect()}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            assert got[r[0]] == (group[i - 1][2] if i else None, i + 1)


def test_trailing_window(spark):
    rows, df = skewed_events(spark)
    got = {r["id"]: r["in_window"] for r in ac.rate_counts(df, "k", "us", 600, 3).collect()}
    for group in by_key(rows).values():
        for r in group:
            assert got[r[0]] == sum(r[2] - 600 * S < o[2] <= r[2] for o in group)


def test_sessions(spark):
    rows, df = skewed_events(spark)
    assert scale.segment_width(df, ["k"], "us", 100) < scale.segment_width(df, ["k"], "us", 1000)
    parted = ac.split_at_gaps(df, "k", "us", 1800 * S, "id", width=scale.segment_width(df, ["k"], "us", 50))
    got = sorted(tuple(r) for r in parted.groupBy("k", "session").agg(F.min("us"), F.max("us"), F.count("*")).drop("session").collect())
    want = []
    for k, group in by_key(rows).items():
        cur = [group[0]]
        for a, b in zip(group, group[1:]):
            if b[2] - a[2] > 1800 * S:
                want.append((k, cur[0][2], cur[-1][2], len(cur)))
                cur = []
            cur.append(b)
        want.append((k, cur[0][2], cur[-1][2], len(cur)))
    assert got == sorted(want)


def test_token_bucket_and_sliding_log(spark):
    rows, df = skewed_events(spark)
    bucket = {r["id"]: r["allowed"] for r in folds.token_bucket(df, "k", "us", "id", 3.0, 1 / 600).collect()}
    log = {r["id"]: (r["allowed"], r["remaining"]) for r in folds.sliding_log(df, "k", "us", "id", 900, 2).collect()}
    for group in by_key(rows).values():
        tokens, last, kept = 3.0, group[0][2], []
        for r in group:
            tokens = min(3.0, tokens + (r[2] - last) / S / 600)
            last = r[2]
            assert bucket[r[0]] is (tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
            kept = [t for t in kept if t > r[2] - 900 * S]
            allowed = len(kept) < 2
            if allowed:
                kept.append(r[2])
            assert log[r[0]] == (allowed, 2 - len(kept))


def test_adaptive_delay_across_segments(spark):
    rows, df = skewed_events(spark)
    got = {r["id"]: r["delay"] for r in folds.adaptive_delay(df, "k", "us", "id", "outcome", width=1800 * S).collect()}
    for group in by_key(rows).values():
        delay, run = 1.0, 0
        for r in group:
            if r[3] == "success":
                run += 1
                if run >= 5:
                    delay, run = max(1.0, delay * 0.9), 0
            else:
                run = 0
                delay = min(300.0, delay * 2) if r[3] == "rate_limit" else min(60.0, delay * 1.5)
            assert got[r[0]] == pytest.approx(delay, rel=1e-9)


@pytest.mark.parametrize("few", [10_000, 5, 1])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(scale, "FEW_VALUES", few)
    rng = np.random.default_rng(1)
    for values in (rng.exponential(5, 5001), np.repeat([1.0, 2.0, 9.0], [4000, 10, 3]), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        row = scale.exact_quantiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.99}).first()
        assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(values, [0.5, 0.95, 0.99])))


def test_an_order_stays_one_document(spark, tmp_path):
    from pagemill.plans import workflows as wp

    o = spark.sql("SELECT 7L AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, '2-HIGH' AS o_orderpriority")
    line = spark.range(1, 5001).selectExpr(
        "7L AS l_orderkey", "int(id) AS l_linenumber", "id AS l_partkey", "1L AS l_suppkey", "1.0D AS l_extendedprice", "0.0D AS l_discount", "'A' AS l_returnflag", "'F' AS l_linestatus")
    o.write.parquet(str(tmp_path / "orders.parquet"))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = wp.parse_workflow(spark, str(tmp_path)).collect()
    assert [(r["o_orderkey"], r["node_count"]) for r in rows] == [(7, 5000)]
    assert wp.graph_edges(spark, str(tmp_path)).count() == 4999


def test_fingerprint_and_labels_cover_every_row(spark):
    f = spark.range(100).select("id", F.lit(5).alias("size"), F.lit(1).alias("m"))
    was = kn.fingerprint(f, "id", F.col("size"), F.col("m")).first()["checksum"]
    assert was == kn.fingerprint(f.orderBy(F.col("id").desc()).repartition(3), "id", F.col("size"), F.col("m")).first()["checksum"]
    assert was != kn.fingerprint(f.withColumn("m", F.when(F.col("id") == 77, 2).otherwise(1)), "id", F.col("size"), F.col("m")).first()["checksum"]
    v = spark.range(500).select(F.when(F.col("id") >= 400, F.col("id")).alias("label"))
    assert tuple(ve.collection_stats(v, "label").first()) == (500, 100)


def test_names_and_reachability(spark):
    files = spark.createDataFrame([(1, "a.json", "h1"), (2, "a.json", "h2"), (3, "a.json", "h1"), (4, "a.json", "h3"), (5, "b.json", "h1")], "seq long, name string, h string")
    got = {r["seq"]: (r["final_name"], r["skipped"]) for r in fr.disambiguate_names(files, "name", "h", "seq", 2).collect()}
    assert got == {1: ("a.json", 1), 2: ("a_1.json", 0), 4: ("a_2.json", 0), 5: ("b.json", 0)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in fr.reachable(edges, seeds, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [r["node"] for r in fr.reachable(edges, seeds, 9, 2).collect()] == ["a", "b"]


def test_merge_blocks(spark):
    docs = spark.createDataFrame([(1,), (2,)], "d long")
    chunks = spark.range(1, 26).select(F.lit(1).cast("long").alias("d"), F.col("id").alias("i"), F.col("id").alias("v"))
    got = mg.documents_with_chunks(docs, chunks, "d", "i", ["v"], block=10).collect()
    assert sorted(len(r["chunks"]) for r in got if r["chunks"]) == [5, 10, 10] and sum(r["chunks"] is None for r in got) == 1


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((400, 16)).astype(np.float32)
    m = np.vstack([m, m[:1].repeat(200, axis=0)])  # many copies of one vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(5)
    q = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit[:20] @ unit.T
    want = {i: [int(j) for j in np.lexsort((np.arange(len(m)), -np.round(sims[i], 5)))[:5]] for i in range(20)}
    got = defaultdict(dict)
    for r in ve.bulk_top_k(df, "vec_id", q, "query_id", 5, block=7).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert all([got[i][k] for k in range(1, 6)] == want[i] for i in range(1, 20))


@pytest.mark.parametrize("part", [8192, 50])
def test_inverted_lists(spark, monkeypatch, part):
    """Recall against the exact search, on vectors without clusters and many copies of one."""
    monkeypatch.setattr(ivf, "PART", part)
    rng = np.random.default_rng(6)
    m = rng.standard_normal((1500, 24)).astype(np.float32)
    m = np.vstack([m, m[:1].repeat(300, axis=0)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = df.filter("vec_id BETWEEN 1 AND 60").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in ve.bulk_top_k(df, "vec_id", q, "query_id", 5, block=17, part=100).collect()}
    quantiser = ivf.fit(df, "vec_id")
    index = ivf.index(df, "vec_id", quantiser)
    assert index.count() == 1800
    found = {(r["query_id"], r["vec_id"]) for r in ivf.search(index, quantiser, df, "vec_id", q, "query_id", 5).collect()}
    recall, read = len(found & exact) / len(exact), ivf.share_read(index, quantiser, q, "query_id")
    print(f"recall at 5: {recall:.3f}; codes read: {read:.2f}; rows scored exactly: {100 / 1800:.3f}")
    assert len(exact) == 300 and recall >= 0.9 and read < 0.75


def test_queries_are_sent_to_parts_not_to_lists(spark, monkeypatch):
    """What is sent grows with the rows, and any cut into parts and blocks finds the same."""
    sent = lambda n, q: q * (at := ivf.dealt_into(n, q))[0] + n * at[1]
    assert sent(102_564, 10_260) < 30 * 102_564 and sent(615_384, 61_560) < 6 * sent(102_564, 10_260)
    rng = np.random.default_rng(9)
    m = rng.standard_normal((700, 16)).astype(np.float32)
    m = np.vstack([m, m[:1].repeat(200, axis=0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    q = df.filter("vec_id < 50").select(F.col("vec_id").alias("query_id"), "embedding")
    quantiser = ivf.fit(df, "vec_id")
    index = ivf.index(df, "vec_id", quantiser)
    found = []
    for part, block in ((1 << 19, 1 << 12), (100, 9)):
        monkeypatch.setattr(ivf, "PART", part)
        monkeypatch.setattr(ivf, "BLOCK", block)
        found.append({(r["query_id"], r["rank"], r["vec_id"]) for r in ivf.search(index, quantiser, df, "vec_id", q, "query_id", 5).collect()})
    assert found[0] == found[1] and len(found[0]) == 250


def test_best_codes_against_all_scores(monkeypatch):
    """The short list is cut while lists are gone through; equal codes go by their place."""
    rng = np.random.default_rng(10)
    points = rng.standard_normal((400, 8))
    centres = ivf.lloyd(points, 12, 5, 1)
    own = ivf.Quantiser(centres, rng.standard_normal((4, 6, 2)))
    lists = own.nearest(points, 1)[:, 0]
    codes = own.codes(points, lists)
    points, lists, codes = np.vstack([points, points[:90]]), np.append(lists, lists[:90]), np.vstack([codes, codes[:90]])
    units = points[:30]
    monkeypatch.setattr(ivf, "SCORES", 200)
    asking, columns, scores = ivf.best_codes(own, units, 7, lists, codes, 10)
    for i, u in enumerate(units):
        near = set(own.nearest(u[None], 7)[0])
        all_scores = {c: u @ (own.centres[lists[c]] + np.concatenate([own.books[p][codes[c, p]] for p in range(4)])) for c in range(490) if lists[c] in near}
        want = sorted(all_scores, key=lambda c: (-round(all_scores[c], 9), c))[:10]
        assert list(columns[asking == i]) == want and np.allclose(scores[asking == i], [all_scores[c] for c in want])


def test_positional_postings(spark):
    rng = np.random.default_rng(8)
    said = {i: [str(x) for x in rng.choice(["a", "ab", "abc", "b", "ba"], rng.integers(0, 30))] for i in range(80)}
    said[80] = ["a", "a", "a", "a"]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in said.items()] + [(99, None)], "id long, text string").repartition(3)
    index = ft.positions(docs, "id", "text").cache()

    def times(tokens, unit):
        n = len(unit.words)
        fits = lambda w, x, i: w.startswith(x) if unit.prefix and i == n - 1 else w == x
        return sum(all(fits(tokens[at + i], unit.words[i], i) for i in range(n)) for at in range(len(tokens) - n + 1))

    for branches in ([ft.All((ft.phrase("a a"),))], [ft.All((ft.phrase("A ab b", prefix=True), ft.word("ba")))], [ft.All((ft.prefix("ab"),), (ft.phrase("b a"), ft.word("abc")))],
                     [ft.All((ft.phrase("a b"),)), ft.All((ft.phrase("abc abc"),), (ft.prefix("ba"),))], [ft.All((ft.word("zz"),))]):
        want = {i for i, t in said.items() if any(all(times(t, u) for u in b.units) and not any(times(t, u) for u in b.without) for b in branches)}
        got = {r["id"]: r["score"] for r in ft.search(index, "id", branches, 82).collect()}
        assert set(got) == want and all(x > 0 for x in got.values())
    tf = {r["id"]: r["tf"] for r in ft.occurrences(index, "id", [ft.phrase("a a")]).collect()}
    assert tf == {i: times(t, ft.phrase("a a")) for i, t in said.items() if times(t, ft.phrase("a a"))} and tf[80] == 3
    index.unpersist()


def test_postings_are_made_in_segments(spark, monkeypatch):
    """One row for each different word of a text, sorted in each segment; only texts are dealt."""
    monkeypatch.setattr(ft, "SEGMENT", 200)
    said = {i: ["a b a", "b", "", "c é c c"][i % 4] for i in range(60)}
    docs = spark.createDataFrame(list(said.items()) + [(99, None)], "id long, text string")
    index = ft.positions(docs, "id", "text")
    got = index.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 75 and {r["part"] for r in got} == set(range(2))
    assert [(r["part"], r["term"], r["id"]) for r in got] == sorted((r["part"], r["term"], r["id"]) for r in got)
    assert {(r["id"], r["term"]): r["positions"] for r in got} == {(i, w): [n for n, x in enumerate(t.split()) if x == w] for i, t in said.items() for w in t.split()}
    assert all(r["size"] == len(said[r["id"]].split()) and r["tf"] == len(r["positions"]) for r in got)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange") == 1


def test_kept_tables_follow_their_source(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def total():
        source = spark.read.parquet(path)
        return session.kept("sums", source, lambda: built.append(1) or source.agg(F.sum("x").alias("s"))).first()["s"]

    spark.range(5).select(F.col("id").alias("x")).write.parquet(path)
    assert total() == total() == 10 and len(built) == 1
    spark.range(3).select(F.col("id").alias("x")).write.mode("append").parquet(path)
    assert total() == 13 and len(built) == 2
    session.forget_kept(spark)
    assert total() == 13 and len(built) == 3


def test_embedding_rules(spark):
    df = spark.createDataFrame([(1, "some words"), (2, " "), (3, "some words"), (4, "boom")], "id long, t string")

    def load():
        inner = hashing_encoder(8)

        def encode(ts):
            if "boom" in ts:
                raise ValueError("no")
            return inner(ts)

        return encode

    got = {r["id"]: r for r in ve.embed(df, "id", "t", load, dim=8, batch=1).collect()}
    assert got[1]["embedding"] == got[3]["embedding"] and np.linalg.norm(got[1]["embedding"]) == pytest.approx(1, abs=1e-5)
    assert got[2]["error"] == "empty text" and set(got[4]["embedding"]) == {0.0} and "encoder failed" in got[4]["error"]


def test_search_small(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "a"), (4, "")], "id long, text string")
    scan = {r["id"]: r["score"] for r in se.bm25_scan(docs, "id", "text", ["a", "b"]).collect()}
    size = 4
    index = se.build_index(docs, "id", "text")
    assert {r["id"]: r["score"] for r in se.search_index(index, "id", ["a", "b"], size, 1.5).collect()} == pytest.approx(scan) and set(scan) == {1}
    assert spark.createDataFrame([("The other thé the.",)], "c string").select(se.highlight(F.col("c"), "the").alias("h")).first()["h"] == "<em>The</em> other thé <em>the</em>."


def test_best_of_many_rows_holds_few_scores(monkeypatch):
    import numpy as np

    from pagemill.operators import vectors as ve

    monkeypatch.setattr(ve, "SCORES", 1000)
    table, held = np.random.default_rng(5).integers(0, 9, (130, 90)).astype(float), []
    rows, columns, scores = ve.best_by_slices(130, 90, 4, lambda s: held.append(table[s].size) or table[s])
    assert [(r, c) for r, c in zip(rows, columns)] == [(r, c) for r in range(130) for c in np.argsort(-table[r], kind="stable")[:4]]
    assert (scores == table[rows, columns]).all() and max(held) <= 1000
    assert [len(x) for x in ve.best_by_slices(3, 0, 4, None)] == [0, 0, 0]
