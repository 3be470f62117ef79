"""Set-similarity and spelling joins against all pairs; tables rewritten by bucket."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import merge as mg
from pagemill.operators import setjoin as sj
from pagemill.operators import trends as tr
from pagemill.plans import QUERIES
from tests.conftest import rows


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, threshold):
    """One token is in nearly every set, one set has many copies, one is empty, one is null."""
    rng = random.Random(3)
    sets = {i: ["all"] * (rng.random() < 0.9) + [f"t{rng.randint(0, 12)}" for _ in range(rng.randint(0, 7))] for i in range(120)}
    sets |= {i: ["x", "y", "x", None] for i in range(120, 160)} | {160: [], 161: None}
    classes, members = sj.set_classes(spark.createDataFrame(list(sets.items()), "k long, s array<string>"), "k", "s")
    plain = {}
    for k, s in sets.items():
        if s is not None:
            plain.setdefault(frozenset(x for x in s if x), []).append(k)
    assert dict(rows(members)) == {k: v[0] for v in plain.values() for k in v}
    want = {(min(plain[a][0], plain[b][0]), max(plain[a][0], plain[b][0])): len(a & b) / len(a | b) for a in plain for b in plain if a and b and a != b and len(a & b) / len(a | b) >= threshold}
    assert {(r["a"], r["b"]): r["similarity"] for r in sj.similar_sets(classes, threshold).collect()} == pytest.approx(want)


def test_sets_are_made_once(spark):
    """However often classes and members are joined, no set is computed again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(i):
        made.add(1)
        return [f"t{i % 3}", f"t{i % 4}"]

    classes, members = sj.set_classes(spark.range(48).repartition(3).select(F.col("id").alias("k"), tokens("id").alias("s")), "k", "s")
    pairs = sj.similar_sets(classes, 0.3)
    assert members.join(pairs, F.col("rep") == F.col("a")).count() > 0 and members.count() == 48 and pairs.count() == pairs.distinct().count()
    assert made.value == 48


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2])
def test_corrections_against_all_pairs(spark, limit):
    rng = random.Random(limit)
    terms = {"".join(rng.choices("abcé", k=rng.randint(1, 16))): rng.randint(1, 9) for _ in range(150)}
    asked = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(40)] + [t[:-1] + "x" for t in list(terms)[:40]] + [t[1:] for t in list(terms)[40:60]] + ["", None, "zzzzzzzz"]
    got = {r["word"]: (r["correction"], r["distance"]) for r in sj.correct_words(
        spark.createDataFrame(list(terms.items()), "term string, n long"), spark.createDataFrame([(a,) for a in asked], "w string"), "w", limit).collect()}
    want = {}
    for a in set(asked) - {None}:
        near = [(distance(a, t), -n, t) for t, n in terms.items() if distance(a, t) <= limit]
        want[a] = (min(near)[2], min(near)[0]) if near else (None, None)
    assert got == want


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "store")
    store = mg.BucketStore(spark, path, "k", 8)
    store.create(spark.createDataFrame([(i, f"h{i}", "old") for i in [*range(40), None]], "k long, h string, v string"))
    before = files(path)
    batch = spark.createDataFrame([(3, "h3", "same"), (5, "new", "new"), (100, "h100", "new")], "k long, h string, v string")
    touched = set(store._touched(batch))
    store.upsert(batch, "h")
    after = files(path)
    changed = lambda a: {int(f.split("bucket=")[1].split("/")[0]) for f in a}
    assert changed(before ^ after) <= touched and len(before & after) >= 8 - len(touched)
    assert {r["k"]: r["v"] for r in store.read().collect()} == {**{i: "old" for i in [*range(40), None]}, 5: "new", 100: "new"}
    store.update(spark.createDataFrame([(7, "seven")], "k long, v string"), ["v"])
    assert store.read().filter("k = 7").first()["v"] == "seven"
    placed = {r["k"]: r["bucket"] for r in store._placed(store.read()).collect()}
    emptied = next(b for b in range(8) if b in placed.values() and b != placed[None])
    gone = {k for k, b in placed.items() if b == emptied}
    store.delete(spark.createDataFrame([(k,) for k in gone] + [(None,)], "k long"))
    assert {r["k"] for r in store.read().collect()} == set(placed) - gone and not any(f"bucket={emptied}/" in f for f in files(path))


def test_trends_keep_null_days_and_metrics(spark):
    events = spark.createDataFrame([("a", None)] * 3 + [("b", None)] + [("a", "2024-01-01 00:00:00")], "topic string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    series = {(r["topic"], r["day"]): r["popularity"] for r in tr.daily_series(events, "topic", "ts").collect()}
    assert series[("a", None)] == 0.75 and series[("b", None)] == 0.25 and len(series) == 3
    points = spark.createDataFrame([(m, i, 1.0 + i % 2) for m in ("x", None) for i in range(20)] + [(None, 99, 50.0), ("x", 99, 50.0)], "metric string, ts long, value double")
    found = tr.anomalies(points, "metric", "ts", "value").collect()
    assert sorted((str(r["metric"]), r["ts"]) for r in found) == [("None", 99), ("x", 99)] and all(r["description"] for r in found)


def test_only_the_named_host_is_blocked(spark, tmp_path):
    urls = ["http://spam-farm.example.org/en/1", "http://www.spam-farm.example.com/en/2", "http://a.example.org/en/spam-farm"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("")).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["reason"] for r in QUERIES["U12_should_scrape"](spark, str(tmp_path)).collect()}
    assert got[0] == "Domain blocked: spam-farm.example.org" and got[1] == got[2] == "Pattern excludes URL: spam-farm|cheap-pills"
