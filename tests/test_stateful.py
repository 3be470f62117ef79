"""Streams with list, map and value state; files that change between two runs."""

from __future__ import annotations

import datetime
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagemill.operators import merge as mg
from pagemill.streaming import jobs, stateful

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, user long, doc long, kind string, ts timestamp_ntz"


def batches(spark, path, rows, parts):
    """The rows in time order as files that a stream takes one by one."""
    os.makedirs(path)
    rows = sorted(rows, key=lambda r: r[4])
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        columns = list(zip(*part, strict=True)) if part else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.timestamp("us")]
        pq.write_table(pa.table({n: pa.array(c, k) for n, c, k in zip(["id", "user", "doc", "kind", "ts"], columns, kinds, strict=True)}), f"{path}/part{i}.parquet")
        os.utime(f"{path}/part{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, max_files=1)


def events(n, users, seed=1, hours=400):
    rng = random.Random(seed)
    return [(i, 1 if rng.random() < 0.4 else rng.randint(2, users), rng.randint(1, 3), rng.choice(["in", "in", "out", "other"]), DAY + datetime.timedelta(seconds=rng.randint(0, hours * 3600))) for i in range(n)]


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_bounded_log_keeps_the_newest_of_each_key(spark, tmp_path):
    rows, progress = events(900, 8), []
    stream = batches(spark, str(tmp_path / "in"), rows, 4)
    sink = jobs.drain(stateful.bounded_log(stream, "ts", "user", "id", 10), "update", state=jobs.ROCKS, progress=progress)
    got = {(r["user"], r["rank"]): r["id"] for r in jobs.newest_updates(spark, sink, ["user", "rank"]).collect()}
    want = {}
    for user in {r[1] for r in rows}:
        newest = sorted(((r[4], r[0]) for r in rows if r[1] == user), reverse=True)[:10]
        want |= {(user, i): ident for i, (_, ident) in enumerate(newest, 1)}
    assert got == want and len(progress) >= 4
    # what is held does not follow the number of events: at most ten entries for each of eight keys
    assert max(state_rows(progress)) <= 8 * 10


def test_presence_times_out_and_leaves_no_state(spark, tmp_path):
    rows, progress = [r for r in events(1500, 300, seed=2) if r[3] != "other"], []
    rows.append((9999, 77, 1, "in", DAY + datetime.timedelta(hours=420)))
    sink = jobs.drain(stateful.presence(batches(spark, str(tmp_path / "in"), rows, 5), "ts", "doc", "user", "id", "in", "out", "kind", 48), "update", state=jobs.ROCKS, progress=progress)
    got = {(r["doc"], r["user"]) for r in jobs.newest_updates(spark, sink, ["doc", "user"]).filter("present").collect()}
    mark = max(r[4] for r in rows) - datetime.timedelta(minutes=10)
    last = {}
    for r in rows:
        last[(r[2], r[1])] = max(last.get((r[2], r[1]), (DAY, -1, "")), (r[4], r[0], r[3]))
    fresh = {k: v for k, v in last.items() if v[0] + datetime.timedelta(hours=48) > mark}
    assert got == {k for k, v in fresh.items() if v[2] == "in"} and 0 < len(got) < len(fresh) < len(last) / 2
    # one value for each key that was active in the last two days, out of several hundred
    assert state_rows(progress)[-1] == len(fresh) < max(state_rows(progress)) / 2


def test_entries_expire_by_timer(spark, tmp_path):
    rows, progress = events(800, 5, seed=3), []
    sink = jobs.drain(stateful.expiring_entries(batches(spark, str(tmp_path / "in"), rows, 4), "ts", "user", "id", 24, shards=4), "update", state=jobs.ROCKS, progress=progress)
    got = {r["id"] for r in jobs.newest_updates(spark, sink, ["user", "id"]).filter("live").collect()}
    mark = max(r[4] for r in rows) - datetime.timedelta(minutes=10)
    want = {r[0] for r in rows if r[4] + datetime.timedelta(hours=24) > mark}
    assert got == want and 0 < len(want) < 100
    assert state_rows(progress)[-1] == len(want) < max(state_rows(progress))


@pytest.mark.parametrize("kind", ["parquet", "text"])
def test_changed_files_come_again(spark, tmp_path, kind):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    store = mg.BucketStore(spark, str(tmp_path / "index"), "key", 4)
    schema = spark.createDataFrame([], "key string, body string" if kind == "parquet" else "path string, modified timestamp, content string").schema

    def write(name, body, at):
        os.makedirs(folder, exist_ok=True)
        if kind == "parquet":
            pq.write_table(pa.table({"key": [name], "body": [body], "unread": [1]}), f"{folder}/{name}")
        else:
            with open(f"{folder}/{name}", "w") as f:
                f.write(body)
        os.utime(f"{folder}/{name}", (at, at))

    def run():
        key, body = ("key", "body") if kind == "parquet" else (F.element_at(F.split("path", "/"), -1), "content")
        stream = jobs.changed_files(spark, folder, schema, "doc*", kind).select(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), F.col(body).alias("body"))
        build = lambda df: df.select("key", F.explode(F.split("body", " ")).alias("word"))
        jobs.changing_index(stream, "key", build, store, log)
        return sorted((r["key"], r["word"]) for r in store.read().collect())

    now = int(time.time()) - 1000
    for name, body in (("doc1", "a b"), ("doc2", "c"), ("doc3", "d e"), ("other", "z"), ("_doc4", "z")):
        write(name, body, now)
    assert run() == [("doc1", "a"), ("doc1", "b"), ("doc2", "c"), ("doc3", "d"), ("doc3", "e")]
    assert run() == [("doc1", "a"), ("doc1", "b"), ("doc2", "c"), ("doc3", "d"), ("doc3", "e")]
    write("doc1", "new", now + 10)
    write("doc5", "f", now + 10)
    assert run() == [("doc1", "new"), ("doc2", "c"), ("doc3", "d"), ("doc3", "e"), ("doc5", "f")]


def test_native_entries_leave_the_state_by_the_watermark(spark, tmp_path):
    rows, progress = events(800, 5, seed=3), []
    sink = jobs.drain(jobs.live_entries(batches(spark, str(tmp_path / "in"), rows, 4), "ts", "user", "id", 24), "update", state=jobs.ROCKS, progress=progress)
    got = [r["id"] for r in jobs.unexpired(spark.read.parquet(sink), progress).collect()]
    mark = max(r[4] for r in rows) - datetime.timedelta(minutes=10)
    want = {r[0] for r in rows if r[4] + datetime.timedelta(hours=24) > mark}
    assert sorted(got) == sorted(want) and 0 < len(want) < 100
    assert state_rows(progress)[-1] == len(want) < max(state_rows(progress))
    assert max(p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in progress) == 0  # no call into Python for each entry


def test_native_moves_and_silence(spark, tmp_path):
    rows, progress = [r for r in events(1500, 300, seed=2) if r[3] != "other"], []
    rows.append((9999, 77, 1, "in", DAY + datetime.timedelta(hours=420)))
    sink = jobs.drain(jobs.last_moves(batches(spark, str(tmp_path / "in"), rows, 5), "ts", "doc", "user", "id", "in", "out", "kind", 48), "update", state=jobs.ROCKS, progress=progress)
    last = spark.read.parquet(sink).groupBy("doc", "user").agg(F.max(F.struct("us", "id", "joined", "expires_at")).alias("m")).select("doc", "user", "m.*")
    got = {(r["doc"], r["user"]) for r in jobs.unexpired(last.filter("joined"), progress).collect()}
    mark, want = max(r[4] for r in rows) - datetime.timedelta(minutes=10), {}
    for r in rows:
        want[(r[2], r[1])] = max(want.get((r[2], r[1]), (DAY, -1, "")), (r[4], r[0], r[3]))
    assert got == {k for k, v in want.items() if v[0] + datetime.timedelta(hours=48) > mark and v[2] == "in"} and got
    assert state_rows(progress)[-1] < max(state_rows(progress)) / 2
