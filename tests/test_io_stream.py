import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import chunks as ch
from pagemill.operators import knowledge as kn
from pagemill.operators import reports as rp
from pagemill.operators import workflows as wf
from pagemill.sources import files, sinks
from pagemill.plans import QUERIES
from pagemill.streaming import jobs


def page(n, **extra):
    return {"url": f"https://a.example.com/{n}", "title": f"T{n}", "content": "some text", "headings": [{"level": 1, "text": "H", "id": ""}], "metadata": {"k": "v"}, "word_count": 2, **extra}


@pytest.fixture
def folder(tmp_path):
    for n in range(3):
        (tmp_path / f"p{n}.json").write_text(json.dumps(page(n), indent=2))
    (tmp_path / "empty.json").write_text(json.dumps(page(7, content="")))
    (tmp_path / "broken.json").write_text('{"url": ')
    (tmp_path / "scraping_summary.json").write_text('{"pages": []}')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.json").write_text(json.dumps(page(9)))
    return str(tmp_path)


def test_page_scan(spark, folder):
    got = files.scan_pages_json(spark, folder)
    assert sorted(r["title"] for r in got.collect()) == ["T0", "T1", "T2", "T7"]
    counts, errors = files.scan_status(files.scan_json_recursive(spark, folder))
    assert {r["status"]: r["n"] for r in counts.collect()} == {"processed": 4, "skipped": 1, "error": 1}
    assert errors.first()["file_path"].endswith("broken.json")
    hashed = files.scan_binary_with_hash(spark, folder, "p*.json")
    assert hashed.count() == 3 and all(r["file_size"] > 0 for r in hashed.collect())


def test_log_filter_runs_before_the_limit(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"{i} {'ERROR' if i in (1, 8) else 'INFO'}" for i in range(10)))
    assert [r["value"] for r in files.scan_log_text(spark, str(tmp_path), "error", 5).collect()] == ["8 ERROR", "1 ERROR"]


def test_snapshot_round_trip(spark, tmp_path):
    root, df = str(tmp_path / "s"), spark.range(100).withColumn("v", F.col("id") * 2)
    sinks.snapshot(df, root, "20240101000000")
    sinks.snapshot(df.limit(10), root, "20240105000000")
    assert sinks.restore(spark, root, "20240101000000").exceptAll(df).count() == 0
    kept = sinks.kept_snapshots(sinks.manifest(spark, root), "2024-01-06 00:00:00", 3).collect()
    assert [(r["stamp"], r["rows"]) for r in kept] == [("20240105000000", 10)]
    assert files.new_or_changed_files(spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "path string, mtime long"),
                                      spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime long")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x'), ("", "z")], "x string, y string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted((r["x"] or "", r["y"]) for r in files.scan_csv(spark, str(tmp_path / "c"), ["x", "y"]).collect()) == [("", "z"), ("a,b", 'q"x')]


def workflows(spark, *docs):
    return spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(docs)], "stem string, json string")


def test_workflow_validation_and_repair(spark):
    df = workflows(spark, "", '{"nodes": [1,],}', '{"name": "X"}', '{"name": "My workflow", "nodes": [1], "connections": {"a": 1}}', '{"a": "b"c"}')
    got = {r["stem"]: (r["errors"], r["warnings"]) for r in wf.validate(df).collect()}
    assert got["f0"][0] == ["Empty file"] and got["f1"][0] == ["Invalid JSON"] and got["f4"][0] == ["Invalid JSON"]
    assert got["f2"][0] == ["Missing required field: nodes", "Missing required field: connections"]
    assert got["f3"] == ([], ["Default or empty workflow name"])
    fixed = {r["stem"]: (r["repaired"], r["was_repaired"]) for r in wf.repair(df).collect()}
    assert json.loads(fixed["f1"][0]) == {"nodes": [1], "connections": {}} and fixed["f1"][1]
    assert json.loads(fixed["f2"][0]) == {"name": "X", "nodes": [], "connections": {}} and not fixed["f2"][1]
    assert fixed["f4"] == ('{"a": "b"c"}', False)


def test_workflow_triggers_and_services(spark):
    node = lambda t, n="n": {"name": n, "type": t, "typeVersion": 2, "parameters": {}, "notes": ""}
    doc = lambda *ns: json.dumps({"name": "A", "tags": ["x", {"name": "y"}, {"id": 3}, {}], "nodes": ns, "connections": {}})
    b = "base-nodes."
    df = workflows(spark, doc(node(b + "cron"), node(b + "webhook")), doc(node(b + "webhook"), node(b + "cron")), doc(node(b + "gmailTrigger")), doc(node(b + "manualTrigger")),
                   doc(node(b + "set", "Slack step"), node("x-nodes.youtubeThing"), node(b + "foobar")), doc(*[node(b + s) for s in ("slack", "gmail", "notion", "jira")] * 3))
    p = wf.parse(df).withColumn("s", wf.integrations(F.col("nodes"), (b,))).withColumn("t", wf.trigger_type(F.col("nodes"), F.size("s")))
    got = {r["stem"]: (r["t"], r["s"]) for r in p.collect()}
    assert [got[f"f{i}"][0] for i in range(6)] == ["Webhook", "Scheduled", "Webhook", "Manual", "Manual", "Complex"]
    assert got["f2"][1] == ["Gmail"] and got["f4"][1] == ["Foobar", "Slack", "YouTube"]
    assert p.first()["tags"] == ["x", "y", "3", "tag"]


def test_stream_drops_late_rows_and_matches_batch(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    t0 = datetime(2024, 1, 1)
    first = [(t0 + timedelta(minutes=7 * i), "a" if i % 3 else "b", 1.0) for i in range(40)]
    late = [(t0 + timedelta(minutes=1), "a", 100.0), (t0 + timedelta(minutes=400), "a", 1.0)]
    folder = str(tmp_path / "in")
    log, sink = str(tmp_path / "log"), str(tmp_path / "out")
    for i, part in enumerate((first, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.tumbling(jobs.file_stream(spark, folder, spark.createDataFrame([], schema).schema, "*.parquet"), "ts", "k", "v")
        jobs.drain(stream, "append", sink, log)
    got = {(r["start"], r["k"]): (r["n"], r["total"]) for r in spark.read.parquet(sink).collect()}
    batch = spark.createDataFrame(first, schema).groupBy(F.window("ts", "1 hour").alias("w"), "k").agg(F.count("*").alias("n"), F.sum("v").alias("t"))
    want = {(r["w"]["start"], r["k"]): (r["n"], r["t"]) for r in batch.collect()}
    assert got == want  # the late row is not in its window, and nothing else is lost


def test_stream_index_and_bounded_log(spark, tmp_path):
    docs, log, out = str(tmp_path / "docs"), str(tmp_path / "log"), str(tmp_path / "out")
    build = lambda df: ch.explode_chunks(df, "doc_id", ch.stride_chunks(F.col("text")))
    for part in ([(1, "a" * 900), (2, "b")], [(2, "b"), (3, "c" * 10)]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
        stream = jobs.file_stream(spark, docs, spark.read.parquet(docs).schema, "*.parquet")
        jobs.incremental_index(stream, "doc_id", build, out, log)
    assert sorted((r["doc_id"], r["chunk_index"]) for r in spark.read.parquet(out).collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    table, log2 = str(tmp_path / "t"), str(tmp_path / "log2")
    jobs.keep_newest(jobs.file_stream(spark, docs, spark.read.parquet(docs).schema, "*.parquet", max_files=1), "text", "doc_id", 1, table, log2)
    last = max(os.listdir(table))
    assert {r["doc_id"] for r in spark.read.parquet(f"{table}/{last}").collect()} == {1, 2, 3}


def test_hooks_and_update_cycle(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "id long, t string")
    out = kn.with_hooks(df, [lambda d: d.withColumn("t", F.lower("t")), lambda d: d.missing()], lambda d: d, [lambda d: d.filter("id = 1")])
    assert [tuple(r) for r in out.collect()] == [(1, "a")]
    old, new = (spark.createDataFrame(r, "k long, m long") for r in ([(1, 1), (2, 1)], [(2, 2), (3, 1)]))
    row, done = rp.update_cycle(old, new, "k", "m", {"a": lambda d: d.count(), "b": lambda d: 1 / 0, "c": lambda d: d.count()})
    r = row.first()
    assert (r["new_files"], r["modified_files"], r["deleted_files"], r["steps_failed"], r["success"]) == (1, 1, 1, 1, False) and done == {"a": True, "b": False}
    assert kn.is_stale({"file_count": 1, "checksum": "x"}, {"file_count": 1, "checksum": "x"}, 25) and not kn.is_stale({"file_count": 1, "checksum": "x"}, {"file_count": 1, "checksum": "x"}, 1)


@pytest.mark.parametrize("parts", [0, 3])
def test_table_stream_reads_one_file_and_a_folder_of_parts(spark, sf, tmp_path, parts):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    if parts:
        d.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path) if parts else sf
    for name in ("S12_streaming_file_source", "Z11_incremental_index"):
        got = QUERIES[name](spark, folder)
        assert got.select("doc_id").distinct().count() == d.filter("text <> ''" if name[0] == "Z" else "true").select("doc_id").distinct().count()


def test_one_file_for_each_row_is_written_by_the_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    values = [f'{{"url": "u{i}",\n "content": "t\u00e9{i}"}}' for i in range(40)] + ["", None]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(5)
    for _ in range(2):  # written anew, not added
        sinks.write_one_per_file(df, path, "json")
        names = sorted(os.listdir(path))
        assert len(names) == 42 and all(n.endswith(".json") for n in names)  # no side files, which driver renames would leave
        assert sorted(open(f"{path}/{n}", encoding="utf-8").read() for n in names) == sorted((v or "") + "\n" for v in values)
    assert files.scan_pages_json(spark, path).filter("url IS NOT NULL").count() == 40
