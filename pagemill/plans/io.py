"""Source and sink queries: tables written out by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls as ux
from pagemill.operators import html_records as hr
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import REC, pages, records
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q
from pagemill.plans.urls import CATEGORY_SQL, SECTION_CTE, section_urls
from pagemill.session import checkpoint_root
from pagemill.sources import files, sinks
from pagemill.streaming import jobs


def folder(spark, name):
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _page_files(spark, sf):
    path = folder(spark, "pages-json")
    r = records(spark, sf).select("url", "title", F.col("main_content").alias("content"), tx.word_count(F.col("main_content")).alias("word_count"))
    sinks.write_json(r.withColumn("content_hash", F.md5(F.encode("content", "UTF-8"))), path)
    return path


@query("S1_scan_pages_json", REC + f" SELECT url, title, md5(main_content) AS content_hash, {sp.wc('main_content')} AS word_count FROM rec")
def scan_pages(spark, sf):
    return files.scan_pages_json(spark, _page_files(spark, sf), one_per_file=False).select("url", "title", "content_hash", "word_count")


@query("S2_scan_json_status", REC + " SELECT CASE WHEN main_content = '' THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n FROM rec GROUP BY 1")
def scan_status(spark, sf):
    return files.scan_status(files.scan_json_recursive(spark, _page_files(spark, sf), one_per_file=False))[0]


@query("S1_scan_one_per_file", REC + f" SELECT url, title, md5(main_content) AS content_hash, {sp.wc('main_content')} AS word_count FROM rec")
def scan_one_per_file(spark, sf):
    """Every record in a file of its own, written over several lines of one object."""
    path = folder(spark, "page-files")
    r = records(spark, sf).select("url", "title", F.col("main_content").alias("content"), tx.word_count(F.col("main_content")).alias("word_count"))
    lines = F.to_json(F.struct("url", "title", "content", "word_count", F.md5(F.encode("content", "UTF-8")).alias("content_hash")), {"pretty": "true"})
    sinks.write_one_per_file(r.select(lines.alias("value")), f"{path}", "json")
    return files.scan_pages_json(spark, path).select("url", "title", "content_hash", "word_count")


@query("S2_failing_files", "SELECT CASE WHEN page_id % 7 = 3 THEN 'error' ELSE 'processed' END AS status, count(*) AS n, md5(coalesce(string_agg(CASE WHEN page_id % 7 = 3 THEN '{\"url\": \"' || url || '\", \"content\": ' END, '|' ORDER BY url), '')) AS texts FROM pages GROUP BY 1")
def failing_files(spark, sf):
    """Files that break off are listed with their text; the others are read."""
    path = folder(spark, "page-files")
    whole = F.to_json(F.struct("url", F.lit("text").alias("content")))
    broken = F.concat(F.lit('{"url": "'), "url", F.lit('", "content": '))
    sinks.write_one_per_file(table(spark, sf, "pages").select(F.when(F.col("page_id") % 7 == 3, broken).otherwise(whole).alias("value")), path, "json")
    counts, errors = files.scan_status(files.scan_json_recursive(spark, path))
    texts = F.array_sort(F.collect_list(F.regexp_replace("error", "\n$", "")))
    listed = errors.groupBy(F.lit("error").alias("status")).agg(F.md5(F.array_join(texts, "|")).alias("texts"))
    return counts.join(listed, "status", "left").select("status", "n", F.coalesce("texts", F.md5(F.lit(""))).alias("texts"))


@query("S3_scan_binary_with_hash")
def scan_binary(spark, sf):
    scanned = files.scan_binary_with_hash(spark, _page_files(spark, sf), "*.json")
    return scanned.select("file_hash", "file_size")


@query("S3_hash_of_each_file", "SELECT md5(html || chr(10)) AS file_hash, strlen(html) + 1 AS file_size FROM pages")
def hash_of_each_file(spark, sf):
    """Every page as a file of its own, hashed from its bytes."""
    path = folder(spark, "html-files")
    sinks.write_one_per_file(table(spark, sf, "pages").select(F.col("html").alias("value")), path, "html")
    return files.scan_binary_with_hash(spark, path, "*.html").select("file_hash", "file_size")


@query("S4_scan_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def scan_csv(spark, sf):
    path, columns = folder(spark, "orders-csv"), ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    sinks.write_csv(table(spark, sf, "orders").select(*columns), path)
    return files.scan_csv(spark, path, columns)


@query("S5_scan_log_text", "WITH l AS (SELECT 'event ' || event_id || CASE event_type WHEN 'error' THEN ' ERROR' ELSE ' INFO' END || ' user ' || user_id AS value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT value FROM l")
def scan_log(spark, sf):
    path = folder(spark, "log-text")
    line = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", " ERROR").otherwise(" INFO"), F.lit(" user "), F.col("user_id").cast("string"))
    table(spark, sf, "events").orderBy("ts", "event_id").select(line.alias("value")).write.text(path)
    return files.scan_log_text(spark, path, "error", 200)


@query("S7_csv_written", REC + f" SELECT url, title, {sp.wc('main_content')} AS word_count, len(h1s) AS headings_count, len(hrefs) AS links_count FROM rec")
def csv_written(spark, sf):
    """Counts of the nested fields as CSV, read back."""
    path = folder(spark, "page-counts")
    r = records(spark, sf).select("url", "title", tx.word_count(F.col("main_content")).alias("word_count"), "headings", F.col("raw_links").alias("links"))
    sinks.write_csv(sinks.page_counts(r), path)
    return spark.read.schema("url string, title string, word_count long, headings_count long, links_count long").option("header", True).option("escape", '"').csv(path)


@query("S7_csv_page_index", f"""WITH {SECTION_CTE}, {sp.PAGES_CTE.strip()}, p AS (SELECT page_id, {CATEGORY_SQL} AS category, url FROM sec)
SELECT p.url, title, category, length(main_content) AS content_length, {sp.wc('main_content')} AS word_count, '2024-02-01T00:00:00Z' AS scraped_at FROM p JOIN rec USING (page_id)""")
def csv_page_index(spark, sf):
    """The other set of columns: what each page is, how long, and when it was read."""
    path = folder(spark, "page-index")
    urls = section_urls(spark, sf).select("page_id", "url", ux.category(F.col("url")).alias("category"))
    r = records(spark, sf).select("page_id", "title", F.col("main_content").alias("content"))
    sinks.write_csv(sinks.page_index(urls.join(r, "page_id"), "2024-02-01T00:00:00Z"), path)
    columns = "url string, title string, category string, content_length long, word_count long, scraped_at string"
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)


@query("S8_sink_json", "SELECT doc_id, lang, md5(text) AS content_hash FROM documents")
def sink_json(spark, sf):
    path = folder(spark, "documents-json")
    sinks.write_json(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    back = spark.read.schema("doc_id long, lang string, text string").json(path)
    return back.select("doc_id", "lang", F.md5(F.encode("text", "UTF-8")).alias("content_hash"))


# Parent of each category; categories without one have no table.
PARENTS = {
    "integrations": "integrations", "integrations_builtin": "integrations", "integrations_creating_nodes": "integrations", "integrations_creating-nodes": "integrations",
    "workflows": "workflows", "hosting": "hosting", "hosting_installation": "hosting", "hosting_configuration": "hosting", "release_notes": "release_notes",
    "release_notes_legacy": "release_notes", "user_management": "user_management", "api": "api", "code": "code", "code_builtin": "code", "courses": "courses",
    "advanced_ai": "advanced_ai", "glossary": "glossary",
}


@query("S10_partitioned_by_category", f"WITH {SECTION_CTE}, c AS (SELECT page_id, {CATEGORY_SQL} AS c FROM sec), m(c, parent) AS (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in PARENTS.items())}) SELECT parent, count(*) AS n, min(page_id) AS first_page FROM c JOIN m USING (c) GROUP BY parent")
def partitioned(spark, sf):
    path = folder(spark, "by-category")
    c = section_urls(spark, sf).select("page_id", "url", ux.category(F.col("url")).alias("category"))
    sinks.write_by_category(sinks.fold_categories(c, PARENTS).drop("category"), path, "parent")
    return spark.read.parquet(path).groupBy("parent").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("S11_snapshot_restore", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS manifest_rows FROM orders")
def snapshot_restore(spark, sf):
    root = folder(spark, "snapshots")
    sinks.snapshot(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), root, "20240201000000")
    rows = sinks.kept_snapshots(sinks.manifest(spark, root), "2024-02-10 00:00:00", 30).first()["rows"]
    return sinks.restore(spark, root, "20240201000000").withColumn("manifest_rows", F.lit(rows).cast("long"))


@query("S11_expired_snapshots", "SELECT o_orderkey, o_totalprice, 2::BIGINT AS kept FROM orders WHERE o_orderstatus <> 'P'")
def expired_snapshots(spark, sf):
    """Three snapshots of which the oldest is deleted; the newest left is restored."""
    root, o = folder(spark, "snapshots"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for stamp, rows in (("20240101000000", o), ("20240201000000", o.filter("o_orderstatus = 'P'")), ("20240205000000", o.filter("o_orderstatus <> 'P'"))):
        sinks.snapshot(rows.drop("o_orderstatus"), root, stamp)
    sinks.expire_snapshots(spark, root, "2024-02-10 00:00:00", 30)
    left = sinks.manifest(spark, root)
    newest = left.agg(F.max("stamp")).first()[0]
    return sinks.restore(spark, root, newest).withColumn("kept", F.lit(left.count()))


@query("S12_streaming_file_source", "SELECT doc_id, lang FROM documents")
def streaming_source(spark, sf):
    stream = jobs.table_stream(spark, f"{sf}/documents.parquet", table(spark, sf, "documents").schema)
    return spark.read.parquet(jobs.drain(stream.select("doc_id", "lang"), "append"))


@query("S9_write_text_blocks", REC + " SELECT count(*) AS pages, sum(length(main_content))::BIGINT AS chars FROM rec")
def write_text(spark, sf):
    """Blocks written as text files; the rule lines found again mark the pages."""
    path = folder(spark, "text-blocks")
    r = records(spark, sf).withColumn("block", sinks.text_block(F.col("url"), F.col("title"), F.col("main_content")))
    sinks.write_text(r, "block", path)
    lines = spark.read.text(path)
    body = ~F.col("value").startswith("URL: ") & ~F.col("value").startswith("Title: ") & (F.col("value") != "=" * 80)
    return lines.agg((F.count_if(F.col("value") == "=" * 80) / 2).cast("long").alias("pages"), F.sum(F.when(body, F.length("value")).otherwise(0)).alias("chars"))
