"""Report queries over pages, documents, events and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import text as tx
from pagemill.functions import urls as ux
from pagemill.operators import reports as rp
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import REC, _LINKS, records
from pagemill.plans.merge import date, orders
from pagemill.plans.registry import ORACLES, query, table
from pagemill.plans.sqlparts import q
from pagemill.plans.trends import events
from pagemill.plans.urls import CATEGORY_SQL, HOST, SCHEME, SECTION_CTE, section_urls
from pagemill.session import checkpoint_root
from pagemill.session import kept

NOW = "2024-02-01 00:00:00"
_SEG = "regexp_extract(url, '^[^:]+://[^/]+/([^/?#]*)', 1)"


def _pages(spark, sf):
    return records(spark, sf).withColumn("word_count", tx.word_count(F.col("main_content")))


@query("A1_content_statistics", REC + f""", p AS (SELECT url, {sp.wc('main_content')} AS w, len(h1s) AS h, len(hrefs) AS l FROM rec)
SELECT unnest(['total_pages', 'total_words', 'total_headings', 'total_links', 'words_min', 'words_max', 'words_avg']) AS metric,
unnest([count(*)::DOUBLE, sum(w)::DOUBLE, sum(h)::DOUBLE, sum(l)::DOUBLE, min(w)::DOUBLE, max(w)::DOUBLE, round(avg(w), 4)]) AS value FROM p
UNION ALL SELECT 'category:' || CASE WHEN {_SEG} = '' THEN 'root' ELSE {_SEG} END, count(*)::DOUBLE FROM p GROUP BY 1""")
def content_statistics(spark, sf):
    p = kept("report_pages", table(spark, sf, "pages"), lambda: _pages(spark, sf).select("url", "word_count", "headings", "raw_links"))
    seg = F.coalesce(F.nullif(F.regexp_extract("url", "^[^:]+://[^/]+/([^/?#]*)", 1), F.lit("")), F.lit("root"))
    return rp.content_statistics(p, {"headings": F.size("headings"), "links": F.size("raw_links")}, seg, stored=True)


@query("A2_heading_analysis", REC + f""", h AS (SELECT unnest(h1s) AS t FROM rec)
SELECT unnest(['total_headings', 'unique_headings', 'level_1', 'level_2', 'level_3', 'level_4', 'level_5', 'level_6', {', '.join(map(q, rp.HEADING_PATTERNS))}]) AS metric,
unnest([count(*)::DOUBLE, count(DISTINCT t)::DOUBLE, count(*)::DOUBLE, 0, 0, 0, 0, 0, {', '.join(f"count(*) FILTER ({sp.any_of('lower(t)', w)})::DOUBLE" for w in rp.HEADING_PATTERNS.values())}]) AS value FROM h""")
def heading_analysis(spark, sf):
    return rp.heading_analysis(scale.rows_of(records(spark, sf), [], "headings", "h").select("h.level", "h.text"))


@query("A2_most_common_headings", REC + ", h AS (SELECT page_id, unnest(h1s) AS text FROM rec) SELECT text, count(*) AS n FROM h GROUP BY text ORDER BY n DESC, min(page_id) LIMIT 20")
def most_common_headings(spark, sf):
    h = scale.rows_of(records(spark, sf), ["page_id"], "headings", "h").select("page_id", "h.text")
    return rp.most_common(h, "text", 20, F.col("page_id"))


# No page holds code, so the lines of documents stand for code blocks here.
_CODE = "WITH c AS (SELECT unnest(string_split(text, e'\\n')) AS content, lang AS language, CASE WHEN source < 'src5' THEN 'pre' ELSE 'code' END AS type FROM documents)"


@query("A3_code_analysis", _CODE + f""" SELECT unnest(['total_code_blocks', {', '.join(map(q, rp.CODE_PATTERNS))}, 'avg_code_length']) AS metric,
unnest([count(*)::DOUBLE, {', '.join(f"count(*) FILTER ({sp.any_of('lower(content)', w)})::DOUBLE" for w in rp.CODE_PATTERNS.values())}, round(avg(length(content)), 4)]) AS value FROM c
UNION ALL SELECT 'language:' || language, count(*)::DOUBLE FROM c GROUP BY 1 UNION ALL SELECT 'type:' || type, count(*)::DOUBLE FROM c GROUP BY 1""")
def code_analysis(spark, sf):
    d = table(spark, sf, "documents")
    kind = F.when(F.col("source") < "src5", "pre").otherwise("code")
    return rp.code_analysis(scale.rows_of(d, [F.col("lang").alias("language"), kind.alias("type")], F.split("text", "\n"), "content"))


@query("A4_link_analysis", REC + _LINKS + f""", u AS (SELECT {SCHEME} || '://' || {HOST} || href AS link FROM l), x AS (SELECT link, contains(link, 'example.org') AS i FROM u)
SELECT unnest(['total_internal_links', 'total_external_links', 'unique_internal_links', 'unique_external_links']) AS metric, unnest([count(*) FILTER (i), count(*) FILTER (NOT i), count(DISTINCT link) FILTER (i), count(DISTINCT link) FILTER (NOT i)])::DOUBLE AS value FROM x
UNION ALL (SELECT 'linked:' || link, count(*)::DOUBLE AS c FROM x WHERE i GROUP BY link ORDER BY c DESC, link LIMIT 10)
UNION ALL (SELECT 'domain:' || string_split(link, '/')[3] AS d, count(*)::DOUBLE AS c FROM x WHERE NOT i GROUP BY d ORDER BY c DESC, d LIMIT 10)""")
def link_analysis(spark, sf):
    def links():
        r = scale.rows_of(records(spark, sf), ["url"], "raw_links", "l")
        return r.select(ux.resolve_url(F.col("url"), F.col("l.href")).alias("url"))

    return rp.link_analysis(kept("report_links", table(spark, sf, "pages"), links), "example.org", stored=True)


_MENTION = r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]*\s*[Tt]ion(?![\p{L}\p{N}_])"
_FLAT = sp.squash("text")
_DOUBLED = f"regexp_replace({_FLAT}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"


@query("A5_entity_mentions", f"""SELECT doc_id, source AS name, lang AS url, 'integration_page' AS type FROM documents WHERE lang = 'de'
UNION ALL SELECT DISTINCT doc_id, replace(unnest(regexp_extract_all({_DOUBLED}, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-zA-Z]*\\s*[Tt]ion)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)), '  ', ' '), lang, 'content_mention' FROM documents""")
def entity_mentions(spark, sf):
    """Capitalised words ending in the entity word; the word is a parameter."""
    d = table(spark, sf, "documents").withColumn("text", tx.squash(F.col("text")))
    return rp.entity_mentions(d, "doc_id", "lang", "source", "text", _MENTION, F.col("lang") == "de")


@query("A6_analysis_report")
def analysis_report(spark, sf):
    return rp.report_json({"content_statistics": content_statistics(spark, sf), "heading_analysis": heading_analysis(spark, sf), "link_analysis": link_analysis(spark, sf)})


_PARTS = {"content_statistics": "A1_content_statistics", "heading_analysis": "A2_heading_analysis", "link_analysis": "A4_link_analysis"}


@query("A6_report_read_back", " UNION ALL ".join(f"SELECT '{name}' AS report, metric, round(value, 4) AS value FROM ({ORACLES[part]})" for name, part in _PARTS.items()))
def report_read_back(spark, sf):
    """The lines of the report, parsed again."""
    line = F.from_json("json", "metric string, value double")
    return analysis_report(spark, sf).select("report", line.alias("l")).select("report", "l.metric", F.round("l.value", 4).alias("value"))


@query("A7_crawl_summary", REC + f""", p AS (SELECT url, {sp.wc('main_content')} AS w FROM rec) SELECT 'total' AS kind, NULL AS url, sum(w)::BIGINT AS words, count(*) AS pages, count(*) FILTER (w < 100) AS errors FROM p UNION ALL SELECT 'page', url, w, 1, (w < 100)::BIGINT FROM p""")
def crawl_summary(spark, sf):
    return rp.crawl_summary(_pages(spark, sf).select("url", "word_count"), F.col("word_count") < 100)


@query("A8_document_statistics", "SELECT 'lang' AS grouping_name, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'total', 'total', count(*) FROM documents")
def document_statistics(spark, sf):
    d = table(spark, sf, "documents")
    grouped = d.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 1, "lang").when(F.col("g") == 2, "source").otherwise("total")
    return grouped.select(name.alias("grouping_name"), F.coalesce("lang", "source", F.lit("total")).alias("name"), "n")


@query("A9_dashboard_database_metrics", f"SELECT count(*) AS total_documents, max(ts) AS latest, round(avg(length(props)), 4) AS avg_length, round(sum(length(props)) / 1048576.0::DOUBLE, 6) AS size_mb, round((epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(max(ts)))::BIGINT) / 3600.0::DOUBLE, 4) AS data_age_hours FROM events")
def dashboard_metrics(spark, sf):
    m = rp.database_metrics(events(spark, sf), F.length("props"), F.col("ts").cast("timestamp"), NOW)
    return m.withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query("A10_run_history", """WITH l AS (SELECT ts, CASE event_type WHEN 'purchase' THEN 'Full automation completed. Success: True' WHEN 'error' THEN 'Full automation completed. Success: False' ELSE 'step ' || event_type END AS line FROM events)
SELECT count(*) FILTER (contains(line, 'Full automation completed')) AS total_runs, count(*) FILTER (contains(line, 'Success: True')) AS successful_runs, max(ts) FILTER (contains(line, 'Full automation completed')) AS last_run,
round(count(*) FILTER (contains(line, 'Success: True')) / count(*) FILTER (contains(line, 'Full automation completed'))::DOUBLE * 100, 4) AS success_rate, max(ts) FILTER (contains(line, 'Full automation completed')) + INTERVAL 2 DAY AS next_run FROM l""")
def run_history(spark, sf):
    line = (F.when(F.col("event_type") == "purchase", "Full automation completed. Success: True").when(F.col("event_type") == "error", "Full automation completed. Success: False")
            .otherwise(F.concat(F.lit("step "), "event_type")))
    return rp.run_history(events(spark, sf).select("ts", line.alias("line")), "line", "ts", 2)


_HEALTH = """WITH m AS (SELECT ts::DATE AS day, least(100.0, max(value) / 2)::DOUBLE AS cpu_percent, least(100.0, avg(value) * 3)::DOUBLE AS memory_percent, least(100.0, sum(value) / 100)::DOUBLE AS disk_percent,
(epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT) / 3600.0::DOUBLE AS data_age_hours, count(*) FILTER (event_type = 'view') AS total_documents, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE * 100 AS success_rate, count(*) AS total_runs FROM events GROUP BY 1),
h AS (SELECT day, list_filter([""" + ", ".join(f"CASE WHEN {c} > {h} THEN printf({q(ht)}, round({c}, 1)) END" for c, h, ht, s, st in rp.HEALTH_LIMITS) + """, CASE WHEN total_documents = 0 THEN 'No documents in database' END, CASE WHEN success_rate < 80 AND total_runs > 5 THEN printf('Low automation success rate: %.1f%%', round(success_rate, 1)) END], lambda x: x IS NOT NULL) AS issues,
list_filter([""" + ", ".join(f"CASE WHEN {c} > {s} AND {c} <= {h} THEN printf({q(st)}, round({c}, 1)) END" for c, h, ht, s, st in rp.HEALTH_LIMITS) + """, CASE WHEN success_rate >= 80 AND success_rate < 95 AND total_runs > 5 THEN printf('Automation success rate could be better: %.1f%%', round(success_rate, 1)) END], lambda x: x IS NOT NULL) AS warnings FROM m),
s AS (SELECT day, array_to_string(issues, '; ') AS issues, array_to_string(warnings, '; ') AS warnings, CASE WHEN len(issues) > 0 THEN 'unhealthy' WHEN len(warnings) > 0 THEN 'warning' ELSE 'healthy' END AS status, greatest(0, 100 - len(issues) * 20 - len(warnings) * 5)::BIGINT AS score FROM h)"""


def _health(spark, sf):
    cap = lambda c: F.least(F.lit(100.0), c)
    m = events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        cap(F.max("value") / 2).alias("cpu_percent"), cap(F.avg("value") * 3).alias("memory_percent"), cap(F.sum("value") / 100).alias("disk_percent"),
        ((F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))) / 3600).alias("data_age_hours"),
        F.count_if(F.col("event_type") == "view").alias("total_documents"), (F.count_if(F.col("event_type") != "error") / F.count("*") * 100).alias("success_rate"), F.count("*").alias("total_runs"))
    return rp.health(m)


@query("A11_health_status", _HEALTH + " SELECT * FROM s")
def health_status(spark, sf):
    """Daily aggregates of the event values stand for the probes."""
    return _health(spark, sf).select("day", F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"), "status", "score")


@query("A11_overall_health", _HEALTH + " SELECT CASE WHEN count(*) FILTER (status = 'unhealthy') > 0 THEN 'unhealthy' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'healthy' END AS overall_status, count(*) AS total_components, count(*) FILTER (status = 'healthy') AS healthy_components, count(*) FILTER (status = 'warning') AS degraded_components, count(*) FILTER (status = 'unhealthy') AS unhealthy_components FROM s")
def overall_health(spark, sf):
    return rp.overall_health(_health(spark, sf), "status")


@query("A12_data_freshness", f"WITH a AS (SELECT max(ts) AS latest, (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(max(ts)))::BIGINT) / 3600.0::DOUBLE AS age FROM events) SELECT latest, round(age, 4) AS age_hours, age < 72 AS is_fresh, age > 48 AND age < 72 AS is_aging FROM a")
def data_freshness(spark, sf):
    return rp.freshness(events(spark, sf), F.col("ts").cast("timestamp"), NOW).withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query("A13_user_stats", "WITH l AS (SELECT o_custkey, max(o_orderdate) AS last, min(o_orderdate) AS first FROM orders GROUP BY 1) SELECT count(*) AS total_users, count(*) FILTER (last >= '2001-01-01') AS active_users, count(*) FILTER (last IS NULL OR last < '2001-01-01') AS inactive_users, count(*) FILTER (first >= TIMESTAMP '2001-07-02' - INTERVAL 30 DAY) AS new_users FROM customer LEFT JOIN l ON c_custkey = o_custkey")
def user_stats(spark, sf):
    last = orders(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first"))
    u = table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    active = F.coalesce(F.col("last") >= date("2001-01-01"), F.lit(False))
    return u.agg(F.count("*").alias("total_users"), F.count_if(active).alias("active_users"), F.count_if(~active).alias("inactive_users"),
                 F.count_if(F.col("first") >= date("2001-06-02")).alias("new_users"))


@query("A14_category_examples", f"WITH {SECTION_CTE}, c AS (SELECT page_id, url, {CATEGORY_SQL} AS category FROM sec), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_id) AS rk FROM c) SELECT category, count(*) AS n, string_agg(url, '|' ORDER BY page_id) FILTER (rk <= 3) AS examples FROM r GROUP BY category")
def category_examples(spark, sf):
    c = section_urls(spark, sf).withColumn("category", ux.category(F.col("url")))
    return rp.category_examples(c, "category", "url", "page_id").select("category", "n", F.array_join("examples", "|").alias("examples"))


@query("A15_category_stats", "SELECT lang AS category, count(*) AS n, max(doc_id) AS latest, round(avg(quality), 6) AS avg_quality, count(DISTINCT source) AS subcategories FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def category_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"), F.round(F.avg("quality"), 6).alias("avg_quality"),
                                                          F.count_distinct("source").alias("subcategories"))


@query("A15_subcategories", "SELECT DISTINCT lang AS category, source AS subcategory FROM documents")
def subcategories(spark, sf):
    """The sets of subcategories as rows, whatever their size."""
    return table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("source").alias("subcategory")).distinct()


@query("A16_distinct_categories", "SELECT DISTINCT source AS category FROM documents ORDER BY 1")
def distinct_categories(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("category")).distinct().orderBy("category")


@query("A16_merged_kb_stats", "SELECT 'documents' AS kind, count(*) AS files, count(*) AS pages FROM documents UNION ALL SELECT 'workflows', count(DISTINCT l_orderkey), count(*) FROM lineitem")
def merged_kb_stats(spark, sf):
    d = table(spark, sf, "documents").agg(F.count("*").alias("files"), F.count("*").alias("pages"))
    w = table(spark, sf, "lineitem").agg(F.count_distinct("l_orderkey").alias("files"), F.count("*").alias("pages"))
    return d.select(F.lit("documents").alias("kind"), "files", "pages").unionByName(w.select(F.lit("workflows").alias("kind"), "files", "pages"))


@query("A17_percentiles", "SELECT round(avg(value), 6) AS avg_time, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate, round(count(*) FILTER (event_type <> 'error') / (max(epoch_us(ts)) - min(epoch_us(ts))) * 1e6, 9)::DOUBLE AS throughput FROM events")
def percentiles(spark, sf):
    e = events(spark, sf)
    quantiles = scale.exact_quantiles(e, "value", {"p95": 0.95, "p99": 0.99})
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ok = F.count_if(F.col("event_type") != "error")
    rates = e.agg(F.round(F.avg("value"), 6).alias("avg_time"), F.round(ok / F.count("*"), 6).alias("success_rate"), F.round(ok / (F.max(us) - F.min(us)) * 1e6, 9).alias("throughput"))
    both = quantiles.unionByName(rates, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("avg_time", "success_rate", "throughput")], *[F.round(F.max(c), 6).alias(c) for c in ("p95", "p99")])


@query("A18_histogram", "WITH b AS (SELECT event_type, unnest([" + ", ".join(f"'{b}'" for b in rp.HISTOGRAM_BOUNDS) + ", '+Inf']) AS le, unnest([" + ", ".join(f"count(*) FILTER (value <= {b})" for b in rp.HISTOGRAM_BOUNDS) + ", count(*)]) AS n, count(*) AS observations, round(sum(value), 4) AS total FROM events GROUP BY event_type) SELECT * FROM b")
def histogram(spark, sf):
    return rp.histogram(events(spark, sf), "event_type", "value")


def _metrics(spark, sf):
    return rp.counters_and_gauges(events(spark, sf), "event_type", F.lit(1).cast("bigint"), F.col("value"), F.struct("ts", "event_id"))


@query("A19_counters_gauges", "SELECT event_type, count(*) AS counter, arg_max(value, ts) AS gauge FROM events GROUP BY 1")
def counters_gauges(spark, sf):
    return _metrics(spark, sf)


@query("A19_exposition", "WITH m AS (SELECT event_type AS k, count(*) AS c, arg_max(value, ts) AS g FROM events GROUP BY 1) SELECT '# HELP ' || k || '_counter Events' || e'\\n# TYPE ' || k || e'_counter counter\\n' || k || '_counter ' || c || e'\\n# HELP ' || k || e'_gauge Events\\n# TYPE ' || k || e'_gauge gauge\\n' || k || '_gauge ' || g AS text FROM m")
def exposition(spark, sf):
    return rp.exposition(_metrics(spark, sf), "event_type")


@query("A20_job_progress", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE * 100, 4) AS percent FROM events GROUP BY 1")
def job_progress(spark, sf):
    return rp.job_progress(events(spark, sf), "user_id", F.col("event_type") != "error")


@query("A21_update_cycle", """WITH o AS (SELECT o_orderkey, o_orderdate AS m FROM orders WHERE o_orderdate < '2001-01-01'), n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS m FROM orders WHERE o_orderdate >= '1996-01-01'),
j AS (SELECT o.m AS a, n.m AS b FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey) SELECT count(*) FILTER (a IS NULL) AS new_files, count(*) FILTER (b > a) AS modified_files, count(*) FILTER (b IS NULL) AS deleted_files, count(*) FILTER (a IS NULL OR b IS NULL OR b > a) AS total_changes, 3 AS steps_ok, 0 AS steps_failed, TRUE AS success, count(*) FILTER (a IS NULL OR b > a) AS indexed FROM j""")
def update_cycle(spark, sf):
    """The new snapshot is written, its new and changed files are indexed by month, and
    a report is made from the index; the last column counts what the report holds."""
    from pagemill.operators.knowledge import changed_files
    from pagemill.plans.merge import _snapshots

    old, new = _snapshots(spark, sf)
    base = f"{checkpoint_root(spark)}/cycle-{uuid.uuid4().hex}"
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    month = F.date_trunc("month", F.col("m"))
    steps = {
        "ingest": lambda d: d.write.parquet(f"{base}/snapshot"),
        "index": lambda d: changed_files(read("snapshot"), old, "o_orderkey", "m").withColumn("month", month).write.parquet(f"{base}/index"),
        "report": lambda d: read("index").groupBy("month").agg(F.count("*").alias("n")).write.parquet(f"{base}/report"),
    }
    counts, done = rp.update_cycle(old, new, "o_orderkey", "m", steps)
    indexed = read("report").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if all(done.values()) else 0
    return counts.withColumn("indexed", F.lit(indexed).cast("long"))
