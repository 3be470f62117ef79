"""Knowledge table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import chunks as ch
from pagemill.operators import knowledge as kn
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import docs
from pagemill.plans.labels import _SEC_PAGES, section_records
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q
from pagemill.plans.text import CHUNK_DIGESTS
from pagemill.session import kept

# Names look like <section>_<sub>_<page>, taken from the moved page URL.
_NAME = "replace(regexp_extract(url, '^[^:]+://[^/]+/(.*)$', 1), '/', '_')"
_HEAD = "string_split(name, '_')[1]"
_CAT = f"coalesce(CASE {_HEAD} {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in kn.CATEGORY_NAMES.items())} END, upper(substr({_HEAD}, 1, 1)) || lower(substr({_HEAD}, 2)))"
_SUB = "CASE WHEN len(string_split(name, '_')) > 1 THEN array_to_string(string_split(name, '_')[2:], '_') ELSE 'general' END"
_SRC = _SEC_PAGES + f", n AS (SELECT *, {_NAME} AS name FROM sp), k AS (SELECT *, {_CAT} AS category, {_SUB} AS subcategory FROM n)"


def named(spark, sf):
    name = F.replace(F.regexp_extract("url", r"^[^:]+://[^/]+/(.*)$", 1), F.lit("/"), F.lit("_"))
    # stored once for each version of the pages: the chunk builder filters on the extracted text
    return kept("named_pages", table(spark, sf, "pages"), lambda: section_records(spark, sf).select("page_id", "url", "title", "main_content").withColumn("name", name))


@query("K1_category_from_filename", _SRC + " SELECT page_id, category, subcategory FROM k")
def category_from_filename(spark, sf):
    c, s = kn.category_from_name(F.col("name"))
    return named(spark, sf).select("page_id", c.alias("category"), s.alias("subcategory"))


def _tags_sql(content: str, title: str, cat: str, sub: str) -> str:
    low = f"(lower({content}) || ' ' || lower({title}))"
    known = f"list_filter(regexp_extract_all({low}, {q(tx.WORD_CHAR + '+')}), lambda w: w IN ({', '.join(map(q, kn.TAG_WORDS))}))"
    found = f"list_distinct(list_concat([lower({cat}), lower({sub})], list_concat(regexp_extract_all({low}, {q(kn.NODE_NAME)}, 1), {known})))"
    return f"list_sort(list_filter({found}, lambda t: length(t) > 2 AND t NOT IN ({', '.join(map(q, kn.TAG_STOP_WORDS))})))"


_CLEANED = sp.squash(f"regexp_replace(regexp_replace(main_content, {q(tx.WS + '+')}, ' ', 'g'), {q(tx.TAG_PATTERN)}, '', 'g')")


@query("K2_knowledge_chunks", _SRC + f""" SELECT page_id, substr(md5(url || ':' || title || ':' || main_content), 1, 16) AS id, {_CLEANED} AS clean, category, subcategory, {sp.wc('main_content')} AS word_count,
array_to_string({_tags_sql('main_content', 'title', 'category', 'subcategory')}, '|') AS tags FROM k WHERE length({sp.strip('main_content')}) >= 50""")
def knowledge_chunks(spark, sf):
    c = kn.knowledge_chunks(named(spark, sf), "title", "main_content", "url", "name")
    return c.select("page_id", "id", "clean", "category", "subcategory", "word_count", F.array_join("tags", "|").alias("tags"))


@query("K2_knowledge_chunks_light", _SRC + f""" SELECT page_id, substr(md5(url || ':' || title || ':' || length(main_content)), 1, 16) AS id, {sp.squash('main_content')} AS clean,
lower(category) || '|' || lower(subcategory) || CASE WHEN contains(lower(title), 'node') THEN '|node' ELSE '' END || CASE WHEN contains(lower(title), 'workflow') THEN '|workflow' ELSE '' END AS tags FROM k WHERE length({sp.strip('main_content')}) >= 50""")
def knowledge_chunks_light(spark, sf):
    c = kn.knowledge_chunks(named(spark, sf), "title", "main_content", "url", "name", "light")
    return c.select("page_id", "id", "clean", F.array_join("tags", "|").alias("tags"))


@query("K3_chunk_metadata", f"SELECT doc_id, {sp.wc('text')} AS word_count, contains(text, '```') OR contains(text, '<code>') AS has_code_examples, {sp.n_matches('text', '#+' + tx.WS)} AS section_count FROM documents")
def chunk_metadata(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in kn.chunk_metadata(F.col("text")).items()])


@query("K4_domain_tags", f"SELECT doc_id, array_to_string({_tags_sql('text', 'source', 'lang', 'source')}, '|') AS tags FROM documents")
def domain_tags(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(kn.domain_tags(F.col("text"), F.col("source"), F.col("lang"), F.col("source")), "|").alias("tags"))


@query("K5_category_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def category_counts(spark, sf):
    return kn.category_counts(table(spark, sf, "documents"), "source")


@query("K5_kb_stats", "SELECT count(*) AS total_chunks, round(avg(length(text)), 4) AS avg_content_length, sum(length(text))::BIGINT AS total_content_length, count(*) FILTER (contains(text, '```') OR contains(text, '<code>')) AS chunks_with_code, (sum(length(text)) // count(*))::BIGINT AS average_chunk_size FROM documents")
def kb_stats(spark, sf):
    return kn.kb_stats(table(spark, sf, "documents"), "text")


@query("K6_changed_files", """WITH m AS (SELECT o_orderkey, o_orderdate AS mtime FROM orders WHERE o_orderdate < '1999-01-01'), f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mtime FROM orders)
SELECT f.o_orderkey FROM f LEFT JOIN m USING (o_orderkey) WHERE m.mtime IS NULL OR m.mtime < f.mtime""")
def changed_files(spark, sf):
    o = table(spark, sf, "orders")
    manifest = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", F.col("o_orderdate").alias("mtime"))
    touched = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).otherwise(F.col("o_orderdate"))
    return kn.changed_files(o.select("o_orderkey", touched.alias("mtime")), manifest, "o_orderkey", "mtime").select("o_orderkey")


@query("K7_processing_stats", f"""WITH s AS (SELECT unnest(range(0, length(text), 450)) AS i, text FROM documents), c AS (SELECT count(*) AS n FROM s WHERE {sp.not_blank('substr(text, (i + 1)::BIGINT, 500)')}),
p AS (SELECT count(*) AS n, max(doc_id) AS last_update FROM documents WHERE lang = 'en'), t AS (SELECT count(*) AS n FROM documents)
SELECT c.n AS total_chunks, p.n AS processed_files, p.last_update, t.n AS total_files, t.n - p.n AS pending_files, round(c.n / greatest(p.n, 1)::DOUBLE, 6) AS chunks_per_file, round(p.n / 60.0::DOUBLE, 6) AS processing_rate FROM c, p, t""")
def processing_stats(spark, sf):
    """English documents count as processed, their id as the time of processing."""
    d = table(spark, sf, "documents")
    chunks = ch.explode_chunks(docs(spark, sf), "doc_id", ch.stride_chunks(F.col("text")))
    return kn.processing_stats(chunks, d.filter("lang = 'en'").select(F.col("doc_id").alias("processed_at")), d, 60.0)


@query("K8_source_fingerprint", """WITH t AS (SELECT count(*) AS file_count, sum(length(o_orderpriority))::BIGINT AS total_size,
sum(('0x' || substr(md5(o_orderkey || ':' || epoch(o_orderdate)::BIGINT), 1, 15))::BIGINT)::VARCHAR AS names FROM orders) SELECT file_count, total_size, md5(file_count || ':' || total_size || ':' || names) AS checksum FROM t""")
def fingerprint(spark, sf):
    o = table(spark, sf, "orders")
    return kn.fingerprint(o, "o_orderkey", F.length("o_orderpriority"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")))


@query("K9_hooks", f"SELECT doc_id, {sp.squash('lower(text)')} AS cleaned, length({sp.squash('lower(text)')}) AS n FROM documents")
def hooks(spark, sf):
    """A stage before, a failing one that is left out, and a stage after the build."""
    return kn.with_hooks(
        docs(spark, sf), [lambda d: d.withColumn("text", F.lower("text")), lambda d: d.no_such_method()],
        lambda d: d.select("doc_id", tx.squash(F.col("text")).alias("cleaned")), [lambda d: d.withColumn("n", F.length("cleaned").cast("long"))])


@query("K10_document_chunks", CHUNK_DIGESTS)
def document_chunks(spark, sf):
    return ch.document_chunks(docs(spark, sf), "doc_id", "text", "hashing-64").select("document_id", "chunk_index", "content_hash", "word_count", "embedding_model")
