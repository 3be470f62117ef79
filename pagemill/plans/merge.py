"""Join, upsert, delete, diff, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import text as tx
from pagemill.functions import urls as ux
from pagemill.operators import merge as mg
from pagemill.plans import sqlparts as sp
from pagemill.plans.registry import query, table
from pagemill.plans.urls import CATEGORY_SQL, SECTION_CTE, section_urls
from pagemill.session import kept_path

_TYPE = "CASE WHEN o_orderstatus = 'F' THEN 'documentation' ELSE 'workflow' END"


def date(s: str):
    return F.lit(s).cast("timestamp_ntz")


def orders(spark, sf):
    return table(spark, sf, "orders")


def _views(spark, sf, kind):
    docs = orders(spark, sf).select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "documentation").otherwise("workflow").alias("document_type"))
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), F.col("l_extendedprice").alias("price"))
    return mg.chunks_of_type(chunks, docs, "document_id", kind)


for _kind in ("documentation", "workflow"):
    @query(f"J1_chunks_of_{_kind}", f"SELECT l_orderkey AS document_id, l_linenumber::BIGINT AS chunk_index, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_TYPE} = '{_kind}'")
    def chunk_view(spark, sf, kind=_kind):
        return _views(spark, sf, kind)


@query("J1_documents_of_type", f"SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE {_TYPE} = 'documentation'")
def document_view(spark, sf):
    return orders(spark, sf).filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


_PARTS = "l_linenumber || ':' || l_partkey || ':' || l_suppkey"


@query("J2_documents_with_chunks", f"""WITH b AS (SELECT l_orderkey, string_agg({_PARTS}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS chunks FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS document_id, chunks FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""")
def documents_with_chunks(spark, sf):
    d = orders(spark, sf).select(F.col("o_orderkey").alias("document_id"))
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_partkey", "l_suppkey")
    out = mg.documents_with_chunks(d, c, "document_id", "l_linenumber", ["l_partkey", "l_suppkey"])
    text = F.array_join(F.transform("chunks", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"], s["l_suppkey"])), ",")
    return out.select("document_id", F.when(F.col("chunks").isNotNull(), text).alias("chunks"))


def hashed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text", F.md5(F.encode("text", "UTF-8")).alias("h"))


@query("J5_insert_if_absent", """WITH d AS (SELECT *, md5(text) AS h FROM documents), e AS (SELECT doc_id, source, h FROM d WHERE lang = 'en'),
n AS (SELECT min(doc_id) AS doc_id, source, h FROM d WHERE lang <> 'en' AND length(text) > 0 GROUP BY source, h)
SELECT * FROM e UNION ALL SELECT n.* FROM n ANTI JOIN e ON n.source = e.source AND n.h = e.h""")
def insert_if_absent(spark, sf):
    d = hashed(spark, sf)
    return mg.insert_absent(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), ["source", "h"], "doc_id", "text").select("doc_id", "source", "h")


@query("J6_insert_if_absent_by_hash", """WITH d AS (SELECT *, md5(text) AS h FROM documents), e AS (SELECT doc_id, h FROM d WHERE source < 'src5'),
n AS (SELECT min(doc_id) AS doc_id, h FROM d WHERE length(text) > 0 GROUP BY h) SELECT * FROM e UNION ALL SELECT n.* FROM n ANTI JOIN e ON n.h = e.h""")
def insert_by_hash(spark, sf):
    d = hashed(spark, sf)
    return mg.insert_absent(d.filter("source < 'src5'"), d, ["h"], "doc_id", "text").select("doc_id", "h")


_OLD = "SELECT o_orderkey, o_totalprice AS price, md5(o_orderkey || o_orderpriority) AS h FROM orders WHERE o_orderdate < '1999-01-01'"
_NEW = "SELECT o_orderkey, o_totalprice + 1 AS price, CASE WHEN o_orderstatus = 'O' THEN md5(o_orderpriority) ELSE md5(o_orderkey || o_orderpriority) END AS h FROM orders WHERE o_orderdate >= '1997-01-01'"


@query("J7_upsert", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
CASE WHEN n.h IS NULL OR o.h = n.h THEN o.price ELSE n.price END AS price, CASE WHEN n.h IS NULL THEN 'kept' WHEN o.h IS NULL THEN 'inserted' WHEN o.h = n.h THEN 'skipped' ELSE 'updated' END AS action
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert(spark, sf):
    """Two overlapping date ranges of the orders; open orders change their hash."""
    old, new = _versions(spark, sf)
    return mg.upsert(old, new, "o_orderkey", "h").select("o_orderkey", "price", "action")


def _versions(spark, sf):
    o = orders(spark, sf)
    same = F.md5(F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority"))
    old = o.filter(F.col("o_orderdate") < date("1999-01-01")).select("o_orderkey", F.col("o_totalprice").alias("price"), same.alias("h"))
    new = o.filter(F.col("o_orderdate") >= date("1997-01-01")).select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("price"), F.when(F.col("o_orderstatus") == "O", F.md5("o_orderpriority")).otherwise(same).alias("h"))
    return old, new


@query("J7_bucket_upsert", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
CASE WHEN n.h IS NULL OR o.h = n.h THEN o.price ELSE n.price END AS price, CASE WHEN n.h IS NULL OR o.h = n.h THEN o.h ELSE n.h END AS h FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def bucket_upsert(spark, sf):
    """The written table after its touched buckets were rewritten."""
    old, new = _versions(spark, sf)
    store = mg.BucketStore(spark, kept_path(spark, "orders_upsert"), "o_orderkey", 16)
    store.create(old)
    store.upsert(new, "h")
    return store.read().select("o_orderkey", "price", "h")


@query("V9_bucket_update_delete", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def bucket_update_delete(spark, sf):
    """Prices of urgent orders set to 0 and open deliveries deleted, in the written table."""
    o = orders(spark, sf)
    store = mg.BucketStore(spark, kept_path(spark, "orders_update"), "o_orderkey", 16)
    store.create(o.select("o_orderkey", "o_totalprice"))
    store.update(o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), ["o_totalprice"])
    store.delete(o.filter("o_orderstatus = 'P'"))
    return store.read().select("o_orderkey", "o_totalprice")


@query("J7_upsert_counts", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT CASE WHEN n.h IS NULL THEN 'kept' WHEN o.h IS NULL THEN 'inserted' WHEN o.h = n.h THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey GROUP BY ALL""")
def upsert_counts(spark, sf):
    return upsert(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


@query("J8_derived_fields", f"SELECT doc_id, md5(text) AS content_hash, {sp.wc('text')} AS word_count, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM documents")
def derived_fields(spark, sf):
    d = mg.derived_fields(table(spark, sf, "documents"), "text", tx.word_count(F.col("text")), "2024-02-01 00:00:00")
    return d.select("doc_id", "content_hash", "word_count", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("J9_cascade_delete", """WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'documents' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT * FROM g)
UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM g)""")
def cascade_delete(spark, sf):
    d = orders(spark, sf).withColumnRenamed("o_orderkey", "k")
    left, chunks = mg.cascade_delete(d, table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"), "k", d.filter("o_orderstatus = 'P'"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(left, "documents").unionByName(count(chunks, "chunks"))


_DIFF = """WITH o AS (SELECT o_orderkey, o_orderdate AS m FROM orders WHERE o_orderdate < '2001-01-01'), n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS m FROM orders WHERE o_orderdate >= '1996-01-01'),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.m IS NULL THEN 'new' WHEN n.m IS NULL THEN 'deleted' WHEN n.m > o.m THEN 'modified' END AS change_type FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)"""


def _snapshots(spark, sf):
    o = orders(spark, sf)
    old = o.filter(F.col("o_orderdate") < date("2001-01-01")).select("o_orderkey", F.col("o_orderdate").alias("m"))
    bumped = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).otherwise(F.col("o_orderdate"))
    return old, o.filter(F.col("o_orderdate") >= date("1996-01-01")).select("o_orderkey", bumped.alias("m"))


@query("J10_snapshot_diff", _DIFF + " SELECT * FROM j WHERE change_type IS NOT NULL")
def snapshot_diff(spark, sf):
    return mg.snapshot_diff(*_snapshots(spark, sf), "o_orderkey", "m")


@query("J10_change_counts", _DIFF + " SELECT count(*) FILTER (change_type = 'new') AS new_files, count(*) FILTER (change_type = 'modified') AS modified_files, count(*) FILTER (change_type = 'deleted') AS deleted_files, count(change_type) AS total_changes FROM j")
def change_counts(spark, sf):
    return mg.change_counts(mg.snapshot_diff(*_snapshots(spark, sf), "o_orderkey", "m"))


@query("J11_content_changes", """WITH s AS (SELECT doc_id, CASE WHEN lang = 'de' THEN md5(lower(text)) ELSE md5(text) END AS h FROM documents WHERE lang <> 'es')
SELECT doc_id, CASE WHEN s.h IS NULL THEN 'new' WHEN s.h = md5(text) THEN 'unchanged' ELSE 'changed' END AS state FROM documents LEFT JOIN s USING (doc_id)""")
def content_changes(spark, sf):
    d = hashed(spark, sf)
    stored = d.filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", F.md5(F.encode(F.lower("text"), "UTF-8"))).otherwise(F.col("h")).alias("h"))
    return mg.content_changes(d, stored, "doc_id", "h").select("doc_id", "state")


@query("L1_recent_documents", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent(spark, sf):
    return orders(spark, sf).select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(25)


@query("L2_most_common", f"""WITH w AS (SELECT doc_id, unnest({sp.words('text')}) AS term, generate_subscripts({sp.words('text')}, 1) - 1 AS pos FROM documents)
SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, min(doc_id * 1000000 + pos) LIMIT 20""")
def most_common(spark, sf):
    w = scale.rows_of(table(spark, sf, "documents"), ["doc_id"], tx.words(F.col("text")), "term", "pos")
    counted = w.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return counted.orderBy(F.col("n").desc(), "first").limit(20).select("term", "n")


@query("L3_top_n_per_group", f"WITH {SECTION_CTE}, c AS (SELECT page_id, url0, {CATEGORY_SQL} AS category FROM sec), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_id) AS rank FROM c) SELECT category, rank, page_id FROM r WHERE rank <= 3")
def top_n_per_group(spark, sf):
    c = section_urls(spark, sf).select("page_id", ux.category(F.col("url")).alias("category"))
    return scale.top_n_per_key(c, ["category"], [F.col("page_id")], 3).select("category", F.col("rank").cast("long").alias("rank"), "page_id")


@query("L5_union_with_provenance", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English Pages' WHEN 'fr' THEN 'French Pages' ELSE 'German Pages' END AS category FROM documents WHERE lang IN ('en', 'fr', 'de')")
def union_with_provenance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    names = {"docs_english_pages_table": "en", "docs_french_pages_table": "fr", "docs_german_pages_table": "de"}
    return mg.union_tables({n: d.filter(F.col("lang") == v).drop("lang") for n, v in names.items()}, "docs_", "_table").select("doc_id", "category")


@query("L6_unified_union", """SELECT 'doc-' || doc_id AS id, 'documentation' AS document_type, source AS title, NULL::VARCHAR AS description, length(text) AS content_length, lang AS language, NULL::BIGINT AS node_count FROM documents
UNION ALL SELECT 'wf-' || o_orderkey, 'workflow', 'Order ' || o_orderkey, o_orderpriority, length('Order ' || o_orderkey || ' ' || o_orderpriority), NULL, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def unified_union(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("description"),
                                             F.col("text").alias("content"), F.col("lang").alias("language"))
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("node_count"))
    w = orders(spark, sf).join(n, "o_orderkey", "left").select(
        F.concat(F.lit("wf-"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("description"), F.lit("").alias("content"), "node_count")
    return mg.union_unified(d, w).select("id", "document_type", "title", "description", F.length("content").cast("long").alias("content_length"), "language", "node_count")


@query("L7_distinct_keeping_order", f"WITH w AS (SELECT doc_id, unnest({sp.words('text')}) AS term, generate_subscripts({sp.words('text')}, 1) AS pos FROM documents), f AS (SELECT doc_id, term, min(pos) AS pos FROM w GROUP BY ALL) SELECT doc_id, md5(string_agg(term, ' ' ORDER BY pos)) AS distinct_words FROM f GROUP BY doc_id")
def distinct_keeping_order(spark, sf):
    text = F.array_join(F.array_distinct(tx.words(F.col("text"))), " ")
    return table(spark, sf, "documents").filter(tx.not_blank(F.col("text"))).select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("distinct_words"))


@query("L8_key_sets", _DIFF + ", k AS (SELECT o_orderkey, EXISTS (SELECT 1 FROM o WHERE o.o_orderkey = orders.o_orderkey) AS a, EXISTS (SELECT 1 FROM n WHERE n.o_orderkey = orders.o_orderkey) AS b FROM orders) SELECT o_orderkey, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_old' ELSE 'only_new' END AS key_set FROM k WHERE a OR b")
def key_sets(spark, sf):
    return mg.key_sets(*_snapshots(spark, sf), "o_orderkey")
