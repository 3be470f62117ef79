"""Vector and text search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import text as tx
from pagemill.operators import fulltext as ft
from pagemill.operators import ivf
from pagemill.operators import search as se
from pagemill.operators import setjoin as sj
from pagemill.operators import vectors as ve
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import REC, docs, records
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q
from pagemill.session import kept


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[])"
_DOT = "list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[])"


_HASHED = f"""WITH w AS (SELECT doc_id, unnest({sp.words('lower(text)')}) AS word FROM documents), h AS (SELECT word, {sp.crc32('word')} AS h FROM (SELECT DISTINCT word FROM w)),
s AS (SELECT doc_id, h % 64 AS dim, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w JOIN h USING (word) GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS size FROM s GROUP BY doc_id)"""


@query("V1_embed_text", _HASHED + f""" SELECT d.doc_id, CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, CASE WHEN text IS NULL OR {sp.strip('text')} = '' THEN 'empty text' END AS error FROM documents d LEFT JOIN n USING (doc_id)""")
def embed(spark, sf):
    e = ve.embed(docs(spark, sf), "doc_id", "text")
    return e.select("doc_id", F.round(F.sqrt(ve.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), "error")


@query("V1_embedding_components", _HASHED + " SELECT doc_id, dim, round((v / size)::FLOAT::DOUBLE, 4) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0")
def embedding_components(spark, sf):
    """Every component of every vector that is not 0."""
    e = ve.embed(docs(spark, sf), "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
    return e.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query("V2_unseen_texts", "WITH h AS (SELECT sha256(text) || ':hash-64' AS text_key, lang FROM documents) SELECT DISTINCT text_key FROM h WHERE text_key NOT IN (SELECT text_key FROM h WHERE lang = 'en')")
def unseen(spark, sf):
    d = table(spark, sf, "documents")
    store = d.filter("lang = 'en'").select(ve.text_key(F.col("text"), "hash-64").alias("text_key"))
    return ve.unseen_texts(d, "text", store, "hash-64").select("text_key")


@query("V3_cosine_similarity", f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings")
def cosine(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.round(ve.similarity_to(F.col("embedding"), ve.vector_of(v, "vec_id", 3)), 6).alias("similarity"))


_TOP = "row_number() OVER (ORDER BY s DESC, vec_id) AS rank"


@query("V4_top_k_similar", f"WITH s AS (SELECT vec_id, {_COS} AS s FROM embeddings), r AS (SELECT vec_id, round(s, 6) AS score, {_TOP} FROM s) SELECT * FROM r WHERE rank <= 5")
def top_k(spark, sf):
    v = vectors(spark, sf)
    return ve.top_k(v, "vec_id", ve.vector_of(v, "vec_id", 3), 5)


@query("V5_inner_product_threshold", f"WITH s AS (SELECT vec_id, {_DOT} AS s FROM embeddings), r AS (SELECT vec_id, round(s, 6) AS score, {_TOP} FROM s) SELECT * FROM r WHERE rank <= 50 AND score >= 0.7")
def inner_product(spark, sf):
    v = vectors(spark, sf)
    return ve.top_k(v, "vec_id", ve.vector_of(v, "vec_id", 3), 50, threshold=0.7, inner_product=True)


@query("V6_filtered_search", f"WITH s AS (SELECT vec_id, {_COS} AS s FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 3)), r AS (SELECT vec_id, round(s, 6) AS score, {_TOP} FROM s) SELECT * FROM r WHERE rank <= 20 AND score >= 0.2")
def filtered(spark, sf):
    v = vectors(spark, sf)
    label = v.filter("vec_id = 3").select("label").first()[0]
    return ve.top_k(v, "vec_id", ve.vector_of(v, "vec_id", 3), 20, where=F.col("label") == label, threshold=0.2)


def _approximate(spark, sf):
    v = vectors(spark, sf)
    queries = v.filter("label = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    quantiser = ivf.fit(v, "vec_id")
    rows = kept("vector_lists", v, lambda: ivf.index(v, "vec_id", quantiser))
    return v, queries, ivf.search(rows, quantiser, v, "vec_id", queries, "query_id", 5)


@query("V7_approximate_top_k")
def approximate(spark, sf):
    return _approximate(spark, sf)[2].select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("V7_recall", "SELECT count(*) * 5 AS wanted, TRUE AS recall_reached FROM embeddings WHERE label = 3")
def approximate_recall(spark, sf):
    """Whether nine in ten of the exact best rows are among the approximate ones."""
    v, queries, near = _approximate(spark, sf)
    exact = ve.bulk_top_k(v, "vec_id", queries, "query_id", 5).select("query_id", "vec_id")
    both = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("met")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("met") >= F.lit(0.9) * F.count("*")).alias("recall_reached"))


@query("V8_add_documents", "SELECT vec_id::VARCHAR AS vec_id, 'stored' AS source, '2024-01-01' AS added_at FROM embeddings WHERE label <> 1 UNION ALL SELECT vec_id::VARCHAR, CASE WHEN vec_id > 100 THEN 'given' ELSE 'unknown' END, '2024-02-01' FROM embeddings WHERE label = 1")
def add_documents(spark, sf):
    v = vectors(spark, sf)
    store = v.filter("label <> 1").select("vec_id", "embedding", F.lit("stored").alias("source"), F.lit("2024-01-01").alias("added_at"))
    batch = v.filter("label = 1").select("vec_id", "embedding", F.when(F.col("vec_id") > 100, "given").alias("source"), F.lit(None).cast("string").alias("added_at"))
    return ve.add_documents(store, batch, "vec_id", "unknown", "2024-02-01").select("vec_id", "source", "added_at")


@query("V9_update_delete", "SELECT vec_id, CASE WHEN label = 2 THEN 77 ELSE label END AS label FROM embeddings WHERE label NOT IN (4, 5)")
def update_delete(spark, sf):
    v = vectors(spark, sf).select("vec_id", "label")
    changed = ve.update_rows(v, v.filter("label = 2").withColumn("label", F.lit(77)), "vec_id", ["label"])
    return ve.delete_rows(ve.delete_rows(changed, v.filter("label = 4"), "vec_id"), where=F.col("label") == 5)


@query("V10_get_by_id", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE vec_id = 42")
def get_by_id(spark, sf):
    return vectors(spark, sf).filter("vec_id = 42").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("V11_collection_stats", "SELECT count(*) AS total, count(DISTINCT label) AS labels FROM embeddings")
def collection_stats(spark, sf):
    return ve.collection_stats(vectors(spark, sf), "label")


def knowledge(spark, sf):
    """Extracted once for each version of the pages, as searches over pages run on the stored table."""
    pages = table(spark, sf, "pages")
    r = kept("search_pages", pages, lambda: records(spark, sf).select("page_id", "title", F.col("main_content").alias("content"), "language"))
    return r.select("page_id", "title", "content", F.array("language").alias("tags"))


_TERMS = ["the", "tion", "en"]
_SCORE = "(" + " + ".join(f"CAST(contains(lower(title), {q(t)}) AS INT) * 3 + CAST(contains(lower(main_content), {q(t)}) AS INT) + CAST(language = {q(t)} AS INT) * 2" for t in _TERMS) + ")"
_HITS = REC + f", s AS (SELECT page_id, title, main_content, {_SCORE} AS score FROM rec), h AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, page_id LIMIT 5)"


@query("R1_keyword_search", _HITS + " SELECT page_id, score FROM h")
def keyword_search(spark, sf):
    return se.keyword_search(knowledge(spark, sf), " ".join(_TERMS), "page_id").select("page_id", "score")


@query("R2_lookup_topic", REC + " SELECT page_id, title, substr(main_content, 1, 500) || '...' AS snippet FROM rec WHERE contains(lower(title), 'retion') OR contains(lower(main_content), 'retion') OR contains(language, 'retion') ORDER BY page_id LIMIT 3")
def lookup_topic(spark, sf):
    return se.lookup_topic(knowledge(spark, sf), "retion", "page_id")


@query("R3_lookup_examples", REC + " , f AS (SELECT page_id, title, main_content FROM rec WHERE regexp_matches(lower(main_content), 'workflow|example|tutorial|these|other') AND contains(lower(title), 'th') ORDER BY page_id LIMIT 5) SELECT page_id, title, substr(main_content, 1, 400) || '...' AS snippet FROM f")
def lookup_examples(spark, sf):
    return se.lookup_words(knowledge(spark, sf), list(se.EXAMPLE_WORDS) + ["these", "other"], "page_id", 5, 400, ("th",))


@query("R3_lookup_practices", REC + " SELECT page_id, title, substr(main_content, 1, 300) || '...' AS snippet FROM rec WHERE regexp_matches(lower(main_content), 'best practice|recommendation|tip|should|avoid|there') ORDER BY page_id LIMIT 4")
def lookup_practices(spark, sf):
    return se.lookup_words(knowledge(spark, sf), list(se.PRACTICE_WORDS) + ["there"], "page_id", 4, 300)


@query("R4_answer_snippet", _HITS + " SELECT round(CASE WHEN count(*) = 0 THEN 0.1 ELSE least(0.9, count(*) * 0.15 + 0.25) END, 4)::DOUBLE AS confidence, substr(string_agg('**' || title || e'**\\n' || substr(main_content, 1, 400) || '...', e'\\n\\n' ORDER BY score DESC, page_id), 1, 500) AS answer FROM h")
def answer_snippet(spark, sf):
    return se.answer(se.keyword_search(knowledge(spark, sf), " ".join(_TERMS), "page_id"), "page_id")


_QUERY = ["with", "that"]
_TOK = f"regexp_extract_all(lower(text), {q(tx.WORD_CHAR + '+')})"
_BM25 = f"""WITH t AS (SELECT doc_id, lang, len({_TOK}) AS dl, {', '.join(f"len(list_filter({_TOK}, lambda x: x = {q(t)})) AS tf{i}" for i, t in enumerate(_QUERY))} FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(_QUERY)))} FROM t),
b AS (SELECT doc_id, lang, round({' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))' for i in range(len(_QUERY)))}, 6) AS score FROM t, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(_QUERY)))})"""


def _bm25(spark, sf, where=None):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return se.bm25_scan(d, "doc_id", "text", _QUERY, where)


@query("R5_fulltext_search", _BM25 + " SELECT doc_id, score FROM b WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5")
def fulltext(spark, sf):
    return se.page(_bm25(spark, sf, F.col("lang") == "en"), [F.col("score").desc(), F.col("doc_id")], 20, 5)


@query("R5_fulltext_total", _BM25 + " SELECT count(*) AS total FROM b WHERE lang = 'en'")
def fulltext_total(spark, sf):
    return _bm25(spark, sf, F.col("lang") == "en").agg(F.count("*").alias("total"))


@query("R5_fulltext_index", _BM25 + " SELECT doc_id, score FROM b")
def fulltext_index(spark, sf):
    """The same scores out of an inverted index that is written once for each version of the table."""
    d = docs(spark, sf)
    index = kept("fulltext_terms", d, lambda: se.build_index(d, "doc_id", "text"))
    size = d.agg(F.count("*").alias("n"), F.avg(F.size(se.tokens(F.col("text")))).alias("a")).first()
    return se.search_index(index, "doc_id", _QUERY, size["n"], size["a"])


def _tf(words: str, prefix: bool = False) -> str:
    """DuckDB text for the number of places where the words stand in the token list."""
    parts = words.split()
    last = f"starts_with(tok[i + {len(parts) - 1}], {q(parts[-1])})" if prefix else f"tok[i + {len(parts) - 1}] = {q(parts[-1])}"
    tests = " AND ".join([*[f"tok[i + {j}] = {q(w)}" for j, w in enumerate(parts[:-1])], last])
    return f"len(list_filter(range(1, len(tok) - {len(parts) - 2}), lambda i: {tests}))"


def _matched(units: dict[str, str], accepted: str, scored: list[str]) -> str:
    """Documents by their unit counts, with the BM25 sum over the scored units."""
    weight = " + ".join(f"ln(1 + (n - df_{u} + 0.5::DOUBLE) / (df_{u} + 0.5::DOUBLE)) * {u} * 2.2::DOUBLE / ({u} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for u in scored)
    return f"""WITH t0 AS (SELECT doc_id, {_TOK} AS tok FROM documents), t AS (SELECT doc_id, len(tok) AS dl, {', '.join(f'{x} AS {u}' for u, x in units.items())} FROM t0),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl, {', '.join(f'count(*) FILTER ({u} > 0) AS df_{u}' for u in units)} FROM t)
SELECT doc_id, round({weight}, 6) AS score FROM t, st WHERE {accepted}"""


def positions(spark, sf):
    d = docs(spark, sf)
    return kept("fulltext_positions", d, lambda: ft.positions(d, "doc_id", "text")), d.count()


def _match(spark, sf, *branches):
    index, n = positions(spark, sf)
    return ft.search(index, "doc_id", list(branches), n)


@query("R5_fulltext_phrase", _matched({"a": _tf("in the"), "b": _tf("with")}, "a > 0 AND b > 0", ["a", "b"]))
def fulltext_phrase(spark, sf):
    return _match(spark, sf, ft.All((ft.phrase("in the"), ft.word("with"))))


@query("R5_fulltext_prefix", _matched({"a": _tf("thes", True), "b": _tf("of th", True)}, "a > 0 AND b > 0", ["a", "b"]))
def fulltext_prefix(spark, sf):
    return _match(spark, sf, ft.All((ft.prefix("thes"), ft.phrase("of th", prefix=True))))


@query("R5_fulltext_boolean", _matched({"a": _tf("mit license"), "b": _tf("der"), "c": _tf("die d", True), "d": _tf("und")}, "a > 0 OR (b > 0 AND c > 0 AND d = 0)", ["a", "b", "c"]))
def fulltext_boolean(spark, sf):
    """The phrase, or both words without the third."""
    return _match(spark, sf, ft.All((ft.phrase("MIT License"),)), ft.All((ft.word("der"), ft.phrase("die d", prefix=True)), (ft.word("und"),)))


@query("J3_fulltext_join_base", _BM25 + " SELECT doc_id, score, source, b.lang FROM b JOIN documents USING (doc_id)")
def fulltext_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang").join(_bm25(spark, sf), "doc_id").select("doc_id", "score", "source", "lang")


@query("R6_ilike_search", "SELECT doc_id, source FROM documents WHERE (text ILIKE '%with THE%' OR source ILIKE '%with THE%' OR lang ILIKE '%with THE%') AND lang = 'en' ORDER BY doc_id DESC LIMIT 20 OFFSET 5")
def ilike(spark, sf):
    hits = se.ilike_search(table(spark, sf, "documents"), "with THE", ["text", "source", "lang"], {"lang": "en"})
    return se.page(hits.select("doc_id", "source"), [F.col("doc_id").desc()], 20, 5)


@query("R6_ilike_users", "SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%00001%') AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20")
def ilike_users(spark, sf):
    hits = se.ilike_search(table(spark, sf, "customer"), "00001", ["c_name", "c_mktsegment"], {"c_mktsegment": "BUILDING"})
    return se.page(hits.select("c_custkey", "c_name"), [F.col("c_custkey")], 20)


@query("R7_paginate", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paginate(spark, sf):
    return se.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 100)


_VHITS = f"v0 AS (SELECT vec_id AS doc_id, {_COS} AS s FROM embeddings), vh AS (SELECT doc_id, round(s, 6) AS score FROM v0 ORDER BY s DESC, doc_id LIMIT 50), th AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 50)"


def _hits(spark, sf):
    v = vectors(spark, sf)
    vh = ve.top_k(v, "vec_id", ve.vector_of(v, "vec_id", 3), 50).select(F.col("vec_id").alias("doc_id"), "score")
    th = se.page(_bm25(spark, sf), [F.col("score").desc(), F.col("doc_id")], 50)
    return vh, th


@query("R8_hybrid_search", _BM25 + ", " + _VHITS + " SELECT coalesce(vh.doc_id, th.doc_id) AS doc_id, round(coalesce(vh.score, 0) * 0.7::DOUBLE + coalesce(th.score, 0) * 0.3::DOUBLE, 6) AS combined_score FROM vh FULL JOIN th ON vh.doc_id = th.doc_id")
def hybrid(spark, sf):
    return se.hybrid(*_hits(spark, sf), "doc_id")


@query("R9_field_boost", REC + " SELECT page_id, (CAST(contains(lower(title), 'tion') AS INT) * 2.0 + CAST(contains(lower(main_content), 'tion') AS INT) * 1.0)::DOUBLE AS score FROM rec ORDER BY score DESC, page_id LIMIT 20")
def field_boost(spark, sf):
    has = lambda c: F.lower(c).contains("tion").cast("double")
    k = knowledge(spark, sf).select("page_id", se.field_boost({"title": has("title"), "content": has("content")}, {"title": 2.0, "content": 1.0}).alias("score"))
    return se.page(k, [F.col("score").desc(), F.col("page_id")], 20)


@query("R10_deduplicate_results", "SELECT user_id, max(value) AS value FROM events GROUP BY 1")
def deduplicate(spark, sf):
    return se.deduplicate(table(spark, sf, "events"), "user_id", "value")


@query("R11_enrich_results", _BM25 + ", " + _VHITS + " SELECT vh.doc_id, vh.score, source, documents.lang FROM vh LEFT JOIN documents USING (doc_id)")
def enrich(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return se.enrich(_hits(spark, sf)[0], d, "doc_id").select("doc_id", "score", "source", "lang")


@query("R12_filter_sort_results", _BM25 + " SELECT doc_id, score FROM b WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 30")
def filter_sort(spark, sf):
    joined = fulltext_join(spark, sf).filter("lang = 'en'").select("doc_id", "score")
    return se.page(joined, [F.col("score").desc(), F.col("doc_id")], 30)


_PADDED = "regexp_replace(text, '([^\\p{L}\\p{N}_])', e'\\x01\\\\1\\x01', 'g')"


@query("R13_highlight", f"""SELECT doc_id, md5(replace(regexp_replace(e'\\x01' || {_PADDED} || e'\\x01', e'(?i)\\x01(the|with)\\x01', e'\\x01<em>\\\\1</em>\\x01', 'g'), e'\\x01', '')) AS highlighted FROM documents""")
def highlight(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.encode(se.highlight(F.col("text"), "the with"), "UTF-8")).alias("highlighted"))


@query("R14_facets", "SELECT 'category' AS facet, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest([source, lang]) AS t FROM documents) GROUP BY 2")
def facets(spark, sf):
    return se.facets(table(spark, sf, "documents").withColumn("tags", F.array("source", "lang")), "lang", "tags")


_WORDS = f"(SELECT unnest({_TOK}) AS term FROM documents)"


def words(spark, sf):
    return scale.rows_of(docs(spark, sf), [], se.tokens(F.col("text")), "term")


@query("R15_suggestions", f"SELECT term, count(*) AS n FROM {_WORDS} WHERE starts_with(term, 'th') GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def suggestions(spark, sf):
    return se.suggestions(words(spark, sf), "term", "th", 10)


_MISSPELLED = ["thet", "wiht", "quee"]


@query("R16_spell_correct", f"WITH v AS (SELECT term, count(*) AS n FROM {_WORDS} GROUP BY 1), m(word) AS (VALUES ('thet'), ('wiht'), ('quee')), r AS (SELECT word, term, levenshtein(term, word) AS d, row_number() OVER (PARTITION BY word ORDER BY levenshtein(term, word), n DESC, term) AS k FROM v, m) SELECT word, term AS correction, d AS distance FROM r WHERE k = 1")
def spell_correct(spark, sf):
    return se.spell_correct(words(spark, sf).groupBy("term").agg(F.count("*").alias("n")), _MISSPELLED)


# DuckDB counts edits of bytes: letters of two bytes become capitals, which no word holds.
_BY_LETTER = "levenshtein(translate(term, 'éèñßêíçüöóä', 'ABCDEFGHIJK'), translate(word, 'éèñßêíçüöóä', 'ABCDEFGHIJK'))"


@query("R16_correct_table", f"""WITH v AS (SELECT term, count(*) AS n FROM {_WORDS} GROUP BY 1 HAVING count(*) >= 5), b AS (SELECT DISTINCT unnest({_TOK}) AS word FROM benchmark), m AS (SELECT word FROM b ANTI JOIN v ON word = term),
r AS (SELECT word, term, {_BY_LETTER} AS d, n FROM v, m WHERE {_BY_LETTER} <= 2), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, n DESC, term) AS k FROM r)
SELECT m.word, term AS correction, d AS distance FROM m LEFT JOIN k ON m.word = k.word AND k.k = 1""")
def correct_table(spark, sf):
    """Every rare or unknown word of the benchmark against the words the documents use at least five times."""
    vocabulary = words(spark, sf).groupBy("term").agg(F.count("*").alias("n")).filter("n >= 5")
    asked = scale.rows_of(table(spark, sf, "benchmark"), [], se.tokens(F.col("text")), "word").distinct()
    unknown = asked.join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    return sj.correct_words(vocabulary, unknown, "word")


@query("R17_expand_query", "SELECT p_partkey, array_to_string(CASE p_type WHEN 'ECONOMY' THEN ['ECONOMY', 'cheap', 'basic'] WHEN 'PROMO' THEN ['PROMO', 'offer'] ELSE [p_type] END, '|') AS terms FROM part")
def expand_query(spark, sf):
    e = se.expand_query(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", {"ECONOMY": ["cheap", "basic"], "PROMO": ["offer"]})
    return e.select("p_partkey", F.array_join("terms", "|").alias("terms"))


@query("R18_cluster_results", f"WITH s AS (SELECT vec_id, label, round({_COS}, 6) AS s FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k FROM s) SELECT label, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS members FROM r GROUP BY label")
def cluster_results(spark, sf):
    v = vectors(spark, sf)
    score = F.round(ve.similarity_to(F.col("embedding"), ve.vector_of(v, "vec_id", 3)), 6)
    c = se.cluster_by(v.select("label", "vec_id", score.alias("score")), "label", "vec_id", "score")
    return c.select("label", "n", F.array_join("members", ",").alias("members"))


@query("R18_cluster_kmeans")
def cluster_kmeans(spark, sf):
    return se.cluster_vectors(vectors(spark, sf).select("vec_id", "embedding"), "embedding", 8).select("vec_id", "cluster")


@query("R19_personalized_search", _BM25 + " SELECT doc_id, round(score + CASE WHEN lang IN ('en', 'de') THEN 0.3::DOUBLE ELSE 0.0 END, 6) AS personal_score FROM b ORDER BY personal_score DESC, doc_id LIMIT 30")
def personalized(spark, sf):
    p = se.personalize(fulltext_join(spark, sf), "lang", ["en", "de"]).select("doc_id", "personal_score")
    return se.page(p, [F.col("personal_score").desc(), F.col("doc_id")], 30)


@query("R20_bulk_search", "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.label = 3), r AS (SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")
def bulk_search(spark, sf):
    """The vectors of one label are the list of queries; the corpus is the whole table."""
    v = vectors(spark, sf)
    queries = v.filter("label = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = ve.bulk_top_k(v, "vec_id", queries, "query_id", 5)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("R21_search_analytics", """SELECT 'total' AS metric, unnest(['total', 'successful', 'failed', 'avg_time']) AS name, unnest([count(*)::DOUBLE, count(*) FILTER (event_type <> 'error')::DOUBLE, count(*) FILTER (event_type = 'error')::DOUBLE, round(avg(value), 6)]) AS value FROM events
UNION ALL (SELECT 'popular', props, count(*)::DOUBLE AS c FROM events GROUP BY props ORDER BY c DESC, props LIMIT 5) UNION ALL SELECT 'daily', ts::DATE::VARCHAR, count(*)::DOUBLE FROM events GROUP BY 2""")
def search_analytics(spark, sf):
    return se.search_analytics(table(spark, sf, "events"), "props", F.col("event_type") != "error", "value", "ts")


@query("R21_user_timeline", "SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'click') AS chats FROM events GROUP BY ALL")
def user_timeline(spark, sf):
    return se.user_timeline(table(spark, sf, "events"), "user_id", {"searches": F.col("event_type") == "view", "chats": F.col("event_type") == "click"}, "ts")
