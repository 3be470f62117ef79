"""Cleaning, statistics, chunking and keyword queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import chunks as ch
from pagemill.operators import keywords as kw
from pagemill.operators import knowledge as kn
from pagemill.operators import table_functions as tables
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import REC, docs, records
from pagemill.plans.registry import ORACLES, query
from pagemill.plans.sqlparts import q
from pagemill.plans.urls import OUTPUT_NAME_SQL
from pagemill.functions import urls as ux


def r(x, pattern, to):
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


_CLEAN = sp.strip(r(r(r(r(sp.decode("text"), tx.TAG_PATTERN, " "), tx.URL_PATTERN, "[URL]"), tx.EMAIL_PATTERN, "[EMAIL]"), tx.WS + "+", " "))
_NO_FLAGS = sp.strip(sp.decode("text"))


@query("T1_clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned, {_NO_FLAGS} AS entities_only FROM documents")
def clean_text(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", tx.clean_text(c).alias("cleaned"),
                                  tx.clean_text(c, False, False, True, True).alias("entities_only"))


@query("T2_clean_knowledge_text", f"SELECT doc_id, {sp.squash(r(r('text', tx.WS + '+', ' '), tx.TAG_PATTERN, ''))} AS cleaned FROM documents")
def clean_knowledge(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clean_knowledge_text(F.col("text")).alias("cleaned"))


_PROCESSED = "replace(replace(replace(replace(" + sp.squash("text") + ", 'advertisement', ''), 'popup', ''), 'cookie-notice', ''), 'newsletter', '')"


@query("T3_clean_processed_text", f"SELECT doc_id, {_PROCESSED} AS cleaned, substr(sha256({_PROCESSED}), 1, 16) AS content_hash FROM documents")
def clean_processed(spark, sf):
    c = tx.clean_processed_text(F.col("text"), normalize=False)
    return docs(spark, sf).select("doc_id", c.alias("cleaned"), tx.content_hash16(c).alias("content_hash"))


@query("T3_clean_processed_text_nfkc")
def clean_processed_nfkc(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clean_processed_text(F.col("text")).alias("cleaned")).withColumn("content_hash", tx.content_hash16(F.col("cleaned")))


def _chunker(name, mode, size=1000, overlap=200, oracle=None):
    @query(name, oracle)
    def run(spark, sf):
        return ch.chunk_table(docs(spark, sf), "doc_id", "text", mode, size, overlap).select("doc_id", "chunk_index", "total_chunks", "content")


def _windows_sql(last: str, stop: str, columns: str) -> str:
    """Overlapping slices of 1000 characters by recursion: each end is `last` place found in the slice, or its full length."""
    end = f"CASE WHEN s + 1000 >= n THEN s + 1000 ELSE coalesce({last}, s + 1000) END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, n, 0 AS k, 0::BIGINT AS s, {end.replace('s + 1000', '0 + 1000').replace('(s ', '(0 ')} AS e FROM d
UNION ALL SELECT doc_id, text, n, k + 1, s, {end} FROM (SELECT doc_id, text, n, k, greatest(s + 1, e - 200) AS s FROM w WHERE e < n + {stop}) WHERE s < n),
c AS (SELECT doc_id, k, n, {sp.strip('substr(text, s + 1, e - s)')} AS content FROM w), f AS (SELECT doc_id, n, content, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index,
count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM c WHERE content <> '') SELECT doc_id, {columns} FROM f"""


# The last blank among the 100 places up to the full length, or the place behind the last sentence end.
_BLANK_END = "s + 901 + nullif(length(regexp_extract(substr(text, (s + 902)::BIGINT, 100), '(?s)^(.*)[ \\t\\n\\x0B\\f\\r]', 0)), 0) - 1"
_SENTENCE_END = "s + 901 + nullif(length(regexp_extract(substr(text, (s + 902)::BIGINT, 100), '(?s)^(.*)[.!?\\n]', 0)), 0)"
def _packed_sql(pieces: str, first: str, glue: str, size: int) -> str:
    """Pieces packed up to 1000 characters behind the list `first`, each new chunk with the last 200 of the one before."""
    fold = (f"list_reduce(list_transform({pieces}, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) + {size} <= 1000 THEN list_concat(a[:-2], [a[-1] || {glue} || x[1]]) "
            f"WHEN length(a[-1]) > 200 THEN list_append(a, right(a[-1], 200) || {glue} || x[1]) ELSE list_concat(a, x) END, {first})")
    return f"list_filter(list_transform({fold}, lambda c: {sp.strip('c')}), lambda c: c <> '')"


def _sentences_sql(source: str, name: str) -> str:
    """CTEs that give `name`(doc_id, l): the sentence chunks of the texts of `source`(doc_id, text). A text without a
    sentence end, or a first sentence beyond a chunk, is cut by characters; the rest is packed by a fold."""
    end = f"CASE WHEN s + 1000 >= n THEN s + 1000 ELSE coalesce({_BLANK_END}, s + 1000) END"
    return f"""{name}_p AS (SELECT doc_id, text, list_transform(string_split_regex(text, '[.!?]+[ \\t\\n\\x0B\\f\\r]+'), lambda p: {sp.strip('p')}) AS p FROM {source}),
{name}_q AS (SELECT doc_id, text, len(p) = 1 AS bare, list_concat(list_transform(list_filter(p[:-2], lambda x: x <> ''), lambda x: x || '. '), list_filter([p[-1]], lambda x: x <> '')) AS q FROM {name}_p),
{name}_d AS (SELECT doc_id, CASE WHEN bare THEN text ELSE q[1] END AS text FROM {name}_q WHERE bare OR length(q[1]) > 1000),
{name}_w AS (SELECT doc_id, text, length(text) AS n, 0 AS k, 0::BIGINT AS s, {end.replace('>= n', '>= length(text)').replace('s + 1000', '0 + 1000').replace('(s ', '(0 ')} AS e FROM {name}_d
UNION ALL SELECT doc_id, text, n, k + 1, s, {end} FROM (SELECT doc_id, text, n, k, greatest(s + 1, e - 200) AS s FROM {name}_w WHERE e < n) WHERE s < n),
{name}_l AS (SELECT doc_id, list(c ORDER BY k) AS l FROM (SELECT doc_id, k, {sp.strip('substr(text, s + 1, e - s)')} AS c FROM {name}_w) WHERE c <> '' GROUP BY doc_id),
{name} AS (SELECT doc_id, CASE WHEN bare THEN l ELSE {_packed_sql("q[2:]", "coalesce(l, [q[1]])", "''", 0)} END AS l FROM {name}_q LEFT JOIN {name}_l USING (doc_id))"""


_BY_SENTENCE = "WITH RECURSIVE src AS (SELECT doc_id, text FROM documents WHERE length(text) > 0), " + _sentences_sql("src", "c")
_BY_PARAGRAPH = f"""WITH RECURSIVE g AS (SELECT doc_id, text, string_split_regex(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n') AS g FROM documents WHERE length(text) > 0),
m AS (SELECT doc_id, text, len(g) = 1 AS one, list_filter(list_transform(g, lambda p: {sp.strip('p')}), lambda p: p <> '') AS m FROM g WHERE length(text) > 1000),
src AS (SELECT doc_id, CASE WHEN one THEN text ELSE m[1] END AS text FROM m WHERE one OR length(m[1]) + 2 > 1000), {_sentences_sql("src", "s")},
c AS (SELECT doc_id, [text] AS l FROM g WHERE length(text) <= 1000 UNION ALL
SELECT doc_id, CASE WHEN one THEN l ELSE {_packed_sql("m[2:]", "coalesce(l, [m[1]])", "(chr(10) || chr(10))", 2)} END FROM m LEFT JOIN s USING (doc_id))"""
_CHUNK_ROWS = " SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk_index, len(l) AS total_chunks, unnest(l) AS content FROM c"
_chunker("T4_split_text", "paragraph", oracle=_BY_PARAGRAPH + _CHUNK_ROWS)
_chunker("T5_split_by_sentences", "sentence", oracle=_BY_SENTENCE + _CHUNK_ROWS)
_chunker("T6_split_by_characters", "char", oracle=_windows_sql(_BLANK_END, "0", "chunk_index, total_chunks, content"))


@query("T7_chunk_words", f"""WITH w AS (SELECT doc_id, {sp.words('text')} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS i FROM w), p AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 100], ' ') AS content FROM s),
n AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM p WHERE length(content) > 50)
SELECT doc_id, chunk_index, content FROM n""")
def chunk_words(spark, sf):
    """Windows of 100 words every 80, all of them."""
    return ch.explode_chunks(ch.word_chunks(docs(spark, sf), "text", "c", 100, 20), "doc_id", F.col("c"))


def _in_sql(spark, sf, statement):
    """A statement over the documents in which the chunkers are table functions."""
    tables.register(spark)
    return spark.sql(statement, documents=docs(spark, sf))


@query("T4_split_text_sql", ORACLES["T4_split_text"])
def split_text_sql(spark, sf):
    return _in_sql(spark, sf, "SELECT doc_id, c.* FROM {documents}, LATERAL chunk_text(text, 'paragraph', 1000, 200) AS c")


@query("T5_split_by_sentences_sql", ORACLES["T5_split_by_sentences"])
def split_by_sentences_sql(spark, sf):
    return _in_sql(spark, sf, "SELECT doc_id, c.* FROM {documents}, LATERAL chunk_text(text, 'sentence', 1000, 200) AS c")


@query("T6_split_by_characters_sql", ORACLES["T6_split_by_characters"])
def split_by_characters_sql(spark, sf):
    return _in_sql(spark, sf, "SELECT doc_id, c.* FROM {documents}, LATERAL chunk_text(text, 'char', 1000, 200) AS c")


@query("T8_chunk_char_sentence_sql")
def chunk_char_sentence_sql(spark, sf):
    return _in_sql(spark, sf, """SELECT doc_id, IF(total_chunks > 1, concat(doc_id, '_part_', chunk_index), cast(doc_id AS string)) AS id, content, total_chunks > 1 AS is_split_chunk,
        IF(total_chunks > 1, chunk_index, NULL) AS chunk_part, cast(length(content) AS bigint) AS chunk_char_count
        FROM {documents}, LATERAL chunk_text(text, 'char_sentence', 1000, 200) AS c""")


# A chunk stands at its first place from the end of the one before on, or at that end where the packing changed the text.
_OFFSETS = _BY_PARAGRAPH + f""", x AS ({_CHUNK_ROWS.strip()}), o AS (SELECT doc_id, -1 AS chunk_index, 0::BIGINT AS total_chunks, '' AS content, 0::BIGINT AS start_index, 0::BIGINT AS end_index FROM g
UNION ALL SELECT doc_id, chunk_index, total_chunks, content, b, b + length(content) FROM (SELECT x.*, o.end_index + greatest(instr(substr(g.text, o.end_index + 1), x.content) - 1, 0) AS b
FROM o JOIN x ON x.doc_id = o.doc_id AND x.chunk_index = o.chunk_index + 1 JOIN g ON g.doc_id = x.doc_id))
SELECT doc_id, chunk_index::BIGINT AS chunk_index, total_chunks, start_index, end_index"""
CHUNK_DIGESTS = _BY_PARAGRAPH + f", x AS ({_CHUNK_ROWS.strip()}) SELECT doc_id AS document_id, chunk_index, sha256(content) AS content_hash, {sp.wc('content')} AS word_count, 'hashing-64' AS embedding_model FROM x"


@query("T10_chunk_offsets_sql", _OFFSETS + " FROM o WHERE chunk_index >= 0")
def chunk_offsets_sql(spark, sf):
    return _in_sql(spark, sf, "SELECT doc_id, chunk_index, total_chunks, start_index, end_index FROM {documents}, LATERAL chunk_text(text, 'paragraph', 1000, 200, true) AS c")


@query("T8_chunk_char_sentence", "WITH whole AS (SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 1 AND 1000), parts AS (" + _windows_sql(
    _SENTENCE_END, "200", "chunk_index, total_chunks, content, n") + """) SELECT doc_id, doc_id::VARCHAR AS id, text AS content, FALSE AS is_split_chunk, NULL::BIGINT AS chunk_part, length(text) AS chunk_char_count FROM whole
UNION ALL SELECT doc_id, CASE WHEN total_chunks > 1 THEN doc_id || '_part_' || chunk_index ELSE doc_id::VARCHAR END, content, total_chunks > 1, CASE WHEN total_chunks > 1 THEN chunk_index END, length(content) FROM parts WHERE n > 1000""")
def chunk_char_sentence(spark, sf):
    return ch.split_parts(docs(spark, sf), "doc_id", "text")


ORACLES["T8_chunk_char_sentence_sql"] = ORACLES["T8_chunk_char_sentence"]


@query("T9_chunk_chars_stride", f"""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents), p AS (SELECT doc_id, i, substr(text, (i + 1)::BIGINT, 500) AS content FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, content, md5(content) AS content_hash FROM p WHERE {sp.not_blank('content')}""")
def chunk_stride(spark, sf):
    rows = ch.explode_chunks(docs(spark, sf), "doc_id", ch.stride_chunks(F.col("text")))
    return rows.withColumn("content_hash", F.md5(F.encode("content", "UTF-8")))


@query("T10_chunk_offsets", _OFFSETS + f", length(content) AS char_count, {sp.wc('content')} AS word_count, {sp.n_matches('content', tx.SENTENCE_BREAK)} + 1 AS sentence_count FROM o WHERE chunk_index >= 0")
def chunk_offsets(spark, sf):
    rows = ch.with_chunk_metadata(ch.chunk_table(docs(spark, sf), "doc_id", "text"))
    return rows.select("doc_id", "chunk_index", "total_chunks", "start_index", "end_index", "char_count", "word_count", "sentence_count")


# Greedy packing as a fold: a list of chunks so far, to which the next chunk is joined or added.
@query("T11_merge_chunks", f"""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents), p AS (SELECT doc_id, i, substr(text, (i + 1)::BIGINT, 500) AS c FROM s),
l AS (SELECT doc_id, list([c] ORDER BY i) AS l FROM p WHERE {sp.not_blank('c')} GROUP BY doc_id),
m AS (SELECT doc_id, list_filter(list_transform(list_reduce(l, lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) < 2000 THEN list_concat(a[:-2], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END), lambda c: {sp.strip('c')}), lambda c: c <> '') AS m FROM l)
SELECT doc_id, unnest(m) AS content, generate_subscripts(m, 1) - 1 AS chunk_index FROM m""")
def merge_chunks(spark, sf):
    return ch.explode_chunks(docs(spark, sf), "doc_id", ch.merge_chunk_array(ch.stride_chunks(F.col("text")), 2000))


_SENT = f"({sp.n_matches('text', tx.SENTENCE_BREAK)} + 1)"
_PAR = f"({sp.n_matches('text', tx.PARAGRAPH_BREAK)} + 1)"
_LANG = "CASE WHEN length(text) = 0 THEN 'unknown' WHEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text)::DOUBLE > 0.9 THEN 'en' ELSE 'unknown' END"


@query("T12_text_metadata", f"""SELECT doc_id, length(text) AS char_count, {sp.wc('text')} AS word_count, {sp.n_matches('text', chr(10))} + 1 AS line_count, {_PAR} AS paragraph_count, {_SENT} AS sentence_count,
regexp_matches(text, {q(tx.URL_PATTERN)}) AS has_urls, regexp_matches(text, {q(tx.EMAIL_PATTERN)}) AS has_emails, regexp_matches(text, {q(tx.TAG_PATTERN)}) AS has_html,
array_to_string(regexp_extract_all(text, {q(tx.URL_PATTERN)}), '|') AS urls, array_to_string(regexp_extract_all(text, {q(tx.EMAIL_PATTERN)}), '|') AS emails, {_LANG} AS language FROM documents""")
def text_metadata(spark, sf):
    m = tx.text_metadata(F.col("text"))
    m["urls"], m["emails"] = F.array_join(m["urls"], "|"), F.array_join(m["emails"], "|")
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in m.items()])


@query("T13_detect_language", f"SELECT doc_id, {_LANG} AS detected FROM documents")
def detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", tx.detect_language_simple(F.col("text")).alias("detected"))


_CHARS = f"length(regexp_replace(text, {q(tx.WS + '+')}, '', 'g'))"


@query("T14_text_statistics", f"""SELECT doc_id, length(text) AS total_characters, {sp.wc('text')} AS total_words, {_SENT} AS total_sentences, {_PAR} AS total_paragraphs,
round(CASE WHEN {sp.wc('text')} > 0 THEN {_CHARS} / {sp.wc('text')}::DOUBLE ELSE 0 END, 2) AS avg_word_length, round({sp.wc('text')} / {_SENT}::DOUBLE, 2) AS avg_sentence_length, round({sp.wc('text')} / {_PAR}::DOUBLE, 2) AS avg_paragraph_length FROM documents""")
def text_statistics(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in tx.text_statistics(F.col("text")).items()])


@query("T15_readability_simple", f"SELECT doc_id, round(CASE WHEN {sp.wc('text')} = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 100 - 1.5 * ({sp.wc('text')} / {_SENT}::DOUBLE) - 2.0 * ({_CHARS} / {sp.wc('text')}::DOUBLE))) END, 6)::DOUBLE AS readability FROM documents")
def readability(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(tx.readability_simple(F.col("text")), 6).alias("readability"))


@query("T16_chunk_ids", REC + f""", n AS (SELECT *, {OUTPUT_NAME_SQL} AS f FROM rec)
SELECT page_id, substr(md5(url || ':' || title || ':' || substr(main_content, 1, 200)), 1, 16) AS chunk_id, 'chunk_' || f || '_' || substr(md5(url || ':' || title || ':' || f || ':' || substr(main_content, 1, 100)), 1, 12) AS file_chunk_id,
substr(md5(url || ':' || title || ':' || length(main_content)), 1, 16) AS length_chunk_id FROM n""")
def chunk_ids(spark, sf):
    ids = kn.chunk_ids(F.col("url"), F.col("title"), F.col("main_content"), ux.output_name(F.col("url")), (200, 100))
    return records(spark, sf).select("page_id", *[c.alias(n) for n, c in ids.items()])


@query("T16_whole_chunk_ids", REC + f""", n AS (SELECT *, {OUTPUT_NAME_SQL} AS f FROM rec)
SELECT page_id, substr(md5(url || ':' || title || ':' || main_content), 1, 16) AS chunk_id, 'chunk_' || f || '_' || substr(md5(url || ':' || title || ':' || f || ':' || main_content), 1, 12) AS file_chunk_id FROM n""")
def whole_chunk_ids(spark, sf):
    ids = kn.chunk_ids(F.col("url"), F.col("title"), F.col("main_content"), ux.output_name(F.col("url")))
    return records(spark, sf).select("page_id", *[ids[n].alias(n) for n in ("chunk_id", "file_chunk_id")])


def _terms_sql(terms: str, stop: list[str], n: int) -> str:
    return f"""WITH l AS (SELECT doc_id, {terms} AS l FROM documents), w AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM l),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS fp FROM w WHERE length(term) >= 4 AND term NOT IN ({', '.join(map(q, stop))}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fp) AS rank FROM c) SELECT doc_id, rank, term, n FROM r WHERE rank <= {n}"""


@query("T17_top_keywords", _terms_sql(f"list_filter(regexp_extract_all(lower(text), {q(tx.WORD_CHAR + '+')}), lambda w: regexp_matches(w, '^[a-z]{{3,}}$'))", kw.STOP_WORDS, 20))
def top_keywords(spark, sf):
    return kw.top_keywords(docs(spark, sf), "doc_id", "text")


@query("T18_top_topics", _terms_sql(sp.words("lower(text)"), kw.TOPIC_STOP_WORDS, 5))
def top_topics(spark, sf):
    return kw.top_topics(docs(spark, sf), "doc_id", "text")


@query("T19_lead_summary", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary FROM documents")
def lead_summary(spark, sf):
    return docs(spark, sf).select("doc_id", tx.lead_summary(F.col("text")).alias("summary"))
