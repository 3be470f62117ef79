"""One thin query per operator over its whole table, and the DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (bpe, chat_format, decontaminate, language_id, license_scan, line_dedup, quality_rules, resampling, sharding, simhash, spelling,
                          topk, toxicity)
from pagemill.llm.common import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, usable=fold_of(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, machine).select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.fit(docs, usable=fold_of(F.col("doc_id"), 4) != 2)
    return language_id.predict(docs, trees, ["doc_id"]).select(
        "doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, ["doc_id"], ids=False)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


ORACLES["op9_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
    SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hits AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
places AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
owners AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(owners.n, 0) AS BIGINT) AS n_items, sha256(coalesce(owners.ids, '')) AS items_sha256,
    coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.r = places.r LEFT JOIN owners ON d.r = owners.r
"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _gram_rows() -> str:
    return ", ".join(f"('{gram}', {k}, '{label}', {base}, {i}, {grams}, {told}, {tells})" for gram, k, label, base, i, grams, told, tells in license_scan.template_grams(3))


ORACLES["op2_license_scan"] = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents
), g(gram, k, label, base, pos, grams, told, tells) AS (VALUES """ + _gram_rows() + r"""),
spots AS (SELECT r, w, unnest(range(0, len(w) - 1)) AS place FROM d WHERE len(w) >= 2),
cut AS (SELECT r, place, k, array_to_string(w[place + 1:place + k], ' ') AS gram FROM spots, (SELECT DISTINCT k FROM g)),
met AS (SELECT r, label, base, grams, tells, told, cut.k, place, pos, place - pos AS diag FROM cut JOIN g ON cut.gram = g.gram AND cut.k = g.k),
lines AS (SELECT r, label, base, grams, tells, k, diag, min(place) AS lo, max(place) AS hi, list(DISTINCT pos) AS seen, coalesce(list(DISTINCT pos) FILTER (WHERE told), []) AS said FROM met GROUP BY ALL),
jumps AS (SELECT *, base OR diag - coalesce(lag(diag) OVER (PARTITION BY r, label, base ORDER BY diag), -1000000000) > 2 AS apart FROM lines),
runs AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY r, label, base ORDER BY diag) AS run FROM jumps),
whole AS (
    SELECT r, label, base, grams, tells, k, run, min(lo) AS first, max(hi) + k - 1 AS last, len(list_distinct(flatten(list(seen)))) AS covered, len(list_distinct(flatten(list(said)))) AS said
    FROM runs GROUP BY r, label, base, grams, tells, k, run
), good AS (
    SELECT * FROM whole WHERE CASE WHEN base THEN covered = grams ELSE covered / grams >= 0.6 AND last - first + 1 <= (grams + k - 1) * 1.5 AND said = tells END
), per AS (
    SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(covered / grams) AS score
    FROM good GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
    CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per ON d.r = per.r
"""


@query
def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    tree = chat_format.chained(rows.unionByName(added), "conv_id", "turn", "role", "text")
    found = chat_format.conversations(tree)
    turns = F.transform(chat_format.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = found.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLES["op10_chat_format"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, 8 + length(role) + 1 + length(text) + 8 + length(text) - length(translate(text, '<[\', '')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return kept.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """DuckDB text for the unsigned CRC-32 of a string expression's UTF-8 bytes, by the usual byte table."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    digits = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance_resampling"] = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents
), b AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word
    FROM benchmark
), f AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
vocabulary AS (SELECT word, """ + _crc32("word") + r""" % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM f UNION ALL SELECT word FROM b))),
s AS (SELECT bucket, sum(n) AS n FROM f JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
        / ((CAST(s.n AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
    FROM s LEFT JOIN t USING (bucket)
), means AS (SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS mean FROM f JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
    SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(mean, 0) AS weight,
        coalesce(mean, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN means ON d.r = means.r
), placed AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS many FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * many // 100 THEN place END AS rank
FROM scored LEFT JOIN placed ON scored.r = placed.r
"""


@query
def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLES["op12_topk_search"] = r"""
WITH v AS (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM pairs)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM placed WHERE place <= 5
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]+'), lambda x: length(x) >= 7)) AS run
    FROM documents
), hashed AS (SELECT run, times, """ + _crc32("(d || ':' || run)") + r""" AS h FROM (SELECT d, run, count(*) AS times FROM runs GROUP BY d, run)),
read AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM read WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
    SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
    UNION SELECT cuts.word, words.word FROM cuts JOIN words ON cuts.rest = words.word
    UNION SELECT words.word, cuts.word FROM cuts JOIN words ON cuts.rest = words.word
), best AS (
    SELECT pairs.word, count(*) AS n_near, arg_min(near, (-words.n, near)) AS near, max(words.n) AS near_n FROM pairs JOIN words ON pairs.near = words.word GROUP BY pairs.word
), named AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
    SELECT word, word AS link FROM named
    UNION ALL SELECT chain.word, named.form FROM chain JOIN named ON chain.link = named.word WHERE named.form IS NOT NULL
), ends AS (SELECT chain.word, link AS root FROM chain JOIN named ON chain.link = named.word WHERE named.form IS NULL)
SELECT named.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM named JOIN ends ON named.word = ends.word
"""
