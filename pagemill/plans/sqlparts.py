"""DuckDB fragments shared by the check queries."""

from __future__ import annotations

from pagemill.functions import html as hx
from pagemill.functions import quality as qx
from pagemill.functions import text as tx

WS = tx.WS


def q(s: str) -> str:
    """A single-quoted SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def replace_all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"


def crc32(x: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, byte by byte over the table of its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    digits = f"list_transform(range(0, strlen({x})), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def squash(x: str) -> str:
    return f"trim({replace_all(x, WS + '+', q(' '))})"


def strip(x: str) -> str:
    return replace_all(x, f"^{WS}+|{WS}+$", "''")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS + '+')}), lambda w: w <> '')"


def wc(x: str) -> str:
    return f"len({words(x)})"


def decode(x: str, entities=tx.ENTITIES) -> str:
    for a, b in entities:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def sentences(x: str) -> str:
    return f"string_split_regex({x}, {q(tx.SENTENCE_END)})"


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, {q(tx.NOT_WS)})"


def n_sentences(x: str) -> str:
    return f"len(list_filter({sentences(x)}, lambda s: {not_blank('s')}))"


def n_paragraphs(x: str) -> str:
    return f"len(list_filter(string_split({x}, e'\\n\\n'), lambda s: {not_blank('s')}))"


def n_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def match_chars(x: str, pattern: str, group: int = 0) -> str:
    return f"length(array_to_string(regexp_extract_all({x}, {q(pattern)}, {group}), ''))"


def whole_word(x: str, word: str) -> str:
    return f"regexp_matches({x}, {q(f'(^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_]){word}($|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])')})"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def hit_sum(x: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(n)}) AS INT)" for n in needles) + ")"


def inner_text(x: str) -> str:
    return decode(replace_all(x, hx.ANY_TAG, "''"))


def first_text(x: str, tag: str) -> str:
    return strip(inner_text(f"regexp_extract({x}, {q(hx.element(tag))}, 1)"))


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, {q(sep)})"


# Page records: columns page_id, url, title, description, main_content, language, n_h, links.
PAGES_CTE = f"""
clean AS (SELECT page_id, url, html, {replace_all('html', hx.NOISE_PATTERN, "''")} AS c FROM pages),
parts AS (SELECT page_id, url, html, c, {first_text('c', 'h1')} AS h1, {first_text('c', 'title')} AS t, {first_text('c', 'p')} AS p,
  {squash(inner_text(f"regexp_extract(c, {q(hx.region('main'))}, 1)"))} AS m1,
  {squash(inner_text(f"regexp_extract(c, {q(hx.region('article'))}, 1)"))} AS m2,
  {squash(inner_text(f"regexp_extract(c, {q(hx.region('body'))}, 1)"))} AS m3,
  regexp_extract(c, {q('''(?is)<html[^>]*lang=["']([^"']+)["']''')}, 1) AS lang0 FROM clean),
rec AS (SELECT page_id, url, html, c,
  CASE WHEN h1 <> '' THEN h1 ELSE t END AS title,
  CASE WHEN length(p) > 300 THEN substr(p, 1, 300) || '...' WHEN length(p) > 50 THEN p ELSE '' END AS description,
  CASE WHEN {wc('m1')} > 20 THEN m1 WHEN {wc('m2')} > 20 THEN m2 ELSE m3 END AS main_content,
  CASE WHEN lang0 <> '' THEN lower(substr(lang0, 1, 2)) ELSE 'en' END AS language,
  list_filter(list_transform(regexp_extract_all(c, {q(hx.element('h1'))}, 1), lambda h: {strip(inner_text('h'))}), lambda h: h <> '') AS h1s,
  list_filter(regexp_extract_all(html, {q(hx.LINK_PATTERN)}, 1), lambda h: h <> '' AND NOT regexp_matches(h, {q(hx.SKIPPED_LINK)})) AS hrefs
  FROM parts)"""


def score_columns(t: str, title: str, description: str, n_head: str, hierarchy_ok: str) -> str:
    """Metric and score columns over text t; elements the tables never hold count as absent."""
    low = f"lower({t})"
    w, s, p = wc(t), n_sentences(t), n_paragraphs(t)
    per_s = f"({wc(replace_all(t, tx.SENTENCE_END, q(' ')))} / ({s})::DOUBLE)"
    per_p = f"({w} / ({p})::DOUBLE)"
    long_share = f"({n_matches(t, tx.WORD_CHAR + '{10,}')} / ({w})::DOUBLE)"
    boiler = " + ".join(match_chars("low", pat) for _, pat in qx.BOILERPLATE)
    noise = " + ".join(match_chars("low", pat, g) for _, pat, g in qx.NOISE)
    terms = " + ".join(f"CAST({whole_word('low', x)} AS INT)" for x in qx.TECHNICAL)
    return f"""
s1 AS (SELECT *, {low} AS low, {w} AS word_count, {s} AS sentence_count, {p} AS paragraph_count,
   {per_s} AS per_s, {per_p} AS per_p, {long_share} AS long_share FROM src),
s2 AS (SELECT *,
   CASE WHEN sentence_count > 0 THEN word_count / sentence_count::DOUBLE ELSE 0.0 END AS avg_sentence_length,
   CASE WHEN paragraph_count > 0 THEN sentence_count / paragraph_count::DOUBLE ELSE 0.0 END AS avg_paragraph_length,
   CASE WHEN low = '' THEN 0.0 ELSE ({boiler}) / length(low)::DOUBLE END AS boilerplate_ratio,
   CASE WHEN low = '' THEN 0.0 ELSE 1 - len(list_distinct(list_transform(list_filter({sentences('low')}, lambda s: {not_blank('s')}), lambda s: {strip('s')}))) / len({sentences('low')})::DOUBLE END AS duplicate_content_ratio,
   ({terms}) AS terms, ({noise}) AS noise FROM s1),
s3 AS (SELECT *,
   CASE WHEN word_count < 50 THEN 10.0 WHEN word_count < 150 THEN 30.0 WHEN word_count < 300 THEN 60.0 WHEN word_count <= 2000 THEN 100.0 WHEN word_count <= 5000 THEN 80.0 ELSE 60.0 END::DOUBLE AS content_length_score,
   CASE WHEN {t} = '' THEN 0.0 ELSE least(
     CASE WHEN sentence_count = 0 THEN 0 WHEN per_s BETWEEN 10 AND 25 THEN 30 WHEN per_s BETWEEN 8 AND 30 THEN 20 ELSE 10 END
     + CASE WHEN paragraph_count = 0 THEN 0 WHEN per_p BETWEEN 30 AND 200 THEN 25 WHEN per_p BETWEEN 20 AND 300 THEN 15 ELSE 5 END
     + CASE WHEN word_count = 0 THEN 0 WHEN long_share < 0.1 THEN 25 WHEN long_share < 0.2 THEN 15 ELSE 5 END
     + CASE WHEN {n_head} > 0 THEN 20 ELSE 0 END, 100) END::DOUBLE AS readability_score,
   (CASE WHEN {title} <> '' THEN 20 ELSE 0 END + CASE WHEN {wc(title)} BETWEEN 10 AND 15 THEN 10 ELSE 0 END
     + CASE WHEN {description} <> '' THEN 15 ELSE 0 END + CASE WHEN {n_head} > 0 THEN 20 ELSE 0 END
     + CASE WHEN {hierarchy_ok} THEN 15 ELSE 0 END)::DOUBLE AS structure_score,
   CASE WHEN low = '' THEN 0.0 ELSE greatest(100 - boilerplate_ratio * 50 - duplicate_content_ratio * 30, 0) END::DOUBLE AS uniqueness_score,
   (CASE WHEN {title} <> '' THEN 25 ELSE 0 END + CASE WHEN word_count >= 100 THEN 40 WHEN {t} <> '' THEN 20 ELSE 0 END
     + CASE WHEN {description} <> '' THEN 10 ELSE 0 END + CASE WHEN {n_head} > 0 THEN 10 ELSE 0 END)::DOUBLE AS completeness_score,
   CASE WHEN low = '' THEN 0.0 ELSE greatest(least(50.0 + CASE WHEN terms >= 5 THEN 30 WHEN terms >= 3 THEN 20 WHEN terms >= 1 THEN 10 ELSE 0 END - noise / length(low)::DOUBLE * 30, 100.0), 0.0) END::DOUBLE AS technical_score
   FROM s2),
s4 AS (SELECT *, round(content_length_score * 0.15::DOUBLE + readability_score * 0.25::DOUBLE + structure_score * 0.20::DOUBLE + uniqueness_score * 0.15::DOUBLE + completeness_score * 0.15::DOUBLE + technical_score * 0.10::DOUBLE, 2) AS overall_score FROM s3),
scored AS (SELECT *, CASE WHEN overall_score >= 85 THEN 'excellent' WHEN overall_score >= 70 THEN 'good' WHEN overall_score >= 55 THEN 'fair' WHEN overall_score >= 40 THEN 'poor' ELSE 'very_poor' END AS quality_level,
   list_filter([CASE WHEN {title} = '' THEN 'Missing title' END, CASE WHEN word_count < 50 THEN 'Insufficient content length' END,
     CASE WHEN boilerplate_ratio > 0.3 THEN 'High boilerplate content ratio' END, CASE WHEN duplicate_content_ratio > 0.5 THEN 'High duplicate content ratio' END], lambda x: x IS NOT NULL) AS issues,
   list_filter([CASE WHEN {description} = '' THEN 'Missing description' END, CASE WHEN {n_head} = 0 THEN 'No headings found - poor structure' END,
     CASE WHEN avg_sentence_length > 30 THEN 'Sentences too long - poor readability' END, CASE WHEN avg_sentence_length < 8 THEN 'Sentences too short - choppy reading' END,
     'Missing author information', 'Missing publication date'], lambda x: x IS NOT NULL) AS warnings FROM s4)"""


PAGE_SCORES = "WITH " + PAGES_CTE + ", src AS (SELECT * FROM rec)," + score_columns(
    "main_content", "title", "description", "len(h1s)", "len(h1s) > 0")
DOC_SCORES = "WITH src AS (SELECT * FROM documents)," + score_columns("text", "''", "''", "0", "FALSE")
HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
