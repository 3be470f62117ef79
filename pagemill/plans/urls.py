"""URL and frontier queries over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import html as hx
from pagemill.functions import urls as ux
from pagemill.operators import frontier as fr
from pagemill.plans import sqlparts as sp
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q

SCHEME = "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"
HOST = sp.HOST
PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
PARTS = f"list_filter(string_split({PATH}, '/'), lambda x: x <> '')"
NORMAL = f"""{SCHEME} || '://' || CASE {SCHEME} WHEN 'http' THEN regexp_replace({HOST}, ':80$', '') WHEN 'https' THEN regexp_replace({HOST}, ':443$', '') ELSE {HOST} END
 || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {QUERY} <> '' THEN '?' || array_to_string(list_sort(string_split({QUERY}, '&')), '&') ELSE '' END"""


def urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


# Rules of the sample site: the generic pattern first, so it shadows the later ones.
RULES = [
    {"pattern": r"^https://www\.", "type": "documentation", "priority": 2, "include": True, "max_depth": 5, "follow_links": True},
    {"pattern": r"^https://www\.[^/]*/en/", "type": "api_reference", "priority": 1, "include": True, "max_depth": 5, "follow_links": True},
    {"pattern": r"^https?://blog\.", "type": "blog", "priority": 4, "include": True, "max_depth": 1, "follow_links": False},
    {"pattern": r"spam-farm|cheap-pills", "type": "external", "priority": 5, "include": False, "max_depth": 0, "follow_links": False},
    {"pattern": r"\?utm_source=", "type": "changelog", "priority": 3, "include": True, "max_depth": 2, "follow_links": True},
]


def rule_sql(field: str, x: str = "url") -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v).upper()
    whens = " ".join(f"WHEN regexp_matches({x}, {q(r['pattern'])}) THEN {lit(r[field])}" for r in RULES)
    return f"CASE {whens} ELSE {lit(fr.DEFAULT_RULE[field])} END"


@query("U1_normalize_url", f"SELECT page_id, {NORMAL} AS normalized FROM pages")
def normalize_url(spark, sf):
    return urls(spark, sf).select("page_id", ux.normalize_url(F.col("url")).alias("normalized"))


@query("U2_strip_slash_url", f"""SELECT page_id, {SCHEME} || '://' || {HOST} || regexp_replace(CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END, '(.)/$', '\\1') || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END AS stripped, regexp_replace(url, '#.*$', '') AS no_fragment FROM pages""")
def strip_slash(spark, sf):
    return urls(spark, sf).select("page_id", ux.strip_slash_url(F.col("url")).alias("stripped"), ux.drop_fragment(F.col("url")).alias("no_fragment"))


@query("U3_domain", f"SELECT page_id, {HOST} AS domain, {HOST} = 'spam-farm.example.org' AS same_domain FROM pages")
def domain(spark, sf):
    return urls(spark, sf).select("page_id", ux.host(F.col("url")).alias("domain"), ux.same_domain(F.col("url"), F.lit("https://spam-farm.example.org/x")).alias("same_domain"))


@query("U4_resolve_relative_url", f"""WITH {sp.PAGES_CTE}, l AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM rec)
SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN {SCHEME} || '://' || {HOST} || href ELSE href END AS link FROM l""")
def resolve_relative(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", hx.raw_links(F.col("html")).alias("l"))
    links = scale.rows_of(pages, ["page_id", "url"], "l", "link", "pos")
    return links.select("page_id", "pos", ux.resolve_url(F.col("url"), F.col("link.href")).alias("link"))


@query("U5_classify_url", f"SELECT page_id, {rule_sql('type')} AS type, {rule_sql('priority')}::BIGINT AS priority, {rule_sql('pattern')} AS pattern FROM pages")
def classify_url(spark, sf):
    return fr.classify(urls(spark, sf), RULES).select("page_id", "rule.type", F.col("rule.priority").cast("long").alias("priority"), "rule.pattern")


_LANG_AS_PATH = "'https://site.example.com' || replace(replace(regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1), '/en/', '/integrations/'), '/fr/', '/tutorials/')"


@query("U6_classify_path", f"""WITH x AS (SELECT page_id, lower(regexp_extract({_LANG_AS_PATH}, '^[^:]+://[^/]+(/[^?#]*)', 1)) AS p FROM pages)
SELECT page_id, CASE {' '.join(f"WHEN regexp_matches(p, {q(pat)}) THEN {q(name)}" for name, pat in ux.PATH_RULES)} {' '.join(f"WHEN contains(p, {q(piece)}) THEN {q(name)}" for name, piece in ux.PATH_FALLBACKS)} ELSE 'general' END AS label FROM x""")
def classify_path(spark, sf):
    """Language folders stand for sections, so that several labels occur."""
    p = F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)
    moved = F.concat(F.lit("https://site.example.com"), F.replace(F.replace(p, F.lit("/en/"), F.lit("/integrations/")), F.lit("/fr/"), F.lit("/tutorials/")))
    return urls(spark, sf).select("page_id", ux.classify_path(moved).alias("label"))


_SITE = "CASE WHEN " + sp.any_of("lower(url)", ("example.org",)) + " THEN 'own' " + " ".join(f"WHEN {sp.any_of('lower(url)', ps)} THEN {q(n)}" for n, ps in ux.SITE_TYPES) + " ELSE 'generic' END"


@query("U7_site_type", f"SELECT page_id, {_SITE} AS site_type FROM pages")
def site_type(spark, sf):
    return urls(spark, sf).select("page_id", ux.site_type(F.col("url"), ("example.org",)).alias("site_type"))


def _rule(pattern, type_, priority, scrape, follow, depth):
    return {"pattern": pattern, "type": type_, "priority": priority, "should_scrape": scrape, "follow_links": follow, "max_depth": depth}


# Rule sets per site type; the set of the own site is a parameter.
RULE_SETS = {
    "own": [_rule(r"/en/", "documentation", "high", True, True, 5), _rule(r"/fr/", "integration", "high", True, True, 3),
            _rule(r"/de/", "forum_post", "low", False, False, 1)],
    "documentation": [_rule(r".*/docs?/.*", "documentation", "high", True, True, 4), _rule(r".*/documentation/.*", "documentation", "high", True, True, 4),
                      _rule(r".*/guide/.*", "tutorial", "high", True, True, 3)],
    "blog": [_rule(r".*/blog/.*", "blog_post", "medium", True, False, 1), _rule(r".*/post/.*", "blog_post", "medium", True, False, 1),
             _rule(r".*/article/.*", "blog_post", "medium", True, False, 1)],
    "api_docs": [_rule(r".*/api/.*", "api_reference", "high", True, True, 3), _rule(r".*/reference/.*", "api_reference", "high", True, True, 3)],
    "generic": [_rule(r".*", "general", "low", True, True, 2)],
}
_SITE_FIELDS = ["pattern", "type", "priority", "should_scrape", "follow_links", "max_depth"]
_SITE_DEFAULT = _rule("", "unknown", "medium", True, True, 5)


def _site_rule(field: str) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v).upper()
    whens = " ".join(f"WHEN s = {q(n)} AND regexp_matches(url, {q(r['pattern'])}) THEN {lit(r[field])}" for n, rs in RULE_SETS.items() for r in rs)
    return f"CASE {whens} ELSE {lit(_SITE_DEFAULT[field])} END AS {field}"


@query("U8_site_rule_sets", f"WITH x AS (SELECT page_id, url, {_SITE} AS s FROM pages) SELECT page_id, s AS site_type, " + ", ".join(_site_rule(f) for f in _SITE_FIELDS) + " FROM x")
def site_rule_sets(spark, sf):
    out = fr.classify_by_site(urls(spark, sf), RULE_SETS, ("example.org",), _SITE_FIELDS, _SITE_DEFAULT)
    return out.select("page_id", "site_type", "rule.*")


@query("U9_path_allowed", f"SELECT page_id, url FROM pages WHERE NOT {sp.any_of(f'lower({PATH})', ux.EXCLUDED_PATHS + ('/changelog/', '/blog/', '/community/', '/en/1'))}")
def path_allowed(spark, sf):
    return urls(spark, sf).filter(ux.path_allowed(F.col("url"), excluded=ux.EXCLUDED_PATHS + ("/en/1",)))


@query("U10_allowed_by_lists", """
WITH seen AS (SELECT url FROM pages WHERE contains(url, '#top')), failed AS (SELECT url FROM pages WHERE ends_with(url, '.html'))
SELECT page_id, url FROM pages WHERE (contains(url, '/en/') OR contains(url, '/fr/')) AND NOT (contains(url, 'spam-farm') OR contains(url, 'utm_source'))
AND url NOT IN (SELECT url FROM seen) AND url NOT IN (SELECT url FROM failed)""")
def allowed_by_lists(spark, sf):
    u = urls(spark, sf)
    return fr.allowed_by_lists(u, u.filter(F.col("url").contains("#top")), u.filter(F.col("url").endswith(".html")),
                               ["/en/", "/fr/"], ["spam-farm", "utm_source"]).select("page_id", "url")


@query("U11_domain_and_type_allowed", f"SELECT page_id, url FROM pages WHERE ends_with({HOST}, 'example.org') AND NOT regexp_matches(url, {q(ux.SKIPPED_FILES)}) AND NOT regexp_matches(url, {q(ux.SKIPPED_PATHS)})")
def domain_and_type(spark, sf):
    return urls(spark, sf).filter(ux.domain_and_type_allowed(F.col("url"), ux.host(F.col("url")).endswith("example.org")))


@query("U12_should_scrape", f"""WITH done AS (SELECT url FROM pages WHERE contains(url, '?page=')), x AS (SELECT page_id, url, {HOST} AS d FROM pages)
SELECT page_id, url, CASE WHEN url IN (SELECT url FROM done) OR d = 'spam-farm.example.org' OR NOT {rule_sql('include')} OR {rule_sql('priority')} = 5 THEN FALSE ELSE TRUE END AS allowed,
CASE WHEN url IN (SELECT url FROM done) THEN 'Already processed' WHEN d = 'spam-farm.example.org' THEN 'Domain blocked: ' || d
WHEN NOT {rule_sql('include')} OR {rule_sql('priority')} = 5 THEN 'Pattern excludes URL: ' || {rule_sql('pattern')} ELSE 'URL allowed for scraping' END AS reason FROM x""")
def should_scrape(spark, sf):
    u = urls(spark, sf)
    blocked = u.select(ux.host(F.col("url")).alias("domain")).filter("domain = 'spam-farm.example.org'").distinct()
    return fr.should_fetch(u, u.filter(F.col("url").contains("?page=")), blocked, RULES)


_FRONTIER = f"WITH f AS (SELECT {NORMAL} AS n, min(page_id) AS seq FROM pages GROUP BY 1), g AS (SELECT n AS url, seq, {rule_sql('type', 'n')} AS type, {rule_sql('priority', 'n')}::BIGINT AS priority, {rule_sql('include', 'n')} AS include FROM f)"


def _frontier(spark, sf):
    f = fr.add_urls(urls(spark, sf), RULES, "page_id")
    return f.withColumn("priority", F.col("priority").cast("long"))


@query("U13_frontier_add", _FRONTIER + " SELECT * FROM g")
def frontier_add(spark, sf):
    return _frontier(spark, sf)


@query("U13_frontier_next", _FRONTIER + " SELECT url, priority, seq FROM g WHERE include AND priority <> 5 ORDER BY priority, seq LIMIT 10")
def frontier_next(spark, sf):
    return fr.next_urls(_frontier(spark, sf), 10).select("url", "priority", "seq")


_OUTCOMES = """SELECT 'page-' || user_id AS url, count(*) FILTER (event_type <> 'error') AS scrape_count, count(*) FILTER (event_type = 'error') AS error_count,
 arg_max('status ' || event_id, ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY 1"""


def _outcomes(spark, sf):
    e = table(spark, sf, "events").withColumn("url", F.concat(F.lit("page-"), F.col("user_id").cast("string")))
    return fr.outcomes(e, "url", F.col("event_type") != "error", F.concat(F.lit("status "), F.col("event_id").cast("string")), F.struct("ts", "event_id"))


@query("U14_mark_outcomes", _OUTCOMES)
def mark_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query("U15_frontier_stats", _FRONTIER + f""", o AS ({_OUTCOMES})
SELECT 'type' AS metric, type AS name, count(*)::DOUBLE AS value FROM g GROUP BY ALL UNION ALL SELECT 'priority', priority::VARCHAR, count(*)::DOUBLE FROM g GROUP BY ALL
UNION ALL SELECT 'total', 'total_urls', count(*)::DOUBLE FROM o UNION ALL SELECT 'total', 'error_urls', count(*) FILTER (error_count > 0)::DOUBLE FROM o
UNION ALL SELECT 'total', 'success_rate', round(sum(scrape_count) / greatest(1, sum(scrape_count) + sum(error_count))::DOUBLE, 6) FROM o""")
def frontier_stats(spark, sf):
    return fr.frontier_stats(_frontier(spark, sf), _outcomes(spark, sf))


@query("U16_link_graph_levels", """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
walk AS (SELECT 'p1' AS node, 0 AS depth UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON e.src = walk.node WHERE walk.depth < 3)
SELECT node, min(depth)::BIGINT AS depth FROM walk GROUP BY node""")
def link_graph(spark, sf):
    """Part and supplier keys of order lines as a two-sided link graph."""
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    edges = l.select(F.col("p").alias("src"), F.col("s").alias("dst")).unionByName(l.select(F.col("s").alias("src"), F.col("p").alias("dst")))
    seeds = l.filter(F.col("p") == "p1").select(F.col("p").alias("node"))
    return fr.reachable(edges, seeds, 3)


_CAT_URL = "'https://site.example.com/' || CASE lang WHEN 'en' THEN 'integrations/builtin/' WHEN 'fr' THEN 'release-notes/0-x/' WHEN 'de' THEN 'hosting/installation/' ELSE 'flow-logic/' END || lang || '-' || seg"
_CAT_SRC = f"SELECT page_id, url AS url0, regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS seg FROM pages"


def section_urls(spark, sf):
    """Page URLs moved below documentation sections by language."""
    lang, seg = F.regexp_extract("url", r"^[^:]+://[^/]+/([a-z]+)/", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    section = F.when(lang == "en", "integrations/builtin/").when(lang == "fr", "release-notes/0-x/").when(lang == "de", "hosting/installation/").otherwise("flow-logic/")
    return urls(spark, sf).select("page_id", F.col("url").alias("url0"), F.concat(F.lit("https://site.example.com/"), section, lang, F.lit("-"), seg).alias("url"))


SECTION_CTE = f"sec0 AS ({_CAT_SRC}), sec AS (SELECT page_id, url0, {_CAT_URL} AS url FROM sec0)"
CATEGORY_SQL = f"""CASE WHEN len({PARTS}) = 0 THEN 'root' WHEN {PARTS}[1] = 'integrations' AND {PARTS}[2] IN ('builtin', 'creating-nodes') THEN 'integrations_' || {PARTS}[2] WHEN {PARTS}[1] = 'integrations' THEN 'integrations'
WHEN {PARTS}[1] = 'hosting' AND {PARTS}[2] IN ('installation', 'configuration', 'architecture') THEN 'hosting_' || {PARTS}[2] WHEN {PARTS}[1] = 'hosting' THEN 'hosting'
WHEN {PARTS}[1] = 'code' AND {PARTS}[2] IN ('cookbook', 'builtin') THEN 'code_' || {PARTS}[2] WHEN {PARTS}[1] = 'code' THEN 'code'
WHEN {PARTS}[1] = 'release-notes' AND {PARTS}[2] = '0-x' THEN 'release_notes_legacy' ELSE replace({PARTS}[1], '-', '_') END"""
SUBCATEGORY_SQL = f"CASE WHEN len({PARTS}) >= 3 THEN replace({PARTS}[3], '-', '_') END"


@query("U17_category_from_url", f"WITH {SECTION_CTE} SELECT page_id, {CATEGORY_SQL} AS category FROM sec")
def category_from_url(spark, sf):
    return section_urls(spark, sf).select("page_id", ux.category(F.col("url")).alias("category"))


@query("U18_subcategory_from_url", f"WITH {SECTION_CTE} SELECT page_id, {SUBCATEGORY_SQL} AS subcategory FROM sec")
def subcategory_from_url(spark, sf):
    return section_urls(spark, sf).select("page_id", ux.subcategory(F.col("url")).alias("subcategory"))


@query("U19_category_first_segment", f"WITH {SECTION_CTE}, x AS (SELECT page_id, split_part(replace(url, 'https://site.example.com/', ''), '/', 1) AS c FROM sec) SELECT page_id, CASE WHEN c = '' THEN 'root' ELSE c END AS category FROM x")
def category_first_segment(spark, sf):
    return section_urls(spark, sf).select("page_id", ux.first_segment(F.col("url"), "https://site.example.com/").alias("category"))


@query("U20_doc_type_from_url", f"WITH {SECTION_CTE} SELECT page_id, CASE {' '.join(f'WHEN contains(url, {q(p)}) THEN {q(k)}' for p, k, _ in ux.DOC_TYPES)} ELSE 'node_docs' END AS doc_type, CASE {' '.join(f'WHEN contains(url, {q(p)}) THEN {q(c)}' for p, _, c in ux.DOC_TYPES)} ELSE 'general' END AS category FROM sec")
def doc_type_from_url(spark, sf):
    kind, cat = ux.doc_type(F.col("url"))
    return section_urls(spark, sf).select("page_id", kind.alias("doc_type"), cat.alias("category"))


@query("U21_document_id", "SELECT page_id, md5(url || '_' || 'node_docs') AS document_id FROM pages")
def document_id(spark, sf):
    return urls(spark, sf).select("page_id", ux.document_id(F.col("url"), F.lit("node_docs")).alias("document_id"))


OUTPUT_NAME_SQL = f"""regexp_replace(CASE WHEN regexp_replace(replace({PATH}, '/', '_'), '^_+|_+$', '', 'g') = '' THEN 'index' ELSE regexp_replace(replace({PATH}, '/', '_'), '^_+|_+$', '', 'g') END, '[<>:"/\\\\|?*]', '_', 'g') || '.json'"""


@query("U22_output_paths", f"""SELECT page_id, {OUTPUT_NAME_SQL} AS file_name,
CASE WHEN regexp_replace({PATH}, '^/', '') = '' THEN 'index.md' WHEN ends_with({PATH}, '/') THEN regexp_replace({PATH}, '^/', '') || 'index.md' ELSE regexp_replace({PATH}, '^/', '') || '.md' END AS file_path FROM pages""")
def output_paths(spark, sf):
    return urls(spark, sf).select("page_id", ux.output_name(F.col("url")).alias("file_name"), ux.output_path(F.col("url")).alias("file_path"))


@query("U23_asset_filename", f"""WITH x AS (SELECT page_id, url, string_split(regexp_replace({PATH}, '/+$', ''), '/')[-1] AS last FROM pages), y AS (SELECT *, regexp_extract(last, '.([.][^.]*)$', 1) AS ext FROM x)
SELECT page_id, CASE WHEN substr(last, 1, length(last) - length(ext)) = '' THEN 'asset' ELSE substr(last, 1, length(last) - length(ext)) END || '_' || substr(md5(url), 1, 8) || CASE WHEN ext = '' THEN '.png' ELSE ext END AS asset FROM y""")
def asset_filename(spark, sf):
    return urls(spark, sf).select("page_id", ux.asset_filename(F.col("url"), "image").alias("asset"))


@query("U24_disambiguate_names", f"""WITH x AS (SELECT page_id, {OUTPUT_NAME_SQL} AS name, md5(html) AS h FROM pages), k AS (SELECT name, h, min(page_id) AS page_id, count(*) - 1 AS skipped FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM k)
SELECT page_id, name, skipped, CASE WHEN n > 1 THEN regexp_replace(name, '[.][^.]*$', '') || '_' || (n - 1) || regexp_extract(name, '([.][^.]*)$', 1) ELSE name END AS final_name FROM r""")
def disambiguate(spark, sf):
    files = table(spark, sf, "pages").select("page_id", ux.output_name(F.col("url")).alias("name"), F.md5(F.encode("html", "UTF-8")).alias("h"))
    return fr.disambiguate_names(files, "name", "h", "page_id").select("page_id", "name", "skipped", "final_name")


@query("J4_rule_theta_join", "WITH r(rule_order, pattern, type) AS (VALUES " + ", ".join(f"({i + 1}, {q(r['pattern'])}, {q(r['type'])})" for i, r in enumerate(RULES)) + ") SELECT page_id, url, rule_order, type FROM pages JOIN r ON regexp_matches(url, pattern)")
def rule_theta_join(spark, sf):
    return fr.matching_rules(urls(spark, sf), RULES)
