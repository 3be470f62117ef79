"""Workflow queries: one JSON document per order, its lines as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import labels as lb
from pagemill.operators import setjoin as sj
from pagemill.operators import workflows as wf
from pagemill.plans import sqlparts as sp
from pagemill.plans.html import docs
from pagemill.plans.registry import query, table
from pagemill.plans.sqlparts import q
from pagemill.session import kept, materialize

# Type prefix of the nodes that the documents below carry.
B = "base-nodes."


def files(spark, sf):
    """Document texts, one per order whatever its number of lines.

    A document is one JSON row, so its lines meet in one place by nature.
    """
    lines = table(spark, sf, "lineitem")
    no, flag, status = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    kind = (
        F.when((no == 1) & (flag == "A"), "webhook").when((no == 1) & (flag == "N"), "scheduleTrigger").when(no == 1, "manualTrigger")
        .when((no == 2) & (status == "O"), "gmail").when(no == 2, "slack").when(no == 3, "httpRequest").when(no == 4, "googleSheets")
        .when(no == 5, "set").when(no == 6, "telegramTrigger").otherwise("if"))
    node = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.lit(B), kind).alias("type"),
        F.when(status == "F", 1).otherwise(2).alias("version"), F.when(F.col("l_discount") > 0.05, "discounted").otherwise("").alias("notes"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(node)).alias("n"))
    # placed by the join key with a given count: adaptive execution would merge the
    # small shuffle, and few tasks would do the JSON work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = table(spark, sf, "orders").repartition(parts, "o_orderkey").join(grouped, "o_orderkey", "left")
    n, key = F.coalesce(F.col("n"), F.array().cast(grouped.schema["n"].dataType)), F.col("o_orderkey").cast("string")
    step = lambda i: F.concat(F.lit("Node "), (i + 1).cast("string"))
    nodes = F.transform(n, lambda x, i: F.struct(
        step(i).alias("name"), x["type"].alias("type"), x["version"].alias("typeVersion"),
        F.struct(x["l_partkey"].cast("string").alias("part")).alias("parameters"), x["notes"].alias("notes")))
    links = F.map_from_entries(F.transform(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))), lambda x, i: F.struct(
        step(i).alias("k"), F.create_map(F.lit("main"), F.array(F.struct(step(i + 1).alias("node")))).alias("v"))))
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "My workflow").when(p == "5-LOW", "").when(p == "2-HIGH", F.concat(F.lit("Sync order "), key)).otherwise(F.concat(F.lit("Order "), key, F.lit(" notification")))
    text = F.when(p == "3-MEDIUM", "").otherwise(F.concat(F.lit("Order of customer "), F.col("o_custkey").cast("string")))
    body = F.to_json(F.struct(
        key.alias("id"), name.alias("name"), (F.col("o_orderstatus") == "O").alias("active"), text.alias("description"), nodes.alias("nodes"), links.alias("connections"),
        F.create_map(F.lit("timezone"), F.lit("UTC"), F.lit("retries"), F.lit("3")).alias("settings")))
    tags = F.concat(F.lit('{"tags":["'), p, F.lit('",{"name":"'), F.col("o_orderstatus"), F.lit('"},{"id":7},{}],'))
    return o.select("o_orderkey", F.concat(key, F.lit("_order_http_api")).alias("stem"), F.concat(tags, F.substr(body, F.lit(2))).alias("json"))


def parsed(spark, sf):
    return wf.parse(files(spark, sf))


def enriched(spark, sf):
    p = parsed(spark, sf).withColumn("services", wf.integrations(F.col("nodes"), (B,)))
    p = p.withColumns({"node_count": F.size("nodes").cast("long"), "trigger": wf.trigger_type(F.col("nodes"), F.size("services"))})
    return p.withColumn("complexity", wf.complexity_bucket(F.col("node_count")))


_KIND = """CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN 'webhook' WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 'scheduleTrigger' WHEN l_linenumber = 1 THEN 'manualTrigger' WHEN l_linenumber = 2 AND l_linestatus = 'O' THEN 'gmail' WHEN l_linenumber = 2 THEN 'slack'
WHEN l_linenumber = 3 THEN 'httpRequest' WHEN l_linenumber = 4 THEN 'googleSheets' WHEN l_linenumber = 5 THEN 'set' WHEN l_linenumber = 6 THEN 'telegramTrigger' ELSE 'if' END"""
_SRC = f"""WITH n AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, {_KIND} AS kind, l_partkey AS part, CASE WHEN l_discount > 0.05 THEN 'discounted' ELSE '' END AS notes, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS version FROM lineitem),
sv AS (SELECT *, CASE kind WHEN 'webhook' THEN 'Webhook' WHEN 'gmail' THEN 'Gmail' WHEN 'slack' THEN 'Slack' WHEN 'httpRequest' THEN 'HTTP Request' WHEN 'googleSheets' THEN 'Google Sheets' WHEN 'telegramTrigger' THEN 'Telegram' END AS service FROM n),
a AS (SELECT k, count(*) AS nodes, list_sort(list(DISTINCT service) FILTER (service IS NOT NULL)) AS services, list_sort(list(DISTINCT '{B}' || kind)) AS types,
 arg_max(CASE kind WHEN 'webhook' THEN 'Webhook' ELSE 'Scheduled' END, pos) FILTER (kind IN ('webhook', 'scheduleTrigger')) AS strong, bool_or(kind = 'telegramTrigger') AS weak,
 list_sort(list(DISTINCT '{B}' || kind) FILTER (version = 1 OR contains(lower(kind), 'trigger'))) AS triggers, list_sort(list(DISTINCT nullif(replace(kind, 'Trigger', ''), ''))) AS stripped FROM sv GROUP BY k),
w AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, coalesce(nodes, 0) AS node_count, greatest(coalesce(nodes, 0) - 1, 0) AS connection_count, coalesce(services, []) AS services, coalesce(types, []) AS types, coalesce(triggers, []) AS triggers, coalesce(stripped, []) AS stripped,
 CASE WHEN coalesce(nodes, 0) > 10 AND len(services) > 3 THEN 'Complex' WHEN strong IS NOT NULL THEN strong WHEN weak THEN 'Webhook' ELSE 'Manual' END AS trigger,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'My workflow' WHEN '5-LOW' THEN '' WHEN '2-HIGH' THEN 'Sync order ' || o_orderkey ELSE 'Order ' || o_orderkey || ' notification' END AS json_name,
 CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'Order HTTP API' WHEN o_orderpriority = '2-HIGH' THEN 'Sync order ' || o_orderkey ELSE 'Order ' || o_orderkey || ' notification' END AS name,
 CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE 'Order of customer ' || o_custkey END AS description FROM orders LEFT JOIN a ON k = o_orderkey)"""


@query("W1_parse_workflow", _SRC + " SELECT o_orderkey, name, o_orderstatus = 'O' AS active, node_count, description FROM w")
def parse_workflow(spark, sf):
    return parsed(spark, sf).select("o_orderkey", "name", "active", F.size("nodes").cast("long").alias("node_count"), "description")


@query("W2_format_workflow_name", "SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) >= 0 THEN array_to_string(list_transform(string_split(p_name || ' http ' || p_type, ' '), lambda w: CASE lower(w) WHEN 'http' THEN 'HTTP' WHEN 'api' THEN 'API' ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') END AS name FROM part")
def format_name(spark, sf):
    stem = F.concat_ws("_", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("http"), F.replace("p_type", F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", wf.format_name(stem).alias("name"))


@query("W3_complexity_bucket", _SRC + " SELECT o_orderkey, CASE WHEN node_count <= 5 THEN 'low' WHEN node_count <= 15 THEN 'medium' ELSE 'high' END AS bucket, CASE WHEN node_count <= 3 THEN 'simple' WHEN node_count <= 8 THEN 'medium' ELSE 'complex' END AS label FROM w")
def complexity(spark, sf):
    n = F.size("nodes")
    return parsed(spark, sf).select("o_orderkey", wf.complexity_bucket(n).alias("bucket"), wf.complexity_label(n).alias("label"))


@query("W4_trigger_type", _SRC + " SELECT o_orderkey, trigger FROM w")
def trigger_type(spark, sf):
    return enriched(spark, sf).select("o_orderkey", "trigger")


@query("W5_integrations", _SRC + " SELECT o_orderkey, array_to_string(services, '|') AS services FROM w")
def integrations(spark, sf):
    return enriched(spark, sf).select("o_orderkey", F.array_join("services", "|").alias("services"))


@query("W6_generate_description", _SRC + """ SELECT o_orderkey, CASE trigger WHEN 'Webhook' THEN 'Webhook-triggered automation that' WHEN 'Scheduled' THEN 'Scheduled automation that' WHEN 'Complex' THEN 'Complex multi-step automation that' ELSE 'Manual workflow that' END
|| CASE len(services) WHEN 0 THEN '' WHEN 1 THEN ' integrates with ' || services[1] WHEN 2 THEN ' connects ' || services[1] || ' and ' || services[2] ELSE ' orchestrates ' || services[1] || ', ' || services[2] || ', and ' || services[3] END
|| CASE WHEN contains(lower(name), 'sync') THEN ' to synchronize data' WHEN contains(lower(name), 'notification') THEN ' for notifications and alerts' ELSE ' for data processing' END || '. Uses ' || node_count || ' nodes' || CASE WHEN len(services) > 3 THEN ' and integrates with ' || len(services) || ' services' ELSE '' END || '.' AS summary FROM w""")
def generate_description(spark, sf):
    return enriched(spark, sf).select("o_orderkey", wf.describe(F.col("name"), F.col("trigger"), F.col("services"), F.col("node_count")).alias("summary"))


@query("W7_clean_tags", "SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus || '|7|tag' AS tags FROM orders")
def clean_tags(spark, sf):
    return parsed(spark, sf).select("o_orderkey", F.array_join("tags", "|").alias("tags"))


@query("W8_analyze_workflow", _SRC + """ SELECT o_orderkey, node_count, connection_count, array_to_string(types, '|') AS node_types, array_to_string(stripped, '|') AS integrations, array_to_string(triggers, '|') AS trigger_types, least(1.0, (node_count + connection_count) / 50.0::DOUBLE)::DOUBLE AS complexity_score,
greatest(0.0, round(1.0 - CASE WHEN json_name = '' THEN 0.2 ELSE 0 END - CASE WHEN description = '' THEN 0.3 ELSE 0 END - CASE WHEN node_count = 0 THEN 0.5 ELSE 0 END, 6))::DOUBLE AS completeness_score FROM w""")
def analyze(spark, sf):
    a = wf.analyze(parsed(spark, sf), (B,))
    return a.select("o_orderkey", "node_count", "connection_count", F.array_join("node_types", "|").alias("node_types"), F.array_join("stripped", "|").alias("integrations"),
                    F.array_join("trigger_types", "|").alias("trigger_types"), "complexity_score", "completeness_score")


_CATEGORY = """CASE WHEN contains(lower(array_to_string(triggers, '|')), 'webhook') THEN 'webhook' WHEN contains(lower(array_to_string(triggers, '|')), 'schedule') THEN 'scheduled' WHEN contains(lower(array_to_string(triggers, '|')), 'manual') THEN 'manual'
WHEN list_has_any(stripped, ['slack', 'telegram']) THEN 'communication' WHEN list_contains(stripped, 'gmail') THEN 'email' WHEN list_contains(stripped, 'googleSheets') THEN 'data' ELSE 'automation' END"""


@query("W9_categorize_workflow", _SRC + f" SELECT o_orderkey, {_CATEGORY} AS category FROM w")
def categorize(spark, sf):
    a = wf.analyze(parsed(spark, sf), (B,))
    return a.select("o_orderkey", wf.categorize(F.col("trigger_types"), F.col("stripped")).alias("category"))


@query("W10_keyword_category", "SELECT doc_id, CASE " + " ".join(f"WHEN {sp.any_of('lower(text)', ks)} THEN {q(n.title())}" for n, ks in lb.KEYWORD_CATEGORIES) + " ELSE 'General' END AS category FROM documents")
def keyword_category(spark, sf):
    return docs(spark, sf).select("doc_id", lb.keyword_category(F.col("text")).alias("category"))


@query("W11_workflow_to_text", _SRC + f""", t AS (SELECT k, string_agg('- Node ' || pos || ' ({B}' || kind || ')', e'\\n' ORDER BY pos) AS lines FROM n GROUP BY k)
SELECT o_orderkey, 'Workflow: ' || name || CASE WHEN description <> '' THEN e'\\nDescription: ' || description ELSE '' END || CASE WHEN node_count > 0 THEN e'\\nNodes (' || node_count || e'):\\n' || lines ELSE '' END AS content FROM w LEFT JOIN t ON k = o_orderkey""")
def to_text(spark, sf):
    p = parsed(spark, sf)
    return p.select("o_orderkey", wf.to_text(p).alias("content"))


@query("W12_workflow_summary", _SRC + " SELECT o_orderkey, array_to_string(types, '|') AS integrations, '' AS trigger_types, least(1.0, (node_count + connection_count) / 100.0::DOUBLE)::DOUBLE AS complexity_score FROM w")
def summary(spark, sf):
    s = wf.summary(F.col("nodes"), F.col("connections"))
    return parsed(spark, sf).select("o_orderkey", F.array_join(s["integrations"], "|").alias("integrations"), F.array_join(s["trigger_types"], "|").alias("trigger_types"), s["complexity_score"].alias("complexity_score"))


@query("W13_workflow_chunks", _SRC + f""", c AS (SELECT o_orderkey, 0 AS g, 0 AS pos, 'description' AS chunk_type, description AS content FROM w WHERE description <> ''
UNION ALL SELECT k, 1, pos, 'nodes', 'Node: Node ' || pos || ' | Type: {B}' || kind || ' | part: ' || part || CASE WHEN notes <> '' THEN ' | Notes: ' || notes ELSE '' END FROM n JOIN orders ON o_orderkey = k
UNION ALL SELECT k, 2, 0, 'connections', 'Workflow Connections: | ' || string_agg('Node ' || (pos - 1) || ' -> Node ' || pos, ' | ' ORDER BY pos) FROM n JOIN orders ON o_orderkey = k WHERE pos > 1 GROUP BY k
UNION ALL SELECT o_orderkey, 3, 0, 'settings', 'Workflow Settings: | timezone: UTC | retries: 3' FROM w)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY g, pos) - 1 AS chunk_index, chunk_type, content FROM c""")
def chunks(spark, sf):
    return wf.chunks(parsed(spark, sf), "o_orderkey").drop("content_hash")


_VALID = _SRC + """, v AS (SELECT o_orderkey, o_orderpriority, list_filter([CASE WHEN node_count = 0 THEN 'Missing required field: nodes' END, CASE WHEN node_count < 2 THEN 'Missing required field: connections' END], lambda x: x IS NOT NULL) AS errors, CASE WHEN json_name IN ('', 'My workflow') THEN 'Default or empty workflow name' ELSE '' END AS warnings FROM w)"""


@query("W14_validate_workflow", _VALID + " SELECT o_orderkey, array_to_string(errors, '|') AS errors, warnings, len(errors) = 0 AS valid FROM v")
def validate(spark, sf):
    return wf.validate(files(spark, sf)).select("o_orderkey", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "valid")


@query("W15_repair_json", "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS was_repaired, TRUE AS readable FROM orders")
def repair(spark, sf):
    """Documents of urgent orders get a trailing comma and lose it again."""
    f = files(spark, sf).withColumn("urgent", F.get_json_object("json", "$.tags[0]") == "1-URGENT")
    broken = f.withColumn("json", F.when(F.col("urgent"), F.regexp_replace("json", r"\}$", ",}")).otherwise(F.col("json")))
    return wf.repair(broken).select("o_orderkey", "was_repaired", F.try_parse_json("repaired").isNotNull().alias("readable"))


@query("W16_duplicate_files", "WITH g AS (SELECT md5(text) AS h, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, h, copies, doc_id = kept AS keep FROM documents JOIN g ON md5(text) = h")
def duplicate_files(spark, sf):
    return wf.duplicate_files(docs(spark, sf).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h")), "doc_id", "h")


@query("W17_error_breakdown", _VALID + " SELECT 'error' AS kind, unnest(errors) AS name, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'category', o_orderpriority, count(*) FROM v WHERE len(errors) > 0 GROUP BY 2")
def error_breakdown(spark, sf):
    f = files(spark, sf).withColumn("category", F.get_json_object("json", "$.tags[0]"))
    return wf.error_breakdown(wf.validate(f), "category")


@query("W18_flow_diagram", _SRC + f""", s AS (SELECT k, string_agg('    Node_' || pos || CASE WHEN contains(lower(kind), 'trigger') THEN '([' WHEN contains(kind, 'webhook') THEN '{{{{' WHEN contains(kind, 'if') THEN '{{' ELSE '[' END || 'Node ' || pos || e'\\n(' || kind || ')' ||
CASE WHEN contains(lower(kind), 'trigger') THEN '])' WHEN contains(kind, 'webhook') THEN '}}}}' WHEN contains(kind, 'if') THEN '}}' ELSE ']' END, e'\\n' ORDER BY pos) AS shapes, string_agg('    Node_' || (pos - 1) || ' --> Node_' || pos, e'\\n' ORDER BY pos) FILTER (pos > 1) AS arrows FROM n GROUP BY k)
SELECT o_orderkey, md5('flowchart TD' || coalesce(e'\\n' || shapes, '') || coalesce(e'\\n' || arrows, '')) AS diagram FROM w LEFT JOIN s ON k = o_orderkey""")
def flow_diagram(spark, sf):
    p = parsed(spark, sf)
    return p.select("o_orderkey", F.md5(wf.flow_text(p)).alias("diagram"))


@query("W19_graph_edges", _SRC + " SELECT k AS o_orderkey, 'Node ' || (pos - 1) AS source, 'main' AS output, 'Node ' || pos AS target FROM n JOIN orders ON o_orderkey = k WHERE pos > 1")
def graph_edges(spark, sf):
    return wf.edges(parsed(spark, sf), "o_orderkey")


@query("W20_service_category", _SRC + " SELECT o_orderkey, array_to_string(services, '|') AS services FROM w WHERE list_has_any(services, ['Telegram', 'Slack']) ORDER BY o_orderkey DESC LIMIT 50 OFFSET 10")
def service_category(spark, sf):
    e = wf.of_category(enriched(spark, sf).select("o_orderkey", "services"), "messaging", "services")
    return e.orderBy(F.col("o_orderkey").desc()).offset(10).limit(50).select("o_orderkey", F.array_join("services", "|").alias("services"))


@query("W20_service_category_total", _SRC + " SELECT count(*) AS total FROM w WHERE list_has_any(services, ['Telegram', 'Slack'])")
def service_category_total(spark, sf):
    return wf.of_category(enriched(spark, sf).select("o_orderkey", "services"), "messaging", "services").agg(F.count("*").alias("total"))


@query("W21_similar_workflows", _SRC + """, t AS (SELECT services AS s FROM w WHERE o_orderkey = 7) SELECT o_orderkey, round(CASE WHEN len(list_distinct(list_concat(services, s))) > 0 THEN len(list_intersect(services, s)) / len(list_distinct(list_concat(services, s)))::DOUBLE ELSE 0 END, 6) AS similarity FROM w, t WHERE o_orderkey <> 7 ORDER BY similarity DESC, o_orderkey LIMIT 5""")
def similar_workflows(spark, sf):
    return wf.similar(enriched(spark, sf).select("o_orderkey", "services"), "o_orderkey", "services", 7)


# Different service sets, each named by its smallest workflow, and the similar pairs among them.
_SETS = _SRC + """, u AS (SELECT o_orderkey, list_sort(list_distinct(services)) AS s FROM w), c AS (SELECT s, min(o_orderkey) AS rep, count(*) AS members FROM u GROUP BY s),
p AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS j, a.members AS am, b.members AS bm FROM c a JOIN c b ON a.rep < b.rep AND len(a.s) > 0 AND len(b.s) > 0)"""


def _classes(spark, sf):
    return sj.set_classes(enriched(spark, sf).select("o_orderkey", "services"), "o_orderkey", "services")


@query("W21_similar_sets", _SETS + " SELECT a, b, round(j, 6) AS similarity FROM p WHERE j >= 0.5")
def similar_sets(spark, sf):
    classes, _ = _classes(spark, sf)
    return sj.similar_sets(classes, 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("W21_similar_counts", _SETS + """, q AS (SELECT a AS rep, bm AS n FROM p WHERE j >= 0.5 UNION ALL SELECT b, am FROM p WHERE j >= 0.5), t AS (SELECT rep, sum(n) AS n FROM q GROUP BY rep)
SELECT u.o_orderkey, c.rep, (c.members - 1 + coalesce(t.n, 0))::BIGINT AS similar FROM u JOIN c ON u.s = c.s LEFT JOIN t ON c.rep = t.rep""")
def similar_counts(spark, sf):
    """For every workflow, how many others have an equal or a similar set."""
    classes, members = _classes(spark, sf)
    pairs = materialize(sj.similar_sets(classes, 0.5))
    sizes = classes.select(F.col("rep").alias("other"), "members")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    near = both.join(sizes, "other").groupBy("rep").agg(F.sum("members").alias("near"))
    totals = classes.join(near, "rep", "left").select("rep", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("similar"))
    return members.join(scale.maybe_broadcast(totals), "rep").select("o_orderkey", "rep", "similar")


@query("W22_workflow_stats", _SRC + """ SELECT unnest(['total', 'active', 'inactive', 'total_nodes', 'avg_nodes']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (o_orderstatus = 'O')::DOUBLE, count(*) FILTER (o_orderstatus <> 'O')::DOUBLE, sum(node_count)::DOUBLE, round(avg(node_count), 4)]) AS value FROM w
UNION ALL SELECT 'unique_integrations', count(DISTINCT s)::DOUBLE FROM (SELECT unnest(services) AS s FROM w) UNION ALL SELECT 'trigger:' || trigger, count(*)::DOUBLE FROM w GROUP BY 1
UNION ALL SELECT 'complexity:' || CASE WHEN node_count <= 5 THEN 'low' WHEN node_count <= 15 THEN 'medium' ELSE 'high' END, count(*)::DOUBLE FROM w GROUP BY 1""")
def workflow_stats(spark, sf):
    # several aggregates read the same few columns: written once, scanned cheaply
    rows = enriched(spark, sf).select("active", "node_count", "trigger", "complexity", "services")
    narrow = kept("workflow_numbers", rows, lambda: rows)
    return wf.stats(narrow, "services")


@query("W22_top_node_types", _SRC + f" SELECT '{B}' || kind AS type, count(*) AS n FROM n JOIN orders ON o_orderkey = k GROUP BY 1 ORDER BY n DESC, type LIMIT 10")
def top_node_types(spark, sf):
    return wf.top_node_types(parsed(spark, sf))
