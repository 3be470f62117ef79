"""Workflow documents: nested JSON with nodes and connections, as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.scale import keep_computed, rows_of

SCHEMA = (
    "id string, name string, active boolean, description string, "
    "nodes array<struct<name:string,type:string,typeVersion:int,parameters:map<string,string>,notes:string>>, "
    "connections map<string,map<string,array<struct<node:string>>>>, settings map<string,string>")

def _starts(kind: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | kind.startswith(p.lower())
    return test


# Service names by node type in lower case.
SERVICES = {
    "telegram": "Telegram", "telegramtrigger": "Telegram", "discord": "Discord", "slack": "Slack", "whatsapp": "WhatsApp", "mattermost": "Mattermost",
    "teams": "Microsoft Teams", "rocketchat": "Rocket.Chat", "gmail": "Gmail", "mailjet": "Mailjet", "emailreadimap": "Email (IMAP)", "emailsendsmt": "Email (SMTP)",
    "outlook": "Outlook", "googledrive": "Google Drive", "googledocs": "Google Docs", "googlesheets": "Google Sheets", "dropbox": "Dropbox", "onedrive": "OneDrive",
    "box": "Box", "postgres": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "redis": "Redis", "airtable": "Airtable", "notion": "Notion", "jira": "Jira",
    "github": "GitHub", "gitlab": "GitLab", "trello": "Trello", "asana": "Asana", "mondaycom": "Monday.com", "openai": "OpenAI", "anthropic": "Anthropic",
    "huggingface": "Hugging Face", "linkedin": "LinkedIn", "twitter": "Twitter/X", "facebook": "Facebook", "instagram": "Instagram", "shopify": "Shopify",
    "stripe": "Stripe", "paypal": "PayPal", "googleanalytics": "Google Analytics", "mixpanel": "Mixpanel", "googlecalendar": "Google Calendar",
    "googletasks": "Google Tasks", "cal": "Cal.com", "calendly": "Calendly", "typeform": "Typeform", "googleforms": "Google Forms", "form": "Form Trigger",
    "webhook": "Webhook", "httprequest": "HTTP Request", "graphql": "GraphQL", "sse": "Server-Sent Events",
}
# Node types that are no service.
UTILITY_NODES = (
    "set", "function", "code", "if", "switch", "merge", "split", "stickynote", "wait", "schedule", "cron", "manual", "stopanderror", "noop", "error",
    "limit", "aggregate", "summarize", "filter", "sort", "removeduplicates", "datetime", "extractfromfile", "converttofile", "readbinaryfile",
    "readbinaryfiles", "executiondata", "executeworkflow", "executecommand", "respondtowebhook",
)
# Services of each category.
SERVICE_CATEGORIES = {
    "messaging": ["Telegram", "Discord", "Slack", "WhatsApp", "Mattermost", "Microsoft Teams", "Rocket.Chat"],
    "email": ["Gmail", "Mailjet", "Email (IMAP)", "Email (SMTP)", "Outlook"],
    "cloud_storage": ["Google Drive", "Google Docs", "Google Sheets", "Dropbox", "OneDrive", "Box"],
    "database": ["PostgreSQL", "MySQL", "MongoDB", "Redis", "Airtable", "Notion"],
    "project_management": ["Jira", "GitHub", "GitLab", "Trello", "Asana", "Monday.com"],
    "ai_ml": ["OpenAI", "Anthropic", "Hugging Face"], "social_media": ["LinkedIn", "Twitter/X", "Facebook", "Instagram"],
    "ecommerce": ["Shopify", "Stripe", "PayPal"], "analytics": ["Google Analytics", "Mixpanel"],
    "calendar_tasks": ["Google Calendar", "Google Tasks", "Cal.com", "Calendly"], "forms": ["Typeform", "Google Forms", "Form Trigger"],
    "development": ["Webhook", "HTTP Request", "GraphQL", "Server-Sent Events", "YouTube"],
}
# Words with a spelling of their own in formatted names.
NAME_WORDS = {"http": "HTTP", "api": "API"}
# Start of the description by trigger, and purposes by words in the name.
TRIGGER_TEXTS = {"Webhook": "Webhook-triggered automation that", "Scheduled": "Scheduled automation that", "Complex": "Complex multi-step automation that"}
PURPOSES = ((("create",), "to create new records"), (("update",), "to update existing data"), (("sync",), "to synchronize data"),
            (("notification", "alert"), "for notifications and alerts"), (("backup",), "for data backup operations"), (("monitor",), "for monitoring and reporting"))
# Built-in types and trigger types of the summary form.
BUILTIN_TYPES = ("Start", "Set", "IF", "Switch", "Merge", "NoOp", "Function", "FunctionItem")
TRIGGER_TYPES = ("Trigger", "Webhook", "Cron", "Manual Trigger")
# Categories by trigger words, then by integration names.
TRIGGER_CATEGORIES = (("webhook", ("webhook",)), ("scheduled", ("schedule", "cron")), ("manual", ("manual",)))
INTEGRATION_CATEGORIES = (("communication", ("slack", "discord", "telegram")), ("email", ("gmail", "email", "smtp")), ("development", ("github", "gitlab", "git")),
                          ("data", ("airtable", "googlesheets", "notion")))


def parse(files: DataFrame, json: str = "json", stem: str = "stem") -> DataFrame:
    """Parsed fields plus tags, hash, size and the display name."""
    doc = F.from_json(json, SCHEMA, {"mode": "PERMISSIVE"})
    given = F.trim(F.col("name"))
    keep = (given != "") & (given != F.col(stem)) & ~given.startswith("My workflow")
    return (
        files.withColumn("_d", doc).select(*files.columns, "_d.*")
        .withColumns({
            "nodes": F.coalesce("nodes", F.array().cast("array<struct<name:string,type:string,typeVersion:int,parameters:map<string,string>,notes:string>>")),
            "tags": clean_tags(F.col(json)), "file_hash": F.md5(json), "file_size": F.length(json).cast("long"),
            "json_name": F.col("name"), "name": F.when(F.coalesce(keep, F.lit(False)), given).otherwise(format_name(F.col(stem)))})
    )


def format_name(stem: Column) -> Column:
    parts = F.split(stem, "_")
    kept = F.when((F.size(parts) > 1) & F.element_at(parts, 1).rlike("^[0-9]+$"), F.slice(parts, 2, F.size(parts))).otherwise(parts)

    def word(w: Column) -> Column:
        out = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        for plain, shown in NAME_WORDS.items():
            out = F.when(F.lower(w) == plain, shown).otherwise(out)
        return out

    return F.array_join(F.transform(kept, word), " ")


def clean_tags(json: Column) -> Column:
    """Tags may be texts or objects: text, else name, else id, else 'tag'."""
    tags = F.try_parse_json(F.get_json_object(json, "$.tags")).cast("array<variant>")
    get = lambda t, path, kind: F.try_variant_get(t, path, kind)
    return F.transform(tags, lambda t: F.when(F.schema_of_variant(t).startswith("OBJECT"), F.coalesce(
        get(t, "$.name", "string"), get(t, "$.id", "string"), F.lit("tag"))).otherwise(get(t, "$", "string")))


def complexity_bucket(n: Column) -> Column:
    return F.when(n <= 5, "low").when(n <= 15, "medium").otherwise("high")


def complexity_label(n: Column) -> Column:
    return F.when(n <= 3, "simple").when(n <= 8, "medium").otherwise("complex")


def trigger_type(nodes: Column, n_integrations: Column) -> Column:
    """Ordered fold: webhook overrides, then schedule, then any other trigger."""
    def step(acc: Column, n: Column) -> Column:
        kind, name = F.lower(n["type"]), F.lower(n["name"])
        return (
            F.when(kind.contains("webhook") | name.contains("webhook"), "Webhook").when(kind.contains("cron") | kind.contains("schedule"), "Scheduled")
            .when(kind.contains("trigger") & (acc == "Manual") & ~kind.contains("manual"), "Webhook").otherwise(acc))

    folded = F.aggregate(nodes, F.lit("Manual"), step)
    return F.when((F.size(nodes) > 10) & (n_integrations > 3), "Complex").otherwise(folded)


def integrations(nodes: Column, built_in: tuple[str, ...] = (), scoped: tuple[str, ...] = ("@",)) -> Column:
    """Sorted services of the nodes; a hint in the node name wins over the type.

    built_in: type prefixes of the workflow system's own nodes; scoped: prefixes of
    packaged ones. Types under either are looked up among the services.
    """
    table = F.create_map(*[F.lit(x) for kv in SERVICES.items() for x in kv])

    def prepare(n: Column) -> Column:
        kind = F.lower(n["type"])
        raw = F.substring_index(kind, ".", -1)
        for p in built_in:
            raw = F.when(kind.startswith(p.lower()), F.substr(kind, F.lit(len(p) + 1))).otherwise(raw)
        return F.struct(kind.alias("kind"), F.lower(n["name"]).alias("name"), F.replace(raw, F.lit("trigger"), F.lit("")).alias("raw"))

    def service(n: Column) -> Column:
        kind, name, raw = n["kind"], n["name"], n["raw"]
        known = F.when((raw == "") | raw.isin(*UTILITY_NODES), None).otherwise(F.coalesce(F.try_element_at(table, raw), F.initcap(raw)))
        custom = F.when(kind.contains("youtube"), "YouTube").when(kind.contains("telegram"), "Telegram").when(kind.contains("discord"), "Discord")
        by_type = F.when(_starts(kind, built_in + scoped), known).when(kind.contains("-"), custom)
        hint = None
        for key, value in SERVICES.items():
            hint = F.when(name.contains(key), value) if hint is None else hint.when(name.contains(key), value)
        # one scan tells most names apart from those with a hint
        return F.coalesce(F.when(name.rlike("|".join(SERVICES)), hint), by_type)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.transform(nodes, prepare), service))))


def describe(name: Column, trigger: Column, services: Column, n_nodes: Column) -> Column:
    """Template sentence; services in sorted order."""
    head = F.lit("Manual workflow that")
    for kind, text in TRIGGER_TEXTS.items():
        head = F.when(trigger == kind, text).otherwise(head)
    n = F.size(services)
    s = lambda i: F.try_element_at(services, F.lit(i))
    what = (F.when(n == 0, "").when(n == 1, F.concat(F.lit(" integrates with "), s(1))).when(n == 2, F.concat(F.lit(" connects "), s(1), F.lit(" and "), s(2)))
            .otherwise(F.concat(F.lit(" orchestrates "), s(1), F.lit(", "), s(2), F.lit(", and "), s(3))))
    low, purpose = F.lower(name), None
    for words, text in PURPOSES:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        purpose = F.when(test, text) if purpose is None else purpose.when(test, text)
    more = F.when(n > 3, F.concat(F.lit(" and integrates with "), n.cast("string"), F.lit(" services"))).otherwise("")
    return F.concat(head, what, F.lit(" "), purpose.otherwise("for data processing"), F.lit(". Uses "), n_nodes.cast("string"), F.lit(" nodes"), more, F.lit("."))


def connection_count(connections: Column) -> Column:
    sizes = F.transform(F.map_values(connections), lambda outputs: F.size(outputs))
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long")


def analyze(df: DataFrame, built_in: tuple[str, ...] = ()) -> DataFrame:
    """Counts, types, stripped integrations, triggers, complexity, completeness.

    built_in: type prefixes that are taken off for the integrations.
    """
    def bare(kind: Column) -> Column:
        for p in built_in:
            kind = F.replace(kind, F.lit(p), F.lit(""))
        return F.replace(kind, F.lit("Trigger"), F.lit(""))

    types = F.filter(F.transform("nodes", lambda n: n["type"]), lambda t: t != "")
    stripped = F.transform(types, bare)
    triggers = F.transform(F.filter("nodes", lambda n: F.lower(n["type"]).contains("trigger") | (n["typeVersion"] == 1)), lambda n: n["type"])
    out = df.withColumns({
        "node_count": F.size("nodes").cast("long"), "connection_count": connection_count(F.col("connections")), "node_types": F.array_sort(F.array_distinct(types)),
        "stripped": F.array_sort(F.array_distinct(F.filter(stripped, lambda t: t != ""))), "trigger_types": F.array_sort(F.array_distinct(triggers))})
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    completeness = 1.0 - F.when(empty("json_name"), 0.2).otherwise(0.0) - F.when(empty("description"), 0.3).otherwise(0.0) - F.when(F.col("node_count") == 0, 0.5).otherwise(0.0)
    return out.withColumns({
        "complexity_score": F.least(F.lit(1.0), (F.col("node_count") + F.col("connection_count")) / 50.0), "completeness_score": F.greatest(F.lit(0.0), F.round(completeness, 6))})


def categorize(trigger_types: Column, stripped: Column) -> Column:
    joined, label = F.lower(F.array_join(trigger_types, "|")), None
    for name, words in TRIGGER_CATEGORIES:
        test = F.lit(False)
        for w in words:
            test = test | joined.contains(w)
        label = F.when(test, name) if label is None else label.when(test, name)
    for name, names in INTEGRATION_CATEGORIES:
        label = label.when(F.arrays_overlap(F.transform(stripped, lambda s: F.lower(s)), F.array(*[F.lit(n) for n in names])), name)
    return label.otherwise("automation")


def to_text(df: DataFrame) -> Column:
    lines = F.transform("nodes", lambda n: F.format_string("- %s (%s)", n["name"], n["type"]))
    some = F.size("nodes") > 0
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("Workflow: "), blank(F.col("name"))), F.concat(F.lit("Description: "), blank(F.col("description"))),
                       F.when(some, F.concat(F.lit("Nodes ("), F.size("nodes").cast("string"), F.lit("):"))), F.when(some, F.array_join(lines, "\n")))


def summary(nodes: Column, connections: Column) -> dict[str, Column]:
    types = F.array_distinct(F.transform(nodes, lambda n: n["type"]))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    return {"integrations": F.array_sort(F.array_except(types, lit(BUILTIN_TYPES))),
            "trigger_types": F.filter(F.transform(nodes, lambda n: n["type"]), lambda t: t.isin(*TRIGGER_TYPES)),
            "complexity_score": F.least(F.lit(1.0), (F.size(nodes) + connection_count(connections)) / 100.0)}


def chunks(df: DataFrame, key: str) -> DataFrame:
    """One chunk per present part: description, each node, connections, settings."""
    piece = lambda kind, text: F.struct(F.lit(kind).alias("chunk_type"), text.alias("content"))
    label = lambda t, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(t), v))

    def node(n: Column) -> Column:
        params = F.transform(F.filter(F.map_entries(n["parameters"]), lambda e: e["value"] != ""), lambda e: F.concat_ws(": ", e["key"], e["value"]))
        return F.concat_ws(" | ", label("Node: ", n["name"]), label("Type: ", n["type"]), F.nullif(F.array_join(params, " | "), F.lit("")), label("Notes: ", n["notes"]))

    edges = F.transform(F.map_entries("connections"), lambda e: F.concat(
        e["key"], F.lit(" -> "), F.array_join(F.transform(F.flatten(F.map_values(e["value"])), lambda t: t["node"]), ", ")))
    settings = F.transform(F.map_entries("settings"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    parts = F.concat(
        F.array(F.when(F.coalesce("description", F.lit("")) != "", piece("description", F.col("description")))),
        F.transform("nodes", lambda n: piece("nodes", node(n))),
        F.array(F.when(F.size("connections") > 0, piece("connections", F.concat_ws(" | ", F.lit("Workflow Connections:"), edges))),
                F.when(F.size("settings") > 0, piece("settings", F.concat_ws(" | ", F.lit("Workflow Settings:"), settings)))))
    kept = F.filter(parts, lambda p: p.isNotNull() & (p["content"] != ""))
    return rows_of(df, [key], kept, "c", "chunk_index").select(
        key, "chunk_index", "c.chunk_type", "c.content", F.sha2("c.content", 256).alias("content_hash"))


def edges(df: DataFrame, key: str) -> DataFrame:
    outputs = rows_of(df, [key], F.map_entries("connections"), "s")
    targets = rows_of(outputs, [key, F.col("s.key").alias("source")], F.map_entries("s.value"), "o")
    found = rows_of(targets, [key, "source", F.col("o.key").alias("output")], "o.value", "t")
    return found.select(key, "source", "output", F.col("t.node").alias("target"))


def flow_text(df: DataFrame) -> Column:
    """Diagram lines: node shapes by type, then arrows."""
    ident = lambda c: F.regexp_replace(c, "[ -]", "_")

    def shape(n: Column) -> Column:
        kind = F.substring_index(n["type"], ".", -1)
        low, box = F.lower(kind), F.concat(n["name"], F.lit("\n("), kind, F.lit(")"))
        wrap = lambda a, b: F.concat(F.lit("    "), ident(n["name"]), F.lit(a), box, F.lit(b))
        return F.when(low.contains("trigger"), wrap("([", "])")).when(low.contains("webhook"), wrap("{{", "}}")).when(low.contains("if") | low.contains("switch"), wrap("{", "}")).otherwise(wrap("[", "]"))

    arrows = F.flatten(F.transform(F.map_entries("connections"), lambda e: F.transform(
        F.flatten(F.map_values(e["value"])), lambda t: F.concat(F.lit("    "), ident(e["key"]), F.lit(" --> "), ident(t["node"])))))
    return F.array_join(F.concat(F.array(F.lit("flowchart TD")), F.transform("nodes", shape), F.coalesce(arrows, F.array().cast("array<string>"))), "\n")


def validate(files: DataFrame, json: str = "json") -> DataFrame:
    """Errors and warnings of each file; a file without errors is valid."""
    v = F.try_parse_json(json)
    empty, bad = F.length(json) == 0, v.isNull()
    missing = lambda f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")).isin("", "[]", "{}", "null")
    ok = ~empty & ~bad
    name = F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit(""))
    errors = F.array_compact(F.array(
        F.when(empty, "Empty file"), F.when(~empty & bad, "Invalid JSON"), F.when(ok & missing("nodes"), "Missing required field: nodes"),
        F.when(ok & missing("connections"), "Missing required field: connections")))
    warnings = F.array_compact(F.array(F.when(F.length(json) > 1048576, "Large file"), F.when(ok & name.isin("", "My workflow", "New workflow"), "Default or empty workflow name")))
    return files.withColumns({"errors": errors, "warnings": warnings}).withColumn("valid", F.size("errors") == 0)


def repair(files: DataFrame, json: str = "json") -> DataFrame:
    """Trailing commas removed where that makes the text readable; missing nodes
    and connections get empty defaults."""
    fixed = F.regexp_replace(F.regexp_replace(json, r",\s*\}", "}"), r",\s*\]", "]")
    text = F.when(F.try_parse_json(json).isNotNull(), F.col(json)).when(F.try_parse_json(fixed).isNotNull(), fixed).otherwise(F.col(json))
    out = files.withColumns({"repaired": text, "was_repaired": F.try_parse_json(json).isNull() & F.try_parse_json(fixed).isNotNull()})
    v = F.try_parse_json("repaired")
    absent = lambda f: v.isNotNull() & F.try_variant_get(v, f"$.{f}", "variant").isNull()
    add = lambda c, f, value: F.when(absent(f), F.regexp_replace(c, r"\}\s*$", F.when(c.rlike(r"^\s*\{\s*\}\s*$"), f'"{f}": {value}}}').otherwise(f', "{f}": {value}}}'))).otherwise(c)
    with_nodes = add(F.col("repaired"), "nodes", "[]")
    return out.withColumn("_n", with_nodes).withColumn("repaired", add(F.col("_n"), "connections", "{}")).drop("_n")


def duplicate_files(files: DataFrame, key: str, content_hash: str) -> DataFrame:
    """Every file of a group of equal content, with the one that is kept (the first)."""
    groups = files.groupBy(content_hash).agg(F.count("*").alias("copies"), F.min(key).alias("kept")).filter("copies > 1")
    return files.join(groups, content_hash).select(key, content_hash, "copies", (F.col(key) == F.col("kept")).alias("keep"))


def error_breakdown(validated: DataFrame, category: str) -> DataFrame:
    # one pass: every row yields its errors and, if it has any, its category
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    found = F.concat(F.transform("errors", lambda e: pair("error", e)), F.array_compact(F.array(F.when(F.size("errors") > 0, pair("category", F.col(category))))))
    return rows_of(validated, [], found, "p").groupBy("p.kind", "p.name").agg(F.count("*").alias("n"))


def of_category(df: DataFrame, category: str, services: str) -> DataFrame:
    wanted = F.array(*[F.lit(s) for s in SERVICE_CATEGORIES[category]])
    return keep_computed(df, lambda r: F.arrays_overlap(r[services], wanted))


def similar(df: DataFrame, key: str, services: str, target: str | int, n: int = 5) -> DataFrame:
    """Jaccard of the service sets against one workflow, top n. The one set is read
    first and enters the scan as a constant."""
    row = df.filter(F.col(key) == target).select(services).first()
    wanted = F.array(*[F.lit(s) for s in row[0]]).cast("array<string>") if row else F.array().cast("array<string>")
    union = F.size(F.array_union(services, wanted))
    score = F.when(union > 0, F.size(F.array_intersect(services, wanted)) / union).otherwise(0.0)
    return df.filter(F.col(key) != target).select(key, F.round(score, 6).alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(n)


def stats(df: DataFrame, services: str) -> DataFrame:
    """(metric, value) rows: totals, counts by trigger and complexity, services."""
    from pagemill.operators.reports import stack_row

    row = df.agg(F.count("*").alias("total"), F.count_if(F.col("active")).alias("active"), F.count_if(~F.col("active")).alias("inactive"),
                 F.sum("node_count").alias("total_nodes"), F.round(F.avg("node_count"), 4).alias("avg_nodes"))
    distinct = rows_of(df, [], services, "s").agg(F.count_distinct("s").cast("double").alias("value")).select(F.lit("unique_integrations").alias("metric"), "value")
    by = lambda c: df.groupBy(F.concat(F.lit(f"{c}:"), F.col(c)).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return stack_row(row, ["total", "active", "inactive", "total_nodes", "avg_nodes"]).unionByName(distinct).unionByName(by("trigger")).unionByName(by("complexity"))


def top_node_types(df: DataFrame, n: int = 10) -> DataFrame:
    types = rows_of(df, [], "nodes", "n").select("n.type")
    return types.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type").limit(n)
