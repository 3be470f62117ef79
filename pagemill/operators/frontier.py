"""The crawl frontier as tables: dedupe, priorities, outcomes, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import scale
from pagemill.functions import urls as ux
from pagemill.session import discard, materialize

RULE_FIELDS = ["type", "priority", "include", "max_depth", "follow_links", "pattern"]
DEFAULT_RULE = {"type": "unknown", "priority": 3, "include": True, "max_depth": 5, "follow_links": True, "pattern": ".*"}


def classify(df: DataFrame, rules: list[dict], url: str = "url") -> DataFrame:
    return df.withColumn("rule", ux.first_rule(F.col(url), rules, RULE_FIELDS, DEFAULT_RULE))


def classify_by_site(df: DataFrame, rule_sets: dict[str, list[dict]], own_sites: tuple[str, ...], fields: list[str],
                     default: dict, url: str = "url") -> DataFrame:
    """Rule set chosen by site type, then first match inside it."""
    typed = df.withColumn("site_type", ux.site_type(F.col(url), own_sites))
    rule = None
    for name, rules in rule_sets.items():
        found = ux.first_rule(F.col(url), rules, fields, default)
        rule = F.when(F.col("site_type") == name, found) if rule is None else rule.when(F.col("site_type") == name, found)
    return typed.withColumn("rule", rule.otherwise(ux.first_rule(F.col(url), [], fields, default)))


def matching_rules(df: DataFrame, rules: list[dict], url: str = "url") -> DataFrame:
    """Every (url, matching rule) pair: the theta join folded into one projection."""
    found = F.array_compact(F.array(*[
        F.when(F.col(url).rlike(r["pattern"]), F.struct(F.lit(i + 1).alias("rule_order"), F.lit(r["type"]).alias("type")))
        for i, r in enumerate(rules)]))
    return scale.rows_of(df, df.columns, found, "_m").select(*df.columns, "_m.rule_order", "_m.type")


def allowed_by_lists(df: DataFrame, scraped: DataFrame, failed: DataFrame, include: list[str], exclude: list[str], url: str = "url") -> DataFrame:
    """Not seen, not failed, any include piece, no exclude piece."""
    out = df
    if include:
        out = out.filter(_contains_any(F.col(url), include))
    if exclude:
        out = out.filter(~_contains_any(F.col(url), exclude))
    return out.join(scraped.select(url), url, "left_anti").join(failed.select(url), url, "left_anti")


def _contains_any(c: Column, pieces: list[str]) -> Column:
    test = F.lit(False)
    for piece in pieces:
        test = test | c.contains(piece)
    return test


def should_fetch(df: DataFrame, processed: DataFrame, blocked: DataFrame, rules: list[dict], url: str = "url") -> DataFrame:
    """Decision and reason: processed, blocked domain, excluded by rule, allowed."""
    p = processed.select(F.col(url)).distinct().withColumn("_done", F.lit(True))
    b = scale.maybe_broadcast(blocked.select(F.lower("domain").alias("_domain")).distinct()).withColumn("_blocked", F.lit(True))
    joined = (
        classify(df, rules, url).withColumn("_domain", ux.host(F.col(url)))
        .join(p, url, "left").join(b, "_domain", "left")
    )
    excluded = ~F.col("rule.include") | (F.col("rule.priority") == 5)
    reason = (
        F.when(F.col("_done"), "Already processed")
        .when(F.col("_blocked"), F.concat(F.lit("Domain blocked: "), F.col("_domain")))
        .when(excluded, F.concat(F.lit("Pattern excludes URL: "), F.col("rule.pattern")))
        .otherwise("URL allowed for scraping")
    )
    allowed = F.col("_done").isNull() & F.col("_blocked").isNull() & ~excluded
    return joined.withColumns({"allowed": allowed, "reason": reason}).drop("_done", "_blocked", "_domain", "rule")


def add_urls(df: DataFrame, rules: list[dict], seq: str, url: str = "url") -> DataFrame:
    """One row per normalized URL, the first insert winning; partial aggregates only."""
    norm = df.select(ux.normalize_url(F.col(url)).alias("url"), F.col(seq).alias("seq"))
    first = norm.groupBy("url").agg(F.min("seq").alias("seq"))
    return classify(first, rules).select("url", "seq", "rule.type", "rule.priority", "rule.include")


def next_urls(frontier: DataFrame, n: int) -> DataFrame:
    return frontier.filter(F.col("include") & (F.col("priority") != 5)).orderBy("priority", "seq").limit(n)


def outcomes(events: DataFrame, key: str, ok: Column, error: Column, order: Column) -> DataFrame:
    """Counters per URL and the message of its latest error."""
    return events.groupBy(key).agg(
        F.count_if(ok).alias("scrape_count"), F.count_if(~ok).alias("error_count"),
        F.max_by(F.when(~ok, error), F.when(~ok, order)).alias("last_error"))


def frontier_stats(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Long form: totals, counts by type and by priority, success rate."""
    by = lambda c, label: frontier.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(label).alias("metric"), "name", "value")
    ok, bad = F.sum("scrape_count"), F.sum("error_count")
    totals = results.agg(
        F.count("*").cast("double").alias("total_urls"), F.count_if(F.col("error_count") > 0).cast("double").alias("error_urls"),
        F.round(ok / F.greatest(F.lit(1), ok + bad), 6).alias("success_rate"))
    stacked = totals.select(F.expr("stack(3, 'total_urls', total_urls, 'error_urls', error_urls, 'success_rate', success_rate) AS (name, value)"))
    return by("type", "type").unionByName(by("priority", "priority")).unionByName(stacked.select(F.lit("total").alias("metric"), "name", "value"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """Breadth-first levels over edges(src, dst) from seeds(node).

    Each round joins the new level with the edges, drops visited nodes and writes
    the level to the checkpoint folder, so lineage stays short and survives a
    lost executor. A small level is broadcast, a large one shuffles.
    """
    links = materialize(edges.select("src", "dst").distinct())
    level = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    visited = level
    for depth in range(1, max_depth + 1):
        step = (
            links.join(scale.maybe_broadcast(level.select(F.col("node").alias("src")), stored=True), "src", "left_semi")
            .select(F.col("dst").alias("node")).distinct().join(visited.select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(depth).cast("long"))
        )
        level = materialize(step)
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
        if max_pages is not None and visited.count() >= max_pages:
            break
    discard(links)
    return visited if max_pages is None else visited.orderBy("depth", "node").limit(max_pages)


def disambiguate_names(files: DataFrame, name: str, content_hash: str, seq: str, width: int | None = None) -> DataFrame:
    """Same name and hash: later copies skipped and counted. Same name, other
    content: suffix _1, _2, ... in arrival order, numbered in segments so that a
    name holding a large share of all files is spread over many tasks."""
    kept = files.groupBy(name, content_hash).agg(F.min(seq).alias(seq), (F.count("*") - 1).alias("skipped"))
    numbered = scale.running_sum(kept, [name], seq, width or scale.segment_width(files, [name], seq), content_hash, F.lit(1), "_n")
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    suffix = F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    final = F.when(F.col("_n") > 1, F.concat(stem, F.lit("_"), (F.col("_n") - 1).cast("string"), suffix)).otherwise(F.col(name))
    return numbered.withColumn("final_name", final).drop("_n")
