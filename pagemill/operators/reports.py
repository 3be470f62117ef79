"""Statistics and status reports: combined aggregates and small top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.scale import rows_of
from pagemill.session import materialize


def stack_row(row: DataFrame, columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One aggregate row as (metric, value) rows of doubles."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return row.select(F.expr(f"stack({len(columns)}, {pairs}) AS ({name}, {value})"))


def content_statistics(pages: DataFrame, nested: dict[str, Column], segment: Column, stored: bool = False) -> DataFrame:
    """Totals, word distribution and pages per segment as (metric, value) rows.

    Two aggregates read a few numbers per page: those are written once, unless the pages
    already are a stored table, so that the HTML is parsed once.
    """
    pages = pages.select("word_count", segment.alias("_segment"), *[c.alias(f"_{n}") for n, c in nested.items()])
    pages = pages if stored else materialize(pages)
    words = F.col("word_count")
    totals = {
        "total_pages": F.count("*"), "total_words": F.coalesce(F.sum(words), F.lit(0)), **{f"total_{n}": F.coalesce(F.sum(f"_{n}"), F.lit(0)) for n in nested},
        "words_min": F.coalesce(F.min(words), F.lit(0)), "words_max": F.coalesce(F.max(words), F.lit(0)), "words_avg": F.round(F.coalesce(F.avg(words), F.lit(0.0)), 4)}
    row = pages.agg(*[c.alias(n) for n, c in totals.items()])
    per_segment = pages.groupBy(F.concat(F.lit("category:"), "_segment").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return stack_row(row, list(totals)).unionByName(per_segment)


# Substrings counted in headings and in code.
HEADING_PATTERNS = {"contains_node": ("node",), "contains_workflow": ("workflow",), "contains_api": ("api",), "contains_integration": ("integration",),
                    "contains_setup": ("setup", "install", "configure"), "contains_example": ("example",)}
CODE_PATTERNS = {"contains_npm": ("npm",), "contains_docker": ("docker",), "contains_curl": ("curl",), "contains_json": ("{", "}", "[", "]"),
                 "contains_url": ("http",), "contains_api_key": ("api_key", "apikey", "token")}


def any_of(c: Column, needles) -> Column:
    test = F.lit(False)
    for n in needles:
        test = test | c.contains(n)
    return test


def heading_analysis(headings: DataFrame) -> DataFrame:
    """headings(level, text): totals, levels and pattern counts."""
    low = F.lower("text")
    totals = {"total_headings": F.count("*"), "unique_headings": F.count_distinct("text"), **{f"level_{n}": F.count_if(F.col("level") == n) for n in range(1, 7)},
              **{n: F.count_if(any_of(low, w)) for n, w in HEADING_PATTERNS.items()}}
    return stack_row(headings.agg(*[c.alias(n) for n, c in totals.items()]), list(totals))


def most_common(df: DataFrame, value: str, n: int, first: Column | None = None) -> DataFrame:
    order = F.min(first) if first is not None else F.first(value)
    counted = df.groupBy(value).agg(F.count("*").alias("n"), order.alias("_first"))
    return counted.orderBy(F.col("n").desc(), "_first").limit(n).select(value, "n")


def code_analysis(code: DataFrame) -> DataFrame:
    """code(content, language, type): totals, languages, types, patterns, mean length."""
    low = F.lower("content")
    totals = {"total_code_blocks": F.count("*"), **{n: F.count_if(any_of(low, w)) for n, w in CODE_PATTERNS.items()},
              "avg_code_length": F.round(F.coalesce(F.avg(F.length("content")), F.lit(0.0)), 4)}
    out = stack_row(code.agg(*[c.alias(n) for n, c in totals.items()]), list(totals))
    by = lambda c, label: code.filter(F.coalesce(c, F.lit("unknown")) != "").groupBy(F.concat(F.lit(label), F.coalesce(c, F.lit("unknown"))).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return out.unionByName(by(F.lower("language"), "language:")).unionByName(by(F.col("type"), "type:"))


def link_analysis(links: DataFrame, site: str, n: int = 10, stored: bool = False) -> DataFrame:
    """links(url): internal and external totals plus both top lists."""
    links = links.select("url") if stored else materialize(links.select("url"))
    internal = F.col("url").contains(site)
    row = links.agg(
        F.count_if(internal).alias("total_internal_links"), F.count_if(~internal).alias("total_external_links"),
        F.count_distinct(F.when(internal, F.col("url"))).alias("unique_internal_links"), F.count_distinct(F.when(~internal, F.col("url"))).alias("unique_external_links"))
    pieces = F.split("url", "/")
    domain = F.when(F.size(pieces) > 2, F.element_at(pieces, 3)).otherwise(F.col("url"))
    top = lambda df, label: df.groupBy("key").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "key").limit(n).select(F.concat(F.lit(label), "key").alias("metric"), F.col("c").cast("double").alias("value"))
    return (
        stack_row(row, ["total_internal_links", "total_external_links", "unique_internal_links", "unique_external_links"])
        .unionByName(top(links.filter(internal).select(F.col("url").alias("key")), "linked:"))
        .unionByName(top(links.filter(~internal).select(domain.alias("key")), "domain:")))


def entity_mentions(pages: DataFrame, key: str, url: str, title: str, content: str, pattern: str, page_test: Column) -> DataFrame:
    """Rows from pages of the entity kind, and distinct mentions in the text of every page."""
    own = pages.filter(page_test).select(key, F.col(title).alias("name"), F.col(url).alias("url"), F.lit("integration_page").alias("type"))
    found = F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(0)))
    mentioned = rows_of(pages, [key, F.col(url).alias("url")], found, "name").select(key, "name", "url", F.lit("content_mention").alias("type"))
    return own.unionByName(mentioned)


def report_json(parts: dict[str, DataFrame]) -> DataFrame:
    """All analyses as one JSON-lines document: a line per metric, so that a report
    with very many categories is never gathered into one value."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("report"), F.to_json(F.struct("metric", "value")).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out


def crawl_summary(pages: DataFrame, errors: Column) -> DataFrame:
    """A totals row and one row per page; the page list is never gathered."""
    total = pages.agg(F.count("*").alias("pages"), F.count_if(errors).alias("errors"), F.sum("word_count").alias("words"))
    return total.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("words"), F.col("pages"), F.col("errors")).unionByName(
        pages.select(F.lit("page").alias("kind"), "url", F.col("word_count").alias("words"), F.lit(1).cast("bigint").alias("pages"), errors.cast("bigint").alias("errors")))


def database_metrics(docs: DataFrame, length: Column, scraped_at: Column, now: str) -> DataFrame:
    row = docs.agg(F.count("*").alias("total_documents"), F.max(scraped_at).alias("latest"), F.round(F.avg(length), 4).alias("avg_length"), F.round(F.sum(length) / 1048576, 6).alias("size_mb"))
    age = F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 3600, 4)
    return row.withColumn("data_age_hours", age)


def run_history(runs: DataFrame, line: str, ts: str, days: int) -> DataFrame:
    """Runs, successes and the next run out of log lines."""
    run, ok = F.col(line).contains("Full automation completed"), F.col(line).contains("Success: True")
    row = runs.agg(F.count_if(run).alias("total_runs"), F.count_if(run & ok).alias("successful_runs"), F.max(F.when(run, F.col(ts))).alias("last_run"))
    rate = F.when(F.col("total_runs") > 0, F.col("successful_runs") / F.col("total_runs") * 100).otherwise(0.0)
    return row.withColumns({"success_rate": F.round(rate, 4), "next_run": F.col("last_run") + F.make_dt_interval(F.lit(days))})


# Fixed values: (column, issue limit, issue text, warning limit, warning text).
HEALTH_LIMITS = (
    ("cpu_percent", 80, "High CPU usage: %.1f%%", 60, "Elevated CPU usage: %.1f%%"), ("memory_percent", 85, "High memory usage: %.1f%%", 70, "Elevated memory usage: %.1f%%"),
    ("disk_percent", 90, "Low disk space: %.1f%% used", 80, "Disk space getting low: %.1f%% used"), ("data_age_hours", 72, "Data is stale: %.1f hours old", 48, "Data is aging: %.1f hours old"),
)
RATE_LIMITS = (80, "Low automation success rate: %.1f%%", 95, "Automation success rate could be better: %.1f%%")


def health(df: DataFrame) -> DataFrame:
    """Threshold ladders to issues, warnings, status and score."""
    issues, warnings = [], []
    text = lambda f, c: F.format_string(f, F.round(c, 1))
    for column, hard, hard_text, soft, soft_text in HEALTH_LIMITS:
        c = F.col(column)
        issues.append(F.when(c > hard, text(hard_text, c)))
        warnings.append(F.when((c > soft) & (c <= hard), text(soft_text, c)))
    issues.append(F.when(F.col("total_documents") == 0, "No documents in database"))
    rate, many = F.col("success_rate"), F.col("total_runs") > 5
    issues.append(F.when((rate < RATE_LIMITS[0]) & many, text(RATE_LIMITS[1], rate)))
    warnings.append(F.when((rate >= RATE_LIMITS[0]) & (rate < RATE_LIMITS[2]) & many, text(RATE_LIMITS[3], rate)))
    out = df.withColumns({"issues": F.array_compact(F.array(*issues)), "warnings": F.array_compact(F.array(*warnings))})
    status = F.when(F.size("issues") > 0, "unhealthy").when(F.size("warnings") > 0, "warning").otherwise("healthy")
    return out.withColumns({"status": status, "score": F.greatest(F.lit(0), 100 - F.size("issues") * 20 - F.size("warnings") * 5).cast("long")})


def overall_health(components: DataFrame, status: str) -> DataFrame:
    rank = F.when(F.col(status) == "unhealthy", 2).when(F.col(status).isin("warning", "degraded"), 1).otherwise(0)
    return components.agg(F.max_by(status, rank).alias("overall_status"), F.count("*").alias("total_components"), F.count_if(rank == 0).alias("healthy_components"),
                          F.count_if(rank == 1).alias("degraded_components"), F.count_if(rank == 2).alias("unhealthy_components"))


def freshness(df: DataFrame, ts: Column, now: str, limit_hours: int = 72, warn_hours: int = 48) -> DataFrame:
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 3600
    return df.agg(F.max(ts).alias("latest")).withColumns({"age_hours": F.round(age, 4), "is_fresh": age < limit_hours, "is_aging": (age > warn_hours) & (age < limit_hours)})


def category_examples(df: DataFrame, category: str, example: str, order: str, n: int = 3) -> DataFrame:
    """Counts with the first n examples; the n smallest come from a bounded rank filter."""
    from pagemill import scale

    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    firsts = scale.top_n_per_key(df.select(category, example, order), [category], [F.col(order)], n)
    lists = firsts.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("rank", example))).alias("e"))
    return counts.join(lists, category).select(category, "n", F.transform("e", lambda s: s[example]).alias("examples"))


# Upper bounds of the duration histogram.
HISTOGRAM_BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(df: DataFrame, key: str, value: str, bounds=HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative counts per upper bound, with count and sum: one pass, one row per key, then stacked."""
    row = df.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("b_all"), F.round(F.sum(value), 4).alias("total"))
    pairs = ", ".join(f"'{b}', b{i}" for i, b in enumerate(bounds))
    return row.select(key, F.expr(f"stack({len(bounds) + 1}, {pairs}, '+Inf', b_all) AS (le, n)"), F.col("b_all").alias("observations"), "total")


def counters_and_gauges(df: DataFrame, key: str, increment: Column, level: Column, order: Column) -> DataFrame:
    return df.groupBy(key).agg(F.sum(increment).alias("counter"), F.max_by(level, order).alias("gauge"))


def exposition(df: DataFrame, key: str) -> DataFrame:
    line = lambda kind, c: F.format_string(f"# HELP %s_{kind} Events\n# TYPE %s_{kind} {kind}\n%s_{kind} %s", F.col(key), F.col(key), F.col(key), F.col(c).cast("string"))
    return df.select(F.concat_ws("\n", line("counter", "counter"), line("gauge", "gauge")).alias("text"))


def job_progress(df: DataFrame, key: str, ok: Column) -> DataFrame:
    row = df.groupBy(key).agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))
    return row.withColumn("percent", F.round(F.col("processed") / F.col("total") * 100, 4))


def update_cycle(old: DataFrame, new: DataFrame, key: str, mtime: str, steps: dict) -> tuple[DataFrame, dict[str, bool]]:
    """Runs the named steps on the new snapshot and the diff against the old one.

    A failing step fails the run and is counted; the later steps do not run.
    """
    from pagemill.operators.merge import change_counts, snapshot_diff

    done: dict[str, bool] = {}
    for name, step in steps.items():
        try:
            step(new)
            done[name] = True
        except Exception:  # noqa: BLE001
            done[name] = False
            break
    counts = change_counts(snapshot_diff(old, new, key, mtime))
    failed = sum(not ok for ok in done.values())
    return counts.withColumns({"steps_ok": F.lit(len(done) - failed), "steps_failed": F.lit(failed), "success": F.lit(failed == 0)}), done
