"""The tagged knowledge table built from page records."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

# Friendly names of the main categories.
CATEGORY_NAMES = {
    "advanced-ai": "AI & Machine Learning", "api": "API & Integration", "code": "Code & Development", "hosting": "Hosting & Deployment",
    "integrations": "Node Integrations", "data": "Data Management", "flow-logic": "Workflow Logic", "credentials": "Authentication",
    "embed": "Embedding", "courses": "Learning Resources", "glossary": "Reference", "help-community": "Community & Support",
}

# Tag words and the words never used as tags.
TAG_WORDS = (
    "http", "webhook", "code", "function", "if", "switch", "merge", "split", "gmail", "slack", "discord", "telegram", "twitter", "facebook", "mysql",
    "postgres", "mongodb", "redis", "elasticsearch", "api", "rest", "graphql", "json", "xml", "csv",
)
TAG_STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)
NODE_NAME = r"([\p{L}\p{N}_]+)" + tx.WS + r"+node(?:$|[^\p{L}\p{N}_])"


def category_from_name(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, "_")
    head = F.element_at(parts, 1)
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    rest = F.array_join(F.slice(parts, 2, F.size(parts)), "_")
    return F.coalesce(F.try_element_at(names, head), F.initcap(head)), F.when(F.size(parts) > 1, rest).otherwise("general")


def domain_tags(content: Column, title: Column, category: Column, subcategory: Column, n: int | None = None) -> Column:
    """Category, subcategory, node names and known words, sorted: all, or the first n."""
    low = F.concat_ws(" ", F.lower(content), F.lower(title))
    tokens = F.regexp_extract_all(low, F.lit(tx.WORD_CHAR + "+"), F.lit(0))
    known = F.array_intersect(tokens, F.array(*[F.lit(w) for w in TAG_WORDS]))
    nodes = F.when(low.contains("node"), F.regexp_extract_all(low, F.lit(NODE_NAME), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(F.array(F.lower(category), F.lower(subcategory)), nodes, known))
    tags = F.array_sort(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*TAG_STOP_WORDS)))
    return tags if n is None else F.slice(tags, 1, n)


def chunk_metadata(content: Column) -> dict[str, Column]:
    return {
        "word_count": tx.word_count(content),
        "has_code_examples": content.contains("```") | content.contains("<code>"),
        "section_count": F.when(content.contains("#"), tx.count_matches(content, r"#+" + tx.WS)).otherwise(0).cast("long"),
    }


def chunk_ids(url: Column, title: Column, content: Column, file: Column, starts: tuple[int, int] | None = None) -> dict[str, Column]:
    """Ids of a chunk by its whole content. With `starts`, the first two take only so many
    first characters, as in stores whose ids were made so; equal starts then share an id."""
    of = lambda i: content if starts is None else F.substring(content, 1, starts[i])
    joined = lambda *c: F.md5(F.encode(F.concat_ws(":", *c), "UTF-8"))
    return {
        "chunk_id": F.substring(joined(url, title, of(0)), 1, 16),
        "file_chunk_id": F.concat(F.lit("chunk_"), file, F.lit("_"), F.substring(joined(url, title, file, of(1)), 1, 12)),
        "length_chunk_id": F.substring(joined(url, title, F.length(content).cast("string")), 1, 16),
    }


def knowledge_chunks(df: DataFrame, title: str, content: str, url: str, name: str, variant: str = "full") -> DataFrame:
    """variant full: cleaned text and domain tags; light: squashed text, title tags;
    source: cleaned text and file metadata."""
    body, kept = F.col(content), df.filter(F.length(tx.strip(F.col(content))) >= 50)
    category, subcategory = category_from_name(F.col(name))
    staged = kept.withColumns({"category": category, "subcategory": subcategory})
    ids = chunk_ids(F.col(url), F.col(title), body, F.col(name))
    cat, sub = F.col("category"), F.col("subcategory")
    if variant == "full":
        columns = {"id": ids["chunk_id"], "clean": tx.clean_knowledge_text(body), "tags": domain_tags(body, F.col(title), cat, sub)}
    elif variant == "light":
        low = F.lower(F.col(title))
        columns = {"id": ids["length_chunk_id"], "clean": tx.squash(body), "tags": F.concat(
            F.array(F.lower(cat), F.lower(sub)), F.array_compact(F.array(F.when(low.contains("node"), "node"), F.when(low.contains("workflow"), "workflow"))))}
    else:
        columns = {"id": ids["file_chunk_id"], "clean": tx.clean_knowledge_text(body), "char_count": F.length(body).cast("long")}
    return staged.withColumns({**columns, **chunk_metadata(body)})


def category_counts(chunks: DataFrame, category: str = "category") -> DataFrame:
    return chunks.groupBy(category).agg(F.count("*").alias("n"))


def kb_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row; the average chunk size is an integer division."""
    length = F.length(content)
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.round(F.avg(length), 4).alias("avg_content_length"), F.sum(length).alias("total_content_length"),
        F.count_if(F.col(content).contains("```") | F.col(content).contains("<code>")).alias("chunks_with_code"),
        F.expr(f"sum(length({content})) div count(*)").alias("average_chunk_size"))


def changed_files(files: DataFrame, manifest: DataFrame, key: str, mtime: str, force: bool = False) -> DataFrame:
    """Files that are new or newer than the manifest says."""
    if force:
        return files
    known = manifest.groupBy(key).agg(F.max(mtime).alias("_known"))
    return files.join(known, key, "left").filter(F.col("_known").isNull() | (F.col("_known") < F.col(mtime))).drop("_known")


def processing_stats(chunks: DataFrame, processed: DataFrame, n_files: DataFrame, seconds: float) -> DataFrame:
    """Stacked one-row aggregates folded into one row, without a join."""
    parts = (
        chunks.agg(F.count("*").alias("total_chunks")).unionByName(
            processed.agg(F.count("*").alias("processed_files"), F.max("processed_at").alias("last_update")), allowMissingColumns=True)
        .unionByName(n_files.agg(F.count("*").alias("total_files")), allowMissingColumns=True)
    )
    one = parts.agg(*[F.max(c).alias(c) for c in ("total_chunks", "processed_files", "last_update", "total_files")])
    done = F.greatest(F.col("processed_files"), F.lit(1))
    return one.withColumns({
        "pending_files": F.col("total_files") - F.col("processed_files"), "chunks_per_file": F.round(F.col("total_chunks") / done, 6),
        "processing_rate": F.round(F.col("processed_files") / max(seconds, 1.0), 6)})


def fingerprint(files: DataFrame, name: str, size: Column, mtime: Column) -> DataFrame:
    """md5 over count, total size and the sum of a hash of every name and time.

    The sum does not depend on order, so it is combined on the map side.
    """
    named = F.md5(F.encode(F.concat_ws(":", F.col(name).cast("string"), mtime.cast("string")), "UTF-8"))
    hashed = F.conv(F.substring(named, 1, 15), 16, 10).cast("decimal(38,0)")
    one = files.agg(F.count("*").alias("file_count"), F.sum(size).alias("total_size"), F.sum(hashed).cast("string").alias("names"))
    text = F.concat_ws(":", F.col("file_count").cast("string"), F.col("total_size").cast("string"), F.col("names"))
    return one.select("file_count", "total_size", F.md5(F.encode(text, "UTF-8")).alias("checksum"))


def is_stale(current: dict, stored: dict, age_hours: float, limit_hours: float = 24) -> bool:
    return age_hours > limit_hours or any(current[k] != stored[k] for k in ("file_count", "checksum"))


def with_hooks(df: DataFrame, before: list, build, after: list, left_out: list | None = None) -> DataFrame:
    """User stages around a build step. A stage that cannot be planned is left out with
    a warning; its error is added to `left_out` where that list is given."""
    def run(frame: DataFrame, stages: list) -> DataFrame:
        for stage in stages:
            try:
                nxt = frame.transform(stage)
                nxt.schema  # noqa: B018  (analysis happens here)
                frame = nxt
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"stage left out: {e}", stacklevel=2)
                if left_out is not None:
                    left_out.append(e)
        return frame

    return run(build(run(df, before)), after)
