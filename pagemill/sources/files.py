"""File scans with explicit schemas; unreadable input is kept apart, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a stored page record.
PAGE_SCHEMA = (
    "url string, title string, content string, content_html string, headings array<struct<level:int,text:string,id:string>>, "
    "links array<struct<url:string,text:string,title:string>>, code_blocks array<struct<content:string,language:string,type:string>>, "
    "images array<struct<src:string,alt:string,title:string>>, metadata map<string,string>, scraped_at string, word_count long, content_hash string, _corrupt string")
SUMMARY_FILE = "scraping_summary.json"


def _json(spark: SparkSession, path: str, schema: str, one_per_file: bool, recursive: bool) -> DataFrame:
    reader = (
        spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json").option("multiLine", one_per_file).option("recursiveFileLookup", recursive))
    return reader.json(path).withColumn("file_path", F.col("_metadata.file_path")).filter(F.col("_metadata.file_name") != SUMMARY_FILE)


def scan_pages_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Readable page records; one object per file, or one per line for bulk data."""
    return _json(spark, path, PAGE_SCHEMA, one_per_file, False).filter("_corrupt IS NULL").drop("_corrupt")


def scan_json_recursive(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, one_per_file: bool = True) -> DataFrame:
    """All records below path with a status: processed, skipped (no content) or error."""
    rows = _json(spark, path, schema, one_per_file, True)
    status = F.when(F.col("_corrupt").isNotNull(), "error").when(F.coalesce(F.length("content"), F.lit(0)) == 0, "skipped").otherwise("processed")
    return rows.withColumn("status", status)


def scan_status(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts per status, and the failed files with their text."""
    errors = scanned.filter("status = 'error'").select("file_path", F.col("_corrupt").alias("error"))
    return scanned.groupBy("status").agg(F.count("*").alias("n")), errors


def scan_binary_with_hash(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """MD5 and size of every file. Files must fit a row, as single documents do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.md5("content").alias("file_hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV, every column a string."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("escape", '"').csv(path)


def scan_log_text(spark: SparkSession, path: str, level: str | None, n: int) -> DataFrame:
    """The last n lines holding the level. Lines are ordered by file name, block and
    place in the block; the top-n keeps n rows per task."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    wanted = lines if level is None else lines.filter(F.col("value").contains(level.upper()))
    return wanted.orderBy(F.col("f").desc(), F.col("b").desc(), F.col("i").desc()).limit(n).select("value")


def new_or_changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(path, mtime, ...) absent from manifest(path, mtime) or newer there."""
    known = manifest.groupBy("path").agg(F.max("mtime").alias("_m"))
    return files.join(known, "path", "left").filter(F.col("_m").isNull() | (F.col("_m") < F.col("mtime"))).drop("_m")
