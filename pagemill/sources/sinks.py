"""Writers: CSV counts, JSON, text blocks, partitioned tables, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx


def page_counts(records: DataFrame, nested: tuple[str, ...] = ("headings", "links", "code_blocks", "images")) -> DataFrame:
    present = [c for c in nested if c in records.columns]
    return records.select("url", "title", "word_count", *[F.size(c).alias(f"{c}_count") for c in present])


def page_index(records: DataFrame, scraped_at: str) -> DataFrame:
    """One line a page: place, kind and length; absent kinds are left out."""
    kinds = [c for c in ("category", "subcategory") if c in records.columns]
    return records.select("url", "title", *kinds, F.length("content").cast("long").alias("content_length"), tx.word_count(F.col("content")).alias("word_count"), F.lit(scraped_at).alias("scraped_at"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def text_block(url: Column, title: Column, body: Column) -> Column:
    rule = F.lit("=" * 80)
    return F.concat_ws("\n", rule, F.concat(F.lit("URL: "), url), F.concat(F.lit("Title: "), title), rule, body)


def markdown_block(title: Column, body: Column, size: int | None = None) -> Column:
    """Title and body; with `size`, a body of more characters is cut there, as in a preview."""
    cut = body if size is None else F.when(F.length(body) > size, F.concat(F.substring(body, 1, size), F.lit("..."))).otherwise(body)
    return F.concat(F.lit("# "), title, F.lit("\n\n"), cut)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_one_per_file(df: DataFrame, path: str, kind: str) -> None:
    """Each row of the one text column as a file of its own, with `kind` as the file ending.

    The tasks write the files themselves under names of their partition and place, so nothing
    is renamed one by one on the driver and a repeated task writes the same files again. The
    folder is local or in a store that pyarrow knows.
    """
    spark, (column,) = df.sparkSession, df.columns
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(place, True)
    system.mkdirs(place)
    root = place.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, folder = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:/", "file:///", 1))
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch.column(0):
                with target.open_output_stream(f"{folder}/part-{part:05d}-{n:07d}.{kind}", compression=None) as out:
                    out.write(((value.as_py() or "") + "\n").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select(F.col(column).cast("string")).mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one count


def write_by_category(df: DataFrame, path: str, category: str = "category") -> None:
    """One partitioned table in place of a table per category.

    Rows are spread by category and a salt, so a category with a large share of
    the rows is written by many tasks, each into few files.
    """
    # the salt comes from the row itself, so a retried task writes the same rows
    salt = F.pmod(F.xxhash64(*df.columns[:2]), F.lit(32))
    df.repartition(F.col(category), salt).write.mode("overwrite").partitionBy(category).parquet(path)


def fold_categories(df: DataFrame, parents: dict[str, str], category: str = "category") -> DataFrame:
    """Parent of each category from a fixed map; rows without one are left out."""
    pairs = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    return df.withColumn("parent", F.try_element_at(pairs, F.col(category))).filter(F.col("parent").isNotNull())


def snapshot(df: DataFrame, root: str, stamp: str, config: str = "{}") -> None:
    """Copy of a table under its time stamp plus a manifest row."""
    target = f"{root}/snapshot={stamp}"
    df.write.mode("errorifexists").parquet(target)
    spark = df.sparkSession
    rows = spark.read.parquet(target).count()
    manifest = spark.createDataFrame([(stamp, rows, config, target)], "stamp string, rows long, config string, path string")
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/_manifest")


def restore(spark: SparkSession, root: str, stamp: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={stamp}")


def kept_snapshots(man: DataFrame, now: str, days: int) -> DataFrame:
    """Manifest rows younger than the retention limit (stamp: yyyyMMddHHmmss)."""
    age = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return man.filter(F.to_timestamp("stamp", "yyyyMMddHHmmss") >= age)


def expire_snapshots(spark: SparkSession, root: str, now: str, days: int) -> list[str]:
    """Deletes snapshots beyond the retention limit, then writes the manifest without them.

    The folders go first: a manifest row without its folder can be deleted again.
    """
    man = manifest(spark, root)
    kept = man.join(kept_snapshots(man, now, days).select("stamp"), "stamp", "left_semi").select(*man.columns).collect()  # one row a snapshot
    gone = sorted({r["stamp"] for r in man.select("stamp").collect()} - {r["stamp"] for r in kept})
    files = spark._jvm.org.apache.hadoop.fs
    system = files.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for stamp in gone:
        system.delete(files.Path(f"{root}/snapshot={stamp}"), True)
    rows = spark.createDataFrame(kept, man.schema)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest")
    return gone
