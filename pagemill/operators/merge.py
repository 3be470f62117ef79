"""Insert, upsert, delete and comparison of table snapshots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.vectors import update_rows
from pagemill.session import discard, materialize


def chunks_of_type(chunks: DataFrame, documents: DataFrame, key: str, kind: str) -> DataFrame:
    """Chunk rows whose document has the given type; the type filter runs before the join."""
    return chunks.join(documents.filter(F.col("document_type") == kind).select(key), key)


def documents_with_chunks(documents: DataFrame, chunks: DataFrame, key: str, index: str, fields: list[str], block: int | None = None) -> DataFrame:
    """The ordered chunk list of each document, one row per document.

    With `block`, a list comes in rows (key, block) of at most so many index values,
    for documents whose chunks do not fit one row.
    """
    if block is not None:
        chunks = chunks.withColumn("block", F.floor((F.col(index) - 1) / block).cast("long"))
    lists = chunks.groupBy(key, *([] if block is None else ["block"])).agg(F.array_sort(F.collect_list(F.struct(index, *fields))).alias("chunks"))
    return documents.join(lists, key, "left")


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def insert_absent(existing: DataFrame, batch: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """Existing rows plus the first batch row of every unknown key; blank content is skipped."""
    fresh = dedupe_first(batch.filter(F.length(content) > 0), keys, order)
    return existing.unionByName(fresh.join(existing.select(*keys).distinct(), keys, "left_anti"))


def upsert(existing: DataFrame, batch: DataFrame, key: str, content_hash: str, order: str | None = None) -> DataFrame:
    """Batch rows overwrite rows of equal key unless the hash is equal. One shuffle:
    both sides are stacked and the winner comes from a partial aggregate.

    Of several batch rows of a key the largest by `order`, then by its columns, wins.
    """
    columns = [c for c in existing.columns if c != key]
    stacked = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    row = F.struct(*columns)
    rank = F.struct(*([order] if order else []), *columns)
    both = stacked.groupBy(key).agg(
        F.max_by(F.when(F.col("_new") == 0, row), F.when(F.col("_new") == 0, rank)).alias("o"),
        F.max_by(F.when(F.col("_new") == 1, row), F.when(F.col("_new") == 1, rank)).alias("n"))
    keep_old = F.col("n").isNull() | (F.col("o")[content_hash] == F.col("n")[content_hash])
    winner = F.when(F.coalesce(keep_old, F.lit(False)), F.col("o")).otherwise(F.col("n"))
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(keep_old, "skipped").otherwise("updated")
    return both.withColumns({"_w": winner, "action": action}).select(key, *[F.col("_w")[c].alias(c) for c in columns], "action")


def derived_fields(df: DataFrame, content: str, n_words: Column, now: str) -> DataFrame:
    """Fields set when a document is created; the id is random by nature."""
    return df.withColumns({
        "id": F.uuid(), "content_hash": F.md5(F.encode(content, "UTF-8")), "word_count": n_words,
        "created_at": F.lit(now).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp")})


def cascade_delete(documents: DataFrame, chunks: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(key).distinct()
    return documents.join(ids, key, "left_anti"), chunks.join(ids, key, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mtime: str) -> DataFrame:
    """Rows (key, change_type) for new, deleted and modified keys. One stacked
    aggregate stands for the full outer join."""
    both = old.select(key, F.lit(True).alias("in_old"), F.col(mtime).alias("o")).unionByName(
        new.select(key, F.lit(True).alias("in_new"), F.col(mtime).alias("n")), allowMissingColumns=True)
    one = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"), F.max("in_old").alias("in_old"), F.max("in_new").alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(F.col("n") > F.col("o"), "modified")
    return one.select(key, kind.alias("change_type")).filter(F.col("change_type").isNotNull())


def change_counts(diff: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("change_type") == k).alias(f"{k}_files")
    return diff.agg(count("new"), count("modified"), count("deleted"), F.count("*").alias("total_changes"))


def content_changes(current: DataFrame, stored: DataFrame, key: str, content_hash: str) -> DataFrame:
    known = stored.select(key, F.col(content_hash).alias("_h"))
    state = F.when(F.col("_h").isNull(), "new").when(F.col("_h").eqNullSafe(F.col(content_hash)), "unchanged").otherwise("changed")
    return current.join(known, key, "left").withColumn("state", state).drop("_h")


def union_tables(tables: dict[str, DataFrame], prefix: str = "", suffix: str = "") -> DataFrame:
    """Same-shaped tables appended; the category comes from the table name."""
    def label(name: str) -> str:
        return name.removeprefix(prefix).removesuffix(suffix).replace("_", " ").title()

    return reduce(DataFrame.unionByName, [df.withColumn("category", F.lit(label(n))) for n, df in tables.items()])


def union_unified(documents: DataFrame, workflows: DataFrame) -> DataFrame:
    """Both shapes in one superset; missing columns NULL, empty content falls back."""
    out = documents.withColumn("document_type", F.lit("documentation")).unionByName(
        workflows.withColumn("document_type", F.lit("workflow")), allowMissingColumns=True)
    fallback = F.concat_ws(" ", "title", "description")
    return out.withColumn("content", F.coalesce(F.nullif(F.col("content"), F.lit("")), fallback))


def key_sets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key once with its set: only_new, only_old or both."""
    both = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    one = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return one.select(key, F.when(F.col("o") == 0, "only_new").when(F.col("n") == 0, "only_old").otherwise("both").alias("key_set"))


class BucketStore:
    """A table in folders bucket=0, 1, ... by key hash, of which a change rewrites the touched ones.

    Changes are computed from the touched buckets alone, written aside, and put in their
    place by dynamic partition overwrite: other files keep their names, and a broken job
    before that step leaves the table as it was. Rows without a key are kept, share a
    bucket, and match no change by key but the upsert's, for which they are one key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int"))

    def create(self, df: DataFrame) -> None:
        rows = self._placed(df).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.path)

    def exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._placed(keys.select(self.key)).select("bucket").distinct().collect())  # at most `buckets` numbers

    def _replace(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if not touched:
            return
        stored = self.spark.read.parquet(self.path)
        columns = [c for c in stored.columns if c != "bucket"]
        after = materialize(change(stored.filter(F.col("bucket").isin(touched)).select(*columns)).select(*columns))
        emptied = set(touched) - set(self._touched(after))
        self._placed(after).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        for bucket in emptied:  # an overwrite does not see a bucket without rows
            place = folder(f"{self.path}/bucket={bucket}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        discard(after)

    def upsert(self, batch: DataFrame, content_hash: str, order: str | None = None) -> None:
        self._replace(self._touched(batch), lambda rows: upsert(rows, batch, self.key, content_hash, order))

    def update(self, changes: DataFrame, fields: list[str]) -> None:
        self._replace(self._touched(changes), lambda rows: update_rows(rows, changes, self.key, fields))

    def delete(self, keys: DataFrame) -> None:
        self._replace(self._touched(keys), lambda rows: rows.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def replace_rows(self, keys: DataFrame, rows: DataFrame) -> None:
        """All rows of the given keys are taken out and the given rows put in; a key may have many."""
        both = keys.select(self.key).unionByName(rows.select(self.key))
        self._replace(self._touched(both), lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti").unionByName(rows.select(*old.columns)))
