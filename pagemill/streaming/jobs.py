"""The event operators as Structured Streaming jobs.

Every job reads new files, keeps its state behind a watermark and writes through
a checkpointed sink, so a restart continues where the last commit ended.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pagemill.operators.merge import BucketStore
from pagemill.session import checkpoint_root

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*", kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files that are new since the last run, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(kind).load(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """A parquet table as a stream, be it one file or a folder of parts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return file_stream(spark, path, schema, max_files=max_files)
    folder, _, name = path.rpartition("/")
    return file_stream(spark, folder, schema, name, max_files=max_files)


def timed(events: DataFrame, ts: str, late: str = WATERMARK) -> DataFrame:
    """Plain timestamps become zoned ones, as watermarks require."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour") -> DataFrame:
    return timed(events, ts).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, ts: str, key: str, width: str, slide: str) -> DataFrame:
    return timed(events, ts).groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, idle: str = "30 minutes") -> DataFrame:
    return timed(events, ts).groupBy(F.session_window(ts, idle), key).agg(F.count("*").alias("events"), F.max(ts).alias("last_ts")).select(
        key, F.col("session_window.start").alias("start_ts"), "last_ts", "events")


def token_bucket(events: DataFrame, ts: str, key: str, capacity: float, rate: float) -> DataFrame:
    """Per-event decisions; the state of a key is its token count and last time.

    Rows of a micro-batch are put in time order per key. The state of a key expires
    once it stayed away for as long as an empty bucket takes to fill.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")
    idle_ms = math.ceil(capacity / rate * 1000) + 1
    key_type = events.schema[key].dataType.simpleString()

    def decide(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        tokens, last = state.get if state.exists else (capacity, int(rows["us"].iloc[0]))
        allowed = []
        for now in rows["us"]:
            tokens = min(capacity, tokens + max(0, now - last) / 1e6 * rate)
            last = max(last, int(now))
            allowed.append(tokens >= 1)
            tokens -= 1 if allowed[-1] else 0
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: k[0], "us": rows["us"], "allowed": allowed})

    timed_rows = timed(events, ts).select(key, ts, F.unix_micros(ts).alias("us"))
    return timed_rows.groupBy(key).applyInPandasWithState(
        decide, f"{key} {key_type}, us long, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def membership(events: DataFrame, ts: str, doc: str, user: str, joined: str, left: str, kind: str) -> DataFrame:
    """Last join or leave per (document, user) as an updating aggregate."""
    moves = events.filter(F.col(kind).isin(joined, left)).withColumn("_ts", F.col(ts).cast("timestamp"))
    return moves.groupBy(doc, user).agg(F.max_by(F.col(kind) == joined, "_ts").alias("present"), F.max("_ts").alias("changed_at"))


def live_entries(events: DataFrame, ts: str, owner: str, ident: str, ttl_hours: int) -> DataFrame:
    """(owner, id, expires_at) of every entry that arrives in time, as an updating aggregate.

    The time of expiry is known on arrival and is what the watermark runs over, so the state
    store itself drops an entry once it is dead; `unexpired` reads what is left.
    """
    rows = events.select(owner, ident, (F.col(ts).cast("timestamp") + F.make_dt_interval(hours=F.lit(ttl_hours))).alias("expires_at"))
    return rows.withWatermark("expires_at", f"{ttl_hours} hours {WATERMARK}").groupBy("expires_at", owner, ident).agg(F.count("*").alias("n")).drop("n")


def last_moves(events: DataFrame, ts: str, place: str, member: str, ident: str, joined: str, left: str, kind: str, idle_hours: int, width: str = "1 day") -> DataFrame:
    """(place, member, us, id, joined, expires_at): the last move in each window of time, ties to the larger id.

    The state holds the windows that late rows may still reach; `unexpired` of the last of a
    member's rows tells whether the move still counts after idle_hours.
    """
    moves = timed(events.filter(F.col(kind).isin(joined, left)), ts)
    last = moves.groupBy(F.window(ts, width), place, member).agg(F.max(F.struct(F.unix_micros(ts).alias("us"), F.col(ident).alias("id"), (F.col(kind) == joined).alias("joined"), F.col(ts).alias("at"))).alias("m"))
    return last.select(place, member, "m.us", "m.id", "m.joined", (F.col("m.at") + F.make_dt_interval(hours=F.lit(idle_hours))).alias("expires_at"))


def unexpired(rows: DataFrame, progress: list) -> DataFrame:
    """Rows whose expires_at lies beyond the last watermark of the run that `progress` reports."""
    marks = [p["eventTime"]["watermark"] for p in progress if "watermark" in p["eventTime"]]
    return rows.filter(F.col("expires_at") > F.lit(max(marks)).cast("timestamp")) if marks else rows


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str, sink: str | None = None, checkpoint: str | None = None, state: str | None = None, progress: list | None = None) -> str:
    """Runs over all files there are and stops; returns the folder of results.

    `state` names the state store provider where the job needs another than the session's;
    `progress` receives the reports of all micro-batches. append: a parquet sink with exactly-once commits. update: one folder per
    micro-batch, overwritten if the batch is repeated.
    """
    base = f"{checkpoint_root(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    sink, checkpoint = sink or f"{base}/out", checkpoint or f"{base}/log"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    provider, spark = "spark.sql.streaming.stateStore.providerClass", stream.sparkSession
    before = spark.conf.get(provider, None)
    if state:
        spark.conf.set(provider, state)
    if mode == "append":
        started = writer.format("parquet").option("path", sink).start()
    else:
        started = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()
    try:
        started.awaitTermination()
    finally:
        if state:
            spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    if progress is not None:
        progress += started.recentProgress
    return sink


def newest_updates(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Latest row per key out of the update folders."""
    from pagemill import scale

    rows = spark.read.parquet(sink)
    return scale.last_per_key(rows, keys, F.col("batch")).drop("batch")


def keep_newest(stream: DataFrame, key: str, order: str, n: int, table: str, checkpoint: str) -> None:
    """Bounded log: after each batch the stored newest n rows per key are merged
    with the new ones and written beside the old version, then pointed to."""
    from pagemill import scale

    def merge(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = df
        if batch > 0:
            rows = rows.unionByName(spark.read.parquet(f"{table}/version={batch - 1}"))
        top = scale.top_n_per_key(rows, [key], [F.col(order).desc()], n).drop("rank")
        top.write.mode("overwrite").parquet(f"{table}/version={batch}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def changed_files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*", kind: str = "parquet") -> DataFrame:
    """New files and files that changed since the last run, as a stream."""
    from pagemill.sources.changes import ChangedFiles

    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").schema(schema).option("path", folder).option("glob", glob).option("kind", kind).load()


def changing_index(stream: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], store: BucketStore, checkpoint: str) -> None:
    """Documents that come again take the place of their earlier chunks; only the buckets of
    the batch's documents are rewritten, and a repeated batch gives the same table.

    Of several rows of a document in one batch all are indexed.
    """
    def index(df: DataFrame, batch: int) -> None:
        rows = build(df)
        if store.exists():
            store.replace_rows(df.select(key), rows)
        else:
            store.create(rows)

    q = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def incremental_index(stream: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """New documents become chunk rows. Each batch owns one folder, so a repeated
    batch replaces its rows; documents already indexed are left out."""
    def index(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key])
        if batch > 0:
            known = spark.read.parquet(sink).filter(F.col("batch") < batch).select(key).distinct()
            fresh = fresh.join(known, key, "left_anti")
        build(fresh).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    q = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
