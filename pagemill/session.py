"""Session set-up and the durable checkpoint folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "pagemill") -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a parquet table in the shared checkpoint folder.

    The written table survives the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("table-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def version_of(df: DataFrame) -> str:
    """Digest of the files a table is read from: their paths, lengths and times of change."""
    spark, digest = df.sparkSession, hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        digest.update(f"{name}:{status.getLen()}:{status.getModificationTime()};".encode())
    return digest.hexdigest()[:32]


def kept(name: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() derives from source, written once for each version of it.

    Later calls of the application read what the first one wrote. A new version of the
    source takes the place of the earlier one, which is removed. The folder is written under
    another name first, so a broken write is never read.
    """
    spark = source.sparkSession
    home = f"{checkpoint_root(spark)}/kept-{spark.sparkContext.applicationId}/{name}"
    version, path_of = version_of(source), spark._jvm.org.apache.hadoop.fs.Path
    place = path_of(f"{home}/{version}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        df, draft = build(), path_of(f"{home}/draft-{uuid.uuid4().hex}")
        df.write.parquet(draft.toString())
        for old in files.listStatus(path_of(home)):
            if not old.getPath().getName().startswith("draft-"):
                files.delete(old.getPath(), True)
        if not files.rename(draft, place):
            files.delete(draft, True)  # another thread was faster
    return spark.read.parquet(place.toString())


def kept_path(spark: SparkSession, name: str) -> str:
    """Folder for a table that a query of this application writes anew each time it runs."""
    return f"{checkpoint_root(spark)}/kept-{spark.sparkContext.applicationId}/{name}"


def forget_kept(spark: SparkSession) -> None:
    """Removes all tables that kept() wrote for this application."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/kept-{spark.sparkContext.applicationId}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
