"""Target-distribution importance resampling with a distributed LSD radix sort.

Features of a text are its runs of 1 to `longest` folded words, each hashed into one of
`buckets`. Bucket counts of all source and all target texts give an array of gains, which
is as large as the number of buckets and is broadcast; a text's weight is the mean gain of
its features. A Gumbel draw from a hash of the key is added, and the highest sums are drawn.

The ranks come from a radix sort by stable counting passes, least significant digit of the
composite key first. A pass cuts the rows into blocks of the present order, counts each
block's digits, and turns the counts into global prefix offsets: rows of smaller digits
anywhere, then rows of the same digit in earlier blocks. A block then places its rows by
its offsets alone. Blocks have at most BLOCK rows whatever the keys are, so no key, however
common, makes a large task; every pass is a stored table, so a lost executor repeats one
pass at most. A key needs one pass for every 16 bits of its range.

Defined results: a null text has no features, and a text without features has weight 0; a
null key counts as an empty text in the draw and sorts after all keys; rows that agree in
score and key are ordered by their number of features, beyond which they are the same.
Repeated rows are ranked each. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import FOLD, discard, stored

DIGIT = 16  # bits of a digit
BLOCK = 1 << 18  # rows of a block


def buckets_of(text: bytes, longest: int, buckets: int) -> np.ndarray:
    """Bucket of every feature of a UTF-8 text."""
    words = text.translate(FOLD).split()
    runs = words if longest == 1 else [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def as_bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts per bucket. A task sends one row for each bucket it met."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                sums += np.bincount(buckets_of(value.as_py(), longest, buckets), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    per_task = texts.select(as_bytes(text).alias("t")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, floored."""
    size, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str, text: str = "text", longest: int = 1) -> DataFrame:
    """key, n_words, n_features and weight of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    given = docs.select(F.col(key).alias("key"), as_bytes(text).alias("t"))
    schema = given.select("key").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = shared.value
        for batch in batches:
            found = [buckets_of(value.as_py(), longest, len(array)) for value in batch.column(1)]
            sizes = np.array([len(x) for x in found], np.int64)
            sums = np.array([array[x].sum() for x in found], np.int64)
            # n words have n + (n - 1) + ... features
            words = sizes if longest == 1 else np.array([len(v.as_py().translate(FOLD).split()) for v in batch.column(1)], np.int64)
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums // np.maximum(sizes, 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(scored, schema)


def draw(key: Column, seed: str) -> Column:
    """1000 times a standard Gumbel value, floored, from a hash of seed and key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def offsets(counts: DataFrame) -> DataFrame:
    """(of, value, start): where a block's rows of a digit go in the order after the pass.

    The prefix over digits runs over at most 2**DIGIT rows, whatever the input.
    """
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before"))
    inside = counts.withColumn("own", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return inside.join(F.broadcast(digits), "digit").select(
        F.col("block").alias("of"), F.col("digit").alias("value"), (F.col("before") + F.col("own")).alias("start"))


def place(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """Stable counting sort of one block: every row's place in the whole order."""
    rows = rows.sort_by("pos")
    digit = rows["digit"].to_numpy().astype(np.uint16)
    order = np.argsort(digit, kind="stable")
    sizes = np.bincount(digit, minlength=1 << DIGIT)
    inside = np.empty(len(digit), np.int64)
    inside[order] = np.arange(len(digit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.zeros(1 << DIGIT, np.int64)
    start[starts["value"].to_numpy()] = starts["start"].to_numpy()
    return rows.drop_columns(["block", "digit", "pos"]).append_column("pos", pa.array(start[digit] + inside))


def radix_ranks(rows: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Rows with their place from 1 in ascending order of long columns without nulls, the
    first of `keys` counting most. Rows that agree in all of them get any order."""
    given = stored(rows.withColumn("pos", F.monotonically_increasing_id()))
    ends = given.agg(F.count("*").alias("n"), *[f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)]).first()
    spans = [(k, ends[f"min{i}"], ends[f"max{i}"]) for i, k in enumerate(keys)] if ends["n"] else []
    passes = []
    for name, low, high in reversed(spans):
        wide = high - low >= 1 << 63  # there the sign bit is turned instead, which keeps the order too
        plain = F.col(name).bitwiseXOR(F.lit(-(1 << 63))) if wide else F.col(name) - F.lit(low)
        passes += [F.shiftrightunsigned(plain, shift) for shift in range(0, 64 if wide else (high - low).bit_length(), DIGIT)]
    if ends["n"] and not passes:
        passes = [F.lit(0).cast("long")]  # all keys agree: one pass closes the gaps between places
    for digit in passes:
        cut = given.withColumns({"block": F.floor(F.col("pos") / BLOCK).cast("long"), "digit": digit.bitwiseAND((1 << DIGIT) - 1).cast("int")})
        starts = offsets(cut.groupBy("block", "digit").agg(F.count("*").alias("n")))
        passed = stored(cut.groupBy("block").cogroup(starts.groupBy("of")).applyInArrow(place, given.schema))
        discard(given)
        given = passed
    return given.withColumn(rank, F.col("pos") + 1).drop("pos")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
             buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """key (a long), n_features, weight, score and rank of every row; rank is null where it is not drawn.

    Of the rows with at least `min_words` words, `percent` per cent are drawn without replacement.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = stored(weighed(docs, gain, key, text, longest).withColumn("score", F.col("weight") + draw(F.col("key"), seed)))
    long_enough = F.col("n_words") >= min_words
    drawn = scored.filter(long_enough).count() * percent // 100
    sides = {"down": -F.col("score"), "keyless": F.col("key").isNull().cast("long"), "id": F.coalesce("key", F.lit(0)).cast("long")}
    ranked = radix_ranks(scored.filter(long_enough).withColumns(sides), ["down", "keyless", "id", "n_features"])
    names = [F.col("key").alias(key), "n_features", "weight", "score"]
    return ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.filter(~long_enough).select(*names, F.lit(None).cast("long").alias("rank")))
