"""Building blocks that keep hot keys and global orders out of single tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import materialize

# Largest table that is broadcast or read to the driver, in rows.
SMALL_ROWS = 100_000
# Largest table that is broadcast, in bytes of its stored files.
SMALL_BYTES = 32 << 20


def stored_bytes(df: DataFrame) -> int:
    """Length of the files of a stored table."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def spread(df: DataFrame) -> DataFrame:
    """More partitions for text-heavy input that arrives in fewer than there are
    cores; input of many files or row groups is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def maybe_broadcast(df: DataFrame, limit: int = SMALL_ROWS, stored: bool = False) -> DataFrame:
    """Broadcast hint behind a count of rows and bytes; beyond the limits the join shuffles.

    The side is written to the checkpoint folder first (unless it already is a
    stored table), so the check reads file footers and nothing is computed twice.
    """
    side = df if stored else materialize(df)
    return F.broadcast(side) if side.count() <= limit and stored_bytes(side) <= SMALL_BYTES else side


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key. The rank filter is pushed below the shuffle
    (window group limit), so each map task forwards at most n rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Row with the smallest order value per key, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def keep_computed(df: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Filter on costly computed columns without computing them twice.

    A plain filter would be pushed below the projection and repeat its
    expressions; the row test here sits in a generator that stays above it.
    """
    rows = F.array(F.struct(F.lit(True).alias("_keep"), *df.columns))
    return df.select(F.inline_outer(F.filter(rows, test))).filter("_keep IS NOT NULL").drop("_keep")


def rows_of(df: DataFrame, keep: list, array: Column | str, value: str, pos: str | None = None) -> DataFrame:
    """One row per array element, as explode gives it.

    A plain explode makes the optimizer add a size test on the array below the
    projection, which computes a costly array twice; the outer form does not.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias("_pos", value)).filter("_pos IS NOT NULL")
    if pos is None:
        return out.drop("_pos")
    return out.withColumn(pos, F.col("_pos").cast("long")).drop("_pos")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys in which null equals null; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, test).drop(*[f"_r_{k}" for k in keys])


def segment_of(order_value: Column, width: int) -> Column:
    return F.floor(order_value / width).cast("long")


def segment_width(df: DataFrame, keys: list[str], order: str, target: int = 1_000_000) -> int:
    """Width of the order segments at which the largest key yields about `target`
    rows per segment. One aggregate with a map-side combine; one row comes back."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    row = per_key.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if row["n"] is None:
        return 1
    return max(1, (int(row["hi"]) - int(row["lo"]) + 1) * target // row["n"])


def with_previous(df: DataFrame, keys: list[str], order: str, width: int, tie: str, prev: str = "prev") -> DataFrame:
    """lag(order) per key without one task per key.

    Rows are ordered inside (key, segment of the order value); the first row of a
    segment takes the largest value of the key's previous non-empty segment, which
    comes from a table of one row per key and segment.
    """
    seg = df.withColumn("_seg", segment_of(F.col(order), width))
    ends = seg.groupBy(*keys, "_seg").agg(F.max(order).alias("_end"))
    carried = ends.select(*keys, "_seg", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_seg")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_seg").orderBy(order, tie)
    return (
        join_null_safe(seg.withColumn(prev, F.lag(order).over(inside)), carried, [*keys, "_seg"])
        .withColumn(prev, F.coalesce(F.col(prev), F.col("_carry")))
        .drop("_seg", "_carry")
    )


def running_sum(df: DataFrame, keys: list[str], order: str, width: int, tie: str, value: Column, out: str) -> DataFrame:
    """Inclusive running sum per key: inside segments plus the total of earlier ones."""
    seg = df.withColumn("_seg", segment_of(F.col(order), width)).withColumn("_v", value)
    totals = seg.groupBy(*keys, "_seg").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_seg", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_seg").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_null_safe(seg.withColumn(out, F.sum("_v").over(inside)), offsets, [*keys, "_seg"])
        .withColumn(out, F.col(out) + F.col("_o")).drop("_seg", "_v", "_o")
    )


def trailing_window(df: DataFrame, keys: list[str], order: str, span: int, aggregates: dict[str, Callable]) -> DataFrame:
    """Aggregates over the last `span` order units per row, (value - span, value].

    Rows are grouped by (key, segment as wide as the span); each row is also sent
    once to the next segment as a halo, so a frame never leaves its group.
    """
    seg = segment_of(F.col(order), span)
    own = df.withColumn("_seg", seg).withColumn("_halo", F.lit(False))
    halo = df.withColumn("_seg", seg + 1).withColumn("_halo", F.lit(True))
    w = Window.partitionBy(*keys, "_seg").orderBy(order).rangeBetween(-(span - 1), 0)
    both = own.unionByName(halo)
    return both.withColumns({name: fn(w) for name, fn in aggregates.items()}).filter(~F.col("_halo")).drop("_seg", "_halo")


# Rows between two marks that are few enough to be sorted as one list.
FEW_VALUES = 10_000


def order_statistics(v: DataFrame, ranks: list[int], total: int, accuracy: int = 100_000) -> dict[int, float]:
    """Values at the given ranks (from 0) of a column `v` without nulls, by distributed selection.

    A sketch sets two marks around each rank; one aggregate counts the rows below, at and
    between the marks. A rank that falls on a mark is known; else only the open range that
    holds it goes on, a few parts in 100,000 of the rows, until those can be sorted as a
    short list. Nothing is ranked across the whole table, and repeated values cost nothing.
    """
    found: dict[int, float] = {}
    # per rank: open range (low, high) that holds it, rows before the range, rows inside
    ranges = {r: (None, None, 0, total) for r in ranks}
    value = F.col("v")

    def inside(low, high):
        return (F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value < high)

    while ranges:
        small = {r: x for r, x in ranges.items() if x[3] <= FEW_VALUES}
        if small:
            lists = v.agg(*[F.sort_array(F.collect_list(F.when(inside(*x[:2]), value))).alias(f"r{r}") for r, x in small.items()]).first()
            found |= {r: lists[f"r{r}"][r - x[2]] for r, x in small.items()}
            ranges = {r: x for r, x in ranges.items() if r not in small}
            continue
        eps = 4.0 / accuracy
        shares = {r: (r - x[2] + 1) / x[3] for r, x in ranges.items()}
        marks = v.agg(*[F.percentile_approx(F.when(inside(*x[:2]), value), [max(0.0, shares[r] - eps), min(1.0, shares[r] + eps)], accuracy).alias(f"r{r}") for r, x in ranges.items()]).first()
        tests = []
        for r, x in ranges.items():
            low, high = marks[f"r{r}"]
            here = inside(*x[:2])
            for name, test in (("below", value < low), ("low", value == low), ("between", (value > low) & (value < high)), ("high", value == high)):
                tests.append(F.count_if(here & test).alias(f"{name}{r}"))
        counts = v.agg(*tests).first()
        following = {}
        for r, (low, high, before, n) in ranges.items():
            a, b = marks[f"r{r}"]
            at = r - before
            under, first, middle, last = counts[f"below{r}"], counts[f"low{r}"], counts[f"between{r}"], counts[f"high{r}"]
            if a == b:
                last = 0
            if at < under:
                following[r] = (low, a, before, under)
            elif at < under + first:
                found[r] = a
            elif at < under + first + middle:
                following[r] = (a, b, before + under + first, middle)
            elif at < under + first + middle + last:
                found[r] = b
            else:
                after = under + first + middle + last
                following[r] = (b, high, before + after, n - after)
        ranges = following
    return found


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles of a whole table as one row."""
    v = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    total = v.count()
    one = df.sparkSession.range(1)
    if total == 0:
        return one.select(*[F.lit(None).cast("double").alias(n) for n in probs])
    places = {n: p * (total - 1) for n, p in probs.items()}
    found = order_statistics(v, sorted({r for x in places.values() for r in (int(x), min(int(x) + 1, total - 1))}), total)
    ends = {n: (found[int(x)], found[min(int(x) + 1, total - 1)]) for n, x in places.items()}
    return one.select(*[F.lit(a + (b - a) * (places[n] - int(places[n])) if a != b else a).cast("double").alias(n) for n, (a, b) in ends.items()])
