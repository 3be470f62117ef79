"""Shards by a k-d tree over document metadata.

A node holds documents and a number of leaves to make of them. It is cut along its widest
dimension (range within the node over range of the table) at the weighted median: the
value that leaves the left leaves' share of the bytes on the left. Medians are found for
all nodes of a level at once by histograms: each pass counts the bytes of at most BUCKETS
value ranges per node and looks on inside the range that holds the median, until it
weighs next to nothing. Bytes on one value are cut on by text hash, so equal texts stay
together unless their group itself straddles the cut, and then by key hash. Only the
histograms reach the driver: nodes x BUCKETS rows.

The cuts are a CASE expression over a row's own columns, so sharding a table moves no
row. Slots come from counts of (shard, key-hash bucket) and a ranking within each bucket.

Defined results: a null text weighs 1 byte and has the checksum of an empty text; rows
equal in text and key go to one shard; an empty table has no rows. Null metadata counts
as the smallest value. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored

BUCKETS = 1024
HASHES = 1 << 40
SLOT_ROWS = 50_000  # wanted rows in one ranking


@dataclass(frozen=True)
class Cut:
    """Left of the cut: lexicographically below the values, or equal in all of them."""

    columns: tuple[str, ...]
    values: tuple[float, ...]
    closed: bool

    def left(self) -> Column:
        test = F.col(self.columns[-1]) <= F.lit(self.values[-1]) if self.closed else F.col(self.columns[-1]) < F.lit(self.values[-1])
        for name, value in zip(self.columns[-2::-1], self.values[-2::-1], strict=True):
            test = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
        return test


def coordinates(key: Column, text: Column) -> dict[str, Column]:
    """Size, checksum, dimensions and tie hashes of a row; all but the last from the text alone."""
    given = F.coalesce(text, F.lit(""))
    size = (F.octet_length(given) + 1).cast("long")
    blanks = F.length(given) - F.length(F.translate(given, " ", "")) + 1
    return {
        "size": size, "text_crc32": F.crc32(given.cast("binary")),
        "d_size": F.log2(size), "d_word": F.length(given) / blanks, "d_ascii": F.length(given) / size,
        "h_text": F.pmod(F.xxhash64(given), F.lit(HASHES)).cast("double"),
        "h_key": F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(1)), F.lit(HASHES)).cast("double"),
    }


def metadata(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, *[c.alias(n) for n, c in coordinates(F.col(key), F.col(text)).items()])


def node_of(cuts: dict[int, Cut], upto: int | None = None) -> Column:
    """Node number (root 1, children 2n and 2n+1) of a row by the cuts made so far."""

    def walk(n: int) -> Column:
        if n not in cuts:
            return F.lit(n)
        return F.when(cuts[n].left(), walk(2 * n)).otherwise(walk(2 * n + 1))

    return walk(1)


def medians(rows: DataFrame, wanted: dict[int, tuple[str, float]], weight: str, ties: list[str], slack: float) -> dict[int, Cut]:
    """A cut for each node: wanted[node] = (dimension, bytes on its left)."""
    open_ = {n: {"at": (), "fixed": (), "lo": None, "hi": None, "below": 0.0, "left": left, "order": [dim, *ties]} for n, (dim, left) in wanted.items()}
    done: dict[int, Cut] = {}
    while open_:
        value, low, high, use = (F.lit(None).cast("double") for _ in range(4))
        for n, o in open_.items():
            mine = F.col("node") == n
            for name, at in zip(o["order"], o["fixed"], strict=False):
                mine = mine & (F.col(name) == F.lit(at))
            name = o["order"][len(o["fixed"])]
            if o["lo"] is not None:
                mine = mine & F.col(name).between(F.lit(o["lo"]), F.lit(o["hi"]))
            value = F.when(mine, F.col(name).cast("double")).otherwise(value)
            low = F.when(mine, F.lit(o["lo"])).otherwise(low)
            high = F.when(mine, F.lit(o["hi"])).otherwise(high)
        chosen = rows.select("node", F.col(weight).alias("_w"), value.alias("v"), low.alias("lo"), high.alias("hi")).filter("v IS NOT NULL")
        edges = {}
        fresh = [n for n, o in open_.items() if o["lo"] is None]
        if fresh:
            for r in chosen.filter(F.col("node").isin(fresh)).groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                edges[r["node"]] = (r["lo"], r["hi"])
            for n in fresh:
                open_[n]["lo"], open_[n]["hi"] = edges[n]
            continue
        bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(0)
        counted: dict[int, list] = {}
        for r in chosen.groupBy("node", bucket.alias("b")).agg(F.sum("_w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counted.setdefault(r["node"], []).append((r["b"], float(r["w"]), r["lo"], r["hi"]))
        for n, bars in counted.items():
            o, below = open_[n], open_[n]["below"]
            for _, w, lo, hi in sorted(bars):
                if below + w >= o["left"]:
                    break
                below += w
            columns = tuple(o["order"][: len(o["fixed"]) + 1])
            last = len(o["fixed"]) + 1 == len(o["order"])
            if w <= slack or (lo == hi and last):
                keep = below + w - o["left"] <= o["left"] - below  # the whole bar to the nearer side
                done[n] = Cut(columns, (*o["fixed"], hi if keep else lo), keep)
            elif lo == hi:
                o["fixed"], o["lo"], o["hi"], o["below"] = (*o["fixed"], lo), None, None, below
            else:
                o["lo"], o["hi"], o["below"] = lo, hi, below
        for n in list(done):
            open_.pop(n, None)
    return done


def grow(rows: DataFrame, dims: list[str], leaves: int, weight: str = "size", ties: tuple[str, ...] = ("h_text", "h_key"), slack: float = 0.002) -> dict[int, Cut]:
    """Cuts by node number until there are `leaves` leaves."""
    spread = [F.max(d).alias(f"hi_{d}") for d in dims] + [F.min(d).alias(f"lo_{d}") for d in dims]
    whole = rows.agg(F.sum(weight).alias("w"), *spread).first()
    cuts: dict[int, Cut] = {}
    if whole["w"] is None:
        return cuts
    target, level = whole["w"] / leaves, {1: leaves}
    while any(m > 1 for m in level.values()):
        split = {n: m for n, m in level.items() if m > 1}
        placed = rows.withColumn("node", node_of(cuts)).filter(F.col("node").isin(list(split)))
        wanted = {}
        for r in placed.groupBy("node").agg(F.sum(weight).alias("w"), *spread).collect():
            width = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / ((whole[f"hi_{d}"] - whole[f"lo_{d}"]) or 1.0) for d in dims}
            wanted[r["node"]] = (max(dims, key=lambda d: width[d]), r["w"] * (split[r["node"]] // 2) / split[r["node"]])  # noqa: B023
        cuts |= medians(placed, wanted, weight, list(ties), slack * target)
        level = {c: m for n, k in level.items() for c, m in (((2 * n, k // 2), (2 * n + 1, k - k // 2)) if n in cuts else ((n, 1),))}
    return cuts


def shard_of(cuts: dict[int, Cut]) -> Column:
    """Shard number, leaves from left to right."""

    def leaves(n: int) -> list[int]:
        return leaves(2 * n) + leaves(2 * n + 1) if n in cuts else [n]

    order = F.create_map(*[F.lit(x) for i, n in enumerate(leaves(1)) for x in (n, i)])
    return order[node_of(cuts)]


def slots(rows: DataFrame, shard: str, key: str, hashed: str, ties: list[str]) -> DataFrame:
    """Adds slot: gapless from 0 within a shard, without one task per shard."""
    total = rows.count()
    buckets = max(32, -(-total // SLOT_ROWS))
    placed = rows.withColumn("_b", F.floor(F.col(hashed) / (HASHES / buckets)).cast("int"))
    counts = placed.groupBy(shard, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(shard, "_b").orderBy(hashed, key, *ties)
    return placed.withColumn("_r", F.row_number().over(inside)).join(offsets, [shard, "_b"]).withColumn("slot", (F.col("_from") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_from")


def balanced_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """key, size, text_crc32, shard, slot of every row: shards of nearly equal bytes."""
    rows = stored(metadata(docs, key, text))
    cuts = grow(rows, ["d_size", "d_word", "d_ascii"], shards)
    placed = rows.withColumn("shard", shard_of(cuts))
    return slots(placed, "shard", key, "h_key", ["text_crc32", "size"]).select(key, "size", "text_crc32", "shard", "slot")


def with_shard(docs: DataFrame, cuts: dict[int, Cut], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole rows with their shard, ready for a write partitioned by it; no shuffle."""
    facts = docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in coordinates(F.col(key), F.col(text)).items()])
    return facts.select("_row.*", shard_of(cuts).alias("shard"))
