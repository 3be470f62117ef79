"""Exact top-k search by tiled matrix products.

Vectors are scaled and floored to integers. Queries and candidates are dealt by row number
into blocks of at most about QUERIES and SHARD rows; every query block meets every shard
once, in one matrix product (a tile). A tile keeps the best k candidates of each of its
queries by partial selection, and the lists of a query are merged FAN at a time until one
is left. What a task holds is bounded by the tile; queries are shuffled once for each shard
and candidates once for each query block, nothing is broadcast, and no pair leaves a tile
unless it is among its query's best k there.

Products are taken in doubles where every sum is below 2**53 and so exact, else in whole
numbers of any size, cut to the range of a long.

Defined results: vectors that are null or hold null or non-finite components take no part;
a query meets vectors of its own length only (an empty one scores 0 with other empty ones);
a row is never its own candidate, though a repeated row is; rows that repeat a key are
queries each; equal scores go to the smaller key, a null key last; a query without
candidates has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

QUERIES = 2_048  # rows of a query block
SHARD = 8_192  # rows of a shard
CELLS = 1 << 22  # scores that a tile holds at once
FAN = 8  # lists merged at once
LOW, HIGH = -(1 << 63), (1 << 63) - 1
LISTS = "row long, query_id long, shard int, top array<struct<down:long,keyless:int,key:long>>"


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int, is_query: Column) -> DataFrame:
    """(row, key, v, size, query) of the rows that take part; v holds floor(scale * x) in
    doubles, which are whole."""
    given = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    scaled = given.withColumn("v", F.transform("v", lambda x: x.cast("double") * F.lit(float(scale))))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above all
    return scaled.filter(F.coalesce(finite, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "key", "v", F.size("v").alias("size"), "query")


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers of equally long vectors."""
    components = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(components).reshape(len(vectors), -1) if len(components) else np.zeros((len(vectors), 0))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of whole-number matrices, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    left, right = (np.array([[int(x) for x in row] for row in m], object) for m in (a, b))
    return np.clip(left @ right.T, LOW, HIGH).astype(np.int64)


def best(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k highest values of each row, highest first, ties to the smaller column."""
    n = scores.shape[1]
    k = min(k, n)
    if k == 0:
        return [np.zeros(0, np.int64)] * len(scores)
    out = []
    for row, least in zip(scores, np.partition(scores, n - k, axis=1)[:, n - k], strict=True):
        over = np.flatnonzero(row > least)
        level = np.flatnonzero(row == least)[: k - len(over)]
        out.append(np.concatenate([over[np.argsort(~row[over], kind="stable")], level]))
    return out


def tile(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """Top lists of a query block in one shard."""
    shard = shard.sort_by([("held_key", "ascending"), ("held_row", "ascending")])  # null keys come last
    rows, keys = shard["held_row"].to_numpy(), shard["held_key"].to_pylist()
    asked, right = matrix(queries["v"]), matrix(shard["held_v"])
    own, tops = queries["row"].to_pylist(), []
    step = max(1, CELLS // max(1, len(shard)))
    for lo in range(0, len(queries) if len(shard) else 0, step):
        scores = exact_products(asked[lo:lo + step], right)
        for q, columns in enumerate(best(scores, k + 1), lo):
            mine = columns[rows[columns] != own[q]][:k]
            # ~score rises as score falls, for every long
            tops.append([{"down": int(~scores[q - lo, j]), "keyless": int(keys[j] is None), "key": keys[j]} for j in mine])
    some = queries.slice(0, len(tops))
    kind = pa.list_(pa.struct([("down", pa.int64()), ("keyless", pa.int32()), ("key", pa.int64())]))
    return pa.table({"row": some["row"], "query_id": some["key"], "shard": some["shard"], "top": pa.array(tops, kind)})


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, the key and score of the k rows of highest inner product with each query row."""
    every = stored(whole_vectors(vectors, key, vector, scale, is_query))
    sizes = every.agg(F.count("*").alias("n"), F.count_if("query").alias("asked"), F.coalesce(F.max("size"), F.lit(1)).alias("size")).first()
    rows = max(1, min(SHARD, CELLS // max(1, sizes["size"])))
    shards, blocks = max(1, -(-sizes["n"] // rows)), max(1, -(-sizes["asked"] // min(QUERIES, rows)))
    dealt = lambda parts, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = every.filter("query").withColumn("block", dealt(blocks, "block")).select("row", "key", "v", "size", "block", each(shards).alias("shard"))
    held = every.withColumn("part", dealt(shards, "shard")).select(
        *[F.col(c).alias(f"held_{c}") for c in ("row", "key", "v", "size", "part")], each(blocks).alias("held_block"))
    lists = asked.groupBy("size", "block", "shard").cogroup(held.groupBy("held_size", "held_block", "held_part")).applyInArrow(lambda a, b: tile(a, b, k), LISTS)
    while shards > 1:
        node = F.floor(F.col("shard") / FAN).cast("int")
        lists = lists.groupBy("row", "query_id", node.alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        shards = -(-shards // FAN)
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.key").alias(key), F.bitwise_not("hit.down").alias("score"))
