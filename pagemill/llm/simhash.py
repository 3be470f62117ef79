"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A fingerprint bit is set where over half of the text's shingle hashes (XXH64 of the UTF-8
bytes, seed 42) have it. Equal fingerprints are one node. A tree of vantage points, grown
on a bounded sample, deals the nodes into shards: at each point p with radius r a node
goes inside when d(node, p) <= r, else outside. By the triangle inequality a partner
within `bits` of a node can only lie inside when d <= r + bits and only outside when
d > r - bits, so every node is also sent as a query to the shards its bounds overlap. A
shard grows a tree of its own over its nodes, prunes by the same bounds, and compares
exactly at the leaves. It returns links that connect its nodes as its pairs do, at most
one per node and query, never all pairs of a dense group; components follow from those.

Defined results: a null or wordless text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle of all words; repeated rows share node and
component; a null key never names a component, unless all keys in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.components import components

LEAF = 64  # nodes of a shard's tree that are compared directly
SAMPLE = 65_536  # fingerprints that the driver grows the sharding tree on, at most
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    found = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), 42)], np.uint64)
    runs = zip(*[found[i:] for i in range(words)], strict=False)
    return np.fromiter([digest(s, 42) for s in map(b" ".join, runs)], np.uint64, len(found) - words + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Majority of the hashes' bits, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """`keep` columns and the fingerprint (bigint) of every whole text."""
    given = docs.select(*keep, text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(shingle_hashes(t.as_py(), words)) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints, pa.int64())], names=[*keep, "fingerprint"])

    return given.mapInArrow(made, given.select(*keep).schema.add("fingerprint", "long"))


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage_point(prints: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Point and radius, out of a few, that split evenly and leave few nodes near the border."""
    best, found = np.inf, None
    for p in rng.choice(prints, min(8, len(prints)), replace=False):
        d = _distance(prints, p)
        for r in np.unique(np.quantile(d, [0.35, 0.5, 0.65]).astype(int)):
            inside = np.mean(d <= r)
            if 0 < inside < 1:
                loss = np.mean(np.abs(d - r) <= bits) + 2 * abs(inside - 0.5) ** 2
                if loss < best:
                    best, found = loss, (p, int(r))
    return found


def grow(prints: np.ndarray, leaf: float, bits: int, seed: int = 5) -> list[tuple[int, int, int, int]]:
    """Tree as rows (point, radius, inside, outside); a negative child -k-1 is shard k."""
    rng, rows, shards = np.random.default_rng(seed), [], 0

    def node(part: np.ndarray) -> int:
        nonlocal shards
        split = vantage_point(part, bits, rng) if len(part) > leaf else None
        if split is None:
            shards += 1
            return -shards
        at = len(rows)
        rows.append(None)
        d = _distance(part, split[0])
        rows[at] = (int(split[0]), split[1], node(part[d <= split[1]]), node(part[d > split[1]]))
        return at

    node(prints)
    return rows


def shards_of(prints: np.ndarray, tree: list[tuple[int, int, int, int]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of prints, shard, home) for every shard in which a partner may lie."""
    if not tree:
        return np.arange(len(prints)), np.zeros(len(prints), np.int32), np.ones(len(prints), bool)
    out, todo = [], [(0, np.arange(len(prints)), np.ones(len(prints), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, np.full(len(rows), -at - 1, np.int32), home))
            continue
        point, radius, inside, outside = tree[at]
        d = _distance(prints[rows], np.uint64(point))
        near, far = d <= radius + bits, d > radius - bits
        todo.append((inside, rows[near], (home & (d <= radius))[near]))
        todo.append((outside, rows[far], (home & (d > radius))[far]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def links_of_shard(nodes: np.ndarray, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join nodes and queries as all pairs within `bits` do.

    Pairs are looked up through a vantage-point tree over the nodes and taken into a
    union-find at once, so only links that connect something new remain.
    """
    every = np.unique(np.concatenate([nodes, queries]))
    parent = np.arange(len(every))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, rng = [], [], np.random.default_rng(11)
    todo = [(np.unique(nodes), every)]
    while todo:
        part, asked = todo.pop()
        split = vantage_point(part if len(part) < 512 else rng.choice(part, 512, replace=False), bits, rng) if len(part) > LEAF and len(asked) else None
        if split is not None:
            d, e = _distance(part, split[0]), _distance(asked, split[0])
            todo.append((part[d <= split[1]], asked[e <= split[1] + bits]))
            todo.append((part[d > split[1]], asked[e > split[1] - bits]))
            continue
        step = max(1, 4_000_000 // max(1, len(part)))
        for lo in range(0, len(asked), step):
            block = asked[lo:lo + step]
            q, n = np.nonzero(_distance(block[:, None], part[None, :]) <= bits)
            x, y = block[q], part[n]
            differ = x != y
            for i, j in zip(np.searchsorted(every, x[differ]).tolist(), np.searchsorted(every, y[differ]).tolist(), strict=True):
                ri, rj = root(i), root(j)
                if ri != rj:
                    parent[max(ri, rj)] = min(ri, rj)
                    left.append(i)
                    right.append(j)
    return every[left] if left else every[:0], every[right] if right else every[:0]


def near_links(prints: DataFrame, bits: int = 2, shard: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fingerprint) within `bits`.

    The sample of at most SAMPLE fingerprints grows the tree; every fingerprint is
    sharded and asked. `shard` is the wanted number of nodes per shard.
    """
    spark = prints.sparkSession
    total = prints.count()
    take = min(1.0, SAMPLE / max(1, total))
    sampled = prints.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 20)) < int(take * 0.9 * (1 << 20)) + 1).limit(SAMPLE).toPandas()
    sample = np.sort(sampled["fingerprint"].to_numpy(np.int64).view(np.uint64))
    tree = grow(sample, max(2.0, shard * len(sample) / max(1, total)), bits)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            rows, shards, home = shards_of(values, shared.value, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(values.view(np.int64)[rows]), pa.array(home)], names=["shard", "p", "home"])

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        values, home = part["p"].to_numpy(np.int64).view(np.uint64), part["home"].to_numpy(bool)
        a, b = links_of_shard(values[home], values, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = prints.select("fingerprint").mapInArrow(route, "shard int, p long, home boolean")
    return dealt.groupBy("shard").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2, keep: list[str] | None = None) -> DataFrame:
    """key, `keep`, fingerprint (bigint) and component_id, the smallest key that links reach."""
    columns = [key, *(keep or [])]
    prints = stored(fingerprints(docs, columns, text, words))
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("_least")))
    links = stored(near_links(nodes, bits))
    joined = components(links)
    least = joined.join(nodes, joined["node"] == nodes["fingerprint"])
    least = least.groupBy("label").agg(F.min("_least").alias("_least"))
    moved = joined.join(least, "label").select(F.col("node").alias("fingerprint"), F.col("_least").alias("_group"))
    named = nodes.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("_group", "_least").alias("component_id"))
    return prints.join(named, "fingerprint").select(*columns, "fingerprint", "component_id")


def hex_digits(print_: str) -> Column:
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(print_)), 16, "0"))
