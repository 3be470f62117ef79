"""Line dedup by a segment-partition edit join.

Two lines within `limit` edits share at least one of limit + 1 segments: every line indexes
its even segments under (its length, segment number), and probes, for each length it can
be a partner of, the substrings that may match a segment (the multi-match-aware windows).
Keys that meet an index entry and at least two different lines are live. Live keys of few
lines give candidate pairs; in larger ones the lines are clustered from pivot to pivot, so
a dense group costs one comparison per line, and groups beyond BLOCK lines are dealt into
cells of block pairs. Candidates are verified by banded bit-parallel edit distance. Linked
lines form classes; the first line of a class by (key, line number) stays, wherever it is.

A line is known by a 128-bit hash; live keys are searched on 63 bits of it, which only
widens the candidates. Copies of a line within a task's part are indexed once.

Defined results: lines shorter than `min_chars` are never near; with `short` their exact
repeats go, where they hold a letter or digit, and without it they are left alone; a null text stays null and
has no lines; null keys come first; identical rows (key and text) share their fate; ties
cannot occur otherwise. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import discard, stored
from pagemill.llm.components import components
from pagemill.llm.edit_distance import histograms, within

FEW = 40  # lines of a key that are paired directly
BLOCK = 2_000  # lines of a key that are clustered in one group
SEEN = 500_000  # line hashes a task remembers to skip copies
WANTED = 500_000  # candidate ids (8 bytes each) that may be broadcast


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of even segments, the longer ones last."""
    size, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        own = size + (i >= parts - more)
        out.append((at, own))
        at += own
    return out


def probes(length: int, limit: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, is index entry) of the substrings a line of this length looks up."""
    out = []
    for lack in range(min(limit, length) + 1):
        for i, (at, size) in enumerate(segments(length - lack, limit + 1)):
            low = max(0, at - i, at + lack - (limit - i))
            high = min(length - size, at + i, at + lack + (limit - i))
            out += [(p, p + size, (length - lack) * (limit + 1) + i, lack == 0 and p == at) for p in range(low, high + 1)]
    return out


def line_id(line: str) -> bytes:
    return xxhash.xxh128_digest(line.encode("utf-8", "surrogatepass"))


def short_id(whole: bytes) -> int:
    return int.from_bytes(whole[:8], "big") >> 1


def long_lines(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    return [(i, line) for i, line in enumerate(text.split("\n")) if len(line) >= min_chars] if text else []


def occurrences(docs: DataFrame, key: str, text: str, min_chars: int, short: bool = False) -> DataFrame:
    """(key, mark, line, id) of every line of at least min_chars, and with `short` of every
    line with a letter or digit; mark is the text's hash."""
    given = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("t"))
    schema = given.select("key", "mark").schema.add("line", "integer").add("id", "binary")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, ids = [], [], []
            for r, t in enumerate(batch.column(2)):
                for i, line in long_lines(t.as_py(), 0 if short else min_chars):
                    if len(line) < min_chars and not any(map(str.isalnum, line)):
                        continue
                    rows.append(r)
                    numbers.append(i)
                    ids.append(line_id(line))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(ids, pa.binary())], names=schema.names)

    return given.mapInArrow(found, schema)


def looked_up(docs: DataFrame, text: str, min_chars: int, limit: int) -> DataFrame:
    """(k, v): substring keys, and twice the line's short id plus 1 for index entries."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        plans: dict[int, list] = {}
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                keys, values = [], []
                for t in batch.column(0).slice(lo, 512):
                    for _, line in long_lines(t.as_py(), min_chars):
                        whole = line_id(line)
                        if whole in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(whole)
                        own = short_id(whole) << 1
                        plan = plans.get(len(line))
                        if plan is None:
                            plan = plans[len(line)] = probes(len(line), limit)
                        for a, b, seed, index in plan:
                            keys.append(digest(line[a:b].encode("utf-8", "surrogatepass"), seed))
                            values.append(own | index)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(values, np.uint64).view(np.int64))], names=["k", "v"])

    return docs.select(text).mapInArrow(made, "k long, v long")


def live(rows: DataFrame) -> DataFrame:
    """Rows (k, id, index, n) of keys that meet an index entry and two different lines."""
    by = Window.partitionBy("k")
    own = F.shiftrightunsigned("v", 1)
    seen = rows.select("k", own.alias("id"), (F.col("v").bitwiseAND(1) == 1).alias("index"))
    seen = seen.withColumns({"_lo": F.min("id").over(by), "_hi": F.max("id").over(by), "_any": F.max("index").over(by), "n": F.count("*").over(by)})
    return seen.filter("_any AND _lo < _hi").groupBy("k", "id").agg(F.max("index").alias("index"), F.max("n").alias("n"))


def line_texts(docs: DataFrame, text: str, min_chars: int, wanted: DataFrame) -> DataFrame:
    """(id, whole, line) of the lines whose short id is wanted, each once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, wholes, lines = [], [], []
                for t in batch.column(0).slice(lo, 512):
                    for _, line in long_lines(t.as_py(), min_chars):
                        whole = line_id(line)
                        if whole not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(whole)
                            ids.append(short_id(whole))
                            wholes.append(whole)
                            lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wholes, pa.binary()), pa.array(lines, pa.string())], names=["id", "whole", "line"])

    every = docs.select(text).mapInArrow(made, "id long, whole binary, line string")
    side = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    return every.join(side, "id", "left_semi").dropDuplicates(["whole"])


def cluster(lines: list[str], limit: int) -> list[tuple[int, int]]:
    """Links that join the lines as all pairs within `limit` edits do, from pivot to pivot."""
    rest, links = np.arange(len(lines)), []
    counts, sizes = histograms(lines), np.array([len(x) for x in lines])
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            pivot = queue.pop()
            may = (np.abs(sizes[rest] - sizes[pivot]) <= limit) & (np.abs(counts[rest] - counts[pivot]).sum(1) <= 2 * limit)
            near = np.zeros(len(rest), bool)
            near[may] = within([lines[pivot]] * int(may.sum()), [lines[i] for i in rest[may]], limit)
            links += [(pivot, int(i)) for i in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return links


def near_links(docs: DataFrame, text: str, min_chars: int, limit: int) -> DataFrame:
    """Links (a, b) between the 128-bit ids of different lines within `limit` edits."""
    found = stored(live(looked_up(docs, text, min_chars, limit)))
    wanted = stored(found.select("id").distinct())
    texts = stored(line_texts(docs, text, min_chars, wanted))

    few = found.filter(F.col("n") <= FEW)
    other = few.select("k", F.col("id").alias("other"))
    pairs = few.filter("index").join(other, "k").filter("id <> other").select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y")).distinct()
    left = texts.select(F.col("id").alias("x"), F.col("whole").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("id").alias("y"), F.col("whole").alias("b"), F.col("line").alias("lb"))
    sized = pairs.join(left, "x").join(right, "y").select("a", "b", "la", "lb")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), limit)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    direct = sized.mapInArrow(verified, "a binary, b binary")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    many = found.filter(F.col("n") > FEW).withColumn("blocks", blocks).withColumn("own", own)
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = many.withColumn("partner", partner).select("k", "id", F.least("own", "partner").alias("c1"), F.greatest("own", "partner").alias("c2"))

    def clustered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("whole").sort_values("whole")
        wholes, links = part["whole"].tolist(), cluster(part["line"].tolist(), limit)
        return pd.DataFrame({"a": [wholes[i] for i, _ in links], "b": [wholes[j] for _, j in links]})

    dense = cells.join(texts, "id").select("k", "c1", "c2", "whole", "line").groupBy("k", "c1", "c2").applyInPandas(clustered, "a binary, b binary")
    links = stored(direct.unionByName(dense).distinct())
    for table in (found, wanted, texts):
        discard(table)
    return links


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 30, limit: int = 2, short: bool = False) -> DataFrame:
    """(key, mark, lines, near): numbers of the lines that go from each text; near counts
    those whose class stays under another wording."""
    lines = stored(occurrences(docs, key, text, min_chars, short))
    labels = components(near_links(docs, text, min_chars, limit)).select(F.col("node").alias("id"), F.col("label").alias("class"))
    per = lines.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("key", "mark", "line", "id")).alias("first"))
    named = per.join(labels, "id", "left").withColumn("class", F.coalesce("class", "id"))
    whole = named.groupBy("class").agg(F.sum("n").alias("_n"), F.min("first").alias("_first")).filter("_n > 1")
    fate = stored(named.join(whole, "class").select("id", F.col("_first").alias("stays")))
    same = F.col("key").eqNullSafe(F.col("stays.key")) & F.col("mark").eqNullSafe(F.col("stays.mark")) & (F.col("line") == F.col("stays.line"))
    gone = lines.join(fate, "id").filter(~same)
    return gone.groupBy("key", "mark").agg(
        F.collect_set("line").alias("lines"), F.count_if(F.col("id") != F.col("stays.id")).alias("near"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 30, limit: int = 2, short: bool = False) -> DataFrame:
    """The rows with repeated lines taken out of the text, and n_lines, n_dropped, n_near."""
    gone = dropped_lines(docs, key, text, min_chars, limit, short)
    row = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_t"), F.xxhash64(text).alias("_mark"))
    joined = row.join(gone, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_mark") == F.col("mark")), "left")
    split = joined.withColumn("_lines", F.split("_t", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "lines")
    kept = F.when(F.col("lines").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    names = [f.name for f in docs.schema if f.name != text]
    counts = {
        "n_lines": F.coalesce(F.when(F.col("_t").isNotNull(), F.size("_lines")), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long"), "n_near": F.coalesce("near", F.lit(0)).cast("long")}
    return split.select(*[F.col("_row")[n].alias(n) for n in names], kept.alias(text), *[c.alias(n) for n, c in counts.items()])

