"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

An item's windows are its runs of `window` words (all its words, where it has fewer). The
automaton holds each window once, with blanks around it, so it can only meet whole words;
it reads a document's normalised words once and gives every occurrence. A document word
inside an occurrence is hit; word numbers map back to places in the original text.

Windows are dealt into blocks of about MAX_NODES characters, the most nodes that an
automaton can have, by a hash of the window. One block is the usual case and one pass. With
more, the rows are stored once under a row number; the first block's pass gives every row,
the others only rows they hit, and runs and items unite by row number, so the result is the
same for any number of blocks. Blocks come to the driver one after the other, each behind
that bound, and go out as broadcasts; a task holds one automaton of at most about 250 MB.

Defined results: a null text has no words; a null or wordless item has no windows; an item
with a null id marks words but is not listed; rows of one item id unite; every document row
has its own result, repeated or not. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, folded_words, stored

MAX_NODES = 4_000_000  # characters of the windows in one automaton, about 50 bytes each
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # A-Z included: the original text


def windows_of(text: str | None, window: int) -> list[str]:
    words = [w.decode("utf-8", "replace") for w in folded_words(text)]
    if not words:
        return []
    return [" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))]


def automaton(windows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Windows with the ids that have them; a value is (words in the window, ids)."""
    found = ahocorasick.Automaton()
    for w, owners in windows:
        found.add_word(f" {w} ", (w.count(" ") + 1, owners))
    if windows:
        found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, disjoint hit runs [first, end) in words, and ids of the windows met."""
    words = folded_words(text)
    if not words or not len(machine):
        return len(words), [], set()
    normal = b" " + b" ".join(words) + b" "
    runs, owners, at, counted = [], set(), 0, 0
    read = normal.decode("utf-8", "replace")
    for last, (size, ids) in machine.iter(read):
        counted += read.count(" ", at, last + 1)  # blanks up to here; the window ends with word counted - 1
        at = last + 1
        end = counted - 1
        owners.update(ids)
        if runs and end - size <= runs[-1][1]:
            runs[-1] = (min(runs[-1][0], end - size), max(runs[-1][1], end))
            while len(runs) > 1 and runs[-1][0] <= runs[-2][1]:
                low, high = runs.pop()
                runs[-1] = (min(runs[-1][0], low), max(runs[-1][1], high))
        else:
            runs.append((end - size, end))
    return len(words), runs, owners


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans in the original text of runs of words."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def window_table(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(w, ids): every different window with the known ids of its items, stored."""
    given = items.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(set(windows_of(t, window)))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.string()), pa.array(own, pa.string())], names=["i", "w"])

    return stored(given.mapInArrow(cut, "i string, w string").groupBy("w").agg(F.sort_array(F.collect_set("i")).alias("ids")))


def blocks_of(windows: DataFrame) -> Iterator[list[tuple[str, list[str]]]]:
    """The windows as lists of about MAX_NODES characters; one empty list if there are none."""
    size = windows.agg(F.sum(F.length("w") + 2)).first()[0] or 0
    count = max(1, -(-size // MAX_NODES))
    part = windows.withColumn("b", F.pmod(F.xxhash64("w"), F.lit(count)))
    for b in range(count):
        yield [(r["w"], r["ids"]) for r in part.filter(F.col("b") == b).collect()]


def contamination(docs: DataFrame, items: DataFrame, key: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = 10) -> DataFrame:
    """Per document: `key` columns, n_words, runs (hit words), spans (characters), item_ids."""
    spark = docs.sparkSession
    kind = "array<struct<first:int,end:int>>"
    pairs = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def scanned(rows: DataFrame, keep: list[str], block: list[tuple[str, list[str]]], hits_only: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                at, counts, runs, spans, owners = [], [], [], [], []
                for number, value in enumerate(batch.column(len(keep))):
                    text_ = value.as_py()
                    n, hit, ids = scan(text_, machine)
                    if hits_only and not hit:
                        continue
                    at.append(number)
                    counts.append(n)
                    runs.append([{"first": a, "end": b} for a, b in hit])
                    spans.append([{"first": a, "end": b} for a, b in original_spans(text_ or "", hit)])
                    owners.append(sorted(ids))
                out = [pa.array(counts, pa.int64()), pa.array(runs, pairs), pa.array(spans, pairs), pa.array(owners, pa.list_(pa.string()))]
                kept = [c.take(pa.array(at, pa.int64())) if hits_only else c for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *out], names=[*keep, "n_words", "runs", "spans", "item_ids"])

        return rows.select(*keep, text).mapInArrow(run, f"{names}, n_words long, runs {kind}, spans {kind}, item_ids array<string>")

    windows = window_table(items, item, item_text, window)
    blocks = blocks_of(windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        discard(windows)
        return scanned(docs.select(*key, text), key, first, False)
    held = stored(docs.select(F.struct(*key).alias("_row"), text, F.monotonically_increasing_id().alias("_n")))
    found = stored(scanned(held, ["_n"], first, False))
    more = [stored(scanned(held, ["_n"], second, True))] + [stored(scanned(held, ["_n"], block, True)) for block in blocks]
    for part in more:
        found = found.unionByName(part)
    both = F.transform(F.arrays_zip("runs", "spans"), lambda p: F.struct(
        p["runs"]["first"].alias("first"), p["runs"]["end"].alias("end"), p["spans"]["first"].alias("from"), p["spans"]["end"].alias("to")))
    flat = found.groupBy("_n").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list(both)).alias("both"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    one = held.select("_row", "_n").join(flat.withColumn("both", merged("both")), "_n")
    part = lambda a, b: F.transform("both", lambda r: F.struct(r[a].alias("first"), r[b].alias("end")))
    return one.select(*[F.col("_row")[c].alias(c) for c in key], "n_words", part("first", "end").alias("runs"), part("from", "to").alias("spans"), "item_ids")


def merged(runs: str):
    """Union of word runs [first, end) with their places [from, to), as disjoint runs in order."""
    start = F.expr("cast(array() as array<struct<first:int,end:int,from:int,to:int>>)")

    def add(done, run):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (run["first"] <= last["end"])
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], run["end"]).alias("end"), last["from"].alias("from"), F.greatest(last["to"], run["to"]).alias("to"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), start, add)


def n_hit(runs: str = "runs"):
    return F.aggregate(F.col(runs), F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["first"]).cast("long"))


def digest(ids: list[str]) -> str:
    """Hex SHA-256 of ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def hit_words(runs: list[tuple[int, int]]) -> np.ndarray:
    return np.concatenate([np.arange(a, b) for a, b in runs]) if runs else np.zeros(0, np.int64)
