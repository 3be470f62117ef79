"""Text to chunk rows. Fixed strides are array expressions; the packing folds,
which look at the text while they cut, run in one Arrow pass, a row at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.scale import rows_of

SENTENCE_BREAK = re.compile(r"[.!?]+\s+")
PARAGRAPH_BREAK = re.compile(r"\n\s*\n")


def word_chunks(df: DataFrame, text: str, out: str = "chunks", size: int = 1000, overlap: int = 200, cap: int | None = None, min_chars: int = 50) -> DataFrame:
    """Windows of `size` words every size - overlap; `cap` is the caller's limit.

    The words are a column, so that the windows slice them instead of splitting
    the text again for every window.
    """
    w = F.col("_w")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    pieces = F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")), lambda t: F.length(t) > min_chars)
    return df.withColumn("_w", tx.words(F.col(text))).withColumn(out, pieces if cap is None else F.slice(pieces, 1, cap)).drop("_w")


def stride_chunks(c: Column, size: int = 500, overlap: int = 50) -> Column:
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size))), tx.not_blank)


def merge_chunk_array(chunks: Column, max_size: int = 2000) -> Column:
    """Greedy packing with single blanks: a fold over the lengths finds where groups open, slices join them."""
    none = F.struct(F.array().cast("array<int>").alias("opens"), F.lit(0).alias("used"), F.lit(0).alias("seen"))

    def place(acc: Column, n: Column) -> Column:
        fresh = (acc["seen"] == 0) | (acc["used"] + n >= max_size)
        opens = F.when(fresh, F.concat(acc["opens"], F.array(acc["seen"]))).otherwise(acc["opens"])
        used = F.when(fresh | (acc["used"] == 0), n).otherwise(acc["used"] + n + 1)
        return F.struct(opens.alias("opens"), used.alias("used"), (acc["seen"] + 1).alias("seen"))

    opens = F.aggregate(F.transform(chunks, lambda c: F.length(c)), none, place, lambda acc: acc["opens"])

    def joined(s: Column) -> Column:
        ends = F.concat(F.slice(s["opens"], 2, 2_000_000_000), F.array(F.size(s["all"])))
        return F.zip_with(s["opens"], ends, lambda i, j: tx.strip(F.array_join(F.slice(s["all"], i + 1, j - i), " ")))

    # the one-element array names chunks and openings, so that no slice computes them again
    bound = F.array(F.struct(chunks.alias("all"), opens.alias("opens")))
    return F.filter(F.transform(bound, joined)[0], lambda t: t != "")


def explode_chunks(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    return rows_of(df, [key], chunks, "content", "chunk_index")


class Ends(NamedTuple):
    """Where a window may end: places after `pattern`, or before it, near its full length."""

    pattern: re.Pattern
    after: bool
    slack: int


BLANK_ENDS = Ends(re.compile(r"\s"), False, 100)
SENTENCE_ENDS = Ends(re.compile(r"[.!?\n]"), True, 100)


def windows(text: str, size: int, overlap: int, ends: Ends, reach: int, beyond: int) -> list[str]:
    """Overlapping slices; each end is looked up among the sorted places of the pattern.

    An end moves back by less than `reach`; windows go on until one ends `beyond` past the text.
    """
    places = [m.end() if ends.after else m.start() for m in ends.pattern.finditer(text)]

    def end_of(start: int) -> int:
        full = start + size
        if full >= len(text):
            return full
        latest = full + ends.after
        at = bisect_right(places, latest)
        return places[at - 1] if at and places[at - 1] > latest - min(reach, ends.slack) else full

    bounds = [(0, end_of(0))] if text else []
    while bounds and bounds[-1][1] < len(text) + beyond:
        start = max(bounds[-1][0] + 1, bounds[-1][1] - overlap)
        if start >= len(text):
            break
        bounds.append((start, end_of(start)))
    return [c for c in (text[i:j].strip() for i, j in bounds) if c]


def by_characters(text: str, size: int, overlap: int) -> list[str]:
    return windows(text, size, overlap, BLANK_ENDS, size - size // 2, 0)


def packed(pieces: list[str], glue: str, size: int, overlap: int, split: Callable[[str, int, int], list[str]]) -> list[str]:
    """Chunks of whole pieces; running lengths tell how many fit behind the tail of the chunk before.

    A first piece longer than a chunk is split; later ones stay whole.
    """
    if not pieces:
        return []
    sums = [0, *accumulate(len(p) + len(glue) for p in pieces)]
    *chunks, head = [pieces[0]] if sums[1] <= size else split(pieces[0], size, overlap)
    used = 1
    while True:
        fit = max(used, bisect_right(sums, sums[used] + size - len(head)) - 1)
        whole = glue.join([head, *pieces[used:fit]])
        chunks.append(whole.strip())
        if fit == len(pieces):
            return [c for c in chunks if c]
        tail = [whole[-overlap:]] if 0 < overlap < len(whole) else []
        head, used = glue.join([*tail, pieces[fit]]), fit + 1


def by_sentences(text: str, size: int, overlap: int) -> list[str]:
    *closed, rest = (p.strip() for p in SENTENCE_BREAK.split(text))
    if not closed:
        return by_characters(text, size, overlap)
    return packed([p + ". " for p in closed if p] + [rest] * bool(rest), "", size, overlap, by_characters)


def by_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    pieces = PARAGRAPH_BREAK.split(text)
    if len(text) <= size:
        return [text] * bool(text)
    if len(pieces) == 1:
        return by_sentences(text, size, overlap)
    return packed([p.strip() for p in pieces if not p.isspace() and p], "\n\n", size, overlap, by_sentences)


def by_char_sentence(text: str, size: int, overlap: int) -> list[str]:
    """Fixed size, each end moved back to a sentence end within 100 characters."""
    return [text] if len(text) <= size else windows(text, size, overlap, SENTENCE_ENDS, size, overlap)


MODES = {"paragraph": by_paragraphs, "sentence": by_sentences, "char": by_characters, "char_sentence": by_char_sentence}


def placed_chunks(text: str | None, mode: str, size: int, overlap: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(number, how many, chunk, start, end) of a text's chunks.

    start is the first place of the chunk at or after the previous end, or that
    end itself where the packing changed the text.
    """
    pieces, pos = MODES[mode](text, size, overlap) if text else [], 0
    for i, piece in enumerate(pieces):
        found = text.find(piece, pos)
        begin = found if found >= 0 else pos
        pos = begin + len(piece)
        yield i, len(pieces), piece, begin, pos


OUT_CHARS = 2_000_000  # characters of text whose chunks a task holds before it hands them on


def chunk_frames(batches: Iterator[pd.DataFrame], key: str, text: str, mode: str, size: int, overlap: int) -> Iterator[pd.DataFrame]:
    """The chunks of all texts, handed on after every OUT_CHARS characters of text."""
    columns = [key, "chunk_index", "total_chunks", "content", "start_index", "end_index"]
    for batch in batches:
        rows, held = [], 0
        for k, t in zip(batch[key], batch[text]):
            rows += [(k, *row) for row in placed_chunks(t, mode, size, overlap)]
            held += len(t or "")
            if held >= OUT_CHARS:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def chunk_table(df: DataFrame, key: str, text: str, mode: str = "paragraph", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Rows (key, chunk_index, total_chunks, content, start_index, end_index)."""
    key_type = df.schema[key].dataType.simpleString()

    return df.select(key, text).mapInPandas(
        lambda batches: chunk_frames(batches, key, text, mode, size, overlap), f"{key} {key_type}, chunk_index long, total_chunks long, content string, start_index long, end_index long")


def with_chunk_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(tx.text_metadata(F.col("content")))


def document_chunks(df: DataFrame, key: str, text: str, model: str | None = None, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunk rows with hash and word count; the embedding is filled by a later step."""
    return chunk_table(df, key, text, "paragraph", size, overlap).select(
        F.col(key).alias("document_id"), "chunk_index", "content", F.sha2("content", 256).alias("content_hash"),
        tx.word_count(F.col("content")).alias("word_count"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(model).cast("string").alias("embedding_model"))


def split_parts(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Parts named <key>_part_<n>, whole texts keep their key."""
    rows = chunk_table(df, key, text, "char_sentence", size, overlap)
    split = F.col("total_chunks") > 1
    name = F.when(split, F.concat(F.col(key).cast("string"), F.lit("_part_"), F.col("chunk_index").cast("string"))).otherwise(F.col(key).cast("string"))
    return rows.select(key, name.alias("id"), "content", split.alias("is_split_chunk"), F.when(split, F.col("chunk_index")).alias("chunk_part"),
                       F.length("content").cast("long").alias("chunk_char_count"))
