"""Spelling variant grouping by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point just where their common
prefix and suffix together reach the longer length minus one. Such a pair whose longer word
has m code points therefore shares the first ceil(m / 2) of them or the last floor(m / 2):
each word is sent to those two groups for m = its length and m = its length plus one. In a
group that is too large to compare densely the same holds for the part between the shared
ends, so it is split in two by longer ends, until one code point is left between them; a
group of that kind has at most one word for each letter of the alphabet and one more.

Groups beyond GROUP words are split by Spark, rounds of counting and dealing anew; smaller
ones are split inside their task down to TILE words. The words of a task's groups stand in
two padded code-point matrices, aligned at their starts and at their ends; blocks of rows
are compared with the blocks d rows below, so a tile costs its pairs of words in array
operations and only near pairs leave it. A pair is kept in one group alone: the second half
of a split takes only pairs whose prefix the first half cannot hold.

A word's form is its most frequent near word, where that is frequent enough; forms lead to
ever more frequent words, so the chain to the root has at most log(ratio) steps, followed
by doubling.

Defined results: a null text has no runs; a null key counts as an empty text in the hash of
the slips; repeated rows count each; ties go to the smaller word in code-point order.
Columns other than key and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, stored

RUN = "[A-Za-zÀ-ÿ]"
KEPT = 300_000  # words that a task counts before it sends them on
GROUP = 50_000  # words of a group that one task splits by itself
TILE = 64  # words of a group that are compared densely
BATCH = 40_000  # rows that a task compares at once, beyond a group's own
CELLS = 1 << 23  # code points of one comparison
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)
GROUPED = "group long, m int, head int, tail int, below int, word string, n long"


def word_counts(docs: DataFrame, key: str, text: str, min_length: int, min_count: int, slip: int) -> DataFrame:
    """(word, n) of all words; in every slip-th run by its hash with the key one code point is lost."""
    runs = re.compile(f"{RUN}{{{min_length},}}").findall

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for run, times in Counter(runs(value.as_py() or "")).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(word.encode(), start)
                    if slip and h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    counts[word] += times
                if len(counts) > KEPT:
                    yield sent()
        yield sent()

    parts = docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def padded(words: list[str], width: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, aligned at the start and at the end, zeros elsewhere."""
    left = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    left = left.astype(np.min_scalar_type(int(left.max(initial=0))))
    places = np.arange(width) - (width - sizes)[:, None]
    return left, np.where(places >= 0, np.take_along_axis(left, np.maximum(places, 0), 1), 0)


def marks(left: np.ndarray) -> np.ndarray:
    """Hash of the first j code points of each row in column j."""
    out = np.zeros((len(left), left.shape[1] + 1), np.uint64)
    for j in range(left.shape[1]):
        out[:, j + 1] = (out[:, j] ^ (left[:, j].astype(np.uint64) + np.uint64(1))) * _STEP
        out[:, j + 1] ^= out[:, j + 1] >> np.uint64(29)
    return out


def group_of(starts: np.ndarray, ends: np.ndarray, m: np.ndarray | int, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Number of the group of longer length m, `head` shared first and `tail` shared last code points."""
    row = np.arange(len(starts))
    with np.errstate(over="ignore"):
        mixed = (starts[row, head] * np.uint64(3) + ends[row, tail]) * _STEP
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ np.uint64(1) * np.asarray(head, np.uint64) + (np.asarray(m, np.uint64) << np.uint64(20))) * _STEP
    return mixed.view(np.int64)


def halves(m: np.ndarray, head: np.ndarray, tail: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(head, tail, below) of the two groups that take the place of a group."""
    gap = m - head - tail
    first = head + (gap + 1) // 2
    return [(first, tail, below), (head, tail + gap // 2, np.minimum(below, first))]


def dealt(m: int, words: list[str], rows: np.ndarray, n: np.ndarray, head: np.ndarray, tail: np.ndarray, below: np.ndarray) -> pa.RecordBatch:
    """The chosen rows of `words` in both halves of the groups they stand in."""
    sizes = np.array([len(w) for w in words])
    left, right = padded(words, m, sizes)
    starts, ends = marks(left)[rows], marks(right[:, ::-1])[rows]
    parts, given = [], pa.array(words, pa.string()).take(pa.array(rows))
    for h, t, b in halves(m, head, tail, below):
        columns = [group_of(starts, ends, m, h, t), np.full(len(rows), m), h, t, b]
        kinds = [pa.int64(), *[pa.int32()] * 4]
        parts.append(pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], given, pa.array(n, pa.int64())], names=["group", "m", "head", "tail", "below", "word", "n"]))
    return pa.concat_batches(parts)


def first_groups(words: DataFrame) -> DataFrame:
    """Every word in its four groups."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_pylist()
            counts, sizes = batch.column(1).to_numpy(), np.array([len(w) for w in every])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                same, none = [every[i] for i in at], np.zeros(len(at), int)
                for m in (int(size), int(size) + 1):
                    yield dealt(m, same, np.arange(len(at)), counts[at], none, none, none + m + 1)

    return words.select("word", "n").mapInArrow(made, GROUPED)


def split_groups(rows: DataFrame) -> DataFrame:
    """Rows of too large groups, each in the two halves of its group."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m").to_numpy()
            for width in np.unique(m):
                part = batch.take(pa.array(np.flatnonzero(m == width)))
                words = part.column("word").to_pylist()
                yield dealt(int(width), words, np.arange(len(words)), *[part.column(c).to_numpy() for c in ("n", "head", "tail", "below")])

    return rows.mapInArrow(made, GROUPED)


def small_groups(words: DataFrame) -> DataFrame:
    """Words by group, no group beyond GROUP words but those that cannot be split."""
    rows = stored(first_groups(words))
    while True:
        counts = rows.filter("m - head - tail > 1").groupBy("group").agg(F.count("*").alias("size"))
        large = stored(counts.filter(F.col("size") > GROUP).select("group"))
        if large.count() == 0:
            discard(large)
            return rows
        known = F.broadcast(large)  # at most one group for every GROUP rows
        rest = rows.join(known, "group", "left_anti").unionByName(split_groups(rows.join(known, "group", "left_semi").select(*rows.columns)))
        following = stored(rest.select(*rows.columns))
        discard(rows)
        discard(large)
        rows = following


def near_rows(m: int, words: list[str], group: np.ndarray, head: np.ndarray, tail: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the near words of whole groups with longer length m, each pair once."""
    sizes = np.array([len(w) for w in words])
    left, right = padded(words, m, sizes)
    right = np.ascontiguousarray(right[:, ::-1])
    row, hashes = np.arange(len(words)), None
    while True:
        order = np.argsort(group, kind="stable")
        row, group, head, tail, below = (x[order] for x in (row, group, head, tail, below))
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if group[0] > -(1 << 63) else 0))
        many = np.diff(np.append(starts, len(group)))
        size = np.repeat(many, many)
        large = (size > TILE) & (m - head - tail > 1)
        if not large.any():
            break
        hashes = hashes or (marks(left), marks(right))
        at, rest = np.flatnonzero(large), np.flatnonzero(~large & (size > 1))
        parts = [(row[rest], group[rest], head[rest], tail[rest], below[rest])]
        for h, t, b in halves(m, head[at], tail[at], below[at]):
            parts.append((row[at], group_of(hashes[0][row[at]], hashes[1][row[at]], m, h, t), h, t, b))
        row, group, head, tail, below = (np.concatenate(x) for x in zip(*parts, strict=True))
    left_in = np.repeat(starts + many, many) - np.arange(len(row))  # rows of the group from here on
    full, a, b = sizes[row] == m, [], []
    for d in range(1, int(many.max(initial=1))):
        every = np.flatnonzero(left_in > d)
        every = every[full[every] | full[every + d]]
        step = max(1, CELLS // m)
        for lo in range(0, len(every), step):
            i = every[lo:lo + step]
            x, y = row[i], row[i + d]
            prefix, suffix = (left[x] == left[y]).argmin(1), (right[x] == right[y]).argmin(1)
            own = (head[i] == head[i + d]) & (tail[i] == tail[i + d]) & (prefix >= head[i]) & (suffix >= tail[i]) & (prefix < below[i])
            near = own & (prefix + suffix >= m - 1)
            a.append(x[near])
            b.append(y[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every two near words, both ways, of a table (word, n) of different words."""
    names = ["group", "m", "head", "tail", "below", "word", "n"]

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        width = rows["m"].to_numpy()
        for m in np.unique(width):
            part = rows.take(pa.array(np.flatnonzero(width == m)))
            a, b = near_rows(int(m), part["word"].to_pylist(), *[part[c].to_numpy() for c in ("group", "head", "tail", "below")])
            for x, y in ((a, b), (b, a)):
                out = pa.table({"word": part["word"].take(pa.array(x)), "near": part["word"].take(pa.array(y)), "near_n": part["n"].take(pa.array(y))})
                yield from out.combine_chunks().to_batches(10_000)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) < BATCH:
                continue
            rows = pa.Table.from_batches(waiting)
            group = rows["group"].to_numpy()
            cut = int(np.flatnonzero(np.append(True, group[1:] != group[:-1]))[-1])  # the last group may go on
            if cut:
                yield from compared(rows.slice(0, cut))
            waiting = rows.slice(cut).to_batches()
        if waiting:
            yield from compared(pa.Table.from_batches(waiting))

    grouped = small_groups(words).select(*names).repartition("group").sortWithinPartitions("m", "group")
    return grouped.mapInArrow(streamed, "word string, near string, near_n long")


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of a table (word, form): the last form that a word's forms lead to."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(hops, 1)))):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("end"))
        following = stored(reached.join(onward, "root", "left").select("word", F.coalesce("end", "root").alias("root")))
        reached = following
    return reached


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, ratio: int = 10, slip: int = 31) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with at least min_length code points and min_count occurrences."""
    words = stored(word_counts(docs, key, text, min_length, min_count, slip))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    kept = -F.col("best.down") >= ratio * F.col("n")
    named = stored(words.join(found, "word", "left").select(
        "word", F.when(kept, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, -F.col("best.down")).alias("form_n")))
    most = named.agg(F.max("n")).first()[0] or 1
    ends = roots(named.filter("form IS NOT NULL"), int(math.log(most) / math.log(ratio)) + 1)
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
