"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of the bytes of sample texts. A byte costs
-log2(count / (total + distinct)) in its longest known context; where the context has
not met the byte, the escape costs -log2(distinct / (total + distinct)) and the next
shorter context decides, down to 8 bits for a byte never met. The statistics are frozen,
so a text's code length is a sum over its bytes, and the language with the fewest bits
wins (ties: the first name).

The trees of all languages share their nodes: node numbers of order L come from a table
indexed by (node of order L-1, next byte). Costs per node and language are computed
ahead, and whole Arrow buffers are walked at once.

Defined results: a null text or one without a letter is `und` with score 0. Without any
learnable row every text is `und`. Rows with null language teach nothing. Score is the
posterior of the winner under equal priors. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
PAD = 10  # a newline stands before every text
BLOCK = 1 << 20  # bytes walked at a time
LANGUAGES = 1000  # more names than this are not languages


@dataclass(frozen=True)
class Trees:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol number; the last symbol is "never met"
    child: list[np.ndarray]  # [order]: (node of the shorter gram) * symbols + symbol -> node; last node: unknown
    cost: list[np.ndarray]  # [order][node, language]: bits of the gram's last byte after the rest
    escape: list[np.ndarray]  # [order][node, language]: bits of leaving the context that the gram is

    @property
    def width(self) -> int:
        return int(self.symbol.max()) + 1


def _walk(symbols: np.ndarray, child: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Node of the gram of length L+1 that starts at each position, for each L."""
    nodes = [symbols]
    for order in range(1, len(child)):
        last = nodes[-1][: len(symbols) - order]
        nodes.append(child[order][last.astype(np.int64) * width + symbols[order:]])
    return nodes


def build(texts: list[bytes], langs: list[str], order: int) -> Trees:
    """Counts every context up to `order` bytes in the sample and prices all known grams."""
    names = sorted(set(langs))
    data = np.concatenate([np.frombuffer(bytes([PAD]) * order + t, np.uint8) for t in texts])
    of = np.concatenate([np.full(len(t) + order, names.index(k)) for t, k in zip(texts, langs, strict=True)])
    first = np.concatenate([np.arange(len(t) + order) for t in texts])
    met = np.unique(data)
    symbol = np.full(256, len(met), np.int64)
    symbol[met] = np.arange(len(met))
    width, count = len(met) + 1, len(names)
    s = symbol[data]
    child, cost, escape = [np.zeros(0, np.int32)], [], []
    nodes, parents, sizes = s, np.zeros(len(s), np.int64), [width]
    suffix = None
    for level in range(order + 1):
        if level:
            nodes_before, n_before = nodes, sizes[-1]
            key = nodes_before[: len(s) - level] * width + s[level:]
            known, at, nodes = np.unique(key, return_index=True, return_inverse=True)
            table = np.full((n_before + 1) * width, len(known), np.int32)
            table[known] = np.arange(len(known))
            child.append(table)
            sizes.append(len(known))
            parents, suffix = known // width, nodes_before[at + 1]
        n = sizes[-1] if level else width
        # a gram counts where its last byte belongs to a text, not to the padding before it
        ends = slice(level, None)
        real = first[ends] >= max(order, level)
        flat = np.bincount(nodes[: len(s) - level][real] * count + of[ends][real], minlength=n * count)
        counts = flat.reshape(n, count).astype(np.float64)
        above = 1 if level == 0 else sizes[level - 1] if level > 1 else width
        up = np.zeros(n, np.int64) if level == 0 else parents
        total, distinct = np.zeros((above, count)), np.zeros((above, count))
        np.add.at(total, up, counts)
        np.add.at(distinct, up, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            bits = -np.log2(counts / (total + distinct)[up])
        shorter = np.full((n, count), 8.0) if level == 0 else cost[-1][suffix]
        priced = np.where(counts > 0, bits, leave[up] + shorter)
        # last row: an unknown gram, priced by its caller from the escape and a shorter gram
        cost.append(np.vstack([priced, np.zeros((1, count))]).astype(np.float32))
        escape.append(np.vstack([leave, np.zeros((1, count))]).astype(np.float32))
    return Trees(names, symbol, child, cost, escape)


def code_lengths(texts: list[bytes] | None, trees: Trees, data: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Bits of each text under each language. Texts, or their joined bytes and end offsets."""
    if texts is not None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
    order, width, n = len(trees.child) - 1, trees.width, len(ends)
    if n == 0:
        return np.zeros((0, len(trees.languages)))
    lens = np.diff(ends, prepend=0)
    moved = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * order, lens)
    symbols = np.full(len(data) + n * order, trees.symbol[PAD], np.int64)
    symbols[moved] = trees.symbol[data]
    nodes = _walk(symbols, trees.child, width)
    # position p of the walk is the gram that ends in byte p + order
    bits = trees.cost[order][nodes[order]]
    at = np.flatnonzero(nodes[order] == len(trees.cost[order]) - 1)
    for level in range(order - 1, -1, -1):
        start = at + (order - 1 - level)  # the context: a gram of length level + 1
        bits[at] += trees.escape[level + 1][nodes[level][start]]
        shorter = nodes[level][start + 1]
        bits[at] += trees.cost[level][shorter]
        at = at[shorter == len(trees.cost[level]) - 1] if level else at[shorter == width - 1]
    if len(at):
        bits[at] += trees.escape[0][0] + 8.0 - trees.cost[0][width - 1]
    starts = np.concatenate([[0], ends[:-1]]) + np.arange(n) * order
    sums = np.zeros((n, len(trees.languages)))
    filled = lens > 0
    pads = (starts[1:, None] - order + np.arange(order)).ravel()
    bits[pads[pads >= 0]] = 0
    if filled.any():
        sums[filled] = np.add.reduceat(bits, starts[filled], axis=0, dtype=np.float64)
    return sums


def fit(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = 250, order: int = 3) -> Trees | None:
    """Trees from at most `per_language` whole texts of each language, those of smallest
    key hash. The sample's keys are chosen on (key, language) alone and broadcast: there are
    `per_language` for each language at most."""
    known = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    known = known.select(key, F.col(lang).cast("string").alias("_l")).distinct()
    # the share of each language's keys that is ranked keeps its window at about twice the sample
    counts = known.groupBy("_l").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for row in counts for x in (row["_l"], min(1.0, 2 * per_language / row["count"]))])
    hashed = F.xxhash64(F.col(key).cast("string"))
    ranked = known.filter(F.pmod(hashed, F.lit(1 << 20)) < F.ceil(shares[F.col("_l")] * (1 << 20)))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy(hashed, key))
    drawn = ranked.withColumn("_r", rank).filter(F.col("_r") <= per_language).drop("_r")
    same = [F.col("d._k") == F.col("s._k"), F.col("d._l") == F.col("s._l")]
    pairs = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).cast("string").alias("_l")).alias("d")
    drawn = F.broadcast(drawn.select(F.col(key).alias("_k"), "_l")).alias("s")
    rows = pairs.join(drawn, same[0] & same[1], "left_semi").toPandas().sort_values(["_l", "_k", "_t"], kind="stable")
    rows = rows[rows["_t"].str.len() > 0]
    if rows.empty:
        return None
    return build([t.encode("utf-8", "surrogatepass") for t in rows["_t"]], list(rows["_l"]), order)


def predict(docs: DataFrame, trees: Trees | None, key: list[str], text: str = "text") -> DataFrame:
    """The `key` columns with lang_pred, score and bits_per_byte; one pass, no shuffle."""
    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    if trees is None:
        return docs.select(*key, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast((trees.languages, trees.symbol, trees.child, trees.cost, trees.escape))
    given = docs.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_t"), letters.alias("_letters"))
    wanted = given.select(*key).schema

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trees(*shared.value)
        names = np.array(t.languages)
        for batch in batches:
            whole = batch.column(len(key)).cast(pa.large_string())
            sums, lens = [], []
            edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset: whole.offset + len(whole) + 1]
            data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
            lo = 0
            while lo < len(whole):
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BLOCK, "right")) - 1)
                sums.append(code_lengths(None, t, data[edges[lo]:edges[hi]], edges[lo + 1:hi + 1] - edges[lo]))
                lens.append(np.diff(edges[lo:hi + 1]))
                lo = hi
            if not sums:
                continue
            bits, size = np.concatenate(sums), np.concatenate(lens)
            best = bits.argmin(1)
            least = bits[np.arange(len(bits)), best]
            sure = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
            has = np.asarray(batch.column(len(key) + 1))
            cols = [pa.array(np.where(has, names[best], UNDETERMINED)), pa.array(np.where(has, sure, 0.0)), pa.array(least / np.maximum(size, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *cols], names=[*key, "lang_pred", "score", "bits_per_byte"])

    out = wanted.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return given.mapInArrow(predicted, out)
