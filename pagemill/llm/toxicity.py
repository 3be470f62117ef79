"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). Terms are whole words,
the five-letter runs of words longer than that, and the two- and three-letter runs of words
in scripts written without blanks, over their whole length. x is the scaled square root of a
term's share of the words, so one marked word in twelve weighs the same in short and long
texts; without blanks two letters count as a word. Terms are learned whose mean differs
clearly between the labels, and terms of pairs whose common presence does, whether or not
either term differs on its own; the pairs looked at are those of the PAIRED commonest terms
below a presence in half of the sampled texts.

The machine is fitted on a bounded, key-hashed sample of labelled rows (`per_class` rows
of each label at most); scoring reads every whole text, in Arrow batches.

Defined results: a null or text without words scores as the bias alone. Rows with a null
label or a label other than 0 and 1 teach nothing. Without both labels to learn from, every
score is the share of label 1 among the labelled rows (0 without any). Repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import folded_words

RUN = 5  # letters of the runs of longer words
DENSE = (2, 3)  # letters of the runs in scripts without blanks
SCALE = 100.0
PAIRED = 2_000  # terms whose pairs are tested


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def without_blanks(letter: str) -> bool:
    """Thai to Khmer, and CJK with kana and Hangul."""
    return "\u0e00" <= letter <= "\u0eff" or "\u1000" <= letter <= "\u109f" or "\u1780" <= letter <= "\u17ff" or letter >= "\u2e80"


@lru_cache(1 << 16)
def word_terms(word: bytes) -> tuple[tuple[int, ...], int]:
    """Hashes of a word's terms, and how many words it counts as."""
    if word.isascii():
        runs = [zlib.crc32(word[i:i + RUN], RUN) for i in range(len(word) - RUN + 1)] if len(word) > RUN else ()
        return (zlib.crc32(word), *runs), 1
    letters = word.decode("utf-8", "surrogatepass")
    dense = any(map(without_blanks, letters))
    terms = [zlib.crc32(word)]
    for size in DENSE if dense else (RUN,) if len(letters) > RUN else ():
        terms += [zlib.crc32(letters[i:i + size].encode("utf-8", "surrogatepass"), size) for i in range(len(letters) - size + 1)]
    return tuple(terms), max(1, len(letters) // 2) if dense else 1


def hashed_terms(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (distinct) and values of a text's terms."""
    counts = Counter(folded_words(text))
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    flat: list[int] = []
    lens, total = [], 0
    for (terms, size), n in zip(map(word_terms, counts), counts.values(), strict=True):
        flat += terms
        lens.append(len(terms))
        total += size * n
    ids, at = np.unique(np.array(flat, np.int64) & ((1 << bits) - 1), return_inverse=True)
    n = np.fromiter(counts.values(), np.int64, len(counts))
    return ids, np.sqrt(np.bincount(at, np.repeat(n, lens)) * (SCALE / max(1, total))).astype(np.float32)


def raw_scores(ids: np.ndarray, values: np.ndarray, starts: np.ndarray, m: Machine) -> np.ndarray:
    """Values before the sigmoid of texts laid end to end; text t owns starts[t]:starts[t+1]."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    out = m.bias + np.bincount(owner, m.weights[ids] * values, n)
    for f in range(m.factors.shape[1]):
        part = m.factors[ids, f] * values
        out += 0.5 * (np.bincount(owner, part, n) ** 2 - np.bincount(owner, part * part, n))
    return out


def telling(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, min_texts: int, min_t: float) -> np.ndarray:
    """Buckets whose mean value differs between the labels by `min_t` standard errors.

    The error is that of equal means, so a term absent from one label is not held to its
    own spread there. The rest would only let the machine learn single texts by heart.
    """
    n, sums, squares, met = [], [], np.zeros(size), np.zeros(size, np.int64)
    for y in (0, 1):
        own = [t for t, of in zip(texts, labels, strict=True) if of == y]
        n.append(max(1, len(own)))
        sums.append(np.zeros(size))
        for ids, x in own:
            sums[y][ids] += x
            squares[ids] += x * x
            met[ids] += 1
    mean = [sums[y] / n[y] for y in (0, 1)]
    spread = np.maximum(0, squares / sum(n) - ((sums[0] + sums[1]) / sum(n)) ** 2)
    error = np.sqrt(spread * (1 / n[0] + 1 / n[1]) + 1e-12)
    return (met >= min_texts) & (np.abs(mean[1] - mean[0]) >= min_t * error)


def telling_pairs(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, min_texts: int, min_t: float) -> np.ndarray:
    """Buckets of pairs whose common presence differs between the labels by `min_t` standard errors.

    Two matrix products of text by term count all pairs of the PAIRED commonest terms.
    """
    met = np.zeros(size, np.int64)
    for ids, _ in texts:
        met[ids] += 1
    usable = np.flatnonzero((met >= min_texts) & (met <= len(texts) / 2))
    chosen = np.sort(usable[np.argsort(-met[usable], kind="stable")[:PAIRED]])
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    both, n = [], []
    for y in (0, 1):
        own = [t for (t, _), of in zip(texts, labels, strict=True) if of == y]
        held = np.zeros((len(own), len(chosen)), np.float32)
        for r, ids in enumerate(own):
            held[r, place[ids[place[ids] >= 0]]] = 1
        both.append(held.T @ held)
        n.append(max(1, len(own)))
    rate = (both[0] + both[1]) / sum(n)
    error = np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]) + 1e-12)
    strong = (both[0] + both[1] >= min_texts) & (np.abs(both[1] / n[1] - both[0] / n[0]) >= min_t * error)
    np.fill_diagonal(strong, False)
    out = np.zeros(size, bool)
    out[chosen[strong.any(0)]] = True
    return out


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, factors: int,
          epochs: int, rate: float, l2: float, min_texts: int, min_t: float, min_pair_t: float = 7.0, seed: int = 7) -> Machine:
    """AdaGrad over small batches of the log loss; both labels weigh the same in total."""
    rng, size = np.random.default_rng(seed), 1 << bits
    seen = telling(texts, labels, size, min_texts, min_t) | telling_pairs(texts, labels, size, 2 * min_texts, min_pair_t)
    texts = [(i[seen[i]], x[seen[i]]) for i, x in texts]
    w, v, bias = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, factors)).astype(np.float32), 0.0
    gw, gv, gb = np.full(size, 1e-4, np.float32), np.full((size, factors), 1e-4, np.float32), 1e-4
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            batch = order[lo:lo + 32]
            lens = [len(texts[t][0]) for t in batch]
            ids, x = (np.concatenate([texts[t][c] for t in batch]) for c in (0, 1))
            if not len(ids):
                continue
            owner = np.repeat(np.arange(len(batch)), lens)
            used, at = np.unique(ids, return_inverse=True)
            vx = v[ids] * x[:, None]
            sums = np.stack([np.bincount(owner, vx[:, f], len(batch)) for f in range(factors)], 1)
            squares = np.bincount(owner, (vx * vx).sum(1), len(batch))
            raw = bias + np.bincount(owner, w[ids] * x, len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            gx = g[owner] * x
            dw = np.bincount(at, gx, len(used)) + l2 * w[used]
            gw[used] += dw**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            for f in range(factors):
                dv = np.bincount(at, gx * (sums[owner, f] - vx[:, f]), len(used)) + l2 * v[used, f]
                gv[used, f] += dv**2
                v[used, f] -= rate * dv / np.sqrt(gv[used, f])
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
    v[~seen] = 0
    return Machine(float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = 3000, bits: int = 17, factors: int = 4, epochs: int = 10, rate: float = 0.1, l2: float = 1e-3,
        min_texts: int = 5, min_t: float = 3.5) -> Machine:
    """Fits on labelled rows that satisfy `usable`, at most `per_class` per label.

    The sample is the rows of smallest key hash, chosen on (key, label) alone; its keys,
    at most 2 * per_class, are broadcast, and terms are hashed on the executors.
    """
    known = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_y"))
    known = known.groupBy(key).agg(F.max("_y").alias("_y"))
    drawn = [known.filter(F.col("_y") == y).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(per_class) for y in (0, 1)]
    picked = docs.select(key, F.col(text).alias("_t")).join(F.broadcast(drawn[0].unionByName(drawn[1])), key)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [hashed_terms(t, bits) for t in batch["_t"]]
            yield pd.DataFrame({"k": batch[key].astype(str), "y": batch["_y"], "i": [p[0].astype(np.int32) for p in pairs], "x": [p[1] for p in pairs]})

    rows = picked.mapInPandas(terms, "k string, y int, i array<int>, x array<float>").toPandas()
    rows = rows.sort_values("k", kind="stable").groupby("k", sort=False).head(1)
    y = rows["y"].to_numpy(np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Machine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors), np.float32))
    texts = [(np.asarray(i, np.int32), np.asarray(x, np.float32)) for i, x in zip(rows["i"], rows["x"], strict=True)]
    del rows
    return train(texts, y, bits, factors, epochs, rate, l2, min_texts, min_t)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; one pass, no shuffle."""
    bits = len(machine.weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, out, texts = Machine(*shared.value), [], batch.column(1)
            for lo in range(0, len(texts), 256):
                pairs = [hashed_terms(t, bits) for t in texts.slice(lo, 256).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in pairs])])
                raw = raw_scores(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), starts, m)
                out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(scored, f"`{key}` {kind}, score double")
