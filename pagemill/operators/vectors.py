"""Embeddings and similarity: exact scans, filtered and bulk search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import scale


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Offline default: signed feature hashing of the lower-case words."""
    def encode(texts: list[str]) -> np.ndarray:
        split = [text.lower().split() for text in texts]
        words = [w.encode("utf-8") for own in split for w in own]
        h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        cells = np.repeat(np.arange(len(texts)), [len(own) for own in split]) * dim + h % dim
        return np.bincount(cells, np.where((h >> 16) & 1, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim)

    return encode


def embed(df: DataFrame, key: str, text: str, load_encoder: Callable[[], Callable] = hashing_encoder, dim: int = 64,
          batch: int = 32, normalize: bool = True, max_chars: int | None = None) -> DataFrame:
    """(key, embedding, error): the encoder is loaded once per task and sees batches.

    Blank text is an error; a failing batch gives zero vectors. max_chars cuts for
    encoders with an input limit; by default the whole text is encoded.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder()
        for frame in frames:
            texts = [t if max_chars is None or len(t or "") <= max_chars else t[:max_chars] + "..." for t in frame[text]]
            vectors = np.zeros((len(texts), dim), dtype=np.float64)
            errors: list[str | None] = [None if t and t.strip() else "empty text" for t in texts]
            for i in range(0, len(texts), batch):
                rows = [j for j in range(i, min(i + batch, len(texts))) if errors[j] is None]
                if not rows:
                    continue
                try:
                    vectors[rows] = encode([texts[j] for j in rows])
                except Exception as e:  # noqa: BLE001
                    for j in rows:
                        errors[j] = f"encoder failed: {e}"
            if normalize:
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
            yield pd.DataFrame({key: frame[key], "embedding": list(vectors.astype(np.float32)), "error": errors})

    return df.select(key, text).mapInPandas(run, f"{key} {key_type}, embedding array<float>, error string")


def text_key(text: Column, model: str) -> Column:
    return F.concat(F.sha2(text, 256), F.lit(":"), F.lit(model))


def unseen_texts(df: DataFrame, text: str, store: DataFrame, model: str) -> DataFrame:
    """One row per text whose key is not in store(text_key); copies are encoded once."""
    keyed = df.select(text_key(F.col(text), model).alias("text_key"), F.col(text).alias("text"))
    first = keyed.groupBy("text_key").agg(F.min("text").alias("text"))
    return first.join(store.select("text_key").distinct(), "text_key", "left_anti")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def similarity_to(vector: Column, query: list[float], normalize: bool = True) -> Column:
    """Cosine (or plain inner product) against one constant vector: a matrix
    product per Arrow batch, the vector travelling with the task."""
    q = np.array(query, dtype=np.float64)
    size = float(np.linalg.norm(q)) if normalize else 1.0

    @F.pandas_udf(T.DoubleType())
    def score(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=float)
        m = np.vstack(batch.to_numpy()).astype(np.float64)
        norm = np.linalg.norm(m, axis=1) * size if normalize else np.ones(len(m))
        return pd.Series(np.divide(m @ q, norm, out=np.zeros(len(m)), where=norm > 0))

    return score(vector)


def vector_of(df: DataFrame, key: str, value, vector: str = "embedding") -> list[float]:
    """The one stored vector of a key: a point lookup of a single row."""
    row = df.filter(F.col(key) == value).select(vector).first()
    if row is None:
        raise KeyError(f"no row with {key} = {value}")
    return list(row[0])


def top_k(df: DataFrame, key: str, query: list[float], k: int = 5, vector: str = "embedding", where: Column | None = None,
          threshold: float | None = None, inner_product: bool = False) -> DataFrame:
    """Metadata filter, best k by similarity, then the threshold; ranks keep the
    places held before the threshold. The scan keeps k rows per task."""
    rows = df if where is None else df.filter(where)
    score = similarity_to(F.col(vector), query, normalize=not inner_product)
    best = rows.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)
    # at most k rows are left, so gathering them for their ranks is bounded
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("id")))).alias("l"))
    ranked = listed.select(F.posexplode("l").alias("pos", "r")).select(F.col("r.id").alias(key), F.round(-F.col("r.s"), 6).alias("score"), (F.col("pos") + 1).cast("long").alias("rank"))
    return ranked if threshold is None else ranked.filter(F.col("score") >= threshold)


def unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Matrix of equally long vectors, each divided by its length; zero vectors stay zero."""
    m = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best_of(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores of each row, ties to the smaller order."""
    k = min(k, scores.shape[1])
    if k == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    rows, columns = np.nonzero(scores >= edge[:, None])
    by = np.lexsort((order[columns], -scores[rows, columns], rows))
    rows, columns = rows[by], columns[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


SCORES = 1 << 21  # scores that are held at once


def best_by_slices(rows: int, columns: int, k: int, scores: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, column numbers and scores of the k best of each row, ties to the smaller
    column; scores() gives a slice of the rows, few enough to hold."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, SCORES // max(1, columns))
    for at in range(0, rows if columns else 0, step):
        own = scores(slice(at, at + step))
        r, c = best_of(own, np.arange(columns), k)
        found.append((r + at, c, own[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


def bulk_top_k(corpus: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 5, vector: str = "embedding", block: int = 2048, part: int = 8192) -> DataFrame:
    """Best k corpus rows for each query, by cosine: a join of blocks as matrix products.

    Queries and corpus are dealt by key hash into blocks of about `block` and `part` rows;
    each pair of blocks meets in one task group as one product and lets k rows per query
    out. The plan is the same for any number of queries, and no vector passes the driver.
    Rows without a vector take no part; a corpus key and a query key are each given once.
    """
    key_type, query_type = corpus.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    queries, corpus = queries.filter(F.col(vector).isNotNull()), corpus.filter(F.col(vector).isNotNull())
    blocks, parts = max(1, -(-queries.count() // block)), max(1, -(-corpus.count() // part))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("qv"), dealt(query_key, blocks).alias("qb"), every(parts).alias("qp"))
    held = corpus.select(F.col(key).alias("c"), F.col(vector).alias("cv"), dealt(key, parts).alias("cp"), every(blocks).alias("cb"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("c")
        a, b = (unit_rows(t[c]) if len(t) else np.zeros((0, 1)) for t, c in ((left, "qv"), (right, "cv")))
        rows, columns, scores = best_by_slices(len(left), len(right), k, lambda s: a[s] @ b.T)
        return pa.table({query_key: left["q"].take(pa.array(rows)), key: right["c"].take(pa.array(columns)), "score": pa.array(scores, pa.float64())})

    found = asked.groupBy("qb", "qp").cogroup(held.groupBy("cb", "cp")).applyInArrow(product, f"{query_key} {query_type}, {key} {key_type}, score double")
    return scale.top_n_per_key(found, [query_key], [F.col("score").desc(), F.col(key)], k)


def add_documents(store: DataFrame, batch: DataFrame, key: str, source: str, stamp: str) -> DataFrame:
    """Batch rows with default metadata and ids appended to the store."""
    ready = batch.withColumns({key: F.coalesce(F.col(key).cast("string"), F.sha2(F.to_json("embedding"), 256)), "source": F.coalesce("source", F.lit(source)),
                               "added_at": F.coalesce("added_at", F.lit(stamp))})
    return store.withColumn(key, F.col(key).cast("string")).unionByName(ready)


def update_rows(store: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Given fields overwritten where a change names the key."""
    renamed = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = store.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in store.columns])


def delete_rows(store: DataFrame, keys: DataFrame | None = None, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    out = store if keys is None else store.join(keys.select(key).distinct(), key, "left_anti")
    return out if where is None else out.filter(~F.coalesce(where, F.lit(False)))


def collection_stats(df: DataFrame, label: str) -> DataFrame:
    """Row count and number of distinct labels of the whole collection."""
    per = df.groupBy(label).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count(label).alias("labels"))
