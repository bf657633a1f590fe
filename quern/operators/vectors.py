"""Vector search: exact cosine top-k in blocks, and an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .lexical import top_k

FOUND = "question_id bigint, doc_id bigint, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", embedding: str = "embedding", max_queries: int = 50_000, where: Column | None = None) -> DataFrame:
    """(question_id, doc_id, score, rank): the k vectors of least cosine distance per query, exactly.

    queries: (question_id, embedding). They are broadcast as one matrix while there are at most `max_queries`; every
    block of vectors is multiplied with it and keeps its own k best per query, so only blocks x k rows are shuffled.
    More queries run in that many passes. A filter goes to the scan. Null, empty and zero vectors, and vectors of
    another length than the queries', are never found.
    """
    rows = queries.where("embedding is not null and size(embedding) > 0").select(F.col("question_id").cast("bigint"), "embedding")
    first = rows.agg(F.count("*").alias("n"), F.min_by(F.size("embedding"), "question_id").alias("width")).first()
    width = first["width"] or 0
    source = vectors if where is None else vectors.where(where)
    source = source.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(embedding).alias("embedding")).where(F.size("embedding") == width)
    passes = max(1, -(-first["n"] // max_queries))
    part = F.pmod(F.xxhash64("question_id"), F.lit(passes))
    asked = rows.where(F.size("embedding") == width)
    near = [_nearest(source, asked.where(part == i).collect(), width, k) for i in range(passes)]
    return top_k(reduce(DataFrame.unionByName, near), k, descending=False)


def _nearest(vectors: DataFrame, wanted: list[Row], width: int, k: int) -> DataFrame:
    """The k best of every block of vectors for one pass of queries."""
    ids = [r["question_id"] for r in wanted]
    q = _matrix(pd.Series([r["embedding"] for r in wanted])) if ids else np.zeros((0, width))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, asked = shared.value
        for b in batches:
            if not len(b) or not names:
                continue
            m = _matrix(b["embedding"])
            used = np.abs(m).sum(axis=1) > 0
            m, docs = m[used], b["doc_id"].to_numpy()[used]
            distance = 1 - m @ asked.T
            keep = min(k, len(docs))
            if not keep:
                continue
            # ties at the border stay: the window below decides them by id
            edge = np.partition(distance, keep - 1, axis=0)[keep - 1]
            at = np.nonzero(distance <= edge + 1e-9)
            yield pd.DataFrame({"question_id": np.asarray(names)[at[1]], "doc_id": docs[at[0]], "score": distance[at]})

    return vectors.mapInPandas(blocks, FOUND)


def fit_centroids(vectors: DataFrame, n_lists: int, embedding: str = "embedding", sample_rows: int = 100_000, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Spherical k-means centroids of a bounded sample (at most `sample_rows` rows, by hash of the vector)."""
    sample = vectors.where(F.size(embedding) > 0).select(embedding).orderBy(F.xxhash64(F.col(embedding).cast("string"), F.lit(seed))).limit(sample_rows).toPandas()[embedding]
    if not len(sample):
        return np.zeros((0, 0))
    m = _matrix(sample)
    rng = np.random.default_rng(seed)
    c = m[rng.choice(len(m), size=min(n_lists, len(m)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(m @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                v = m[near == j].sum(axis=0)
                c[j] = v / (np.linalg.norm(v) or 1)
    return c


def build_ivf(vectors: DataFrame, centroids: np.ndarray, doc_id: str = "doc_id", embedding: str = "embedding") -> DataFrame:
    """(doc_id, embedding, list_no): every row, under its nearest centroid. Write it partitioned by list_no."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["list_no"] = np.argmax(_matrix(b["embedding"]) @ shared.value.T, axis=1)
                yield b

    source = vectors.where(F.size(embedding) > 0).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(embedding).alias("embedding"))
    return source.mapInPandas(assign, "doc_id bigint, embedding array<float>, list_no int")


def ivf_topk(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Top-k over the `probes` nearest lists of each query; the other lists are pruned before the vectors are read."""
    asked = queries.where("size(embedding) > 0").select("question_id", "embedding").collect()
    if not asked:
        return index.sparkSession.createDataFrame([], FOUND + ", rank int")
    near = np.argsort(-(_matrix(pd.Series([r["embedding"] for r in asked])) @ centroids.T), axis=1)[:, :probes]
    pairs = [(int(r["question_id"]), int(j), [float(x) for x in r["embedding"]]) for r, row in zip(asked, near) for j in row]
    probe = index.sparkSession.createDataFrame(pairs, "question_id bigint, list_no int, query array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = index.join(F.broadcast(probe), "list_no").select(
        "question_id", "doc_id", (1 - dot(F.col("embedding"), F.col("query")) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("query"), F.col("query"))))).alias("score")
    )
    return top_k(scored, k, descending=False)


def hashed_vectors(postings: DataFrame, width: int = 64) -> DataFrame:
    """Deterministic embedding: (doc_id, embedding) of term frequencies by the first byte of each term's MD5, normalised."""
    digit = lambda i: F.when(F.ascii(F.substring("_h", i, 1)) < 58, F.ascii(F.substring("_h", i, 1)) - 48).otherwise(F.ascii(F.substring("_h", i, 1)) - 87)
    postings = postings.withColumn("_h", F.substring(F.md5("term"), 1, 2))
    slot = (digit(1) * 16 + digit(2)) % width
    sums = postings.groupBy("doc_id", slot.alias("slot")).agg(F.sum("tf").cast("double").alias("v"))
    cells = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return cells.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float")).alias("embedding"))
