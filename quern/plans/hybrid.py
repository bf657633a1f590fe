"""Hybrid retrieval over a question batch as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import STRATEGIES, STRATEGY_SCHEMA, classify_questions, route, rrf_fuse
from ..operators.lexical import bm25_scores, postings, top_k
from ..operators.vectors import cosine_topk, hashed_vectors

FILTER = [c.split()[0] for c in STRATEGY_SCHEMA.split(", ")].index("doc_type_filter")


def hybrid_topk(
    docs: DataFrame,
    questions: DataFrame,
    n_results: int = 10,
    use_bm25: bool = True,
    use_semantic: bool = True,
    use_routing: bool = True,
    doc_vectors: DataFrame | None = None,
    question_vectors: DataFrame | None = None,
    doc_types: DataFrame | None = None,
) -> DataFrame:
    """(question_id, doc_id, score, rank): questions classified, routed, searched in both indexes and fused.

    docs: (doc_id, text); questions: (question_id, question). The flags are Python constants: a branch that is off is
    never planned. Without vectors both sides are embedded by hashed term frequencies. doc_types (doc_id, doc_type) are
    only needed where a strategy filters by type: the vector search of its questions then sees ids of that type alone.
    """
    asked = classify_questions(questions).withColumnRenamed("predicted_type", "question_type") if use_routing else questions.withColumn("question_type", F.lit(None).cast("string"))
    routed = route(asked, "question_type").select("question_id", "question", "semantic_k", "bm25_k", "doc_type_filter", "semantic_weight", "bm25_weight")
    depth = 15
    lists = []
    post = postings(docs, "doc_id", "text")
    if use_semantic:
        dv = hashed_vectors(post) if doc_vectors is None else doc_vectors
        qv = hashed_vectors(postings(questions, "question_id", "question")).withColumnRenamed("doc_id", "question_id") if question_vectors is None else question_vectors
        near = _nearest(dv, qv, routed, doc_types, depth)
        lists.append(near.join(F.broadcast(routed), "question_id").where("rank <= semantic_k").select("question_id", F.lit(1).alias("list_no"), "rank", "doc_id", F.col("semantic_weight").alias("weight"), "doc_type_filter"))
    if use_bm25:
        lexical = top_k(bm25_scores(docs, questions, post=post), depth)
        lists.append(lexical.join(F.broadcast(routed), "question_id").where("rank <= bm25_k").select("question_id", F.lit(2).alias("list_no"), "rank", "doc_id", F.col("bm25_weight").alias("weight"), "doc_type_filter"))
    ranked = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = rrf_fuse(ranked.select("question_id", "list_no", "rank", "doc_id", "weight"))
    return fused.where(F.col("rank") <= n_results)


def _nearest(vectors: DataFrame, asked: DataFrame, routed: DataFrame, doc_types: DataFrame | None, depth: int) -> DataFrame:
    """Vector search, one branch per filter of the strategies: the filter comes before the cut to the nearest."""
    if doc_types is None:
        return cosine_topk(vectors, asked, depth)
    filters = sorted({s[FILTER] for s in STRATEGIES if s[FILTER] is not None})
    typed = vectors.join(doc_types, "doc_id")
    by_filter = asked.join(routed.select("question_id", "doc_type_filter"), "question_id")
    found = [cosine_topk(vectors, by_filter.where("doc_type_filter is null").drop("doc_type_filter"), depth)]
    found += [cosine_topk(typed, by_filter.where(F.col("doc_type_filter") == f).drop("doc_type_filter"), depth, where=F.col("doc_type") == f) for f in filters]
    return reduce(DataFrame.unionByName, found)
