"""Postings, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens

# The constants of BM25 Okapi.
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf). Null texts have no postings; the counts are combined before the shuffle."""
    # the filters that joins would infer stand here, so that every reader of the postings has the same plan below
    known = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    terms = known.select(F.col(doc_id).alias("doc_id"), F.explode(lexical_tokens(F.col(text))).alias("term")).where("term is not null")
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, dl): lexical tokens of each document; 0 for null texts."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.size(lexical_tokens(F.col(text))), F.lit(0)).alias("dl"))


def idf(n_docs: Column, df: Column) -> Column:
    """Natural logarithm of (N - n + 0.5) / (n + 0.5)."""
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def term_stats(docs: DataFrame, doc_id: str, text: str, post: DataFrame | None = None) -> DataFrame:
    """(term, df, n_docs, idf); a negative idf becomes EPSILON times the mean idf of all terms.

    All statistics of a corpus read the same postings, so Spark makes their exchange once and reuses it.
    """
    post = postings(docs, doc_id, text) if post is None else post
    # the sum keeps tf in this branch: with other columns the exchange would be another one
    df = post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("cf > 0")
    total = docs.agg(F.count("*").alias("n_docs"))
    raw = df.crossJoin(F.broadcast(total)).withColumn("raw_idf", idf(F.col("n_docs"), F.col("df")))
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    floor = F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", "n_docs", floor.alias("idf"))


def bm25_scores(docs: DataFrame, questions: DataFrame, doc_id: str = "doc_id", text: str = "text", max_questions: int = 100_000, post: DataFrame | None = None) -> DataFrame:
    """(question_id, doc_id, score) for all documents with a positive score.

    questions: (question_id, question). The distinct question terms with their weights are broadcast while there are at
    most `max_questions` questions; only postings of those terms meet them. A term counts as often as the question
    repeats it. `post` may be a stored postings table; without it the postings are made here.
    """
    post = postings(docs, doc_id, text) if post is None else post
    asked = questions.select("question_id", F.explode(lexical_tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))
    weights = asked.join(term_stats(docs, doc_id, text, post), "term").groupBy("term").agg(
        F.collect_list(F.struct("question_id", (F.col("qtf") * F.col("idf")).alias("w"))).alias("asks")
    )
    if questions.limit(max_questions + 1).count() <= max_questions:
        weights = F.broadcast(weights)
    lengths = post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    total = lengths.agg(F.sum("dl").alias("all_terms")).crossJoin(docs.agg(F.count("*").alias("n")))
    hits = post.join(weights, "term").select("doc_id", "tf", "asks").join(lengths, "doc_id").crossJoin(F.broadcast(total))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("all_terms") / F.col("n"))))
    return (
        hits.select("doc_id", gain.alias("gain"), F.explode("asks").alias("ask"))
        .groupBy(F.col("ask.question_id").alias("question_id"), "doc_id")
        .agg(F.sum(F.col("ask.w") * F.col("gain")).alias("score"))
        .where("score > 0")
    )


def top_k(scores: DataFrame, k: int, by: str = "question_id", descending: bool = True, digits: int = 9) -> DataFrame:
    """The k best per question with their rank from 1; ties by rounded score go to the smaller doc_id."""
    order = F.round("score", digits)
    w = W.partitionBy(by).orderBy(order.desc() if descending else order.asc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
