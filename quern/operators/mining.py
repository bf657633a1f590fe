"""Question mining: filters, best answers, dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import short_hash, strip


def newest_pairs(pairs: DataFrame) -> DataFrame:
    """Each id once: the pair mined last; ties by load time and score."""
    w = W.partitionBy("id").orderBy(F.desc("mined_at"), F.desc("loaded_at"), F.desc("answer_score"))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def curated(pairs: DataFrame, min_score: int = 5, min_length: int = 80) -> DataFrame:
    """Pairs with a high score, a long question, and no link within its first 30 characters."""
    return pairs.where((F.col("answer_score") >= min_score) & (F.length("question") >= min_length) & ~F.contains(F.substring("question", 1, 30), F.lit("https://")))


def best_answers(comments: DataFrame, min_score: int = 3) -> DataFrame:
    """The comment with most positive reactions per issue; ties go to the earlier one. comments: (repo, issue, comment_ord, body, reactions map)."""
    positive = sum((F.coalesce(F.try_element_at("reactions", F.lit(k)), F.lit(0)) for k in ("+1", "heart", "hooray", "rocket")), F.lit(0))
    scored = comments.withColumn("score", positive).where(F.col("score") >= min_score)
    w = W.partitionBy("repo", "issue").orderBy(F.desc("score"), "comment_ord")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mined_pairs(issues: DataFrame, comments: DataFrame, min_score: int = 3, min_body: int = 30) -> DataFrame:
    """(id, repo_name, question, answer, answer_score): issues with a long body and an accepted answer."""
    asked = issues.withColumn("question", strip(F.concat_ws("\n\n", "title", "body"))).where(F.length(strip(F.coalesce("body", F.lit("")))) >= min_body)
    best = best_answers(comments, min_score).select("repo", "issue", F.col("body").alias("answer"), F.col("score").alias("answer_score"))
    return asked.join(best, ["repo", "issue"]).select(short_hash(F.col("repo"), F.col("issue")).alias("id"), F.col("repo").alias("repo_name"), "question", "answer", "answer_score")


def dataset_summary(pairs: DataFrame, language: Column, kind: Column) -> DataFrame:
    """Counts by language, by question type, and in total with distinct repositories: one pass of grouping sets."""
    rows = pairs.select(language.alias("language"), kind.alias("question_type"), "repo_name", "id")
    return rows.groupingSets([["language"], ["question_type"], []], "language", "question_type").agg(
        F.grouping_id().alias("grouping"), F.countDistinct("id").alias("n_pairs"), F.countDistinct("repo_name").alias("n_repos")
    )
